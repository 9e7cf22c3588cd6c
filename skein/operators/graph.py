"""Property graphs as edge tables (src, dst, types) and vertex tables (id, ...), and operators on them.

`types` is a bit mask, so several edges between two vertices are one row. Fixpoints are semi-naive: each round joins only
the rows that the round before found, is anti-joined with everything found so far, and stored, so plans stay small and a
lost executor costs nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.storage import discard, stored

#: The bits of edge types.
READS, DEFINED_BY, CALLS, RETURNS, DEFINES_ON_CALL, DEFINED_BY_ON_CALL, ARGUMENT, SIDE_EFFECT, NSE = (1 << i for i in range(9))
FLOW, CONTROL = 4096, 8192
NAMES = {
    "reads": READS, "defined-by": DEFINED_BY, "calls": CALLS, "returns": RETURNS, "defines-on-call": DEFINES_ON_CALL,
    "defined-by-on-call": DEFINED_BY_ON_CALL, "argument": ARGUMENT, "side-effect-on-call": SIDE_EFFECT,
    "non-standard-evaluation": NSE, "flow": FLOW, "control": CONTROL,
}
#: Tables of a fixpoint's findings that are read one by one before they are stored as one.
COMPACT = 8
#: Data edges that a backward walk follows; others need conditions of their own.
FOLLOWED = READS | DEFINED_BY | ARGUMENT | CALLS | RETURNS


def includes(types: Column, mask: int, every: bool = False) -> Column:
    """Whether types has any (or every) bit of mask."""
    got = types.bitwiseAND(F.lit(mask))
    return got == mask if every else got != 0


def type_names(types: Column) -> Column:
    """The names of the set bits, in the order of the bits."""
    return F.filter(F.array(*[F.when(includes(types, bit), F.lit(name)) for name, bit in NAMES.items()]), lambda x: x.isNotNull())


def merged(*edges: DataFrame) -> DataFrame:
    """The union of edge tables: masks of the same pair are OR-ed, self-edges dropped."""
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.where("src <> dst").groupBy("src", "dst").agg(F.bit_or("types").alias("types"))


def without_types(edges: DataFrame, mask: int) -> DataFrame:
    """Edges with the bits of mask deleted; edges without any bit left go."""
    return edges.withColumn("types", F.col("types").bitwiseAND(F.lit(~mask))).where("types <> 0")


def without_vertices(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of the ids."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    return edges.join(gone, F.col("src") == F.col("_id"), "left_anti").join(gone, F.col("dst") == F.col("_id"), "left_anti")


def induced(edges: DataFrame, ids: DataFrame, dangling: bool = False) -> DataFrame:
    """Edges between the ids; with dangling, all that start at one of them."""
    kept = ids.select(F.col("id").alias("_id")).distinct()
    out = edges.join(kept, F.col("src") == F.col("_id"), "left_semi")
    return out if dangling else out.join(kept, F.col("dst") == F.col("_id"), "left_semi")


def inverted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in; one aggregation, so each edge end is shuffled once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def closure(edges: DataFrame, seeds: DataFrame, backward: bool = False, within: DataFrame | None = None) -> DataFrame:
    """The ids that the seeds reach, and the fewest steps: (id, depth), seeds at depth 0. More columns of the seeds (a
    root, say) are part of the state, so many searches run as one. `within`: ids that may be entered.

    Goes on until nothing new is found, however long the ways are. Steps are stored once, so a round neither merges nor
    scans the edges' sources again; what was found is stored round by round, and every COMPACT rounds as one table, so a
    round reads few tables however many there were.
    """
    state = seeds.columns
    extra = [c for c in state if c != "id"]
    # repeated steps do no harm: what a round finds is made distinct
    steps = (inverted(edges) if backward else edges).select("src", F.col("dst").alias("_to")).where("src <> _to")
    if within is not None:
        steps = steps.join(within.select(F.col("id").alias("_to")).distinct(), "_to", "left_semi")
    steps = stored(steps.select("src", "_to"), "steps")
    frontier = stored(seeds.distinct().withColumn("depth", F.lit(0)), "frontier")
    columns, parts, depth = frontier.columns, [frontier], 0
    while True:
        depth += 1
        found = frontier.join(steps, F.col("id") == F.col("src")).select(*extra, F.col("_to").alias("id")).distinct()
        found = found.join(reduce(DataFrame.unionByName, parts).select(*state), state, "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(found.select(*columns), "frontier")
        if frontier.isEmpty():
            discard(frontier, steps)
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)
        if len(parts) > COMPACT:
            whole = stored(reduce(DataFrame.unionByName, parts[:-1]), "visited")
            discard(*parts[:-1])
            parts = [whole, frontier]


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `reached`: whether a way of at least one step leads from a to b."""
    roots = pairs.select(F.col("a").alias("root")).distinct()
    first = roots.join(edges, F.col("root") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
    found = closure(edges, first).select(F.col("root").alias("a"), F.col("id").alias("b"), F.lit(True).alias("reached"))
    return pairs.join(found, ["a", "b"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def dice(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """Ids on the ways from start to end: what end reaches backward, searched forward from start within that."""
    back = stored(closure(edges, end, backward=True).select("id").distinct(), "dice")
    begin = start.join(back, "id", "left_semi")
    return closure(edges, begin, within=back).select("id").distinct()


def provenance(edges: DataFrame, ids: DataFrame, mask: int = FOLLOWED) -> DataFrame:
    """Ids that the given ones come from, along data edges of the mask."""
    return closure(edges.where(includes(F.col("types"), mask)), ids).select("id").distinct()


def provenance_graph(edges: DataFrame, ids: DataFrame, mask: int = FOLLOWED) -> DataFrame:
    return induced(edges.where(includes(F.col("types"), mask)), provenance(edges, ids, mask))


def static_slice(vertices: DataFrame, edges: DataFrame, criteria: DataFrame, forward: bool = False) -> DataFrame:
    """The slice for the criteria (id): ids in it.

    Reads, definitions, arguments and calls are always followed and non-standard evaluation never. An edge that holds
    only on a call (defines or is defined there) is followed once two different vertices of the slice ask for its
    target. Vertices of the slice bring in what controls them: `vertices` may have cds, array<string>.
    """
    edges = inverted(edges) if forward else edges
    edges = stored(edges.where(~includes(F.col("types"), NSE)).select("src", "dst", "types"), "edges")
    always = edges.where(includes(F.col("types"), FOLLOWED | SIDE_EFFECT)).select("src", "dst")
    if "cds" in vertices.columns and not forward:
        always = always.union(vertices.select(F.col("id").alias("src"), F.explode("cds").alias("dst")))
    twice = edges.where(includes(F.col("types"), DEFINES_ON_CALL | DEFINED_BY_ON_CALL) & ~includes(F.col("types"), FOLLOWED | SIDE_EFFECT)).select("src", "dst")
    known = stored(closure(always, criteria.select("id")).select("id").distinct(), "slice")
    if twice.isEmpty():
        return known
    while True:
        asked = twice.join(known.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("dst").agg(F.countDistinct("src").alias("n")).where("n >= 2")
        more = stored(asked.select(F.col("dst").alias("id")).join(known, "id", "left_anti"), "slice")
        if more.isEmpty():
            return known
        known = stored(known.union(closure(always, more).select("id")).distinct(), "slice")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id of the edges with the smallest id that it is connected with, whatever the directions.

    Large-star and small-star steps in turn, until the edges stand still, which takes about as many rounds as the
    logarithm of the longest way.
    """
    now = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = stored(large.join(low, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u > v").distinct(), "small")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now, large)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all vertices, single ones too, over edges that are not control alone."""
    found = components(without_types(edges, CONTROL | FLOW))
    return vertices.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG without those that a longer way replaces."""
    step = edges.select("src", "dst").distinct()
    roots = step.select(F.col("src").alias("root"), F.col("dst").alias("id")).distinct()
    two = roots.join(step.withColumnRenamed("src", "id"), "id").select("root", F.col("dst").alias("id")).distinct()
    longer = closure(step, two).select(F.col("root").alias("src"), F.col("id").alias("dst"))
    return edges.join(longer.distinct(), ["src", "dst"], "left_anti")


def recursive(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with `recursive`: whether they lie on a cycle."""
    pairs = ids.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return reaches(edges, pairs).select(F.col("a").alias("id"), F.col("reached").alias("recursive"))


def entry_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that no edge enters."""
    return vertices.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def unreachable(vertices: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Vertices that the entries do not reach: dead code."""
    return vertices.join(closure(edges, entries.select("id")).select("id").distinct(), "id", "left_anti")


def happens_before(flow: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `before`: TRUE if every way into b comes from a, NULL if some do, FALSE if none does.

    Chains without branches are one block, so rounds count branches, not vertices: a way through a block passes all of
    its vertices in order. Whether there is a way around a is searched from b backward, not entering a, for all pairs at
    once: there is one if the search comes to a block that nothing leads to.
    """
    blocks = stored(basic_blocks(flow), "blocks")
    steps = flow.select("src", "dst").join(blocks.select(F.col("id").alias("src"), F.col("block").alias("x"), F.col("place").alias("i")), "src")
    steps = steps.join(blocks.select(F.col("id").alias("dst"), F.col("block").alias("y"), F.col("place").alias("j")), "dst")
    steps = stored(steps.where("not (x = y and j = i + 1)").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct(), "steps")
    at = lambda c: blocks.select(F.col("id").alias(c), F.col("block").alias(f"_{c}"), F.col("place").alias(f"{c}_place"))
    asked = stored(pairs.select("a", "b").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left"), "asked")
    wanted = asked.where("_a is not null and _b is not null").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    some = reaches(steps, wanted)
    starts = entry_points(blocks.select(F.col("block").alias("id")).distinct(), steps)
    back = _avoiding(inverted(steps), wanted.where("a <> b").select("a", "b", F.col("b").alias("id")))
    around = back.join(starts, "id", "left_semi").select("a", "b", F.lit(True).alias("around")).distinct()
    known = some.join(around, ["a", "b"], "left").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "reached", "around")
    out = asked.join(known, ["_a", "_b"], "left")
    apart = F.when(~F.coalesce("reached", F.lit(False)), F.lit(False)).when(F.col("around").isNull(), F.lit(True))
    same = F.when(F.col("a_place") < F.col("b_place"), F.lit(True)).when(~F.coalesce("reached", F.lit(False)), F.lit(False))
    return out.select("a", "b", F.when(F.col("_a") == F.col("_b"), same).otherwise(apart).alias("before"))


def _avoiding(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """What each of the seeds (a, b, id) reaches without entering a."""
    steps = stored(steps.select("src", "dst").distinct(), "steps")
    frontier = stored(seeds.distinct(), "avoid")
    parts = [frontier]
    while True:
        found = frontier.join(steps, F.col("id") == F.col("src")).select("a", "b", F.col("dst").alias("id")).where("a <> id").distinct()
        frontier = stored(found.join(reduce(DataFrame.unionByName, parts), ["a", "b", "id"], "left_anti"), "avoid")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)
        if len(parts) > COMPACT:
            parts = [stored(reduce(DataFrame.unionByName, parts[:-1]), "avoided"), frontier]


def basic_blocks(edges: DataFrame) -> DataFrame:
    """(id, block, place): vertices of a maximal chain (each link the only way out of one and into the next) share the
    head's id; place counts from the head. A closed ring has no head: its vertices are blocks of their own.

    Heads come by pointer jumping: each round doubles how far a vertex looks back, until that is further than there are
    vertices; only rings still move then.
    """
    step = edges.select("src", "dst").distinct()
    out_one = step.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src")
    in_one = step.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    link = step.join(out_one, "src", "left_semi").join(in_one, "dst", "left_semi").where("src <> dst")
    ids = step.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    now = ids.join(link.select(F.col("dst").alias("id"), F.col("src").alias("up")), "id", "left")
    now = stored(now.select("id", F.coalesce("up", "id").alias("up"), F.col("up").isNotNull().cast("int").alias("place")), "blocks")
    for _ in range(now.count().bit_length() + 1):
        up = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        moved = now.join(up, "up").select("id", F.col("next").alias("up"), F.least(F.col("place") + F.col("more"), F.lit(1 << 30)).alias("place"), (F.col("next") != F.col("up")).alias("moved"))
        now = stored(moved, "blocks")
        if now.where("moved").isEmpty():
            break
    heads = ids.join(link.select(F.col("dst").alias("id")), "id", "left_anti").select(F.col("id").alias("up"), F.lit(True).alias("_head"))
    found = now.join(heads, "up", "left")
    return found.select("id", F.when(F.col("_head"), F.col("up")).otherwise(F.col("id")).alias("block"), F.when(F.col("_head"), F.col("place")).otherwise(0).alias("place"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges that one side has alone or with other types: src, dst, left_types, right_types."""
    a = left.select("src", "dst", F.col("types").alias("left_types"))
    b = right.select("src", "dst", F.col("types").alias("right_types"))
    return a.join(b, ["src", "dst"], "full").where(~F.col("left_types").eqNullSafe(F.col("right_types")))


def origins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, origin, kind: where a vertex's value comes from, by the types of its edges and the tag of their target."""
    kind = (
        F.when(F.col("tag") == "value", F.lit("constant"))
        .when(includes(F.col("types"), CALLS), F.lit("function-call"))
        .when(includes(F.col("types"), READS), F.lit("read-variable"))
        .when(includes(F.col("types"), DEFINED_BY), F.lit("write-variable"))
        .when(includes(F.col("types"), RETURNS), F.lit("returned"))
    )
    target = vertices.select(F.col("id").alias("dst"), "tag")
    return edges.join(target, "dst").select(F.col("src").alias("id"), F.col("dst").alias("origin"), kind.alias("kind")).where("kind is not null")
