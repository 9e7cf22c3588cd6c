"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Sources in code-point order, null last, have the weights 5, 2, 1, repeating, and share the words of all documents. A
target stops at `most` times its source's words; the excess goes to the others by weight until none is above.

The rates nearest to 1 in relative entropy that meet a source's target are exponentially tilted by the document's size,
rate = min(most, exp(l * size / mean size)), with one multiplier l for each source, the solution of the convex dual. As
rates depend on source and size only, the dual is summed over counted (source, size) pairs; safeguarded Newton steps
for all sources run as one job each.

Rates become whole copies: floor(rate), and one more for the documents whose seeded hash lies most below their rate's
fraction, as many as the source's target has room for, and for a few more that fill the rest. That cut is found by two histograms
of fixed size and an order within the last bin, so no source is ever sorted in one task.

Defined cases: a null text has size 0 and is taken 0 times; null sources form one source, the last; an empty table
gives an empty result; rows without doc_id are told apart by their texts; repeated rows are documents of their own, told
apart by nothing, so equal rows end on the same side of the cut. Columns but doc_id, text and source are ignored by mixed() and kept by expanded().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import WORD
from skein.storage import discard, stored

WEIGHTS = (5, 2, 1)
#: Bins of each histogram of the cut.
BINS = 4096
#: Documents beyond the cut that may fill what it leaves open.
FILLS = 5


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, mark (a hash of the text, which tells rows without doc_id apart)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("mark"))


def targets(of_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target. One row for each source goes in; targets are min(most * size, level * weight).

    The level comes from running sums over the sources by most * size / weight: it is the level of the first source
    that, with all before it at their limits, does not reach its own.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    rows = of_source.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("source_size") * most
    up = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = rows.withColumn("ratio", limit / F.col("weight"))
    rows = rows.withColumn("below", F.sum(limit).over(up) - limit).withColumn("rest", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("own", (F.sum("source_size").over(whole) - F.col("below")) / F.col("rest"))
    level = F.min(F.when(F.col("own") <= F.col("ratio"), F.struct("ratio", "own"))).over(whole)["own"]
    return rows.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("ratio") <= F.col("level"), limit.cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def multipliers(counted: DataFrame, aims: DataFrame, most: int = 3, steps: int = 60, near: float = 1e-9) -> DataFrame:
    """source, scale, l: the dual's solution for each source, by Newton steps kept inside a shrinking bracket.

    counted: source, size, n; aims: source, target, source_size. A source whose target is its limit has l at the upper end of the bracket,
    where all its rates are `most`.
    """
    shape = counted.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    now = aims.join(shape, on(aims, shape)).select(aims["source"], "target", "source_size", "scale", (F.log(F.lit(float(most))) * F.col("scale") / F.col("least") + 1).alias("high"))
    now = now.withColumn("low", F.lit(-700.0)).withColumn("off", F.lit(1.0))
    limit = most * F.col("source_size") * (1 - 1e-12)
    now = now.withColumn("l", F.when(F.col("target") >= limit, F.col("high")).otherwise(F.log(F.greatest("target", F.lit(1e-9)) / F.col("source_size"))))
    now = stored(now, "dual")
    for _ in range(steps):
        tilt = F.col("l") * F.col("size") / F.col("scale")
        free = tilt < F.log(F.lit(float(most)))
        rate = F.when(free, F.exp(F.greatest(tilt, F.lit(-700.0)))).otherwise(F.lit(float(most)))
        words = F.col("n") * F.col("size")
        of = counted.where("size > 0").withColumnRenamed("source", "s").join(now, F.col("s").eqNullSafe(F.col("source")))
        got = of.groupBy("source").agg(F.sum(words * rate).alias("sum"), F.sum(F.when(free, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")).withColumnRenamed("source", "s")
        step = now.join(got, F.col("source").eqNullSafe(F.col("s")))
        gap = F.col("sum") - F.col("target")
        step = step.withColumn("low", F.when(gap < 0, F.col("l")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("l")).otherwise(F.col("high")))
        newton = F.col("l") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.when(F.col("low") <= -700, F.least(F.col("l") * 2, F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        moved = F.when(off <= near, F.col("l")).when(inside, newton).otherwise(F.greatest(middle, F.lit(-700.0)))
        after = stored(step.select("source", "target", "source_size", "scale", "high", "low", moved.alias("l"), off.alias("off")), "dual")
        discard(now)
        now = after
        if (off := now.agg(F.max("off")).first()[0] or 0.0) <= near:
            break
    if off > 1e-6:
        raise RuntimeError(f"the dual did not settle: a source is off its target by a share of {off}")
    # sums of doubles depend on their order in the last digits; reruns have to agree
    return now.select("source", "scale", F.round("l", 10).alias("l"))


def _rate(most: int) -> Column:
    """The tilted rate of a row that knows its source's scale and l; within rounding of a whole number, that number."""
    tilt = F.greatest(F.col("l") * F.col("size") / F.col("scale"), F.lit(-700.0))
    rate = F.when(F.col("size") == 0, 0.0).when(tilt >= F.log(F.lit(float(most))), float(most)).otherwise(F.exp(tilt))
    return F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)


def _rated(rows: DataFrame, known: DataFrame, most: int, seed: int) -> DataFrame:
    """rows (doc_id, source, size and any others) with base, open and key: open rows may get one copy more than base,
    those with the least keys first; 0 < key < 1. known has one row for each source, s."""
    out = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate(most)).withColumn("base", F.floor("rate"))
    hashed = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(1 << 40)) / float(1 << 40)
    return out.withColumn("key", (hashed - (F.col("rate") - F.col("base")) + 1) / 2).withColumn("open", F.col("base") < F.ceil("rate"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 42) -> DataFrame:
    """One row for each source: s, source_size, target, scale, l, cut, picks - all that copies() needs."""
    counted = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counted")
    of_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = stored(targets(of_source, weights, most), "aims")
    dual = multipliers(counted, aims, most).withColumnRenamed("source", "s")
    known = aims.join(dual, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "scale", "l")
    known = stored(known, "known")
    rows = _rated(sized, known, most, seed).where("open")
    cut = _filled(rows, _cut(rows, _short(_rated(sized, known, most, seed))))
    return stored(known.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"), "plan")


def _short(rows: DataFrame) -> DataFrame:
    """source, short: the words that whole copies leave open."""
    return rows.groupBy("source").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("short"))


def _cut(rows: DataFrame, short: DataFrame) -> DataFrame:
    """source, cut, short: all open rows with keys below cut get a copy more; short words are still open then, fewer
    than the rows at the cut have."""
    spans = stored(short.select("source", "short", F.lit(0.0).alias("from"), F.lit(1.0).alias("width")), "spans")
    free = rows.select(F.col("source").alias("s"), "key", "size")
    for _ in range(2):
        inside = free.join(spans, F.col("s").eqNullSafe(F.col("source")))
        inside = inside.withColumn("bin", F.floor((F.col("key") - F.col("from")) / F.col("width") * BINS)).where(F.col("bin").between(0, BINS - 1))
        bins = inside.groupBy("source", "short", "from", "width", "bin").agg(F.sum("size").alias("size"))
        up = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("before", F.sum("size").over(up) - F.col("size"))
        hit = bins.where("before <= short").groupBy("source").agg(F.max(F.struct("bin", "before", "short", "from", "width")).alias("x"))
        left, start = F.col("x.short") - F.col("x.before"), F.col("x.from") + F.col("x.bin") * F.col("x.width") / BINS
        spans = stored(hit.select("source", left.alias("short"), start.alias("from"), (F.col("x.width") / BINS).alias("width")), "spans")
    last = free.join(spans, F.col("s").eqNullSafe(F.col("source")))
    last = last.where(F.floor((F.col("key") - F.col("from")) / F.col("width")) == 0)
    last = last.groupBy("source", "short", "key").agg(F.sum("size").alias("size"))
    up = Window.partitionBy("source").orderBy("key")
    last = last.withColumn("before", F.sum("size").over(up) - F.col("size")).where("before <= short")
    end = last.groupBy("source").agg(F.max(F.struct("key", "before", "short")).alias("x"))
    return end.select("source", F.col("x.key").alias("cut"), (F.col("x.short") - F.col("x.before")).alias("short"))


def _filled(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """source, cut, picks: the keys of at most FILLS rows beyond the cut that get a copy more too. Each is the longest
    that fits what is still open; the last one may be longer, where that comes nearer."""
    now = stored(cut.withColumn("picks", F.array().cast("array<double>")), "fill")
    free = rows.select(F.col("source").alias("s"), "key", "size")
    for i in range(FILLS):
        far = F.col("short") * 2 if i == FILLS - 1 else F.col("short")
        fits = (F.col("key") >= F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= far) & ~F.array_contains("picks", F.col("key"))
        near = F.struct(-F.abs(F.col("size") - F.col("short")), "key", "size")
        got = free.join(now, F.col("s").eqNullSafe(F.col("source"))).where(fits).groupBy("s").agg(F.max(near).alias("x"))
        step = now.join(got, F.col("s").eqNullSafe(F.col("source")), "left")
        more = F.when(F.col("x").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("x.key")))
        now = stored(step.select("source", "cut", (F.col("short") - F.coalesce("x.size", F.lit(0))).alias("short"), more.alias("picks")), "fill")
    return now.select("source", "cut", "picks")


def copies(rows: DataFrame, known: DataFrame, most: int = 3, seed: int = 42) -> DataFrame:
    """rows with source_size, target and copies, by the sources' table of plan() - small, so no row moves."""
    extra = F.col("open") & ((F.col("key") < F.col("cut")) | F.array_contains("picks", F.col("key")))
    out = _rated(rows, known, most, seed).withColumn("copies", F.col("base") + F.coalesce(extra.cast("long"), F.lit(0)))
    return out.select(*rows.columns, "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each document."""
    sized = stored(sizes(docs), "sized")
    out = copies(sized, plan(sized, weights, most, seed), most, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def expanded(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' own columns."""
    known = plan(stored(sizes(docs), "sized"), weights, most, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = sizes_of(docs.select(row.alias("_row"))).select("doc_id", "source", "size", "mark", "_row")
    out = copies(rows, known, most, seed).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select("_row.*")


def sizes_of(rows: DataFrame) -> DataFrame:
    """rows of one struct _row, with the columns of sizes() beside it."""
    size = F.coalesce(F.regexp_count("_row.text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("_row.source").cast("string").alias("source")
    return rows.select("_row", F.col("_row.doc_id").alias("doc_id"), source, size.alias("size"), F.xxhash64("_row.text").alias("mark"))
