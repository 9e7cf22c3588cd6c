"""Graph queries over the foreign keys of the star schema and over users' event flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import graph as G
from skein.plans.registry import query
from skein.session import table


def _id(kind: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def geo_edges(spark: SparkSession, d: str) -> DataFrame:
    """customer and supplier -> nation -> region (reads)."""
    out = [
        table(spark, d, "customer").select(_id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst")),
        table(spark, d, "supplier").select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst")),
        table(spark, d, "nation").select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst")),
    ]
    return out[0].union(out[1]).union(out[2]).withColumn("types", F.lit(G.READS))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """order -> customer (reads)."""
    return table(spark, d, "orders").select(_id("o", "o_orderkey").alias("src"), _id("c", "o_custkey").alias("dst"), F.lit(G.READS).alias("types"))


def line_edges(spark: SparkSession, d: str) -> DataFrame:
    """order -> part (argument), order -> supplier (defined-by), one for each line."""
    lines = table(spark, d, "lineitem")
    parts = lines.select(_id("o", "l_orderkey").alias("src"), _id("p", "l_partkey").alias("dst"), F.lit(G.ARGUMENT).alias("types"))
    return parts.union(lines.select(_id("o", "l_orderkey").alias("src"), _id("s", "l_suppkey").alias("dst"), F.lit(G.DEFINED_BY).alias("types")))


_GEO = """geo AS (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"""
_ORDERS = "ord AS (SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst FROM orders)"
_LINES = """lin AS (
  SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, 64 AS types FROM lineitem
  UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 2 FROM lineitem)"""


@query(
    f"""WITH RECURSIVE {_GEO}, {_ORDERS}, e AS (SELECT * FROM geo UNION ALL SELECT * FROM ord),
    r(id, depth) AS (SELECT 'r:' || r_regionkey, 0 FROM region WHERE r_regionkey = 2
      UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id),
    m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
    SELECT depth, substr(id, 1, 1) AS kind, count(*) AS n FROM m GROUP BY 1, 2"""
)
def flagship_slice(spark: SparkSession, d: str) -> DataFrame:
    """What depends on one region: a backward search over nations, customers, suppliers and orders."""
    edges = geo_edges(spark, d).unionByName(order_edges(spark, d))
    seeds = table(spark, d, "region").where("r_regionkey = 2").select(_id("r", "r_regionkey").alias("id"))
    found = G.closure(edges, seeds, backward=True)
    return found.groupBy("depth", F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {_GEO}, r(id, depth) AS (SELECT 'c:' || c_custkey, 0 FROM customer WHERE c_acctbal < 0
      UNION SELECT e.dst, r.depth + 1 FROM r JOIN geo e ON e.src = r.id)
    SELECT id, min(depth) AS depth FROM r GROUP BY id"""
)
def closure_forward(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "customer").where("c_acctbal < 0").select(_id("c", "c_custkey").alias("id"))
    return G.closure(geo_edges(spark, d), seeds)


@query(
    f"""WITH RECURSIVE {_GEO}, r(root, id, depth) AS (SELECT 'r:' || r_regionkey, 'r:' || r_regionkey, 0 FROM region
      UNION SELECT root, e.src, r.depth + 1 FROM r JOIN geo e ON e.dst = r.id)
    SELECT root, depth, count(DISTINCT id) AS n FROM r GROUP BY 1, 2"""
)
def closure_all_roots(spark: SparkSession, d: str) -> DataFrame:
    """Backward searches from all regions at once: the root is part of the state."""
    seeds = table(spark, d, "region").select(_id("r", "r_regionkey").alias("root"), _id("r", "r_regionkey").alias("id"))
    return G.closure(geo_edges(spark, d), seeds, backward=True).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {_GEO}, {_ORDERS}, e AS (SELECT * FROM geo UNION ALL SELECT * FROM ord),
    b(id) AS (SELECT 'r:1' UNION SELECT e.src FROM b JOIN e ON e.dst = b.id),
    f(id) AS (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT e.dst FROM f JOIN e ON e.src = f.id)
    SELECT id FROM b INTERSECT SELECT id FROM f"""
)
def dice(spark: SparkSession, d: str) -> DataFrame:
    """What lies between urgent orders and one region."""
    start = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(_id("o", "o_orderkey").alias("id"))
    end = table(spark, d, "region").where("r_regionkey = 1").select(_id("r", "r_regionkey").alias("id"))
    return G.dice(geo_edges(spark, d).unionByName(order_edges(spark, d)), start, end)


@query(
    f"""WITH RECURSIVE {_GEO}, {_ORDERS}, {_LINES},
    e AS (SELECT src, dst FROM geo UNION ALL SELECT src, dst FROM ord UNION ALL SELECT src, dst FROM lin WHERE types = 64),
    r(id) AS (SELECT 'o:' || o_orderkey FROM orders WHERE o_totalprice > 200000
      UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)
    SELECT substr(id, 1, 1) AS kind, count(*) AS n FROM r GROUP BY 1"""
)
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """What large orders come from, along reads and arguments, not along definitions."""
    edges = G.merged(geo_edges(spark, d), order_edges(spark, d), line_edges(spark, d))
    seeds = table(spark, d, "orders").where("o_totalprice > 200000").select(_id("o", "o_orderkey").alias("id"))
    found = G.provenance(edges, seeds, G.READS | G.ARGUMENT)
    return found.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LINES} SELECT src, dst, CAST(bit_or(types) AS INTEGER) AS types FROM lin WHERE src <> dst GROUP BY 1, 2"""
)
def edge_bit_or_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merged(line_edges(spark, d))


@query(
    f"""WITH {_LINES}, g AS (SELECT src, bit_or(types) AS types FROM lin GROUP BY 1)
    SELECT src, (types & 66) = 66 AS both_kinds, (types & 2) <> 0 AS defined FROM g"""
)
def edge_bit_filter(spark: SparkSession, d: str) -> DataFrame:
    both = line_edges(spark, d).groupBy("src").agg(F.bit_or("types").alias("types"))
    return both.select("src", G.includes(F.col("types"), G.ARGUMENT | G.DEFINED_BY, every=True).alias("both_kinds"), G.includes(F.col("types"), G.DEFINED_BY).alias("defined"))


@query(f"WITH {_LINES} SELECT src, dst, types & ~2 AS types FROM (SELECT src, dst, bit_or(types) AS types FROM lin GROUP BY 1, 2) WHERE (types & ~2) <> 0")
def edge_types_removed(spark: SparkSession, d: str) -> DataFrame:
    return G.without_types(G.merged(line_edges(spark, d)), G.DEFINED_BY)


@query(
    f"""WITH {_GEO}, v AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 3
      UNION ALL SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'r:3')
    SELECT src, dst FROM geo WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)"""
)
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nation").where("n_regionkey = 3").select(_id("n", "n_nationkey").alias("id"))
    ids = ids.union(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(_id("c", "c_custkey").alias("id")))
    ids = ids.union(table(spark, d, "region").where("r_regionkey = 3").select(_id("r", "r_regionkey").alias("id")))
    return G.induced(geo_edges(spark, d), ids).select("src", "dst")


@query(f"WITH {_GEO} SELECT dst AS src, src AS dst, 1 AS types FROM geo")
def inverted_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.inverted(geo_edges(spark, d))


@query(
    f"""WITH {_GEO} SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (
      SELECT src AS id, 1 AS o, 0 AS i FROM geo UNION ALL SELECT dst, 0, 1 FROM geo) GROUP BY id"""
)
def degree_in_out(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(geo_edges(spark, d))


@query(f"WITH {_GEO} SELECT src, dst FROM geo WHERE src NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal < 0) AND dst <> 'r:0'")
def vertices_removed(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(_id("s", "s_suppkey").alias("id")).union(spark.createDataFrame([("r:0",)], "id string"))
    return G.without_vertices(geo_edges(spark, d), gone).select("src", "dst")


_PASS = """l{n} AS (SELECT id, min(m) AS m FROM (SELECT id, m FROM l{p} UNION ALL SELECT x.a, l{p}.m FROM x JOIN l{p} ON x.b = l{p}.id) GROUP BY id)"""


@query(
    f"""WITH {_LINES}, {_ORDERS}, e AS (SELECT DISTINCT src, dst FROM lin UNION SELECT src, dst FROM ord), x AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    l0 AS (SELECT DISTINCT a AS id, a AS m FROM x), {", ".join(_PASS.format(n=i + 1, p=i) for i in range(8))}
    SELECT id, m AS component FROM l8"""
)
def components(spark: SparkSession, d: str) -> DataFrame:
    """What lines and orders connect, however far apart. The SQL passes least ids on eight times, which suffices on the
    tables given; where ends are further apart it stops short."""
    return G.components(G.merged(line_edges(spark, d), order_edges(spark, d)))


@query(
    """WITH e AS (SELECT event_type || ':' || user_id AS a, event_type || ':' || (user_id // 10 * 10) AS b FROM events), v AS (SELECT a AS id, b FROM e UNION SELECT b, b FROM e)
    SELECT id, min(id) OVER (PARTITION BY b) AS component FROM v"""
)
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Many small components, single vertices too: users of one ten, and one type of event."""
    events = table(spark, d, "events")
    at = lambda u: F.concat_ws(":", "event_type", u.cast("string"))
    edges = events.select(at(F.col("user_id")).alias("src"), at(F.floor(F.col("user_id") / 10) * 10).alias("dst"), F.lit(G.READS).alias("types"))
    return G.clusters(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), G.merged(edges))


@query(
    f"""WITH {_GEO}, e AS (SELECT src, dst FROM geo UNION ALL SELECT 'c:' || c_custkey, 'r:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT src, dst FROM e a WHERE NOT EXISTS (SELECT 1 FROM geo x JOIN geo y ON x.dst = y.src WHERE x.src = a.src AND y.dst = a.dst)"""
)
def transitive_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Shortcuts from customers to regions go, as nations lead there."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    short = c.join(n, c.c_nationkey == n.n_nationkey).select(_id("c", "c_custkey").alias("src"), _id("r", "n_regionkey").alias("dst"), F.lit(G.READS).alias("types"))
    return G.transitive_reduction(geo_edges(spark, d).unionByName(short)).select("src", "dst")


@query(
    f"""WITH {_GEO}, v AS (SELECT src AS id FROM geo UNION SELECT dst FROM geo)
    SELECT id FROM v WHERE id NOT IN (SELECT dst FROM geo)"""
)
def graph_entry_points(spark: SparkSession, d: str) -> DataFrame:
    edges = geo_edges(spark, d)
    return G.entry_points(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)


@query(
    f"""WITH {_GEO}, {_ORDERS} SELECT 'c:' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"""
)
def reachable_complement(spark: SparkSession, d: str) -> DataFrame:
    """Dead code: customers that no finished order leads to."""
    entries = table(spark, d, "orders").where("o_orderstatus = 'F'").select(_id("o", "o_orderkey").alias("id"))
    return G.unreachable(table(spark, d, "customer").select(_id("c", "c_custkey").alias("id")), order_edges(spark, d), entries)


@query(
    f"""WITH {_LINES}, a AS (SELECT src, dst, bit_or(types) AS types FROM lin GROUP BY 1, 2),
    b AS (SELECT src, dst, bit_or(types) AS types FROM (SELECT * FROM lin WHERE types = 2
      UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 1 FROM orders WHERE o_orderstatus = 'P') GROUP BY 1, 2)
    SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CAST(a.types AS INTEGER) AS left_types, CAST(b.types AS INTEGER) AS right_types
    FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst WHERE a.types IS DISTINCT FROM b.types"""
)
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    lines = line_edges(spark, d)
    open_ = table(spark, d, "orders").where("o_orderstatus = 'P'").select(_id("o", "o_orderkey").alias("src"), _id("c", "o_custkey").alias("dst"), F.lit(G.READS).alias("types"))
    return G.diff(G.merged(lines), G.merged(lines.where(F.col("types") == G.DEFINED_BY), open_))


@query(
    """SELECT 'o:' || l_orderkey AS id, 'p:' || l_partkey AS origin, 'constant' AS kind FROM lineitem WHERE l_quantity > 45
    UNION SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'write-variable' FROM lineitem WHERE l_quantity > 45"""
)
def origin_case(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 45")
    edges = lines.select(_id("o", "l_orderkey").alias("src"), F.explode(F.array(F.struct(_id("p", "l_partkey").alias("dst"), F.lit(G.READS).alias("types")), F.struct(_id("s", "l_suppkey").alias("dst"), F.lit(G.DEFINED_BY).alias("types")))).alias("e")).select("src", "e.*")
    vertices = edges.select(F.col("dst").alias("id")).distinct().withColumn("tag", F.when(F.col("id").startswith("p:"), "value").otherwise("variable-definition"))
    return G.origins(vertices, G.merged(edges))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Event types of users one after the other, as a call graph; types: how often, capped bits aside."""
    events = table(spark, d, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null").distinct().withColumn("types", F.lit(G.CALLS))


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a user leads to the user's next one."""
    events = table(spark, d, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(_id("e", "event_id").alias("src"), after.alias("n")).where("n is not null").select("src", _id("e", "n").alias("dst"))


_CALLS = """seq AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
    calls AS (SELECT DISTINCT src, dst FROM seq WHERE dst IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {_CALLS}, r(a, b) AS (SELECT src, dst FROM calls UNION SELECT r.a, c.dst FROM r JOIN calls c ON r.b = c.src)
    SELECT id, EXISTS (SELECT 1 FROM r WHERE r.a = id AND r.b = id) AS recursive FROM (SELECT DISTINCT event_type AS id FROM events)"""
)
def recursion(spark: SparkSession, d: str) -> DataFrame:
    return G.recursive(calls(spark, d), table(spark, d, "events").select(F.col("event_type").alias("id")).distinct())


@query(
    f"""WITH RECURSIVE {_CALLS}, r(a, b) AS (SELECT src, dst FROM calls WHERE src = 'signup' UNION SELECT r.a, c.dst FROM r JOIN calls c ON r.b = c.src WHERE r.b <> 'error')
    SELECT 'signup' AS call, bool_or(b = 'purchase') AND bool_or(b = 'error') AS calls_both, bool_or(b = 'purchase') OR bool_or(b = 'nothing') AS calls_any FROM r"""
)
def does_call_and_or(spark: SparkSession, d: str) -> DataFrame:
    """Whether a call leads to others, by conjunction and disjunction; errors are not followed further."""
    edges = calls(spark, d)
    first = edges.where("src = 'signup'").select(F.col("src").alias("call"), F.col("dst").alias("id"))
    found = G.closure(edges.where("src <> 'error'"), first)
    has = lambda x: F.bool_or(F.col("id") == x)
    return found.groupBy("call").agg((has("purchase") & has("error")).alias("calls_both"), (has("purchase") | has("nothing")).alias("calls_any"))


@query(
    f"""WITH RECURSIVE {_CALLS}, r(a, b) AS (SELECT src, src FROM calls UNION SELECT r.a, c.dst FROM r JOIN calls c ON r.b = c.src WHERE c.dst <> 'purchase')
    SELECT DISTINCT a AS id, b AS raises FROM r WHERE b = 'error'"""
)
def exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Calls that may end in an error on a way that no purchase catches."""
    edges = calls(spark, d)
    seeds = edges.select(F.col("src").alias("root"), F.col("src").alias("id")).distinct()
    found = G.closure(edges.where("dst <> 'purchase'"), seeds)
    return found.where("id = 'error'").select(F.col("root").alias("id"), F.col("id").alias("raises"))


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    p AS (SELECT user_id, min(i) FILTER (event_type = 'view') AS a, max(i) AS b FROM e GROUP BY 1)
    SELECT 'e:' || x.event_id AS a, 'e:' || y.event_id AS b, true AS before FROM p
    JOIN e x ON x.user_id = p.user_id AND x.i = p.a JOIN e y ON y.user_id = p.user_id AND y.i = p.b WHERE p.a < p.b"""
)
def happens_before(spark: SparkSession, d: str) -> DataFrame:
    """A user's first view always comes before the last event: flows do not branch."""
    e = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    ends = e.groupBy("user_id").agg(F.min_by(_id("e", "event_id"), F.when(F.col("event_type") == "view", F.col("i"))).alias("a"), F.max_by(_id("e", "event_id"), "i").alias("b"), F.max(F.col("event_type") == "view").alias("some"))
    return G.happens_before(flow(spark, d), ends.where("some and a <> b").select("a", "b"))


@query(
    """WITH e AS (SELECT 'e:' || event_id AS id, first_value('e:' || event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block,
      count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT id, block FROM e WHERE n > 1"""
)
def basic_blocks(spark: SparkSession, d: str) -> DataFrame:
    return G.basic_blocks(flow(spark, d)).select("id", "block")


@query(
    """SELECT 'e:' || event_id AS id FROM events QUALIFY lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
      AND lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL"""
)
def exit_points(spark: SparkSession, d: str) -> DataFrame:
    """Vertices that nothing follows."""
    edges = G.inverted(flow(spark, d))
    return G.entry_points(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)


@query(
    f"""WITH RECURSIVE {_GEO}, {_ORDERS}, e AS (SELECT src, dst FROM geo UNION ALL SELECT src, dst FROM ord),
    r(id) AS (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 490000 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id),
    asked AS (SELECT 'p:' || l_partkey AS id FROM lineitem WHERE 'o:' || l_orderkey IN (SELECT id FROM r) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2)
    SELECT id FROM r UNION SELECT id FROM asked"""
)
def static_slice(spark: SparkSession, d: str) -> DataFrame:
    """A slice for the largest urgent orders, in which parts count as definitions on call: two orders have to ask for one."""
    parts = table(spark, d, "lineitem").select(_id("o", "l_orderkey").alias("src"), _id("p", "l_partkey").alias("dst"), F.lit(G.DEFINES_ON_CALL).alias("types"))
    edges = G.merged(geo_edges(spark, d), order_edges(spark, d), parts)
    seeds = table(spark, d, "orders").where("o_orderpriority like '1%' and o_totalprice > 490000").select(_id("o", "o_orderkey").alias("id"))
    return G.static_slice(edges.select(F.col("src").alias("id")).distinct(), edges, seeds)
