"""As-of lookups over events and orders, and package history over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import asof as A
from skein.plans.registry import query
from skein.session import table


@query(
    """SELECT event_id, last FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events) WHERE event_type = 'purchase'"""
)
def link_last_call(spark: SparkSession, d: str) -> DataFrame:
    """The last signup before each purchase of a user."""
    found = A.last_call(table(spark, d, "events"), F.col("event_type") == "signup", F.col("event_id"), ["user_id"], ["ts", "event_id"])
    return found.where("event_type = 'purchase'").select("event_id", "last")


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    l AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type = 'view' THEN i END IGNORE NULLS) OVER w AS vi,
      last_value(CASE WHEN event_type = 'error' THEN i END IGNORE NULLS) OVER w AS ei FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, CASE WHEN coalesce(ei, 0) < vi THEN CAST(v AS VARCHAR) END AS last FROM l WHERE event_type = 'purchase'"""
)
def link_last_call_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The last view before a purchase, unless an error came after it."""
    is_a = lambda x: F.col("event_type") == x
    found = A.last_call(table(spark, d, "events"), is_a("view"), F.col("event_id"), ["user_id"], ["ts", "event_id"], stop=is_a("error"))
    return found.where(is_a("purchase")).select("event_id", "last")


@query(
    """SELECT o_orderkey, e.event_id AS event FROM orders o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) e
    ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts"""
)
def join_asof_last_event(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its customer's latest event at that time."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), "o_orderdate")
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("user"), "ts").agg(F.max("event_id").alias("event_id"))
    return A.as_of(orders, events, ["user"], "o_orderdate", "ts", "event_id", "event").select("o_orderkey", "event")


_RELEASES = "rel AS (SELECT l_partkey AS pkg, l_suppkey % 5 AS a, l_linenumber AS b, l_shipdate AS released FROM lineitem)"


def releases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("pkg"), F.concat(F.col("l_suppkey") % 5, F.lit("."), "l_linenumber").alias("version"), F.col("l_shipdate").alias("released"))


@query(
    f"""WITH {_RELEASES}, days AS (SELECT DISTINCT l_partkey AS pkg, y AS date FROM lineitem, (VALUES (TIMESTAMP '1994-01-01'), (TIMESTAMP '1996-06-01'), (TIMESTAMP '1998-01-01')) t(y)),
    m AS (SELECT pkg, date, max(a * 100 + b) AS k FROM days LEFT JOIN rel USING (pkg) WHERE released <= date GROUP BY 1, 2)
    SELECT pkg, date, (k // 100) || '.' || (k % 100) AS version FROM days LEFT JOIN m USING (pkg, date)"""
)
def version_at_date(spark: SparkSession, d: str) -> DataFrame:
    r = releases(spark, d)
    days = spark.sql("select explode(array(timestamp '1994-01-01', timestamp '1996-06-01', timestamp '1998-01-01')) as date")
    return A.version_at(r, r.select("pkg").distinct().crossJoin(F.broadcast(days)))


@query(
    """SELECT o_custkey, o_orderkey, CAST(o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS delta, o_orderkey AS value FROM orders"""
)
def delta_decode_cumsum(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers coded as differences and back."""
    coded = A.encoded(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", ["o_custkey"], ["o_orderkey"])
    return A.decoded(coded, "delta", ["o_custkey"], ["o_orderkey"])


@query(
    """WITH a AS (SELECT DISTINCT l_returnflag AS flag, l_linestatus AS c, l_partkey FROM lineitem)
    SELECT flag, l_partkey FROM a GROUP BY 1, 2 HAVING count(DISTINCT c) = (SELECT count(DISTINCT c) FROM a b WHERE b.flag = a.flag)"""
)
def survivor_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Parts that lines of every status of a flag have."""
    lines = table(spark, d, "lineitem")
    allowed = lines.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("c"), "l_partkey").distinct()
    return A.survivors(allowed, "l_partkey", "c", ["flag"])


@query("SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_partkey)")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    return A.preferred(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber"), ["l_partkey"], "l_linenumber")


@query(
    """WITH e AS (SELECT p_type AS fn, p_brand AS pkg, sum(p_size) AS downloads FROM part GROUP BY 1, 2),
    o AS (SELECT fn, count(*) AS exporters, arg_max(pkg, (downloads, pkg)) AS owner FROM e GROUP BY 1)
    SELECT fn, owner, exporters FROM (SELECT DISTINCT p_type AS fn FROM part) LEFT JOIN o USING (fn)"""
)
def orphan_usage(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    exports = parts.groupBy(F.col("p_type").alias("fn"), F.col("p_brand").alias("pkg")).agg(F.sum("p_size").alias("downloads"))
    return A.sole_owner(exports, parts.select(F.col("p_type").alias("fn")).distinct())


@query(
    """SELECT o_orderkey, count(*) AS n FROM orders JOIN (SELECT s_suppkey, s_suppkey * 2000.0 AS low, s_suppkey * 2000.0 + 3000 AS high FROM supplier) r
    ON o_totalprice >= low AND o_totalprice < high GROUP BY 1"""
)
def join_range_version(spark: SparkSession, d: str) -> DataFrame:
    """Orders in price ranges."""
    r = table(spark, d, "supplier").select((F.col("s_suppkey") * 2000.0).alias("low"), (F.col("s_suppkey") * 2000.0 + 3000).alias("high"))
    found = A.in_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), r, "o_totalprice", "low", "high", 3000)
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(
    """SELECT * FROM (VALUES (1, 0, 'x'), (1, 1, 'verbose'), (1, 2, '...'), (1, 3, 'sep'), (2, 0, 'y'), (2, 1, 'x'), (2, 2, '...')) t(call_id, pos, formal)"""
)
def match_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Two calls of f(x, y, verbose, ..., sep): f(1, verb = 2, other = 3, sep = 4) and f(y = 1, 2, more = 3)."""
    args = spark.createDataFrame([(1, 0, None), (1, 1, "verb"), (1, 2, "other"), (1, 3, "sep"), (2, 0, "y"), (2, 1, None), (2, 2, "more")], "call_id int, pos int, name string")
    names = ["x", "y", "verbose", "...", "sep"]
    formals = spark.createDataFrame([(c, i, n) for c in (1, 2) for i, n in enumerate(names)], "call_id int, idx int, formal string")
    return A.match_arguments(args, formals)
