"""Data-frame verbs over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import verbs as V
from skein.plans.registry import query
from skein.session import table


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def verb_select(spark: SparkSession, d: str) -> DataFrame:
    return V.select(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT * EXCLUDE (p_type, p_retailprice) FROM part")
def verb_select_drop(spark: SparkSession, d: str) -> DataFrame:
    return V.select(table(spark, d, "part"), drop=["p_type", "p_retailprice"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * 2 AS twice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def verb_mutate_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = V.subset(table(spark, d, "lineitem"), "l_shipdate >= timestamp '1997-01-01'", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return V.mutate(rows, net=F.col("l_extendedprice") * (1 - F.col("l_discount")), twice=F.col("net") * 2).drop("l_extendedprice", "l_discount")


@query("SELECT p_partkey, p_size * 2 AS size2 FROM part")
def verb_transmute(spark: SparkSession, d: str) -> DataFrame:
    return V.transmute(table(spark, d, "part"), p_partkey=F.col("p_partkey"), size2=F.col("p_size") * 2)


@query("SELECT p_partkey AS key, p_name AS label, upper(p_brand) AS P_BRAND FROM part")
def verb_rename(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.upper("p_brand").alias("p_brand"))
    return V.rename_with(V.rename(rows, key="p_partkey", label="p_name"), str.upper, ["p_brand"])


@query("SELECT upper(n_name) AS n_name, n_nationkey, n_regionkey FROM nation")
def verb_across(spark: SparkSession, d: str) -> DataFrame:
    return V.across(table(spark, d, "nation"), F.upper, where=lambda kind: kind == "string")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def verb_select_if(spark: SparkSession, d: str) -> DataFrame:
    return V.select_if(table(spark, d, "supplier"), lambda kind: kind in ("int", "bigint"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def verb_head(spark: SparkSession, d: str) -> DataFrame:
    return V.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, [F.col("o_totalprice").desc(), "o_orderkey"])


@query("SELECT s_suppkey FROM supplier QUALIFY row_number() OVER (ORDER BY s_suppkey DESC) > 7")
def verb_head_negative(spark: SparkSession, d: str) -> DataFrame:
    return V.head(table(spark, d, "supplier").select("s_suppkey"), -7, ["s_suppkey"])


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5")
def verb_tail(spark: SparkSession, d: str) -> DataFrame:
    return V.tail(table(spark, d, "customer").select("c_custkey"), 5, ["c_custkey"])


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1000000 OFFSET 12")
def verb_tail_negative(spark: SparkSession, d: str) -> DataFrame:
    return V.tail(table(spark, d, "customer").select("c_custkey"), -12, ["c_custkey"])


@query("SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (ORDER BY p_name, p_partkey) IN (1, 3, 500)")
def verb_slice(spark: SparkSession, d: str) -> DataFrame:
    return V.slice_rows(table(spark, d, "part").select("p_partkey", "p_name"), [1, 3, 500], ["p_name", "p_partkey"])


@query("SELECT p_partkey, p_brand, p_retailprice FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) <= 3")
def verb_slice_max(spark: SparkSession, d: str) -> DataFrame:
    return V.slice_max(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", 3, ["p_brand"])


@query("SELECT p_partkey, p_brand, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) <= 2")
def verb_slice_min(spark: SparkSession, d: str) -> DataFrame:
    return V.slice_max(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", 2, ["p_brand"], least=True)


@query("SELECT event_id FROM events QUALIFY (row_number() OVER (ORDER BY ts, event_id) - 1) % 100 = 0")
def equidistant_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.equidistant(table(spark, d, "events").select("event_id", "ts"), 100, ["ts", "event_id"]).select("event_id")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def verb_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.distinct(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, min(l_discount) AS low, max(l_tax) AS high,
    round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2"""
)
def verb_group_summarise(spark: SparkSession, d: str) -> DataFrame:
    qty = F.sum(F.col("l_quantity").cast("long"))
    return V.summarise(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), qty=qty, low=F.min("l_discount"), high=F.max("l_tax"), mean=F.round(F.avg("l_quantity"), 6))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2")
def verb_count(spark: SparkSession, d: str) -> DataFrame:
    return V.count(table(spark, d, "part"), "p_brand", "p_size")


@query("SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def verb_tally_weighted(spark: SparkSession, d: str) -> DataFrame:
    return V.count(table(spark, d, "lineitem"), "l_partkey", weight="l_linenumber")


@query("SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def verb_add_count(spark: SparkSession, d: str) -> DataFrame:
    return V.add_count(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_nationkey")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


_C = "c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"


@query(f"WITH {_C} SELECT o_orderkey, o_custkey, o_orderstatus, c_nationkey FROM o JOIN c ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return V.join(_orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"})


@query(f"WITH {_C} SELECT o_orderkey, o_custkey, o_orderstatus, c_nationkey FROM o LEFT JOIN c ON o_custkey = c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    return V.join(_orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"}, "left")


@query(f"WITH {_C} SELECT o_orderkey, c_custkey AS o_custkey, o_orderstatus, c_nationkey FROM o RIGHT JOIN c ON o_custkey = c_custkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    return V.join(_orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"}, "right")


@query(f"WITH {_C} SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, o_orderstatus, c_nationkey FROM o FULL JOIN c ON o_custkey = c_custkey")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    return V.join(_orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"}, "full")


@query("SELECT n_nationkey AS key, n_name AS \"name.x\", r_name AS \"name.y\", n_regionkey AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(spark: SparkSession, d: str) -> DataFrame:
    """Common names make the key; other common names get suffixes."""
    n = V.set_names(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "key", "name", "region")
    r = V.set_names(table(spark, d, "region").select("r_regionkey", "r_name"), "region", "name")
    return V.join(n, r, ["region"])


@query("SELECT a.r_name AS one, b.r_name AS two FROM region a CROSS JOIN region b")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    return V.join(r.select(F.col("r_name").alias("one")), r.select(F.col("r_name").alias("two")), [])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return V.join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 300000"), {"c_custkey": "o_custkey"}, "semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return V.join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}, "anti")


@query(
    """SELECT r_regionkey, len(l) AS n, list_sort(list_transform(l, lambda x: x))[1] AS first_nation
    FROM (SELECT r_regionkey, list(n_name) AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)"""
)
def join_nest(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select("r_regionkey")
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return V.nest_join(r, n, ["r_regionkey"]).select("r_regionkey", F.size("nested").cast("long").alias("n"), F.col("nested")[0]["n_name"].alias("first_nation"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def bind_rows(spark: SparkSession, d: str) -> DataFrame:
    n = V.set_names(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "key", "name", "region")
    return V.bind_rows(n, V.set_names(table(spark, d, "region").select("r_regionkey", "r_name"), "key", "name"))


@query(
    """SELECT a.p_partkey, b.s_suppkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS i FROM part) a
    JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS i FROM supplier) b USING (i)"""
)
def bind_cols(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    return V.bind_cols(p, s, ["p_name", "p_partkey"], ["s_name", "s_suppkey"]).select("p_partkey", "s_suppkey")


def _stock(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))
    new = table(spark, d, "part").where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return old, new


_STOCK = """old AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part WHERE p_partkey % 2 = 0),
    new AS (SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 3 = 0)"""


@query(f"WITH {_STOCK} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN o.p_size ELSE n.p_size END AS p_size FROM old o FULL JOIN new n USING (p_partkey)")
def rows_upsert(spark: SparkSession, d: str) -> DataFrame:
    return V.rows_upsert(*_stock(spark, d), ["p_partkey"])


@query(f"WITH {_STOCK} SELECT o.p_partkey, coalesce(o.p_size, n.p_size) AS p_size FROM old o LEFT JOIN new n USING (p_partkey)")
def rows_patch(spark: SparkSession, d: str) -> DataFrame:
    return V.rows_update(*_stock(spark, d), ["p_partkey"], patch=True)


@query(f"WITH {_STOCK} SELECT * FROM old UNION ALL SELECT * FROM new WHERE p_partkey NOT IN (SELECT p_partkey FROM old)")
def rows_insert(spark: SparkSession, d: str) -> DataFrame:
    return V.rows_insert(*_stock(spark, d), ["p_partkey"])


@query(f"WITH {_STOCK} SELECT * FROM old WHERE p_partkey NOT IN (SELECT p_partkey FROM new)")
def rows_delete(spark: SparkSession, d: str) -> DataFrame:
    return V.rows_delete(*_stock(spark, d), ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_tax']) AS name, unnest([l_quantity, l_tax]) AS value FROM lineitem")
def pivot_longer(spark: SparkSession, d: str) -> DataFrame:
    return V.pivot_longer(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def pivot_wider(spark: SparkSession, d: str) -> DataFrame:
    out = V.pivot_wider(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", F.count(F.lit(1)), ["O", "F"])
    return V.replace_na(out, O=0, F=0)


@query("SELECT s_suppkey, unnest(['s_nationkey', 's_acctbal']) AS variable, unnest([CAST(s_nationkey AS DOUBLE), s_acctbal]) AS value FROM supplier")
def verb_melt(spark: SparkSession, d: str) -> DataFrame:
    return V.melt(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal"), ["s_suppkey"])


@query("SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS place FROM customer")
def verb_unite(spark: SparkSession, d: str) -> DataFrame:
    return V.unite(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "place", "c_mktsegment", "c_nationkey", sep="/")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS code, nullif(split_part(o_orderpriority, '-', 2), '') AS word FROM orders")
def verb_separate(spark: SparkSession, d: str) -> DataFrame:
    return V.separate(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["code", "word"], "-")


@query("SELECT p_partkey, substr(p_brand, 1, 5) AS head, substr(p_brand, 6, 3) AS rest FROM part")
def verb_separate_at(spark: SparkSession, d: str) -> DataFrame:
    return V.separate_at(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", {"head": 5, "rest": 3})


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def verb_replace_na(spark: SparkSession, d: str) -> DataFrame:
    out = V.join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "left")
    return V.replace_na(out, quality=-1)


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def verb_drop_na(spark: SparkSession, d: str) -> DataFrame:
    out = V.join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "left")
    return V.drop_na(out, "quality")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS value FROM events)
    SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM e"""
)
def verb_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return V.fill(e, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query("SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median FROM events")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return V.rolling_median(table(spark, d, "events"), "value", 2, ["ts", "event_id"], ["user_id"]).select("event_id", "median")


@query(
    """SELECT p_brand, min(p_size) AS min, max(p_size) AS max, CAST(median(p_size) AS DOUBLE) AS median, round(avg(p_size), 6) AS mean,
    round(stddev_pop(p_size), 6) AS std, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1"""
)
def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = V.statistics(table(spark, d, "part"), "p_size", ["p_brand"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").intersect(table(spark, d, "lineitem").where("l_quantity > 49").select("l_orderkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 45")
def set_minus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_discount > 0.05 and l_quantity > 45").select("l_partkey"))


@query(
    """SELECT event_id, round(regr_slope(value, k) OVER w, 6) AS slope, round(regr_intercept(value, k) OVER w + regr_slope(value, k) OVER w * k, 6) AS fitted
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""
)
def rolling_line(spark: SparkSession, d: str) -> DataFrame:
    """A line through each event's neighbours."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return V.rolling_line(e, "k", "value", 3, ["ts", "event_id"], ["user_id"]).select("event_id", F.round("slope", 6).alias("slope"), F.round("fitted", 6).alias("fitted"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 10 AND l_shipdate >= o_orderdate")
def join_by_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are a large part of their order and left after it was made."""
    o = table(spark, d, "orders").withColumn("tenth", F.col("o_totalprice") / 10)
    found = V.join_by(table(spark, d, "lineitem"), o, {"l_orderkey": "o_orderkey"}, [("l_extendedprice", ">", "tenth"), ("l_shipdate", ">=", "o_orderdate")])
    return found.select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 429496729")
def verb_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the orders, the same on every run."""
    return V.sampled(table(spark, d, "orders"), 0.1, "o_orderkey").select("o_orderkey")


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, o_orderkey FROM orders) SELECT o_orderkey, n FROM r"""
)
def verb_numbered(spark: SparkSession, d: str) -> DataFrame:
    """All rows numbered in order, without a sort in one task."""
    return V.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "n").select("o_orderkey", "n")
