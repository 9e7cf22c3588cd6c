"""Lint rules over the star schema: definitions are parts, calls are events, files are documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import lint as L
from skein.plans.registry import query
from skein.plans.searches import _NODES, nodes
from skein.session import table


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 2)")
def lint_unused_definition(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "lineitem").where("l_quantity < 2").select(F.col("l_partkey").alias("p_partkey"))
    return L.unused(table(spark, d, "part").select("p_partkey", "p_name"), reads, "p_partkey")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'finished'
    WHEN c_custkey IN (SELECT user_id FROM events) THEN 'seen' END AS reason FROM customer"""
)
def lint_undefined_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the first reason that accounts for them; none is a finding."""
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    seen = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return L.undefined(table(spark, d, "customer").select("c_custkey"), [("finished", finished), ("seen", seen)], "c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0)")
def lint_unused_import(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_discount = 0 AND l_tax = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return L.unused(table(spark, d, "supplier").select("s_suppkey"), used, "s_suppkey")


@query(
    """SELECT event_id FROM (SELECT event_id, event_type, bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE event_type = 'purchase' AND NOT coalesce(seen, false)"""
)
def lint_seeded_randomness(spark: SparkSession, d: str) -> DataFrame:
    """Purchases without an earlier signup."""
    is_a = lambda x: F.col("event_type") == x
    return L.unguarded(table(spark, d, "events"), is_a("purchase"), is_a("signup"), ["user_id"], ["ts", "event_id"]).select("event_id")


@query(
    """SELECT event_id FROM (SELECT event_id, event_type, first_value(CASE event_type WHEN 'purchase' THEN true WHEN 'signup' THEN false END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM events) WHERE event_type = 'signup' AND NOT coalesce(next, false)"""
)
def lint_unclosed_connection(spark: SparkSession, d: str) -> DataFrame:
    """Signups that no purchase follows before the next signup."""
    is_a = lambda x: F.col("event_type") == x
    return L.unclosed(table(spark, d, "events"), is_a("signup"), is_a("purchase"), ["user_id"], ["ts", "event_id"]).select("event_id")


@query(
    """WITH n AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-z]+)', 1) AS name FROM documents),
    c AS (SELECT name, CASE WHEN regexp_full_match(name, '[a-z0-9]+') THEN 'flatcase' WHEN regexp_full_match(name, '[A-Z0-9]+(_[A-Z0-9]+)*') THEN 'MACRO_CASE'
      WHEN regexp_full_match(name, '[a-z]+[a-zA-Z0-9]*') THEN 'camelCase' WHEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') THEN 'PascalCase' ELSE 'unknown' END AS casing FROM n WHERE name <> ''),
    e AS (SELECT casing FROM c WHERE casing <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, casing DESC LIMIT 1)
    SELECT name, casing, (SELECT casing FROM e) AS expected FROM c WHERE casing <> (SELECT casing FROM e)"""
)
def lint_naming(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("name")).where("name <> ''").distinct()
    return L.naming(names, "name")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(https?|ftp)://')")
def lint_network(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url").where(F.col("url").rlike("^(https?|ftp)://"))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(html, '=[\x22\x27]/[A-Z]')")
def lint_absolute_path(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an absolute path, in quotes, that begins with a capital letter."""
    return table(spark, d, "pages").where(F.col("html").rlike(r"=[\x22\x27]/[A-Z]")).select("page_id")


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b') THEN 'aws' WHEN regexp_matches(text, '\bgh[pousr]_[A-Za-z0-9]{36}') THEN 'github'
    WHEN regexp_matches(text, '\bxox[abprs]-[A-Za-z0-9-]{10,}') THEN 'slack' WHEN regexp_matches(text, '\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}') THEN 'stripe'
    WHEN regexp_matches(text, '-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----') THEN 'ssh'
    WHEN regexp_matches(text, '(?i)\b(?:passw(?:or)?d|secret|token|api[._-]?key)\s*(?:=|<-|:)\s*["''][^"'']{4,}["'']') THEN 'assigned' END AS form
    FROM documents WHERE form IS NOT NULL"""
)
def lint_credentials(spark: SparkSession, d: str) -> DataFrame:
    return L.secrets(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "form")


@query("SELECT event_id, event_type AS name, '2.0' AS since FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type = 'error'")
def lint_deprecated(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("click", "2.0"), ("error", None), ("view", "9.9")], "name string, since string")
    return L.deprecated(table(spark, d, "events").select("event_id", F.col("event_type").alias("name")), known, version=F.lit("3.1"))


@query(
    f"""WITH {_NODES}, n AS (SELECT file_id, sl, sc, el, ec, node_id FROM nodes WHERE type = 'long' UNION ALL SELECT doc_id, 1, 1, 3, 5, 0 FROM documents)
    SELECT file_id, node_id FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.file_id = a.file_id AND b.node_id <> a.node_id
      AND (b.sl, b.sc) <= (a.sl, a.sc) AND (a.el, a.ec) <= (b.el, b.ec))"""
)
def lint_outermost(spark: SparkSession, d: str) -> DataFrame:
    """Findings that no other finding of their file contains."""
    whole = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("sl"), F.lit(1).alias("sc"), F.lit(3).alias("el"), F.lit(5).alias("ec"), F.lit(0).alias("node_id"))
    found = nodes(spark, d).where("type = 'long'").select(*whole.columns).unionByName(whole)
    return L.outermost(found).select("file_id", "node_id")


@query(
    """WITH d AS (SELECT DISTINCT l_partkey AS k, l_suppkey % 4 AS id, l_returnflag = 'R' AS w FROM lineitem),
    e AS (SELECT k, id, bool_or(w) AND bool_or(NOT w) AS b FROM d GROUP BY 1, 2) SELECT k, bool_and(b) AS covered FROM e GROUP BY 1"""
)
def lint_branch_coverage(spark: SparkSession, d: str) -> DataFrame:
    deps = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 4).alias("id"), (F.col("l_returnflag") == "R").alias("when"))
    return L.every_branch(deps, ["k"])


@query(
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.param, b.param) AS param, CASE WHEN a.k IS NULL THEN 'undocumented' ELSE 'undeclared' END AS side
    FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS param FROM lineitem WHERE l_tax > 0.02) a
    FULL JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber AS param FROM lineitem WHERE l_tax < 0.06) b USING (k, param) WHERE a.k IS NULL OR b.k IS NULL"""
)
def lint_roxygen(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    rows = lambda cond: lines.where(cond).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("param")).distinct()
    return L.missing(rows("l_tax > 0.02"), rows("l_tax < 0.06"), ["k"])


@query("SELECT 'software-has-license' AS rule, 'certain' AS certainty WHERE NOT EXISTS (SELECT 1 FROM documents WHERE text = 'LICENSE')")
def lint_has_license(spark: SparkSession, d: str) -> DataFrame:
    return L.absent(table(spark, d, "documents").where("text = 'LICENSE'"), "software-has-license")


@query(
    """SELECT o_orderkey AS frame, 'c' || (o_orderkey % 8) AS "column", CAST(o_custkey % 9 AS INTEGER) AS row FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND (o_orderkey % 8 NOT IN (SELECT l_linenumber FROM lineitem WHERE l_orderkey = o_orderkey)
      OR o_custkey % 9 > (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey))"""
)
def lint_frame_access(spark: SparkSession, d: str) -> DataFrame:
    """Accesses to columns that an order's lines do not have, or to rows beyond their last."""
    schema = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.sort_array(F.collect_set(F.concat(F.lit("c"), "l_linenumber"))).alias("columns"), F.count("*").alias("rows"))
    access = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), F.concat(F.lit("c"), F.col("o_orderkey") % 8).alias("column"), (F.col("o_custkey") % 9).cast("int").alias("row"))
    return L.invalid_access(access, schema)


@query("SELECT l_orderkey, count(*) AS elements FROM lineitem GROUP BY 1 HAVING count(*) <= 1")
def lint_useless_loop(spark: SparkSession, d: str) -> DataFrame:
    loops = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("elements")).withColumn("leaves_always", F.lit(False))
    return L.useless_loops(loops).select("l_orderkey", "elements")


@query(
    """SELECT event_id AS call_id, 'k' || (CAST(json_extract(props, '$.k') AS INTEGER) % 3) AS kind FROM events
    WHERE event_type IN ('purchase', 'error') AND CAST(json_extract(props, '$.k') AS INTEGER) % 3 > 0"""
)
def lint_problematic_inputs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("name"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("k"))
    kinds = e.select("call_id", F.when(F.col("k") == 0, "const").otherwise(F.concat(F.lit("k"), "k")).alias("kind"))
    return L.problematic(e.select("call_id", "name"), kinds, ["purchase", "error"]).select("call_id", F.col("kinds")[0].alias("kind"))


@query("SELECT source AS role, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other FROM documents GROUP BY 1")
def project_role_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(F.col("source").alias("role")).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"))
