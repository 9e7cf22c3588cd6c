"""Searches over the lines of documents: a line is a node, its number the location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import search as Q
from skein.plans.registry import query
from skein.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "lexeme"))
    return lines.select(
        "file_id", "path", (F.col("i") + 1).alias("node_id"), "lexeme", F.when(F.length("lexeme") > 80, "long").otherwise("short").alias("type"),
        (F.col("i") + 1).alias("sl"), F.lit(1).alias("sc"), (F.col("i") + 1).alias("el"), F.greatest(F.length("lexeme"), F.lit(1)).alias("ec"),
    )


def search(spark: SparkSession, d: str) -> Q.Search:
    return Q.Search(nodes(spark, d))


_NODES = """nodes AS (
  SELECT file_id, path, i AS node_id, lexeme, CASE WHEN length(lexeme) > 80 THEN 'long' ELSE 'short' END AS type, i AS sl, 1 AS sc, i AS el,
    greatest(length(lexeme), 1) AS ec
  FROM (SELECT doc_id AS file_id, source AS path, unnest(string_split(text, chr(10))) AS lexeme, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
_KEYS = ("file_id", "node_id")


@query(f"WITH {_NODES} SELECT file_id, node_id, lexeme FROM nodes WHERE regexp_full_match(lexeme, 'The .*') AND regexp_matches(path, '^src[0-4]$')")
def search_get_regex(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).get(name="The .*", regex=True, path="^src[0-4]$").frame.select(*_KEYS, "lexeme")


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE sl = 2 AND 100 BETWEEN sc AND ec")
def search_fuzzy_range(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).loc_fuzzy(2, 100).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes QUALIFY sl = max(el) OVER (PARTITION BY file_id) - 1")
def search_negative_line(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).get(line=-2).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE sl = 3 AND (file_id = 7 OR regexp_matches(path, '^src9$')) AND sc = 1")
def search_criterion(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).filter((F.col("file_id") == 7) | Q.in_file("^src9$")).criterion("3:1", "3~1").frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE type = 'long' ORDER BY sl, sc, file_id LIMIT 1")
def search_first(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).filter(Q.kind("long")).first().frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes ORDER BY sl DESC, sc DESC, file_id DESC LIMIT 1")
def search_last(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).last().frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes ORDER BY sl, sc, file_id LIMIT 1 OFFSET 17")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).index(17).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes QUALIFY row_number() OVER (ORDER BY sl, sc, file_id) IN (1, 6, 41)")
def search_select(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).select(0, 5, 40).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes ORDER BY sl, sc, file_id LIMIT 25")
def search_take(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).take(25).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE file_id = 3 ORDER BY sl LIMIT 100000 OFFSET 4")
def search_skip(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).filter(F.col("file_id") == 3).skip(4).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE file_id = 5 ORDER BY sl LIMIT 100000 OFFSET 1")
def search_tail(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).filter(F.col("file_id") == 5).tail().frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT DISTINCT file_id, node_id FROM nodes WHERE type = 'long' OR sl = 1")
def search_unique(spark: SparkSession, d: str) -> DataFrame:
    s = search(spark, d)
    return s.filter(Q.kind("long")).merge(s.get(line=1)).unique().frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE type = 'long' UNION ALL SELECT file_id, node_id FROM nodes WHERE sl = 1")
def search_merge(spark: SparkSession, d: str) -> DataFrame:
    s = search(spark, d)
    return s.filter(Q.kind("long")).merge(s.get(line=1)).frame.select(*_KEYS)


@query(f"WITH {_NODES} SELECT file_id, node_id FROM nodes WHERE (type = 'long') <> (sl % 2 = 0) AND NOT (path = 'src1')")
def filter_bool_xor(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, d).filter(Q.one_of(Q.kind("long"), F.col("sl") % 2 == 0) & ~Q.in_file("^src1$")).frame.select(*_KEYS)


@query(
    f"""WITH {_NODES}, x AS (SELECT n.file_id, n.node_id, list_sort(list(DISTINCT l.quality)) AS marks FROM nodes n JOIN labels l ON l.doc_id = n.file_id GROUP BY 1, 2)
    SELECT n.file_id, n.node_id, CAST(x.marks[1] AS INTEGER) AS mark FROM nodes n LEFT JOIN x USING (file_id, node_id) WHERE n.sl = 1"""
)
def search_with_enrichment(spark: SparkSession, d: str) -> DataFrame:
    s = search(spark, d).get(line=1)
    marks = s.frame.select(*_KEYS).join(table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "quality"), "file_id")
    return s.with_("marks", marks, F.col("quality")).frame.select(*_KEYS, F.get("marks", F.lit(0)).alias("mark"))


@query(f"WITH {_NODES} SELECT DISTINCT n.file_id, n.node_id FROM nodes n JOIN nodes o ON o.file_id = n.file_id AND o.sl + 1 = n.sl WHERE o.type = 'long'")
def search_to_enrichment(spark: SparkSession, d: str) -> DataFrame:
    s = search(spark, d).filter(Q.kind("long"))
    return s._with(s.frame.withColumn("next", F.array(F.col("node_id") + 1))).to("next").frame.select(*_KEYS)


_FLAGS = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 6 WHEN 'error' THEN 8 ELSE 0 END"


@query(f"SELECT event_id, ({_FLAGS} & 3) <> 0 AS some, ({_FLAGS} & 3) = 3 AS every FROM events")
def filter_call_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.expr(_FLAGS).alias("props"))
    return rows.select("event_id", Q.call_props(3).alias("some"), Q.call_props(3, every=True).alias("every"))


@query(
    """SELECT p.kind, p.subkind, count(*) AS n, min(event_id) AS first FROM events JOIN (VALUES ('input', 'seen', '^(view|click)$', false),
    ('input', 'view', 'view', true), ('output', 'money', 'purch', false), ('output', 'fail', 'error', true)) p(kind, subkind, pattern, exact)
    ON CASE WHEN p.exact THEN event_type = p.pattern ELSE regexp_matches(event_type, p.pattern) END GROUP BY 1, 2"""
)
def call_context_two_layer(spark: SparkSession, d: str) -> DataFrame:
    """Calls grouped by kind and subkind of the patterns that their names match."""
    rows = [("input", "seen", "^(view|click)$", False), ("input", "view", "view", True), ("output", "money", "purch", False), ("output", "fail", "error", True)]
    patterns = spark.createDataFrame(rows, "kind string, subkind string, pattern string, exact boolean")
    found = Q.two_layers(table(spark, d, "events").select("event_id", F.col("event_type").alias("name")), patterns)
    return found.groupBy("kind", "subkind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
