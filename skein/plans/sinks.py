"""Output formats and nested inputs over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.graphs import _GEO, geo_edges
from skein.plans.registry import query
from skein.session import table
from skein.sources import writers as W


@query(f"WITH {_GEO} SELECT '<urn:' || src || '> <urn:reads> <urn:' || dst || '> <urn:geo> .' AS quad FROM geo")
def quads_export(spark: SparkSession, d: str) -> DataFrame:
    return W.edge_quads(geo_edges(spark, d), "geo", prefix="urn:")


@query(f"WITH {_GEO} SELECT '    ' || replace(src, ':', '_') || ' -->|reads| ' || replace(dst, ':', '_') AS line FROM geo UNION ALL SELECT 'flowchart TD'")
def mermaid_export(spark: SparkSession, d: str) -> DataFrame:
    return W.mermaid(geo_edges(spark, d))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(
    f"""WITH {_GEO}, b AS (SELECT src, dst FROM geo WHERE dst <> 'r:1' UNION ALL SELECT 'r:1', 'r:0'), node AS (SELECT 1)
    SELECT '    ' || replace(src, ':', '_') || ' -.->|- reads| ' || replace(dst, ':', '_') AS line FROM geo WHERE dst = 'r:1'
    UNION ALL SELECT '    ' || replace(src, ':', '_') || ' -->|reads| ' || replace(dst, ':', '_') FROM geo WHERE dst <> 'r:1'
    UNION ALL SELECT '    r_1 -.->|+ reads| r_0' UNION ALL SELECT 'flowchart TD'"""
)
def mermaid_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two graphs in one chart: edges into one region are gone, one edge is new."""
    geo = geo_edges(spark, d)
    new = spark.createDataFrame([("r:1", "r:0", 1)], "src string, dst string, types int")
    return W.mermaid_diff(geo, geo.where("dst <> 'r:1'").unionByName(new))


@query(f"WITH {_GEO} SELECT src, src || ' -> ' || string_agg(dst || ' (reads)', '; ' ORDER BY dst) AS line FROM geo GROUP BY src")
def outline_export(spark: SparkSession, d: str) -> DataFrame:
    return W.outline(geo_edges(spark, d))


@query("SELECT 'nations' AS query, CAST(n_regionkey AS VARCHAR) AS key, count(*) AS rows FROM nation GROUP BY n_regionkey")
def summary_export(spark: SparkSession, d: str) -> DataFrame:
    return W.summary("nations", table(spark, d, "nation"), "n_regionkey")


@query(
    """WITH s AS (SELECT 's' || s_suppkey AS file_id, s_suppkey AS k FROM supplier)
    SELECT file_id, line, CASE line WHEN 3 THEN '  x <- ' || k WHEN 4 THEN '  y <- x * 2 + 1' WHEN 12 THEN '- total <- 0' ELSE '- system(name)' END AS text FROM s, (VALUES (3), (4), (12), (27)) t(line)"""
)
def slice_diff_export(spark: SparkSession, d: str) -> DataFrame:
    """A file's lines against a slice of it: some kept, some dropped."""
    from skein.plans.analysis import program

    p = program(spark, d, "suppliers")
    return W.slice_diff(p.files, p.lines(p.slice("4@y")), color=False).where("line in (3, 4, 12, 27)")


@query("SELECT 's' || s_suppkey AS file_id, '    binop-rhs: RNumber ' || s_suppkey AS text FROM supplier UNION ALL SELECT 's' || s_suppkey, '  expr-list-child: RBinaryOp <-' FROM supplier")
def tree_export(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the third line's assignment, as indented text."""
    from skein.plans.analysis import program

    p = program(spark, d, "suppliers")
    return W.tree(p.nodes.where("sl = 3 and type in ('RBinaryOp', 'RNumber')")).select("file_id", "text")


@query(
    """WITH s AS (SELECT 's' || s_suppkey AS f, s_suppkey AS k FROM supplier) SELECT '<urn:' || f || '> <urn:lexeme> "' || k || '" <urn:tree> .' AS quad FROM s
    UNION ALL SELECT '<urn:' || f || '> <urn:type> "RNumber" <urn:tree> .' FROM s"""
)
def tree_quads(spark: SparkSession, d: str) -> DataFrame:
    """A node's fields as n-quads."""
    from skein.plans.analysis import program

    p = program(spark, d, "suppliers")
    return W.row_quads(p.nodes.where("sl = 3 and type = 'RNumber'").select("file_id", "type", "lexeme"), "file_id", "tree", prefix="urn:")
