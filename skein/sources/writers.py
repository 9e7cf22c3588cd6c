"""Output formats: n-quads, mermaid, SARIF, annotations, text edits. All are projections; df.write does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import type_names


def _iri(text: Column, prefix: str) -> Column:
    return F.concat(F.lit("<" + prefix), text, F.lit(">"))


def _literal(text: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return F.concat(F.lit('"'), text, F.lit('"'))


def edge_quads(edges: DataFrame, context: str, prefix: str = "urn:") -> DataFrame:
    """One n-quad for each type of each edge."""
    rows = edges.select("src", "dst", F.explode(type_names(F.col("types"))).alias("type"))
    return rows.select(F.concat_ws(" ", _iri(F.col("src"), prefix), _iri(F.col("type"), prefix), _iri(F.col("dst"), prefix), _iri(F.lit(context), prefix), F.lit(".")).alias("quad"))


def row_quads(df: DataFrame, key: str, context: str, prefix: str = "urn:") -> DataFrame:
    """One n-quad for each value that is not null, as a literal."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns if c != key])
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(cells).alias("cell")).where("cell.value is not null")
    return rows.select(F.concat_ws(" ", _iri(F.col("key"), prefix), _iri(F.col("cell.name"), prefix), _literal(F.col("cell.value")), _iri(F.lit(context), prefix), F.lit(".")).alias("quad"))


def mermaid(edges: DataFrame, direction: str = "TD") -> DataFrame:
    """The lines of a flow chart."""
    name = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    line = F.format_string("    %s -->|%s| %s", name("src"), F.concat_ws(", ", type_names(F.col("types"))), name("dst"))
    head = edges.sparkSession.createDataFrame([(f"flowchart {direction}",)], "line string")
    return head.union(edges.select(line.alias("line")))


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result (JSON) for each finding: rule, certainty, message, path, sl, sc, el, ec."""
    return findings.select(F.to_json(sarif_result()).alias("result"))


def sarif_result() -> Column:
    region = F.struct(F.col("sl").alias("startLine"), F.col("sc").alias("startColumn"), F.col("el").alias("endLine"), (F.col("ec") + 1).alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("certainty") == "certain", "warning").otherwise("note")
    return F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))


def sarif_logs(findings: DataFrame, tool: str = "skein") -> DataFrame:
    """path, log: for each file a whole SARIF log with one run: the tool, its rules and the file's results in order."""
    one = findings.select("path", "rule", "sl", "sc", sarif_result().alias("result"))
    results = F.transform(F.sort_array(F.collect_list(F.struct("sl", "sc", "rule", "result"))), lambda x: x["result"])
    rules = F.transform(F.sort_array(F.collect_set("rule")), lambda x: F.struct(x.alias("id")))
    by = one.groupBy("path").agg(results.alias("results"), rules.alias("rules"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.col("results"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return by.select("path", F.to_json(log).alias("log"))


def report(findings: DataFrame) -> DataFrame:
    """path, line: one line of text for each finding."""
    where = F.concat_ws(":", "path", "sl", "sc")
    return findings.select("path", F.concat(where, F.lit(": "), "certainty", F.lit(" "), "rule", F.lit(": "), "message").alias("line"))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow annotation lines."""
    kind = F.when(F.col("certainty") == "certain", "warning").otherwise("notice")
    return findings.select(F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", kind, "path", "sl", "sc", "rule", "message").alias("line"))


def reconstructed(nodes: DataFrame) -> DataFrame:
    """file_id, line, text: the code of selected lines, one row a line, gaps left out."""
    return nodes.select("file_id", F.col("sl").alias("line"), "sc", "lexeme").groupBy("file_id", "line").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("sc", "lexeme"))), lambda x: x["lexeme"])).alias("text"))


def applied(text: Column, edits: Column) -> Column:
    """text with edits, array<struct<start, end, text>> over code points (start from 0, end excluded), applied from the
    last to the first; an edit that overlaps a later one is left out."""
    start = F.struct(text.alias("text"), F.lit(1 << 30).alias("free"))
    order = F.reverse(F.array_sort(edits))

    def put(acc: Column, e: Column) -> Column:
        now = acc["text"]
        out = F.concat(F.substring(now, F.lit(1), e["start"]), e["text"], F.substring(now, e["end"] + 1, F.length(now)))
        return F.when(e["end"] <= acc["free"], F.struct(out.alias("text"), e["start"].alias("free"))).otherwise(acc)

    return F.aggregate(order, start, put, lambda acc: acc["text"])


def mermaid_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines of a flowchart of two graphs: edges that both have plain, those of one side alone marked with it."""
    a, b = (x.select("src", "dst", type_names(F.col("types")).alias(n)) for x, n in ((left, "left"), (right, "right")))
    node = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    both = a.join(b, ["src", "dst"], "full")
    side = F.when(F.col("right").isNull(), F.lit("- ")).when(F.col("left").isNull(), F.lit("+ ")).otherwise(F.lit(""))
    names = F.concat_ws(", ", F.array_distinct(F.concat(F.coalesce("left", F.array().cast("array<string>")), F.coalesce("right", F.array().cast("array<string>")))))
    line = F.concat(F.lit("    "), node(F.col("src")), F.when(side == "", F.lit(" -->|")).otherwise(F.lit(" -.->|")), side, names, F.lit("| "), node(F.col("dst")))
    return both.select(line.alias("line")).union(left.sparkSession.createDataFrame([("flowchart TD",)], "line string"))


def outline(edges: DataFrame, label: str = "src") -> DataFrame:
    """src, line: plain text of a graph, one line for each vertex with all that it leads to."""
    to = F.concat("dst", F.lit(" ("), F.concat_ws(", ", type_names(F.col("types"))), F.lit(")"))
    by = edges.groupBy(label).agg(F.concat_ws("; ", F.sort_array(F.collect_list(to))).alias("to"))
    return by.select(label, F.concat(label, F.lit(" -> "), "to").alias("line"))


def slice_diff(texts: DataFrame, lines: DataFrame, color: bool = True) -> DataFrame:
    """file_id, line, text: every line of files (file_id, content); those outside a slice (file_id, line) dimmed, or behind
    a minus without color."""
    every = texts.select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file_id", (F.col("at") + 1).alias("line"), "text")
    marked = every.join(lines.select("file_id", "line", F.lit(True).alias("kept")).distinct(), ["file_id", "line"], "left")
    dim = F.concat(F.lit("\x1b[2m"), "text", F.lit("\x1b[0m")) if color else F.concat(F.lit("- "), "text")
    return marked.select("file_id", "line", F.when(F.col("kept"), F.col("text") if color else F.concat(F.lit("  "), "text")).otherwise(dim).alias("text"))


def summary(name: str, found: DataFrame, key: str) -> DataFrame:
    """query, key, rows: how many results a query has for each value of a column, as its short account."""
    return found.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("query"), "key", "rows")


def tree(nodes: DataFrame) -> DataFrame:
    """file_id, line, text: a syntax tree as indented text, nodes in reading order."""
    number = F.regexp_extract("node_id", r":(\d+)$", 1).cast("long")
    return nodes.select("file_id", (number + 1).alias("line"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "role", F.lit(": "), "type", F.when(F.col("lexeme") != "", F.concat(F.lit(" "), "lexeme")).otherwise("")).alias("text"))
