"""The lint rules over programs: a script for each nation, whose number decides which of its lines offend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.frontend.program import Program
from skein.operators.queries import QUERIES, fixed
from skein.plans.analysis import at, filled, program
from skein.plans.registry import query
from skein.session import table
from skein.sources import writers as W
from skein.storage import held

#: The script of nation {k}; what stands in other braces depends on its number.
SCRIPT = """#' Adds numbers.
#' @param a first
#' @param zz no such
add <- function(a, b) a + b
p <- {path}
q <- read.csv(p)
password <- "hunter{k}22"
download.file("http://example.org/f{k}", "f{k}.csv")
for (v in {over}) {
  print(v)
}
g <- function(m) {
  return(m)
  print("never")
}
w <- g({k})
eval({evaluated})
u <- sapply(1:3, add)
my_first <- 1
my_second <- my_first + w
theThird <- my_second + u
df <- data.frame(a = 1:{rows}, b = 2)
df${column}
df[{row}, ]
e <- read.csv("in{k}.csv")
write.csv(e, "mid{k}.csv")
h <- read.csv("mid{k}.csv")
library(pkgA)
library(pkgB)
fromA(h, q, theThird, password)
{syntax}
repeat {
  {leave}
}
"""
_N = "n AS (SELECT 'r' || n_nationkey AS file_id, n_nationkey AS k FROM nation)"


def scripts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    even, third = k % 2 == 0, k % 3 == 0
    choose = lambda cond, a, b: F.when(cond, F.lit(a)).otherwise(F.lit(b))
    code = filled(
        SCRIPT, path=choose(even, '"/home/user{k}/x.csv"', '"data/x{k}.csv"'), over=choose(third, "{k}", "1:{rows}"), evaluated=choose(third, "parse(text = w)", '"1 + {k}"'),
        column=choose(even, "c", "a"), row=choose(third, "{rows} + 9", "{rows}"), syntax=choose(even, "x = = 3", "x <- 3"), leave=choose(third, "break", "if (w > {k}) break"), rows=k + 2, k=k,
    )
    return table(spark, d, "nation").select(F.concat(F.lit("r"), k).alias("file_id"), code.alias("content"))


_programs: dict[tuple[str, str], Program] = {}


def linted(spark: SparkSession, d: str) -> Program:
    key = (spark.sparkContext.applicationId, d)
    if key not in _programs or not held(_programs[key].rows):
        _programs[key] = Program(scripts(spark, d))
    return _programs[key]


def found(spark: SparkSession, d: str, rule: str, **tables: DataFrame) -> DataFrame:
    """file_id, line, certainty of one rule's findings."""
    p = linted(spark, d)
    return QUERIES["linter"](p, [rule], **tables).join(at(p, "id"), "id").select("file_id", F.col("id_line").alias("line"), "certainty").distinct()


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Project files: the inputs of nations with even numbers."""
    return table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("in"), "n_nationkey", F.lit(".csv")).alias("path"), F.lit("data").alias("role"))


@query(f"WITH {_N} SELECT file_id, 4 AS line, 'certain' AS certainty FROM n")
def rule_roxygen_arguments(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "roxygen-arguments")


@query(f"WITH {_N} SELECT file_id, 5 AS line, 'uncertain' AS certainty FROM n WHERE k % 2 = 0")
def rule_absolute_file_paths(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "absolute-file-paths")


@query(f"WITH {_N} SELECT file_id, 7 AS line, 'uncertain' AS certainty FROM n")
def rule_no_leaked_credentials(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "no-leaked-credentials")


@query(f"WITH {_N} SELECT file_id, 8 AS line, 'certain' AS certainty FROM n")
def rule_network_functions(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "network-functions")


@query(f"WITH {_N} SELECT file_id, line, 'certain' AS certainty FROM n, (VALUES (9), (32)) t(line) WHERE k % 3 = 0")
def rule_useless_loop(spark: SparkSession, d: str) -> DataFrame:
    """Loops over one element, and loops that every way through them leaves."""
    return found(spark, d, "useless-loop")


@query(f"WITH {_N} SELECT file_id, 14 AS line, 'certain' AS certainty FROM n")
def rule_dead_code(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "dead-code")


@query(f"WITH {_N} SELECT file_id, 17 AS line, 'uncertain' AS certainty FROM n WHERE k % 3 = 0")
def rule_problematic_inputs(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "problematic-inputs")


@query(f"WITH {_N} SELECT file_id, line, 'certain' AS certainty FROM n, (VALUES (18), (8)) t(line)")
def rule_deprecated_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that are deprecated, and an argument of one that is."""
    old = spark.createDataFrame([("sapply", None, None), ("download.file", None, None), ("data.frame", None, "stringsAsFactors")], "name string, since string, argument string")
    return found(spark, d, "deprecated-functions", deprecated=old)


@query(f"WITH {_N} SELECT file_id, 21 AS line, 'uncertain' AS certainty FROM n")
def rule_naming_convention(spark: SparkSession, d: str) -> DataFrame:
    """Names in another casing than a file's commonest, among those of several words."""
    p = linted(spark, d)
    got = QUERIES["linter"](p, [("naming-convention", {"casing": "snake_case"})]).join(at(p, "id"), "id").join(p.vertices.select("id", "name"), "id")
    return got.where("name rlike '[a-z][A-Z_]'").select("file_id", F.col("id_line").alias("line"), "certainty").distinct()


@query(f"WITH {_N} SELECT file_id, 23 AS line, 'certain' AS certainty FROM n WHERE k % 2 = 0")
def rule_frame_access(spark: SparkSession, d: str) -> DataFrame:
    """A column that the frame does not have."""
    return found(spark, d, "dataframe-access-validation")


@query(f"WITH {_N} SELECT file_id, line, 'certain' AS certainty FROM n, (VALUES (6), (25)) t(line) WHERE line = 6 OR k % 2 = 1")
def rule_file_path_validity(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not there and that the script has not written before."""
    return found(spark, d, "file-path-validity", listing=listing(spark, d))


@query(f"WITH {_N} SELECT file_id, 29 AS line, 'certain' AS certainty FROM n")
def rule_unused_import(spark: SparkSession, d: str) -> DataFrame:
    exports = spark.createDataFrame([("pkgA", "fromA"), ("pkgB", "fromB")], "package string, name string")
    return found(spark, d, "unused-import", exports=exports)


@query(f"WITH {_N} SELECT file_id, 31 AS line, 'certain' AS certainty FROM n WHERE k % 2 = 0")
def rule_syntactically_valid(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, "syntactically-valid")


@query(f"WITH {_N} SELECT file_id, 30 AS line, 'uncertain' AS certainty FROM n WHERE k % 3 <> 0")
def rule_undefined_symbol(spark: SparkSession, d: str) -> DataFrame:
    """A function that neither the script nor the language defines; not where code is evaluated that may define it."""
    return found(spark, d, "undefined-symbol")


@query("SELECT 'software-has-license' AS rule, 'certain' AS certainty UNION ALL SELECT 'software-has-tests', 'certain'")
def rule_project_files(spark: SparkSession, d: str) -> DataFrame:
    """A project without a license and without tests."""
    return QUERIES["linter"](linted(spark, d), ["software-has-license", "software-has-tests"], listing=listing(spark, d)).select("rule", "certainty")


_S = "s AS (SELECT 's' || s_suppkey AS file_id, s_suppkey AS k FROM supplier)"


def _of_suppliers(spark: SparkSession, d: str, rule: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    return QUERIES["linter"](p, [rule]).join(at(p, "id"), "id").select("file_id", F.col("id_line").alias("line"), "certainty").distinct()


@query(f"WITH {_S} SELECT file_id, 17 AS line, 'certain' AS certainty FROM s WHERE k % 2 = 0")
def rule_stop_call(spark: SparkSession, d: str) -> DataFrame:
    """stop() whose `call.` is not FALSE."""
    return _of_suppliers(spark, d, "stop-call")


@query(f"WITH {_S} SELECT file_id, 21 AS line, 'certain' AS certainty FROM s WHERE k % 3 <> 0")
def rule_seeded_randomness(spark: SparkSession, d: str) -> DataFrame:
    return _of_suppliers(spark, d, "seeded-randomness")


@query(f"WITH {_S} SELECT file_id, 22 AS line, 'certain' AS certainty FROM s WHERE k % 2 = 1")
def rule_unclosed_connection(spark: SparkSession, d: str) -> DataFrame:
    return _of_suppliers(spark, d, "unclosed-connection")


@query(f"WITH {_S} SELECT file_id, line, 'uncertain' AS certainty FROM s, (VALUES (2), (16), (21), (24)) t(line) WHERE line <> 2 OR k % 3 <> 0")
def rule_unused_definitions(spark: SparkSession, d: str) -> DataFrame:
    """A parameter, a draw and a constant that nothing reads."""
    return _of_suppliers(spark, d, "unused-definitions")


@query(f"WITH {_S} SELECT file_id, 'if (a > b) stop(\"no\", call. = FALSE)' AS fixed FROM s WHERE k % 2 = 0")
def rule_quick_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Files with the quick fix for stop-call applied: the offending line of each."""
    p = program(spark, d, "suppliers")
    done = fixed(p, QUERIES["linter"](p, ["stop-call"]))
    return done.select("file_id", F.trim(F.element_at(F.split("content", "\n"), 17)).alias("fixed"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The findings of two rules with their places, as the output formats want them."""
    p = program(spark, d, "suppliers")
    got = QUERIES["linter"](p, ["stop-call", "unclosed-connection"]).select("rule", F.col("id").alias("node_id"), "certainty")
    return got.join(p.nodes, "node_id").select("rule", "certainty", F.concat(F.lit("see "), "rule").alias("message"), F.concat("file_id", F.lit(".R")).alias("path"), "sl", "sc", "el", "ec")


_FOUND = f"""{_S}, m AS (SELECT file_id || '.R' AS path, 'stop-call' AS rule, 17 AS sl, 14 AS sc, 37 AS ec FROM s WHERE k % 2 = 0
    UNION ALL SELECT file_id || '.R', 'unclosed-connection', 22, 8, 22 + length(CAST(k AS VARCHAR)) FROM s WHERE k % 2 = 1)"""


@query(
    f"""WITH {_FOUND} SELECT '{{"ruleId":"' || rule || '","level":"warning","message":{{"text":"see ' || rule || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path
      || '"}},"region":{{"startLine":' || sl || ',"startColumn":' || sc || ',"endLine":' || sl || ',"endColumn":' || (ec + 1) || '}}}}}}]}}' AS result FROM m"""
)
def sarif_export(spark: SparkSession, d: str) -> DataFrame:
    """One SARIF result for each finding."""
    return W.sarif(_messages(spark, d))


@query(f"WITH {_FOUND} SELECT path, '2.1.0' AS version, 'skein' AS tool, count(*) AS results, max(rule) AS rule FROM m GROUP BY path")
def sarif_logs(spark: SparkSession, d: str) -> DataFrame:
    """Whole SARIF logs, read back."""
    at_ = lambda x: F.get_json_object("log", x)
    n = F.json_array_length(at_("$.runs[0].results")).cast("long")
    return W.sarif_logs(_messages(spark, d)).select("path", at_("$.version").alias("version"), at_("$.runs[0].tool.driver.name").alias("tool"), n.alias("results"), at_("$.runs[0].results[0].ruleId").alias("rule"))


@query(f"WITH {_FOUND} SELECT path, path || ':' || sl || ':' || sc || ': certain ' || rule || ': see ' || rule AS line FROM m")
def lint_report(spark: SparkSession, d: str) -> DataFrame:
    return W.report(_messages(spark, d))


@query(f"WITH {_FOUND} SELECT '::warning file=' || path || ',line=' || sl || ',col=' || sc || ',title=' || rule || '::see ' || rule AS line FROM m")
def lint_annotations(spark: SparkSession, d: str) -> DataFrame:
    return W.annotations(_messages(spark, d))
