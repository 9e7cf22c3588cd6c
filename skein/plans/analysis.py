"""Queries over programs: a script for each supplier and one for each nation, written from the rows, parsed and analysed.

What a query must find follows from the supplier's or nation's numbers, so the SQL says it without any program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.frontend.program import Program
from skein.operators import enrich as E
from skein.operators import graph as G
from skein.operators.queries import QUERIES
from skein.operators.search import Search
from skein.plans.registry import query
from skein.session import table
from skein.storage import held

#: The script of supplier {k} of nation {n}; {seed}, {flag} and {end} depend on the supplier's number.
SCRIPT = """library(pkg{n})
{seed}
x <- {k}
y <- x * 2 + 1
name <- paste0("f", y, ".csv")
d <- read.csv(name)
if (u > 0) {
  z <- x
} else {
  z <- y
}
total <- 0
for (i in 1:{n}) {
  total <- total + i
}
f <- function(a, b, c) {
  if (a > b) stop("no", call. = {flag})
  a + b
}
r <- f(x, z)
s <- rnorm(1)
con <- file("log{k}.txt")
{end}
unused <- {k}
write.csv(d, "out.csv")
print(r)
system(name)
"""
#: The script of nation {k}: functions that call themselves, each other, and functions that they are given.
FUNCTIONS = """fact <- function(n) if (n > 0) n * fact(n - 1) else 1
twice <- function(g) g(g({k}))
inc <- function(v) v + 1
even <- function(n) if (n == 0) TRUE else odd(n - 1)
odd <- function(n) if (n == 0) FALSE else even(n - 1)
a <- twice(inc)
b <- fact({k})
c <- even({k})
safe <- function() tryCatch(stop("x"), error = function(e) NULL)
make <- function() function(q) q
if (b > {k}) dec <- function(v) v - 1
dec(2)
m <- make
m()
loud <- function(t) if (t > {k}) stop("loud") else inc(t)
"""

_S = "s AS (SELECT 's' || s_suppkey AS file_id, s_suppkey AS k, s_nationkey + 1 AS n FROM supplier)"
_N = "n AS (SELECT 'n' || n_nationkey AS file_id, n_nationkey AS k FROM nation)"


def filled(template: str, **values: Column) -> Column:
    """A template with columns in place of its {names}."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


_programs: dict[tuple[str, str, str], Program] = {}


def program(spark: SparkSession, d: str, kind: str) -> Program:
    """The analysed scripts of a folder's tables; analysed once for all queries of a session."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _programs or not held(_programs[key].rows):
        _programs[key] = Program(suppliers(spark, d) if kind == "suppliers" else nations(spark, d))
    return _programs[key]


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    seed = F.when(k % 3 == 0, F.concat(F.lit("set.seed("), k, F.lit(")"))).otherwise(F.concat(F.lit("seed <- "), k))
    flag, end = F.when(k % 2 == 0, "TRUE").otherwise("FALSE"), F.when(k % 2 == 0, "close(con)").otherwise("print(con)")
    code = filled(SCRIPT, seed=seed, flag=flag, end=end, k=k, n=F.col("s_nationkey") + 1)
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("file_id"), code.alias("content"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("file_id"), filled(FUNCTIONS, k=k).alias("content"))


def at(p: Program, *names: str) -> DataFrame:
    """file_id, the ids under a name, and their lines under name + _line; one table for each of several names to join."""
    name = names[0]
    return p.nodes.select(F.col("node_id").alias(name), F.col("sl").alias(f"{name}_line"))


def lines_of(p: Program, ids: DataFrame, key: str = "id") -> DataFrame:
    """file_id, line: the distinct lines of ids."""
    return p.nodes.join(ids.select(F.col(key).alias("node_id")).distinct(), "node_id", "left_semi").select("file_id", F.col("sl").alias("line")).distinct()


def _lines(of: str, *lines: int) -> str:
    rows = ", ".join(f"({x})" for x in lines)
    return f"SELECT file_id, line FROM {of}, (VALUES {rows}) t(line)"


@query(
    f"""WITH {_S} SELECT file_id, 'library' AS category, 'library' AS name, 'pkg' || n AS value FROM s
    UNION ALL SELECT file_id, 'read', 'read.csv', 'f' || (2 * k + 1) || '.csv' FROM s UNION ALL SELECT file_id, 'read', 'file', 'log' || k || '.txt' FROM s
    UNION ALL SELECT file_id, 'write', 'write.csv', NULL FROM s UNION ALL SELECT file_id, 'write', 'print', NULL FROM s
    UNION ALL SELECT file_id, 'write', 'print', NULL FROM s WHERE k % 2 = 1"""
)
def query_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["dependencies"](program(spark, d, "suppliers")).select("file_id", "category", "name", "value")


@query(f"WITH {_S} SELECT file_id, 'custom' AS category, 'rnorm' AS name, '1' AS value FROM s")
def query_dependencies_custom(spark: SparkSession, d: str) -> DataFrame:
    """A category of the caller's own."""
    return QUERIES["dependencies"](program(spark, d, "suppliers"), ["custom"], {"custom": ["rnorm"]}).select("file_id", "category", "name", "value")


@query(
    f"""WITH {_S} SELECT file_id, 'name' AS variable, 'f' || (2 * k + 1) || '.csv' AS value FROM s UNION ALL SELECT file_id, 'y', CAST(2 * k + 1 AS VARCHAR) FROM s
    UNION ALL SELECT file_id, 'z', least(CAST(k AS VARCHAR), CAST(2 * k + 1 AS VARCHAR)) || ' or ' || greatest(CAST(k AS VARCHAR), CAST(2 * k + 1 AS VARCHAR)) FROM s
    UNION ALL SELECT file_id, 'total', NULL FROM s"""
)
def query_resolve_value(spark: SparkSession, d: str) -> DataFrame:
    """What variables stand for: folded texts and numbers, two values after a branch, nothing certain after a loop."""
    p, out = program(spark, d, "suppliers"), None
    for criterion, name in (("5@name", "name"), ("4@y", "y"), ("20@z", "z"), ("14@[2]total", "total")):
        got = QUERIES["resolve-value"](p, [criterion]).join(p.nodes.select(F.col("node_id").alias("id"), "file_id"), "id")
        got = got.select("file_id", F.lit(name).alias("variable"), F.when(F.col("values").isNotNull(), F.concat_ws(" or ", F.array_sort("values"))).alias("value"))
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_S} {_lines('s', 3, 4, 7, 8, 9, 10, 11, 16, 18, 19, 20, 26)}")
def query_slice_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the last print depends on: through the call, both branches, and what decides between them."""
    p = program(spark, d, "suppliers")
    return p.lines(p.slice("26@r"))


@query(
    f"""WITH {_S} SELECT file_id, 'x <- ' || k || chr(10) || 'y <- x * 2 + 1' || chr(10) || 'name <- paste0("f", y, ".csv")' || chr(10) || 'system(name)' AS code FROM s"""
)
def query_slice_code(spark: SparkSession, d: str) -> DataFrame:
    """Code from a slice."""
    return QUERIES["static-slice"](program(spark, d, "suppliers"), ["27@name"], code=True)


@query(f"WITH {_S} {_lines('s', 3, 4, 5, 6, 7, 8, 9, 10, 20, 25, 26, 27)}")
def query_slice_forward(spark: SparkSession, d: str) -> DataFrame:
    """Where the first variable goes: through both branches and into the call, whose one argument alone does not make the
    function's inside follow."""
    p = program(spark, d, "suppliers")
    return lines_of(p, p.slice("3@x", forward=True)).where("line <> 16")


@query(f"WITH {_S} SELECT file_id, name FROM s, (VALUES ('u')) t(name)")
def query_slice_free_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that a slice reads and does not define."""
    p = program(spark, d, "suppliers")
    return p.free_names(p.slice("26@r"))


@query(f"WITH {_S} SELECT file_id, kind, subkind, name FROM s, (VALUES ('in', 'csv', 'read.csv'), ('out', 'csv', 'write.csv'), ('run', 'own', 'f')) t(kind, subkind, name)")
def query_call_context(spark: SparkSession, d: str) -> DataFrame:
    found = QUERIES["call-context"](program(spark, d, "suppliers"), [("in", "csv", r"^read\."), ("out", "csv", r"^write\."), ("run", "own", "^f$"), ("run", "none", "^nothing$")])
    return found.select("file_id", "kind", "subkind", "name")


@query(
    f"""WITH {_N} SELECT file_id, targets, name, line FROM n, (VALUES ('local', 'dec', 12), ('global', 'dec', 12), ('must-local', 'inc', 15), ('local', 'inc', 15),
    ('must-global', 'stop', 9), ('must-global', 'stop', 15), ('global', 'stop', 9), ('global', 'stop', 15)) t(targets, name, line)"""
)
def query_call_targets(spark: SparkSession, d: str) -> DataFrame:
    """Calls by where they may go: a function that one branch defines may be it, or may be a global one."""
    p, out = program(spark, d, "nations"), None
    for kind in ("local", "must-local", "global", "must-global"):
        got = QUERIES["call-context"](p, [("k", "s", "dec"), ("k", "s", "inc"), ("k", "s", "stop")], exact=True, targets=kind).select("file_id", F.lit(kind).alias("targets"), "name", F.col("sl").alias("line"))
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_N} SELECT file_id, 14 AS line, 'm' AS name FROM n")
def query_call_aliases(spark: SparkSession, d: str) -> DataFrame:
    """A call by another name that stands for the wanted one."""
    found = QUERIES["call-context"](program(spark, d, "nations"), [("k", "s", "make")], exact=True, aliases=True)
    return found.select("file_id", F.col("sl").alias("line"), "name")


@query(f"WITH {_S} SELECT file_id, 23 AS call, 22 AS last FROM s WHERE k % 2 = 0")
def query_last_call(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    got = QUERIES["link-to-last-call"](p, "close", "file")
    return got.join(at(p, "id"), "id").join(at(p, "last"), "last").join(p.nodes.select(F.col("node_id").alias("id"), "file_id"), "id").select("file_id", F.col("id_line").alias("call"), F.col("last_line").alias("last"))


@query(f"WITH {_S} SELECT file_id, 26 AS call, last FROM s, (VALUES (25), (6)) t(last)")
def query_last_call_goes_on(spark: SparkSession, d: str) -> DataFrame:
    """The search goes on beyond writes and ends at the read before them."""
    p = program(spark, d, "suppliers")
    got = QUERIES["link-to-last-call"](p, "print", r"(read|write)\.csv", go_on=F.col("name") == "write.csv", start=p.calls().where("name = 'print' and sl = 26"))
    return got.join(at(p, "id"), "id").join(at(p, "last"), "last").join(p.nodes.select(F.col("node_id").alias("id"), "file_id"), "id").select("file_id", F.col("id_line").alias("call"), F.col("last_line").alias("last"))


@query(f"WITH {_S} SELECT file_id, 5 AS line, '<-' AS name FROM s")
def query_nested_call(spark: SparkSession, d: str) -> DataFrame:
    """The calls around each paste0()."""
    p = program(spark, d, "suppliers")
    return QUERIES["link-to-nested-call"](p, "paste0").join(p.calls().select("id", "file_id", "name", F.col("sl").alias("line")), "id").select("file_id", "line", "name")


@query(f"WITH {_S} SELECT file_id, pair, before FROM s, (VALUES ('3 26', true), ('8 26', NULL), ('26 3', false), ('7 10', true), ('14 14', NULL), ('8 10', false)) t(pair, before)")
def query_happens_before(spark: SparkSession, d: str) -> DataFrame:
    """Always, on some ways, or never: through a branch, a loop, and backward."""
    p, out = program(spark, d, "suppliers"), None
    for a, b in (("3@x", "26@r"), ("8@z", "26@r"), ("26@r", "3@x"), ("7@u", "10@z"), ("14@total", "14@total"), ("8@z", "10@z")):
        pair = f"{a.split('@')[0]} {b.split('@')[0]}"
        got = QUERIES["happens-before"](p, a, b).select("file_id", F.lit(pair).alias("pair"), "before")
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_S} {_lines('s', 3, 4)}")
def query_dice(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    return lines_of(p, QUERIES["dice"](p, ["3@x"], ["4@y"]))


@query(f"WITH {_S} {_lines('s', 3, 4, 5)}")
def query_provenance(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    return lines_of(p, QUERIES["provenance"](p, ["5@name"]))


@query(f"WITH {_S} {_lines('s', 16, 18)}")
def query_provenance_in_function(spark: SparkSession, d: str) -> DataFrame:
    """What the sum in the function comes from, not leaving the function."""
    p = program(spark, d, "suppliers")
    return lines_of(p, QUERIES["provenance"](p, ["18@+"], within_function=True)).union(p.nodes.where("type = 'RParameter' and lexeme = 'a'").select("file_id", F.col("sl").alias("line"))).distinct()


@query(f"WITH {_S} SELECT file_id, 'read-variable' AS kind, 20 AS line FROM s")
def query_origin(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    return QUERIES["origin"](p, ["26@r"]).join(at(p, "origin"), "origin").join(p.nodes.select(F.col("node_id").alias("id"), "file_id"), "id").select("file_id", "kind", F.col("origin_line").alias("line"))


@query(f"WITH {_S} SELECT file_id, line, name FROM s, (VALUES (4, 'y'), (5, 'y'), (10, 'y')) t(line, name)")
def query_symbol_references(spark: SparkSession, d: str) -> DataFrame:
    """All places of one variable."""
    p = program(spark, d, "suppliers")
    found = QUERIES["symbol-references"](p, ["4@y"]).select(F.col("reference").alias("node_id"))
    return p.nodes.join(found, "node_id", "left_semi").select("file_id", F.col("sl").alias("line"), F.col("lexeme").alias("name"))


@query(f"WITH {_S} SELECT file_id, criterion, kind FROM s, (VALUES ('27@name', 'const'), ('21@s', 'rand'), ('25@d', 'file'), ('18@a', 'param'), ('18@a', 'const')) t(criterion, kind)")
def query_input_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where values come from: constants, a random draw, a file, a parameter with what callers give for it."""
    p, out = program(spark, d, "suppliers"), None
    for c in ("27@name", "21@s", "25@d", "18@a"):
        got = QUERIES["input-sources"](p, [c]).join(p.nodes.select(F.col("node_id").alias("id"), "file_id"), "id").select("file_id", F.lit(c).alias("criterion"), "kind").distinct()
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_N} SELECT file_id, function, call FROM n, (VALUES (15, 15)) t(function, call)")
def query_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that may raise; what tryCatch holds does not."""
    p = program(spark, d, "nations")
    got = QUERIES["inspect-exception"](p).select("function", "call")
    return got.join(at(p, "function"), "function").join(at(p, "call"), "call").join(p.nodes.select(F.col("node_id").alias("function"), "file_id"), "function").select("file_id", F.col("function_line").alias("function"), F.col("call_line").alias("call"))


@query(f"WITH {_S} SELECT file_id, param, strict FROM s, (VALUES ('a', true), ('b', true), ('c', false)) t(param, strict)")
def query_strictness(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    return QUERIES["inspect-strictness"](p).join(p.nodes.select(F.col("node_id").alias("function"), "file_id"), "function").select("file_id", "param", "strict")


@query(
    f"""WITH {_N} SELECT file_id, line, place, recursive FROM n, (VALUES (1, 9, true), (2, 10, false), (3, 8, false), (4, 9, true), (5, 8, true), (9, 9, false), (9, 48, false),
    (10, 9, false), (10, 20, false), (11, CASE WHEN k < 10 THEN 19 ELSE 20 END, false), (15, 9, false)) t(line, place, recursive)"""
)
def query_recursion(spark: SparkSession, d: str) -> DataFrame:
    """Functions that call themselves, directly or by another one."""
    p = program(spark, d, "nations")
    places = p.nodes.select(F.col("node_id").alias("id"), "file_id", F.col("sl").alias("line"), F.col("sc").alias("place"))
    return QUERIES["inspect-recursion"](p).join(places, "id").select("file_id", "line", "place", "recursive")


@query(f"WITH {_N} SELECT file_id, line FROM n, (VALUES (2), (10)) t(line)")
def query_higher_order(spark: SparkSession, d: str) -> DataFrame:
    """A function that is given one, and one that returns one."""
    p = program(spark, d, "nations")
    return lines_of(p, QUERIES["inspect-higher-order"](p).where("higher_order"))


@query(f"WITH {_N} SELECT file_id, call, calls FROM n, (VALUES ('even', true), ('inc', false), ('loud', true), ('fact', false)) t(call, calls)")
def query_does_call(spark: SparkSession, d: str) -> DataFrame:
    """Whether functions come to call odd() or stop(); directly or not."""
    p, out = program(spark, d, "nations"), None
    for name in ("even", "inc", "loud", "fact"):
        got = QUERIES["does-call"](p, name, ["odd", "stop"]).join(p.nodes.select(F.col("node_id").alias("id"), "file_id"), "id").select("file_id", F.lit(name).alias("call"), "calls")
        out = got if out is None else out.union(got)
    return out


@query(
    f"""WITH {_N} SELECT file_id, src, dst FROM n, (VALUES (0, 2), (0, 1), (0, 4), (0, 11), (0, 10), (1, 1), (4, 5), (5, 4), (15, 3)) t(src, dst)"""
)
def query_call_graph(spark: SparkSession, d: str) -> DataFrame:
    """Which functions call which, by their lines; 0 is the file itself."""
    p = program(spark, d, "nations")
    edges = p.call_graph().select("file_id", "src", "dst")
    return edges.join(at(p, "src"), "src", "left").join(at(p, "dst"), "dst").where("dst_line <> 9").select("file_id", F.coalesce("src_line", F.lit(0)).alias("src"), F.col("dst_line").alias("dst")).distinct()


@query(f"WITH {_N} SELECT file_id, src, dst FROM n, (VALUES (0, 2), (0, 1), (0, 4), (0, 11), (0, 10), (1, 1), (4, 5), (5, 4)) t(src, dst)")
def query_call_graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    """The same without functions that nothing calls."""
    p = program(spark, d, "nations")
    edges = p.call_graph(unreachable=False).select("file_id", "src", "dst")
    return edges.join(at(p, "src"), "src", "left").join(at(p, "dst"), "dst").select("file_id", F.coalesce("src_line", F.lit(0)).alias("src"), F.col("dst_line").alias("dst")).distinct()


@query(
    f"""WITH {_S} SELECT file_id, use, definition, name FROM s, (VALUES (4, 3, 'x'), (5, 4, 'y'), (6, 5, 'name'), (8, 3, 'x'), (10, 4, 'y'), (14, 12, 'total'), (14, 14, 'total'), (14, 13, 'i'),
    (17, 16, 'a'), (17, 16, 'b'), (18, 16, 'a'), (18, 16, 'b'), (20, 3, 'x'), (20, 8, 'z'), (20, 10, 'z'), (20, 16, 'f'), (23, 22, 'con'), (25, 6, 'd'), (26, 20, 'r'), (27, 5, 'name')) t(use, definition, name)"""
)
def query_reads(spark: SparkSession, d: str) -> DataFrame:
    """Which definition each use reads: through branches, around the loop, and by parameters."""
    p = program(spark, d, "suppliers")
    named = p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("dst"), "name")
    edges = p.typed(G.READS).join(named, "dst").join(at(p, "src"), "src").join(at(p, "dst"), "dst")
    return edges.select("file_id", F.col("src_line").alias("use"), F.col("dst_line").alias("definition"), "name").distinct()


@query(
    f"""WITH {_S} SELECT file_id, a, b FROM s, (VALUES (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (7, 9), (9, 10), (8, 12), (10, 12), (12, 13), (13, 14), (14, 13), (13, 16),
    (16, 17), (17, 18), (16, 20), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26), (26, 27)) t(a, b)"""
)
def query_control_flow(spark: SparkSession, d: str) -> DataFrame:
    """Which line may follow which."""
    p = program(spark, d, "suppliers")
    edges = p.flow_edges().join(at(p, "src"), "src").join(at(p, "dst"), "dst").where("src_line <> dst_line")
    return edges.select("file_id", F.col("src_line").alias("a"), F.col("dst_line").alias("b")).distinct()


@query(f"WITH {_S} SELECT file_id, line, head FROM s, (VALUES (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (20, 16), (21, 16), (22, 16), (23, 16), (24, 16), (25, 16), (26, 16), (27, 16)) t(line, head)")
def query_basic_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of straight lines outside branches, loops and functions."""
    p = program(spark, d, "suppliers")
    blocks = QUERIES["control-flow"](p, passes=["unique-cf-sets", "to-basic-blocks"])
    out = blocks.join(at(p, "id"), "id").join(at(p, "block"), "block").join(p.nodes.where("depth = 1").select(F.col("node_id").alias("id"), "file_id"), "id")
    return out.where("block_line in (1, 16) and id_line not in (7, 16)").select("file_id", F.col("id_line").alias("line"), F.col("block_line").alias("head"))


@query(f"WITH {_S} SELECT file_id, CASE WHEN k % 3 = 0 THEN 12 ELSE 11 END AS calls, 1 AS loops, 1 AS functions, 2 AS branches FROM s")
def query_normalized_ast(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind."""
    nodes = QUERIES["normalized-ast"](program(spark, d, "suppliers"))
    n = lambda kind: F.count_if(F.col("type") == kind).cast("int")
    return nodes.groupBy("file_id").agg(n("RFunctionCall").alias("calls"), n("RForLoop").alias("loops"), n("RFunctionDefinition").alias("functions"), n("RIfThenElse").alias("branches"))


@query(f"WITH {_S} SELECT file_id, span, sl, sc, el, ec FROM s, (VALUES ('full', 4, 6, 4, 10), ('token', 4, 6, 4, 6), ('statement', 4, 1, 4, 14)) t(span, sl, sc, el, ec)")
def query_location_map(spark: SparkSession, d: str) -> DataFrame:
    """Where x * 2 stands: all of it, its first token, the statement around it."""
    p, out = program(spark, d, "suppliers"), None
    wanted = p.nodes.where("type = 'RBinaryOp' and lexeme = '*' and sl = 4").select("node_id")
    for span in ("full", "token", "statement"):
        got = QUERIES["location-map"](p, span=span).join(wanted, "node_id", "left_semi").select("file_id", F.lit(span).alias("span"), "sl", "sc", "el", "ec")
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_S} SELECT file_id, type, lexeme FROM s, (VALUES ('RSymbol', 'y'), ('RBinaryOp', '<-'), ('RBinaryOp', '+')) t(type, lexeme)")
def query_id_map(spark: SparkSession, d: str) -> DataFrame:
    """What ids of line 4 stand for."""
    p = program(spark, d, "suppliers")
    here = p.nodes.where("sl = 4 and sc < 6").select("node_id")
    plus = p.nodes.where("sl = 4 and lexeme = '+'").select("node_id")
    return QUERIES["id-map"](p).join(here.union(plus).distinct(), "node_id", "left_semi").select("file_id", "type", "lexeme")


@query(f"WITH {_S} SELECT file_id, name FROM s, (VALUES ('x'), ('y'), ('paste0'), ('name')) t(name)")
def query_dataflow_lens(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of lines 3 to 5 in the flow without values and operators."""
    p = program(spark, d, "suppliers")
    ids = QUERIES["dataflow-lens"](p).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    here = p.nodes.where("sl between 3 and 5").select(F.col("node_id").alias("id"))
    return p.vertices.join(ids, "id", "left_semi").join(here, "id", "left_semi").select("file_id", "name").distinct()


@query(f"WITH {_S} SELECT file_id, a, b, together, effects FROM s, (VALUES ('x', 'name', true, false), ('x', 'unused', false, false), ('x', 'r', true, false)) t(a, b, together, effects)")
def query_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Whether variables hang together, and whether anything unknown acts on them."""
    p = program(spark, d, "suppliers")
    of = QUERIES["dataflow-cluster"](p).join(p.vertices.where("tag = 'variable-definition'").select("id", "file_id", "name"), "id")
    one, out = of.where("name = 'x'").select("file_id", F.col("component").alias("mine"), F.col("has_unknown_side_effects").alias("effects")), None
    for b in ("name", "unused", "r"):
        got = of.where(F.col("name") == b).join(one, "file_id").select("file_id", F.lit("x").alias("a"), F.lit(b).alias("b"), (F.col("component") == F.col("mine")).alias("together"), "effects")
        out = got if out is None else out.union(got)
    return out


# searches over programs


@query(f"WITH {_S} SELECT file_id, name, line FROM s, (VALUES ('f', 16), ('print', 23), ('print', 26)) t(name, line) WHERE NOT (name = 'print' AND line = 23 AND k % 2 = 0)")
def search_call_targets(spark: SparkSession, d: str) -> DataFrame:
    """Calls with their targets: the line of the function, or the call's own for a built-in one."""
    p = program(spark, d, "suppliers")
    found = E.call_targets(Search(p.nodes).filter((F.col("type") == "RFunctionCall") & F.col("lexeme").isin("f", "print")), p).frame
    one = found.select("file_id", "sl", F.col("lexeme").alias("name"), F.explode("call_targets").alias("target"))
    return one.join(at(p, "target"), "target", "left").select("file_id", "name", F.coalesce("target_line", F.col("sl")).alias("line"))


@query(f"WITH {_S} SELECT file_id, 23 AS line, 22 AS last FROM s WHERE k % 2 = 0")
def search_last_call(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    found = E.last_call(Search(p.nodes).filter((F.col("type") == "RFunctionCall") & (F.col("lexeme") == "close")), p, "file").frame
    return found.select("file_id", F.col("sl").alias("line"), F.explode("last_call").alias("last")).join(at(p, "last"), "last").select("file_id", "line", F.col("last_line").alias("last"))


@query(f"WITH {_S} SELECT file_id, line, is_root, is_reachable FROM s, (VALUES (3, true, true), (4, true, true)) t(line, is_root, is_reachable)")
def search_cfg_information(spark: SparkSession, d: str) -> DataFrame:
    p = program(spark, d, "suppliers")
    found = E.cfg_information(Search(p.nodes).filter((F.col("lexeme") == "<-") & F.col("sl").isin(3, 4)), p).frame
    return found.select("file_id", F.col("sl").alias("line"), "is_root", "is_reachable")


@query(f"WITH {_S} SELECT file_id, line FROM s, (VALUES (1), (6), (22), (25), (26), (23)) t(line) WHERE line <> 23 OR k % 2 = 1")
def search_from_query(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that another query's result names, with that result beside them."""
    p = program(spark, d, "suppliers")
    found = Search(p.nodes).from_query(QUERIES["dependencies"](p), data="query_data")
    return found.filter(F.size("query_data") == 1).frame.select("file_id", F.col("sl").alias("line"))


@query(f"WITH {_S} SELECT file_id, line, lexeme FROM s, (VALUES (5, 'y'), (17, 'stop')) t(line, lexeme)")
def search_syntax(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by the shape of the tree around them: a name among paste0's arguments, the name of a call below a branch."""
    p = program(spark, d, "suppliers")
    one = Search(p.nodes).syntax('(RFunctionCall "paste0" call-argument: (RArgument arg-value: (RSymbol) @name))')
    two = Search(p.nodes).syntax("(RIfThenElse if-then: (RFunctionCall call-name: (_) @callee))", "callee")
    return one.merge(two).frame.select("file_id", F.col("sl").alias("line"), "lexeme")


@query(f"WITH {_S} SELECT file_id, line, type FROM s, (VALUES (4, 'RBinaryOp')) t(line, type)")
def search_map(spark: SparkSession, d: str) -> DataFrame:
    """From the found nodes to their parents."""
    p = program(spark, d, "suppliers")
    found = Search(p.nodes).get(name="y", line=4).map(lambda nodes: nodes.select(F.col("parent_id").alias("node_id")))
    return found.frame.select("file_id", F.col("sl").alias("line"), "type")


@query(f"WITH {_S} SELECT file_id, criterion, line FROM s, (VALUES ('9^', 7), ('-1@name', 27), ('14@[-1]total', 14), ('4~8', 4), ('3@x(s.*)', 3)) t(criterion, line)")
def search_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Criteria: a statement that covers a line, a line from the end, the last of a name, a place in a range, a file."""
    p, out = program(spark, d, "suppliers"), None
    for c in ("9^", "-1@name", "14@[-1]total", "4~8", "3@x(s.*)"):
        got = Search(p.nodes).criterion(c).frame.select("file_id", F.lit(c).alias("criterion"), F.col("sl").alias("line"))
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_S} SELECT file_id, name FROM s, (VALUES ('print'), ('write.csv'), ('system')) t(name)")
def search_last_calls_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the last three lines, counted from the end."""
    p, out = program(spark, d, "suppliers"), None
    for line in (-1, -2, -3):
        got = Search(p.nodes).get(line=line).filter(F.col("type") == "RFunctionCall").frame.select("file_id", F.col("lexeme").alias("name"))
        out = got if out is None else out.union(got)
    return out


@query(f"WITH {_S} SELECT file_id, criteria FROM s, (VALUES ('4@[1]x'), ('4@[1]y'), ('4@[1]x 4@[1]y')) t(criteria)")
def query_all_criteria(spark: SparkSession, d: str) -> DataFrame:
    """All choices of one or two variables on line 4; y stands before x there."""
    found = QUERIES["all-criteria"](program(spark, d, "suppliers"), 1, 2)
    only = found.where(F.forall("criteria", lambda c: c.startswith("4@")))
    return only.select("file_id", F.array_join(F.array_sort("criteria"), " ").alias("criteria"))


@query(f"WITH {_S} SELECT file_id, 'pkg' || n || '::read.csv' AS qualified FROM s UNION ALL SELECT file_id, 'print' FROM s UNION ALL SELECT file_id, 'print' FROM s WHERE k % 2 = 1")
def query_qualified(spark: SparkSession, d: str) -> DataFrame:
    """Calls with the package that exports them, if one does and is attached."""
    p = program(spark, d, "suppliers")
    exports = p.libraries.select("package").distinct().withColumn("name", F.lit("read.csv"))
    return QUERIES["qualify"](p, exports).where("qualified = 'print' or qualified like '%read.csv'").select("file_id", "qualified")


@query("SELECT 'w' || n_nationkey AS file_id, line, directory FROM nation, LATERAL (VALUES (1, ''), (2, '/data'), (3, '/data/in' || n_nationkey), (4, '/out')) t(line, directory)")
def query_working_directory(spark: SparkSession, d: str) -> DataFrame:
    """Where calls run, after the changes of folder above them."""
    k = F.col("n_nationkey")
    code = filled('setwd("/data")\nsetwd("in{k}")\nsetwd(paste0("/", "out"))\nread.csv("a.csv")', k=k)
    p = Program(table(spark, d, "nation").select(F.concat(F.lit("w"), k).alias("file_id"), code.alias("content")))
    return QUERIES["working-directory"](p).join(at(p, "id"), "id").join(p.calls().where("name in ('setwd', 'read.csv')").select("id"), "id", "left_semi").select("file_id", F.col("id_line").alias("line"), "directory")


@query(f"WITH {_S} SELECT file_id, 0 AS problems FROM s")
def query_invariants(spark: SparkSession, d: str) -> DataFrame:
    """How often each script's flow breaks what flows have to keep: never."""
    p = program(spark, d, "suppliers")
    found = QUERIES["invariants"](p).groupBy("file_id").agg(F.count("*").cast("int").alias("n"))
    return p.files.join(found, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("problems"))


@query(f"WITH {_S} SELECT file_id, CASE WHEN k % 4 = 0 THEN 1000 + k ELSE k END AS x FROM s WHERE k % 5 <> 0")
def query_updated_program(spark: SparkSession, d: str) -> DataFrame:
    """A program after a quarter of its files has changed and a fifth has gone: what x stands for in each."""
    k = F.col("s_suppkey")
    p = program(spark, d, "suppliers")
    changed = table(spark, d, "supplier").where(k % 4 == 0).select(F.concat(F.lit("s"), k).alias("file_id"), F.concat(F.lit("\n\nx <- "), 1000 + k).alias("content"))
    gone = table(spark, d, "supplier").where(k % 5 == 0).select(F.concat(F.lit("s"), k).alias("file_id"))
    after = p.updated(changed.join(gone, "file_id", "left_anti"), gone)
    found = QUERIES["resolve-value"](after, ["3@x"]).join(after.nodes.select(F.col("node_id").alias("id"), "file_id"), "id")
    return found.select("file_id", F.col("values")[0].cast("long").alias("x"))
