"""What calls with a meaning of their own do to the data flow: one small script for each nation and each kind of call.

Every query gives the lines that uses on a script's last line read from, or the lines of the functions that are called;
{k} in a script is the nation's number, and decides branches where a constant condition does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.frontend.program import Program
from skein.operators import graph as G
from skein.plans.analysis import at, filled
from skein.plans.registry import query
from skein.session import table

#: Scripts by kind of call, with the lines that the last line's uses read from: (name, line).
SCOPES: dict[str, tuple[str, list[tuple[str, int]]]] = {
    "assignment": ("x <- {k}\n3 -> y\nz = x\nprint(x, y, z)", [("x", 1), ("y", 2), ("z", 3)]),
    "super-assignment": ("x <- {k}\nset <- function() x <<- 2\nset()\nprint(x)", [("x", 1), ("x", 2)]),
    "assignment-like": ('setGeneric("area", function(s) standardGeneric("area"))\narea({k})', [("area", 1)]),
    "define-argument": ("data(cars)\nprint(cars)", [("cars", 1)]),
    "replacement": ("x <- c(1, {k})\nnames(x) <- c('a', 'b')\nx[2] <- 5\nprint(x)", [("x", 3)]),
    "table-assignment": ("t <- frame({k})\nt[, n := 2]\nprint(t)", [("t", 1)]),
    "local": ("x <- 1\ny <- local({ x <- {k}; x + 1 })\nprint(x)", [("x", 1)]),
    "with": ("d <- data.frame(a = {k})\nb <- 2\nwith(d, a + b)", [("d", 1), ("b", 2)]),
    "attach": ("d <- data.frame(a = {k})\nd <- 3\nprint(d)", [("d", 2)]),
    "rm": ("x <- 1\ny <- {k}\nrm(x)\nprint(x, y)", [("y", 2)]),
    "rm-in-branch": ("x <- {k}\nif (u) rm(x)\nprint(x)", [("x", 1)]),
    "get": ('x <- {k}\nget("x")', [("x", 1)]),
    "new-env": ("e <- new.env()\nx <- {k}\nprint(e, x)", [("e", 1), ("x", 2)]),
    "stack-env": ("f <- function() parent.frame()\nx <- {k}\nprint(x)", [("x", 2)]),
    "access": ("x <- list(a = {k})\nx$a", [("x", 1)]),
    "list": ("a <- {k}\nl <- list(a, 2)\nprint(l)", [("l", 2)]),
    "vector": ("a <- {k}\nv <- c(a, 2)\nprint(v)", [("v", 2)]),
    "namespace-access": ("f <- function(x) x\nd <- {k}\nstats::f(d)", [("d", 2)]),
    "quote": ("x <- {k}\nq <- quote(x)\nprint(q)", [("q", 2)]),
    "pipe": ("x <- {k}\nx |> print()", [("x", 1)]),
    "pipe-back": ("library(magrittr)\nx <- {k}\nx %>% print()", [("x", 2)]),
    "read-all-arguments": ("a <- 1\nb <- {k}\ncat(a, b)", [("a", 1), ("b", 2)]),
}
CONTROL: dict[str, tuple[str, list[tuple[str, int]]]] = {
    "if-then-else": ("x <- 1\nif (u > {k}) x <- 2 else x <- 3\nprint(x)", [("x", 2)]),
    "if-constant": ("x <- 1\nif (FALSE) x <- {k}\nprint(x)", [("x", 1)]),
    "switch": ("x <- 1\nswitch(u, a = x <- 2,\n  b = x <- {k})\nprint(x)", [("x", 1), ("x", 2), ("x", 3)]),
    "switch-with-default": ("x <- 1\nswitch(u, a = x <- 2,\n  x <- {k})\nprint(x)", [("x", 2), ("x", 3)]),
    "lazy-and": ("x <- 1\nu > {k} && (x <- 2)\nprint(x)", [("x", 1), ("x", 2)]),
    "for": ("x <- 0\nfor (i in 1:{k})\n  x <- x + i\nprint(x)", [("x", 1), ("x", 3)]),
    "while": ("x <- 0\nwhile (x < {k})\n  x <- x + 1\nprint(x)", [("x", 1), ("x", 3)]),
    "repeat": ("x <- 0\nrepeat {\n  x <- {k}\n  break\n}\nprint(x)", [("x", 3)]),
    "break": ("x <- 0\nfor (i in 1:3) {\n  x <- {k}\n  break\n}\nprint(x)", [("x", 1), ("x", 3)]),
    "try": ("x <- 1\ntry({\n  x <- {k}\n  stop('x')\n})\nprint(x)", [("x", 1), ("x", 3)]),
    "try-catch-finally": ("x <- 1\ntryCatch(f(),\n  finally = x <- {k})\nprint(x)", [("x", 3)]),
    "stop-if-not": ("x <- {k}\nstopifnot(x > 0)\nprint(x)", [("x", 1)]),
    "expression-list": ("{\n  x <- {k}\n}\nprint(x)", [("x", 2)]),
}
#: Scripts by kind of call, with the lines of the functions that calls of the last line lead to.
CALLS: dict[str, tuple[str, list[int]]] = {
    "function": ("f <- function(x) x\nf({k})", [1]),
    "unnamed": ("(function(x) x)({k})", [1]),
    "apply": ("f <- function(x) x + {k}\nsapply(1:3, f)", [1]),
    "apply-by-name": ('f <- function(x) x + {k}\nlapply(1:3, "f")', [1]),
    "apply-function": ("y <- {k}\nMap(function(x) x + y, 1:3)", [2]),
    "do-call": ('f <- function(x) x\ndo.call("f", list({k}))', [1]),
    "recall": ("g <- 1\nf <- function(n) if (n > 0) Recall(n - 1) else {k}", [2]),
    "s3-dispatch": ("print2 <- function(x) UseMethod('print2')\nprint2.a <- function(x) {k}\nprint2.b <- function(x) 2\nprint2(obj)", [1]),
    "s7-generic": ("area <- new_generic('area', 's')\nmethod(area, Circle) <- function(s) {k}\narea(c1)", [2]),
    "s7-constructor": ("make <- new_class('P', constructor = function(n) n)\nmake({k})", [1]),
    "class-generator": ("Acc <- R6Class('Acc', public = list(add = function(n) n))\nAcc$new({k})", [1]),
    "assignment-like": ('setGeneric("area", function(s) s)\narea({k})', [1]),
    "match-fun": ('f <- function(x) x\ng <- match.fun("f")\ng({k})', [1]),
    "returned": ("make <- function() function(q) q + {k}\nh <- make()\nh(2)", [1]),
}
#: Code in texts: scripts and the lines that the last line reads from, the inlined code's being that of the call.
TEXTS: dict[str, tuple[str, list[tuple[str, int]]]] = {
    "eval": ('eval(parse(text = "x <- {k}"))\nprint(x)', [("x", 1)]),
    "eval-quote": ("eval(quote(x <- {k}))\nprint(x)", [("x", 1)]),
    "string-template": ('a <- {k}\nb <- 2\nglue("{a} of {b}")', [("a", 1), ("b", 2)]),
    "source": ('source("lib{k}.R")\nprint(shared)', [("shared", 1)]),
}


def _files(spark: SparkSession, d: str, cases: dict) -> DataFrame:
    k = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    both = k.withColumn("x", F.explode(F.lit([f"{c}\0{code}" for c, (code, _) in cases.items()])))
    case, code = F.substring_index("x", "\0", 1), F.substring_index("x", "\0", -1)
    return both.select(F.concat(case, F.lit("-"), "k").alias("file_id"), F.replace(code, F.lit("{k}"), F.col("k").cast("string")).alias("content"))


def _sql(cases: dict, column: str) -> str:
    rows = []
    for c, (_, found) in cases.items():
        rows += [f"('{c}', '{x[0]}', {x[1]})" if isinstance(x, tuple) else f"('{c}', {x})" for x in found]
    names = f"(kind, name, {column})" if column == "line" else f"(kind, {column})"
    return f"SELECT kind, n_nationkey AS k, {'name, ' if column == 'line' else ''}{column} FROM nation, (VALUES {', '.join(rows)}) t{names}"


def _reads(p: Program) -> DataFrame:
    """kind, k, name, line: the definitions that uses on the last line of each script read."""
    last = p.nodes.where("role <> 'inlined'").groupBy("file_id").agg(F.max("sl").alias("last"))
    uses = p.nodes.join(last, "file_id").where("sl = last").select(F.col("node_id").alias("src"))
    named = p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("dst"), "name")
    edges = p.typed(G.READS).join(uses, "src", "left_semi").join(named, "dst").join(at(p, "dst"), "dst")
    return edges.select(*_case(), "name", F.col("dst_line").alias("line")).distinct()


def _case() -> list:
    return [F.regexp_replace("file_id", r"-\d+$", "").alias("kind"), F.regexp_extract("file_id", r"-(\d+)$", 1).cast("int").alias("k")]


@query(_sql(SCOPES, "line"))
def processors_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of all kinds, scopes, names in texts, containers."""
    return _reads(Program(_files(spark, d, SCOPES)))


@query(_sql(CONTROL, "line"))
def processors_control(spark: SparkSession, d: str) -> DataFrame:
    """Branches, loops, switch, try, lazy operators."""
    return _reads(Program(_files(spark, d, CONTROL)))


@query(_sql(CALLS, "target"))
def processors_calls(spark: SparkSession, d: str) -> DataFrame:
    """Which functions calls lead to: given ones, returned ones, methods, constructors, the function around."""
    p = Program(_files(spark, d, CALLS))
    last = p.nodes.groupBy("file_id").agg(F.max("sl").alias("last"))
    calls = p.nodes.join(last, "file_id").where("sl = last").select(F.col("node_id").alias("src"))
    edges = p.typed(G.CALLS).join(calls, "src", "left_semi").join(p.vertices.where("tag = 'function-definition'").select(F.col("id").alias("dst")), "dst", "left_semi").join(at(p, "dst"), "dst")
    return edges.select(*_case(), F.col("dst_line").alias("target")).distinct()


@query(_sql(TEXTS, "line"))
def processors_texts(spark: SparkSession, d: str) -> DataFrame:
    """Code in constant texts and in other files."""
    k = F.col("n_nationkey")
    library = table(spark, d, "nation").select(F.concat(F.lit("R/lib"), k, F.lit(".R")).alias("file_id"), F.concat(F.lit("shared <- "), k).alias("content"))
    p = Program(_files(spark, d, TEXTS).unionByName(library))
    return _reads(p).where("kind not like 'R/%'")


@query(
    """SELECT n_nationkey AS k, generic, method FROM nation, (VALUES (1, 2), (1, 3)) t(generic, method)"""
)
def processors_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The methods that a generic's dispatch leads to."""
    code = "show2 <- function(x) UseMethod('show2')\nshow2.a <- function(x) {k}\nshow2.default <- function(x) NextMethod()\nshow2(obj)"
    files = table(spark, d, "nation").select(F.concat(F.lit("g-"), "n_nationkey").alias("file_id"), filled(code, k=F.col("n_nationkey")).alias("content"))
    p = Program(files)
    edges = p.typed(G.CALLS).join(p.vertices.where("name = 'UseMethod'").select(F.col("id").alias("src")), "src", "left_semi").join(at(p, "src"), "src").join(at(p, "dst"), "dst")
    return edges.select(_case()[1], F.col("src_line").alias("generic"), F.col("dst_line").alias("method")).distinct()


@query("SELECT n_nationkey AS k, 4 AS line FROM nation")
def processors_hooks(spark: SparkSession, d: str) -> DataFrame:
    """on.exit() runs with the definitions at the function's end."""
    code = "f <- function() {\n  x <- 1\n  on.exit(print(x))\n  x <- {k}\n}"
    files = table(spark, d, "nation").select(F.concat(F.lit("h-"), "n_nationkey").alias("file_id"), filled(code, k=F.col("n_nationkey")).alias("content"))
    p = Program(files)
    uses = p.vertices.where("tag = 'use' and name = 'x'").select(F.col("id").alias("src"))
    edges = p.typed(G.READS).join(uses, "src", "left_semi").join(at(p, "dst"), "dst")
    return edges.select(_case()[1], F.col("dst_line").alias("line")).distinct()


@query("SELECT n_nationkey AS k, 1 AS loaded FROM nation")
def processors_load(spark: SparkSession, d: str) -> DataFrame:
    """A name that nothing defines may come from a loaded file."""
    code = 'load("data{k}.RData")\nprint(table1)'
    files = table(spark, d, "nation").select(F.concat(F.lit("l-"), "n_nationkey").alias("file_id"), filled(code, k=F.col("n_nationkey")).alias("content"))
    p = Program(files)
    uses = p.vertices.where("tag = 'use' and name = 'table1'").select(F.col("id").alias("src"))
    edges = p.typed(G.READS).join(uses, "src", "left_semi").join(p.unknown_effects.select(F.col("id").alias("dst")), "dst", "left_semi").join(at(p, "dst"), "dst")
    return edges.select(_case()[1], F.col("dst_line").alias("loaded")).distinct()


@query("SELECT n_nationkey AS k, 'pkg' || n_nationkey AS package, line FROM nation, (VALUES (1), (2)) t(line)")
def processors_library(spark: SparkSession, d: str) -> DataFrame:
    """Packages that scripts attach."""
    code = 'library(pkg{k})\nrequireNamespace("pkg{k}")'
    files = table(spark, d, "nation").select(F.concat(F.lit("p-"), "n_nationkey").alias("file_id"), filled(code, k=F.col("n_nationkey")).alias("content"))
    p = Program(files)
    return p.libraries.join(at(p, "call_id"), "call_id").select(_case()[1], "package", F.col("call_id_line").alias("line"))


@query("SELECT n_nationkey AS k, 1 AS formula, 2 AS data FROM nation")
def processors_formulas(spark: SparkSession, d: str) -> DataFrame:
    """A formula that stands for a function: the name in it that is no parameter is read where the formula is made."""
    code = "data <- {k}\nextra <- 3\nmap(data, ~ .x + extra)"
    files = table(spark, d, "nation").select(F.concat(F.lit("f-"), "n_nationkey").alias("file_id"), filled(code, k=F.col("n_nationkey")).alias("content"))
    p = Program(files)
    uses = p.vertices.where("tag = 'use' and name = 'extra'").select(F.col("id").alias("src"))
    lambdas = p.vertices.where("tag = 'function-definition'").select("file_id", F.lit(1).alias("formula"))
    edges = p.typed(G.READS).join(uses, "src", "left_semi").join(at(p, "dst"), "dst").select("file_id", F.col("dst_line").alias("data"))
    return edges.join(lambdas, "file_id").select(_case()[1], "formula", "data").distinct()


@query("SELECT n_nationkey AS k, line FROM nation, (VALUES (3), (5)) t(line)")
def processors_exits(spark: SparkSession, d: str) -> DataFrame:
    """What follows return(), stop() and stopifnot(FALSE) is not reached."""
    code = "f <- function() {\n  return({k})\n  1\n}\ng <- function() { stop('x'); 2 }\nh <- 3"
    files = table(spark, d, "nation").select(F.concat(F.lit("e-"), "n_nationkey").alias("file_id"), filled(code, k=F.col("n_nationkey")).alias("content"))
    p = Program(files)
    return p.dead_code().join(at(p, "id"), "id").select(_case()[1], F.col("id_line").alias("line")).distinct()
