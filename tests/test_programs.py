"""Programs: what is not said by queries with SQL."""

import pytest
from pyspark.sql import functions as F

from skein.frontend.dataflow import analyse
from skein.frontend.program import Program
from skein.frontend.values import Values
from skein.operators import graph as G
from skein.operators.queries import QUERIES
from skein.operators.search import Search
from skein.plans.processors import CALLS, CONTROL, SCOPES, TEXTS


def places(flow):
    out, todo = {}, [flow.root]
    while todo:
        n = todo.pop()
        out[n.id] = n.start[0]
        todo += [c for _, c in n.children]
    return out


@pytest.mark.parametrize("kind", [*SCOPES, *CONTROL, *TEXTS])
def test_reads_of_the_last_line(kind):
    code, want = {**SCOPES, **CONTROL, **TEXTS}[kind]
    flow = analyse(code.replace("{k}", "3"), {"lib3.R": "shared <- 3"})
    at = places(flow)
    last = max(at.values())
    got = {(flow.vertices[d][1], at[d]) for (s, d), b in flow.edges.items() if b & G.READS and at[s] == last and flow.vertices[d][0] == "variable-definition"}
    assert got == set(want)


@pytest.mark.parametrize("kind", CALLS)
def test_functions_that_the_last_line_calls(kind):
    code, want = CALLS[kind]
    flow = analyse(code.replace("{k}", "3"))
    at = places(flow)
    got = {at[d] for (s, d), b in flow.edges.items() if b & G.CALLS and at[s] == max(at.values()) and flow.vertices[d][0] == "function-definition"}
    assert got == set(want)


def test_kinds_are_data():
    """A caller may say what calls of a name do."""
    code = "x <- 1\nforget(x)\nprint(x)"
    reads = lambda flow: any(b & G.READS and flow.vertices[s][1] == "x" and places(flow)[s] == 3 for (s, _), b in flow.edges.items())
    assert reads(analyse(code)) and not reads(analyse(code, kinds={"forget": "rm"}))


def test_effects_of_functions_that_a_function_calls():
    flow = analyse("n <- 0\nset <- function() n <<- 1\nouter <- function() set()\nouter()\nprint(n)")
    at = places(flow)
    assert {at[d] for (s, d), b in flow.edges.items() if b & G.READS and at[s] == 5 and at[d] < 5} == {1, 2}


def test_sources_in_a_ring():
    flow = analyse("source('a.R')\nprint(x)", {"a.R": "x <- 1\nsource('b.R')", "b.R": "source('a.R')\nx <- 2"})
    assert flow.sourced and any(v[1] == "x" for v in flow.vertices.values())


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("x <- 2 ^ 3 %% 5", {3.0}),
        ("x <- -7 %/% 2", {-4}),
        ("x <- c(1, 2) + 1", {(2.0, 3.0)}),
        ("x <- paste('a', c('b', 'c'), sep = '-', collapse = '+')", {"a-b+a-c"}),
        ("x <- file.path('a', basename('b/c.txt'))", {"a/c.txt"}),
        ("x <- if (u) 1 else 2", {1.0, 2.0}),
        ("x <- if (TRUE) 1 else 2", {1.0}),
        ("f <- function() 5\nx <- f() + 1", {6.0}),
        ("f <- function(p) p\nx <- f(1)", None),
        ("x <- 1\nwhile (u) x <- x + 1", None),
        ("x <- 3:1", {(3.0, 2.0, 1.0)}),
        ("x <- 1 / 0", None),
        ("x <- nchar(toupper('abc'))", {3}),
        ("x <- bitwAnd(12L, 10L)", {8}),
    ],
)
def test_constants(code, want):
    flow = analyse(code)
    at = places(flow)
    uses = analyse(code + "\nprint(x)")
    last = [i for i, v in uses.vertices.items() if v[0] == "use" and v[1] == "x"][-1]
    found = Values(uses).of(last)
    assert at and (found == want if want is None else set(found) == want)


@pytest.fixture(scope="module")
def odd(spark):
    code = {
        "s3://bucket/a.R": "x <- 1\nprint(x)\n",
        "deep": "x <- " + "(" * 20_000 + "1" + ")" * 20_000,
        "chain": "x <- " + " + ".join(["1"] * 20_000),
        "long": "\n".join(f"x{i} <- {i}" for i in range(5_000)),
        "bad": "x <- '\\U99999999'\ny <- 1",
        "empty": "",
        "null": None,
        "same/a.R": "x <- 2\nprint(x)\n",
    }
    return Program(spark.createDataFrame(list(code.items()), "file_id string, content string"))


def test_no_file_stops_another(odd):
    files = {x.file_id for x in odd.nodes.select("file_id").distinct().collect()}
    assert files == {"s3://bucket/a.R", "deep", "chain", "long", "bad", "empty", "null", "same/a.R"}
    assert {x.file_id for x in odd.syntax_errors().collect()} == {"bad"}


def test_long_straight_scripts_are_alive(odd):
    assert odd.dead_code().count() == 0


def test_files_with_like_names_stay_apart(odd):
    got = QUERIES["happens-before"](odd, "1@x", "2@x").collect()
    assert sorted((x.file_id, x.before) for x in got) == [("s3://bucket/a.R", True), ("same/a.R", True)]
    ids = odd.slice("2@x").select("file_id").distinct().collect()
    assert {x.file_id for x in ids} == {"s3://bucket/a.R", "same/a.R"}


def test_closure_has_no_last_round(spark):
    chain = spark.range(40).selectExpr("id as src", "id + 1 as dst", "1 as types").unionByName(spark.range(1).selectExpr("100 as src", "101 as dst", "1 as types"))
    got = {x.id: x.depth for x in G.closure(chain, spark.range(1)).collect()}
    assert got == {i: i for i in range(41)}


def test_rings_have_no_head(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "src long, dst long")
    assert {x.id: x.block for x in G.basic_blocks(ring).collect()} == {1: 1, 2: 2, 3: 3, 9: 9, 8: 9}


def test_patterns_that_are_none(odd):
    for text in ("RSymbol", "(RSymbol", "(RSymbol) (RSymbol)"):
        with pytest.raises(ValueError):
            Search(odd.nodes).syntax(text)
    with pytest.raises(ValueError):
        Search(odd.nodes).criterion("nonsense")


def test_code_keeps_marked_lines(spark):
    code = "a <- 1\nb <- 2 # keep\n# keep-start\nc <- 3\n# keep-end\nd <- 4\nprint(a)\n"
    p = Program(spark.createDataFrame([("f", code)], "file_id string, content string"))
    assert p.code(p.slice("7@a")).first().code == "a <- 1\nb <- 2 # keep\n# keep-start\nc <- 3\n# keep-end\nprint(a)"
    assert p.code(p.slice("7@a"), keep=None).first().code == "a <- 1\nprint(a)"


def test_callees_of_a_slice(spark):
    code = "f <- function(v) {\n  v + 1\n}\ng <- function() f(2)\nx <- g()\n"
    p = Program(spark.createDataFrame([("f", code)], "file_id string, content string"))
    lines = lambda ids: {x.line for x in p.lines(ids).collect()}
    assert 4 not in lines(p.slice("2@v")) and 4 in lines(p.slice("2@v", callees=True))


def test_quick_fixes(spark):
    from skein.operators.queries import fixed

    code = "x <- rnorm(3)\ncon <- file('a')\nreadLines(con)\nif (u) stop('x')\n"
    p = Program(spark.createDataFrame([("f", code)], "file_id string, content string"))
    got = fixed(p, QUERIES["linter"](p, ["stop-call", "seeded-randomness", "unclosed-connection"])).first().content
    assert got == "set.seed(1)\nx <- rnorm(3)\ncon <- file('a')\nreadLines(con)\nclose(con)\nif (u) stop('x', call. = FALSE)\n"
    again = Program(spark.createDataFrame([("f", got)], "file_id string, content string"))
    assert QUERIES["linter"](again, ["stop-call", "seeded-randomness", "unclosed-connection"]).count() == 0


def test_connections_that_one_branch_closes(spark):
    code = "con <- file('a')\nif (u) close(con)\nd <- file('b')\nif (u) close(d) else close(d)\n"
    p = Program(spark.createDataFrame([("f", code)], "file_id string, content string"))
    found = QUERIES["linter"](p, ["unclosed-connection"]).join(p.nodes.select(F.col("node_id").alias("id"), "sl"), "id")
    assert [(x.sl, x.certainty) for x in found.collect()] == [(1, "uncertain")]
