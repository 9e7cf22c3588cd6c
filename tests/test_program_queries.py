"""Queries over programs."""

import pytest

from skein.frontend.program import Program
from skein.operators.queries import QUERIES, run

CODE = {
    "a": "library(dplyr)\nd <- read.csv('data.csv')\nx <- 3\ny <- if (runif(1) > 0.5) x else 4\nprint(y)\nwrite.csv(d, 'out.csv')\n",
    "b": "f <- function(n) if (n > 0) f(n - 1) else stop('no')\ng <- function(h) h(2)\nk <- function() tryCatch(stop('x'))\nf(2)\ng(function(z) z)\nplot(1)\nlines(2)\nplot(3)\nlines(4)\n",
    "c": "password <- 'hunter22'\np <- '/home/me/x.csv'\nfor (i in 5) print(i)\nstop('x')\nprint(undefined_thing)\n",
}


@pytest.fixture(scope="module")
def program(spark):
    return Program(spark.createDataFrame(list(CODE.items()), "file_id string, content string"))


def names(program, ids):
    at = {x.id: x.name for x in program.vertices.collect()}
    return sorted(str(at.get(i)) for i in ids)


def test_dependencies(program):
    got = {(x.category, x.name, x.value) for x in QUERIES["dependencies"](program).where("file_id = 'a'").collect()}
    assert got >= {("library", "library", "dplyr"), ("read", "read.csv", "data.csv"), ("write", "print", None)}


def test_call_context(program):
    got = QUERIES["call-context"](program, [("in", "csv", "^read"), ("out", "any", "print|write.*")]).where("file_id = 'a'").collect()
    assert sorted((x.kind, x.name) for x in got) == [("in", "read.csv"), ("out", "print"), ("out", "write.csv")]
    assert {x.name for x in QUERIES["call-context"](program, [("k", "s", "^[fg]$")], targets="local").collect()} == {"f", "g"}


def test_last_call(program):
    at = {x.node_id: x.sl for x in program.nodes.collect()}
    got = QUERIES["link-to-last-call"](program, "lines", "plot").collect()
    assert sorted((at[x.id], at[x.last]) for x in got) == [(7, 6), (9, 8)]


def test_functions(program):
    defs = {x.node_id: x.sl for x in program.nodes.where("file_id = 'b' and type = 'RFunctionDefinition'").collect()}
    assert {defs[x.id]: x.recursive for x in QUERIES["inspect-recursion"](program).collect()} == {1: True, 2: False, 3: False, 5: False}
    assert {defs[x.function] for x in QUERIES["inspect-exception"](program).collect()} == {1}
    assert {defs[x.id]: x.higher_order for x in QUERIES["inspect-higher-order"](program).collect()}[2] is True
    assert [x.calls for x in QUERIES["does-call"](program, "f", ["stop", "print"]).collect()] == [True]
    assert [x.calls for x in QUERIES["does-call"](program, "f", ["stop", "print"], every=True).collect()] == [False]


def test_values(program):
    p = program
    assert [x["values"] for x in QUERIES["resolve-value"](p, ["3@x"]).where("id like 'a:%'").collect()] == [["3"]]
    kinds = {x.kind for x in QUERIES["input-sources"](p, ["5@y"]).where("id like 'a:%'").collect()}
    assert kinds == {"const", "rand"}


def test_linter(program):
    got = {(x.rule, x.file_id) for x in QUERIES["linter"](program).collect()}
    assert {("no-leaked-credentials", "c"), ("absolute-file-paths", "c"), ("useless-loop", "c"), ("stop-call", "c"), ("undefined-symbol", "c"), ("seeded-randomness", "a"), ("dead-code", "c")} <= got


def test_order(program):
    assert [x.before for x in QUERIES["happens-before"](program, "2@d", "6@d").where("a like 'a:%' and b like 'a:%'").collect()] == [True]
    assert [x.before for x in QUERIES["happens-before"](program, "6@d", "2@d").where("a like 'a:%' and b like 'a:%'").collect()] == [False]


def test_run_isolates_errors(program):
    out = run(program, [{"type": "id-map"}, {"type": "no such query"}, {"type": "compound", "query": "location-map", "arguments": [{"ids": ["a:0"]}, {"ids": ["b:0", "b:1"]}]}])
    assert out[0].count() > 0 and isinstance(out[1], KeyError) and [x.count() for x in out[2:]] == [1, 2]
    for name in ("dataflow", "dataflow-lens", "normalized-ast", "control-flow", "dataflow-cluster", "call-graph"):
        assert QUERIES[name](program).count() > 0
    assert QUERIES["provenance"](program, ["5@y"]).count() > 0 and QUERIES["origin"](program, ["5@y"]).count() > 0
    assert QUERIES["dice"](program, ["3@x"], ["5@y"]).count() > 0 and QUERIES["static-slice"](program, ["5@y"], code=True).count() > 0


def test_strictness(spark):
    code = "f <- function(a, b, c, d) {\n  if (a > 0) {\n    x <- b + c\n  } else {\n    x <- b\n  }\n  x\n}\n"
    p = Program(spark.createDataFrame([("s", code)], "file_id string, content string"))
    assert {x.param: x.strict for x in QUERIES["inspect-strictness"](p).collect()} == {"a": True, "b": True, "c": None, "d": False}


def test_project_queries(spark, program):
    from skein.operators.signatures import EXPORTED, Signatures

    listing = spark.createDataFrame([("R/a.R", "source"), ("LICENSE", "license")], "path string, role string")
    assert QUERIES["files"](program, listing, roles=["license"]).count() == 1
    assert ("files:source", "1") in {tuple(x) for x in QUERIES["project"](program, listing).collect()}
    db = Signatures.of(spark, pkg_version=[("dplyr", "0.5", None), ("dplyr", "1.0", None)], fn=[("dplyr", "1.0", "undefined_thing2", EXPORTED)])
    got = QUERIES["guess-dep-versions"](program, db, spark.createDataFrame([("dplyr", ">= 0.9")], "pkg string, constraint string")).collect()
    assert [(x.pkg, x.lowest) for x in got] == [("dplyr", "1.0")]
    assert QUERIES["signature"](program, db, package="dp*").first().newest == "1.0"
    sources = spark.createDataFrame([("z", "x <- data.frame(a = 1:3)")], "file_id string, content string")
    assert QUERIES["absint"](program, sources, ["x"]).first().rows_hi == 3.0
    assert QUERIES["config"](program).count() > 0
    assert QUERIES["search"](program, lambda s: s.get(name="x", path=None).take(2)).count() == 2


def test_more_rules(spark):
    code = (
        "#' Adds.\n#' @param x a number\n#' @param z no such thing\nadd <- function(x, y) x + y\n"
        "cmd <- 'ls'\nsystem(cmd)\nrun <- function(u) eval(u)\ncon <- file('x.txt')\nd <- read.csv('gone.csv')\ne <- read.csv('here.csv')\nsapply(1, add)\n"
    )
    p = Program(spark.createDataFrame([("r", code)], "file_id string, content string"))
    listing = spark.createDataFrame([("here.csv", "data"), ("LICENSE", "license")], "path string, role string")
    old = spark.createDataFrame([("sapply", None)], "name string, since string")
    rules = ["problematic-inputs", "roxygen-arguments", "unclosed-connection", "file-path-validity", "software-has-license", "software-has-tests", "deprecated-functions"]
    at = {x.node_id: x.sl for x in p.nodes.collect()}
    got = sorted({(x.rule, at.get(x.id)) for x in QUERIES["linter"](p, rules, listing, old).collect()}, key=str)
    want = {("problematic-inputs", 7), ("roxygen-arguments", 4), ("unclosed-connection", 8), ("file-path-validity", 9), ("software-has-tests", None), ("deprecated-functions", 11)}
    assert {x for x in got if x[0] != "file-path-validity"} | {x for x in got if x == ("file-path-validity", 9)} == want
