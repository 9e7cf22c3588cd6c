"""Readers of project files."""

import json

import pytest

from skein.sources import files as S
from skein.sources import writers as W

RMD = "---\ntitle: x\n---\n\n```{r setup, echo=FALSE}\nx <- 1\ny <- 2\n```\ntext\n```{python}\nprint(1)\n```\n```{r}\nz <- x\n```\n"
DESCRIPTION = """Package: demo
Version: 1.2.3
Authors@R: c(person("Ada", "Byron", email = "ada@example.org", role = c("aut", "cre")),
    person(given = "Max", family = "Muster", role = "ctb"))
License: MIT + file LICENSE
Depends: R (>= 4.1.0)
Imports: dplyr (>= 1.0.0),
    rlang, stats
"""


@pytest.fixture(scope="module")
def frame(spark):
    return lambda text, path="f": spark.createDataFrame([(path, text)], "path string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rmarkdown(frame):
    got = S.rmarkdown(frame(RMD)).orderBy("chunk").collect()
    assert [(x.engine, x.options, x.code, x.line) for x in got] == [("r", "setup, echo=FALSE", "x <- 1\ny <- 2\n", 6), ("python", "", "print(1)\n", 11), ("r", "", "z <- x\n", 14)]


def test_sweave(frame):
    text = "\\begin{document}\n<<a, echo=T>>=\nx <- 1\n@\ntext\n<<>>=\ny <- 2\n"
    assert rows(S.sweave(frame(text))) == [("f", 0, "a, echo=T", "x <- 1\n"), ("f", 1, "", "y <- 2\n")]


def test_jupyter(frame):
    book = {"cells": [{"cell_type": "markdown", "source": ["# x"]}, {"cell_type": "code", "source": ["x <- 1\n", "y"]}, {"cell_type": "code", "source": "z"}]}
    assert rows(S.jupyter(frame(json.dumps(book)))) == [("f", 0, "x <- 1\ny"), ("f", 1, "z")]


def test_description(frame):
    fields = S.dcf(frame(DESCRIPTION))
    assert rows(S.dependencies(fields)) == [("f", "Depends", "R", ">= 4.1.0"), ("f", "Imports", "dplyr", ">= 1.0.0"), ("f", "Imports", "rlang", None), ("f", "Imports", "stats", None)]
    assert rows(S.authors(fields)) == [("f", "Ada Byron", "ada@example.org", ["aut", "cre"]), ("f", "Max Muster", None, ["ctb"])]
    assert rows(S.licenses(fields)) == [("f", "MIT"), ("f", "file LICENSE")]


def test_namespace(frame):
    text = "# made by hand\nexport(a, \"b\")\nimportFrom(stats, sd)\nS3method(print, demo)\n"
    assert rows(S.namespace(frame(text))) == [("f", "S3method", ["print", "demo"]), ("f", "export", ["a", "b"]), ("f", "importFrom", ["stats", "sd"])]


def test_news(frame):
    text = "# demo 1.1.0\n\n* one\n* two\n\n# demo 1.0\n- three\n"
    assert rows(S.news(frame(text))) == [("f", "1.0", "three"), ("f", "1.1.0", "one"), ("f", "1.1.0", "two")]


def test_lock_files(frame):
    lock = {"R": {"Version": "4.3"}, "Packages": {"dplyr": {"Package": "dplyr", "Version": "1.1.0", "Source": "Repository"}}}
    assert rows(S.renv(frame(json.dumps(lock)))) == [("f", "dplyr", "1.1.0", "Repository")]
    assert rows(S.packrat(frame("PackratFormat: 1.4\n\nPackage: a\nSource: CRAN\nVersion: 2.0\n"))) == [("f", "a", "2.0", "CRAN")]
    leaves = S.toml(frame('[[packages]]\nname = "a"\nversion = "1.0"\n[[packages]]\nname = "b"\nversion = "2"\n'))
    assert rows(S.toml_packages(leaves)) == [("f", "a", "1.0"), ("f", "b", "2")]
    assert rows(S.toml_packages(S.toml(frame('[dependencies]\ndplyr = ">= 1.0"\n')))) == [("f", "dplyr", ">= 1.0")]
    assert S.toml(frame("not = = toml")).count() == 0


def test_session_info(frame):
    text = "R version 4.3.1 (2023-06-16)\nattached base packages:\n[1] stats\nother attached packages:\n[1] dplyr_1.1.2 ggplot2_3.4.2\n"
    assert rows(S.session_info(frame(text))) == [("f", "R", "4.3.1"), ("f", "dplyr", "1.1.2"), ("f", "ggplot2", "3.4.2")]


def test_discovery(spark, tmp_path):
    for name in ("R/a.R", "tests/testthat/test-a.R", "DESCRIPTION", "data/x.rda", "notes.txt", "tmp/b.R", ".git/c.R", "old/d.R"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {x.path: x.role for x in S.discover(spark, str(tmp_path), ignore=["tmp/", "# no"], build_ignore=["^old$|^old/"]).collect()}
    assert got == {"R/a.R": "source", "tests/testthat/test-a.R": "test", "DESCRIPTION": "description", "data/x.rda": "data"}
    assert S.request(spark, "x <- 1", f"file://{tmp_path}/R/a.R").count() == 2


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1,5;a\n2;b\n")
    assert rows(S.read(spark, "read.csv2", str(tmp_path / "a.csv"))) == [("1.5", "a"), ("2", "b")]
    (tmp_path / "b.txt").write_text("1  a\n22 b\n")
    assert rows(S.read_table(spark, str(tmp_path / "b.txt"), names=["n", "c"])) == [("1", "a"), ("22", "b")]
    assert rows(S.read_fixed(spark, str(tmp_path / "b.txt"), widths={"n": 3, "c": 1})) == [("1", "a"), ("22", "b")]


def test_loading_order(spark):
    files = spark.createDataFrame([("R/z.R",), ("R/a.R",), (".Rprofile",), ("R/m.R",)], "path string")
    assert [x.path for x in S.loading_order(files, ["z.R", "a.R"]).orderBy("place").collect()] == [".Rprofile", "R/z.R", "R/a.R", "R/m.R"]


def test_writers(spark):
    found = spark.createDataFrame([("r", "certain", 'say "x"', "a.R", 1, 2, 3, 4)], "rule string, certainty string, message string, path string, sl int, sc int, el int, ec int")
    assert json.loads(W.sarif(found).first()[0])["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 2, "endLine": 3, "endColumn": 5}
    assert W.annotations(found).first()[0] == '::warning file=a.R,line=1,col=2,title=r::say "x"'
    assert sorted(x.quad for x in W.row_quads(spark.createDataFrame([(1, 'a"b', None)], "id int, t string, n string"), "id", "g").collect()) == ['<urn:1> <urn:t> "a\\"b" <urn:g> .']
    text = spark.sql("select 'hello world' as t, array(named_struct('start', 0, 'end', 5, 'text', 'bye'), named_struct('start', 6, 'end', 11, 'text', 'all')) as e")
    assert text.select(W.applied(text.t, text.e)).first()[0] == "bye all"
