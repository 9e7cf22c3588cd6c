"""Signatures and versions."""

from datetime import date

import pytest

from skein.operators.signatures import DEPRECATED, EXPORTED, INTERNAL, Signatures


@pytest.fixture(scope="module")
def db(spark):
    d = date
    return Signatures.of(
        spark,
        pkg_version=[("a", "1.0", d(2020, 1, 1)), ("a", "1.10", d(2022, 1, 1)), ("a", "1.9", d(2021, 1, 1)), ("b", "1.0", d(2020, 1, 1)), ("b", "2.0", d(2021, 6, 1)), ("c", "0.1", d(2020, 1, 1))],
        fn=[("a", "1.10", "f", EXPORTED), ("a", "1.10", "g", INTERNAL), ("a", "1.9", "f", EXPORTED), ("a", "1.0", "old", EXPORTED | DEPRECATED), ("b", "2.0", "f", EXPORTED), ("b", "1.0", "h", EXPORTED)],
        fn_param=[("a", "1.10", "f", "x", 0, True), ("a", "1.10", "f", "y", 1, False)],
        fn_callee=[("a", "1.10", "f", "g"), ("a", "1.10", "g", "h"), ("a", "1.10", "h", "g")],
        pkg_dep=[("a", "1.10", "b", "Imports", ">= 2.0"), ("a", "1.9", "b", "Imports", ">= 1.0"), ("a", "1.0", "missing", "Imports", None), ("b", "2.0", "c", "Imports", ">= 1.0")],
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions(db):
    assert rows(db.packages("?")) == [("a", 3, "1.10"), ("b", 2, "2.0"), ("c", 1, "0.1")]
    assert rows(db.version("a")) == [("a", "1.10")] and rows(db.version("a", "2021-12-31")) == [("a", "1.9")]


def test_functions(db):
    found = db.functions("a", "f*").collect()
    assert [(x.version, x.name, [p.param for p in x.params], x.required) for x in found] == [("1.10", "f", ["x", "y"], 1)]
    assert rows(db.owners().where("name = 'f'")) == [("f", ["a", "b"])]
    assert rows(db.callees("a", "f", "1.10")) == [("g",), ("h",)]
    assert db.exports().where("pkg = 'a' and version = '1.0'").first().deprecated == ["old"]


def test_feasible_versions(spark, db):
    wanted = spark.createDataFrame([("a", None)], "pkg string, constraint string")
    # b 2.0 needs a c that does not exist, so a 1.10, which needs b 2.0, falls too
    assert rows(db.feasible(wanted)) == [("a", "1.0"), ("a", "1.9"), ("b", "1.0"), ("c", "0.1")]
    narrow = spark.createDataFrame([("a", ">= 1.5")], "pkg string, constraint string")
    used = spark.createDataFrame([("a", "f")], "pkg string, name string")
    assert rows(db.feasible(narrow, used)) == [("a", "1.9"), ("b", "1.0"), ("c", "0.1")]
    assert ("a", "1.0") in rows(db.feasible(wanted, date="2020-06-01")) and ("a", "1.9") not in rows(db.feasible(wanted, date="2020-06-01"))
    ok = db.feasible(wanted)
    assert rows(db.candidates(ok, 1)) == [("a", "1.9", 1), ("b", "1.0", 1), ("c", "0.1", 1)]
    assert rows(db.ranges(ok))[0] == ("a", "1.0", "1.9", 2) and int(db.combinations(ok).first()[0]) == 2


def test_sources_and_storage(spark, db, tmp_path):
    other = Signatures.of(spark, pkg_version=[("a", "9.0", date(2024, 1, 1)), ("z", "1.0", date(2024, 1, 1))])
    assert rows(Signatures.merged(db, other).packages()) == [("a", 3, "1.10"), ("b", 2, "2.0"), ("c", 1, "0.1"), ("z", 1, "1.0")]
    db.write(str(tmp_path / "db"), 4)
    assert rows(Signatures.read(spark, str(tmp_path / "db")).packages("a")) == [("a", 3, "1.10")]
