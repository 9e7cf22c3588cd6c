"""Readers, steps and formats by key; records and binary documents."""

import pytest

from skein import registry
from skein.sources import bson


def test_steps_run_after_what_they_need():
    seen = []
    steps = registry.Steps().add("c", lambda a, b: a + b, ["a", "b"]).add("b", lambda a: seen.append("b") or a * 2, ["a"]).add("a", lambda: seen.append("a") or 1).add("d", lambda: seen.append("d"))
    steps.decorate("b", lambda x: x + 10)
    assert steps.order().index("a") < steps.order().index("b") < steps.order().index("c")
    assert steps.run("c")["c"] == 13 and seen == ["a", "b"]
    assert steps.run("c", a=5)["c"] == 25


def test_steps_that_cannot_run():
    with pytest.raises(ValueError):
        registry.Steps().add("a", lambda b: b, ["b"]).add("b", lambda a: a, ["a"]).order()
    with pytest.raises(ValueError):
        registry.Steps().add("a", lambda x: x, ["nowhere"]).run()
    with pytest.raises(ValueError):
        registry.Steps().add("a", int).add("a", int)


def test_unknown_formats(spark):
    with pytest.raises(ValueError):
        registry.rendered(None, "ast", "paper")


def test_documents():
    value = {"n": None, "t": True, "i": 7, "l": 1 << 40, "d": 0.5, "s": "é\0x"[:1], "a": [1, "x", None], "o": {"k": -1}, "empty": ""}
    assert bson.parsed(bson.document(value)) == value
    # the length comes first, a zero byte last
    raw = bson.document({"i": 1})
    assert raw == b"\x0c\0\0\0\x10i\0\x01\0\0\0\0"


def test_readers_by_key(spark):
    files = spark.createDataFrame([("DESCRIPTION", "Package: a\nVersion: 1.0\nImports: b (>= 2)\n"), ("x/DESCRIPTION", "Package: c\nVersion: 0.1\n")], "path string, content string")
    got = registry.versions(files, ["versions:description", "versions:library"])
    assert sorted((x.origin, x.package, x.version) for x in got.collect()) == [("versions:description", "b", ">= 2"), ("versions:library", "a", "1.0"), ("versions:library", "c", "0.1")]
    for key in ("file:description", "meta:description", "file:license"):
        registry.PLUGINS[key](files).collect()
