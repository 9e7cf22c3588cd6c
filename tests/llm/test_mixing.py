"""Mixing: targets by repeated sharing, and what the mix takes."""

import math
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing
from skein.llm.common import documents
from skein.storage import stored


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """source -> target, by giving excesses away until there are none."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= set(over)


def check(docs, near):
    got = mixing.mixed(docs).collect()
    source = {}
    for x in docs.collect():
        source.setdefault((x.doc_id, words(x.text)), x.source)
    of, taken = {}, {}
    for x in docs.collect():
        of[x.source] = of.get(x.source, 0) + words(x.text)
    want = brute_targets(of)
    for x in got:
        s = source[x.doc_id, x["size"]]
        assert x.source_size == of[s] and x.target == pytest.approx(want[s])
        assert 0 <= x.taken <= 3 * x["size"] and x.taken == x.copies * x["size"]
        taken[s] = taken.get(s, 0) + x.taken
    assert len(got) == docs.count()
    for s in of:
        longest = max((words(x.text) for x in docs.collect() if x.source == s), default=0)
        assert abs(taken[s] - want[s]) <= max(near * want[s], longest)
    return got


def test_targets_and_taken_words(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    first = check(docs, 0.03)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))


def test_odd_rows(odd):
    check(odd.select("doc_id", "text", "source").distinct(), 0.5)
    assert mixing.mixed(odd).count() == odd.count()


def test_hot_source_and_limits(spark):
    rows = [(i, "w " * (3 + i % 11), "hot" if i % 3 else f"s{i % 9}") for i in range(600)] + [(1000, "one", "aaa"), (1001, None, "zero")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.03)


def test_expanded_repeats_rows(odd):
    taken = {(x.doc_id, x["size"]): x.copies for x in mixing.mixed(odd).collect()}
    out = mixing.expanded(odd)
    assert out.columns == odd.columns
    n = {(x.doc_id, x.n): x["count"] for x in out.groupBy("doc_id", F.length("text").alias("n")).count().collect()}
    for x in odd.where("doc_id is not null and doc_id <> 2").collect():
        assert n.get((x.doc_id, len(x.text) if x.text is not None else None), 0) == taken[x.doc_id, words(x.text)]


def test_empty_table(none):
    assert mixing.mixed(none).count() == 0 and mixing.expanded(none).count() == 0


def test_plan_has_no_python(spark):
    plan = mixing.mixed(documents(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_by_brute_force(spark):
    """Rates from bisection, copies by sorting each source's keys and filling what is left."""
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "source")
    sized = stored(mixing.sizes(docs), "sized")
    known = mixing.plan(sized)
    rows = {}
    for x in mixing._rated(sized, known.drop("cut", "picks"), 3, 42).collect():
        rows.setdefault(x.source, []).append(x)
    got = {x.doc_id: x.copies for x in mixing.mixed(docs).collect()}
    for own in rows.values():
        scale, target = own[0].scale, own[0].target
        rate = lambda l, size: min(3.0, math.exp(max(min(l * size / scale, 2), -700))) if size else 0.0  # noqa: B023, E731, E741
        low, high = -700.0, 1 + math.log(3) * scale / min(x["size"] for x in own if x["size"])
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(rate(mid, x["size"]) * x["size"] for x in own) < target else (low, mid)
        assert [x.rate for x in own] == pytest.approx([rate(high, x["size"]) for x in own], rel=1e-6, abs=1e-9)
        copies = {x.doc_id: x.base for x in own}
        short, beyond = target - sum(x.base * x["size"] for x in own), []
        for x in sorted((x for x in own if x.open), key=lambda x: x.key):
            if not beyond and x["size"] <= short:
                copies[x.doc_id] += 1
                short -= x["size"]
            else:
                beyond.append(x)
        for i in range(mixing.FILLS):
            far = short * 2 if i == mixing.FILLS - 1 else short
            fits = [x for x in beyond if 0 < x["size"] <= far]
            if fits:
                best = max(fits, key=lambda x: (-abs(x["size"] - short), x.key, x["size"]))
                beyond.remove(best)
                copies[best.doc_id] += 1
                short -= best["size"]
        assert {x.doc_id: got[x.doc_id] for x in own} == copies


def test_rows_without_id_are_taken_one_by_one(spark):
    rows = [(None, f"text number {i} of some", "a") for i in range(300)] + [(i, "b " * 5, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for x in mixing.mixed(docs).collect():
        taken[x.source_size] = (taken.get(x.source_size, (0, 0))[0] + x.taken, x.target)
    assert all(abs(n - target) <= 5 for n, target in taken.values())
