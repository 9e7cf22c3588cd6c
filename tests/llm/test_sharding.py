"""Shards: sizes, groups and slots."""

import zlib

import pytest

from skein.llm import sharding
from skein.llm.common import documents


def check(docs, shards=16):
    text = [(x.doc_id, x.text) for x in docs.collect()]
    got = sharding.sharded(docs, shards).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text)
    assert sorted((str(x.doc_id), x["size"], x.text_crc32) for x in got) == want
    of, slots, sizes = {}, {}, {}
    for x in got:
        of.setdefault((x["size"], x.text_crc32), set()).add(x.shard)
        slots.setdefault(x.shard, []).append(x.slot)
        sizes[x.shard] = sizes.get(x.shard, 0) + x["size"]
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < shards
    assert all(len(v) == 1 for v in of.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes


def test_shards_are_near_equal(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    sizes = check(docs)
    assert len(sizes) == 16 and max(sizes.values()) < 1.06 * sum(sizes.values()) / 16 and min(sizes.values()) > 0.94 * sum(sizes.values()) / 16


def test_reruns_agree(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(str, sharding.sharded(x).collect())) for x in (docs, docs.repartition(5)))
    assert a == b


def test_odd_rows(odd):
    check(odd)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_copies_stay_together(spark, shards):
    rows = [(i, "copy of one text") for i in range(300)] + [(1000 + i, f"text {i} " * (i % 7 + 1)) for i in range(500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), shards)


def test_empty_table(none):
    assert sharding.sharded(none).count() == 0


def brute_tree(rows, shards):
    """row number -> shard, by sorting each node's rows along its widest dimension and cutting at the weighted median."""
    full = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in sharding.DIMENSIONS}

    def split(own, leaves, first):
        if leaves == 1:
            return {r["n"]: first for r in own}
        wide = {d: max(r[d] for r in own) - min(r[d] for r in own) for d in sharding.DIMENSIONS}
        best = max(sharding.DIMENSIONS, key=lambda d: (wide[d] / max(full[d], 1), -sharding.DIMENSIONS.index(d)))
        keys = {}
        for r in own:
            k = r[best] * sharding.HASHES + r["tie"]
            keys[k] = keys.get(k, 0) + r["size"]
        total = sum(keys.values())
        aim, below, cut = total * (leaves // 2) / leaves, 0, None
        for k in sorted(keys):
            if below + keys[k] >= aim:
                take = (below + keys[k] - aim <= aim - below or below == 0) and below + keys[k] < total
                cut, left = (k, below + keys[k]) if take else (k - 1, below)
                break
            below += keys[k]
        if cut is None or not 0 < left < total:
            return {r["n"]: first for r in own}
        n = min(max(round(leaves * left / total), 1), leaves - 1)
        side = lambda r: r[best] * sharding.HASHES + r["tie"] <= cut
        return split([r for r in own if side(r)], n, first) | split([r for r in own if not side(r)], leaves - n, first + n)

    return split(rows, shards, 0)


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_cuts_by_sorting(spark, shards):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [x.asDict() | {"n": i} for i, x in enumerate(sharding.points(docs).collect())]
    want = brute_tree(rows, shards)
    got = {(x.doc_id, x.text_crc32): x.shard for x in sharding.sharded(docs, shards).collect()}
    assert got == {(r["doc_id"], r["text_crc32"]): want[r["n"]] for r in rows}


def test_one_text_outweighs_a_shard(spark):
    rows = [(i, "z" * 100_000 if i < 3 else f"text {i}") for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_many_rows_without_id(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "'the same' as text")
    check(docs, 4)
    assert docs.transform(lambda d: sharding.points(d)).count() == 2000
