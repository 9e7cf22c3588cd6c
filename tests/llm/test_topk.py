"""Exact top-k against all pairs."""

import math

import numpy as np
import pytest

from skein.llm import topk


def brute(rows, queries, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in sorted(sound, reverse=True)}.items()):
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


def run(spark, rows, queries, k=3, parts=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = df.where(df.vec_id.isin(queries))
    return sorted(map(tuple, topk.top_k(df, asks, k, parts).collect()))


ODD = [
    (0, [0.5, -0.25, 1.0, 0.0]), (1, [0.5, -0.25, 1.0, 0.0]), (2, [0.5, -0.25, 1.0, 0.0]), (3, [-1.0, -1.0, -1.0, -1.0]), (4, None), (5, []),
    (6, [1.0, None, 1.0, 1.0]), (7, [float("nan"), 0.0, 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0, 0.0]), (9, [1.0, 2.0]), (10, [1e6, 1e6, -1e6, 3.0]),
    (None, [1.0, 1.0, 1.0, 1.0]), (11, [0.001, 0.001, 0.001, 0.001]), (1, [0.5, -0.25, 1.0, 0.0]), (12, [-0.5, 0.25, -1.0, 0.1]),
]


@pytest.mark.parametrize("parts", [1, 3, 4])
def test_odd_vectors(spark, parts):
    queries = [0, 3, 4, 7, 9, 10]
    assert run(spark, ODD, queries, parts=parts) == brute(ODD, queries, 3)


def test_all_scores_negative(spark):
    rows = [(i, [-float(i), 1.0]) for i in range(1, 9)] + [(0, [1.0, -1.0])]
    assert run(spark, rows, [0], k=5, parts=2) == brute(rows, [0], 5)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(400)
    rows = [(x.vec_id, list(x.embedding)) for x in df.collect()]
    queries = [i for i, _ in rows if i % 50 == 0]
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()))
    assert got == brute(rows, queries, 5)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(i, [math.sin(i), math.cos(i), i / 9]) for i in range(20)]
    assert run(spark, rows, list(range(0, 20, 2)), k=2, parts=2) == brute(rows, list(range(0, 20, 2)), 2)


def test_empty_table(spark):
    assert run(spark, [], [0]) == []


def test_thresholds_pass_over_groups():
    """On clustered vectors phases 2 and 3 look at few of the pairs, and find what all pairs give."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 300
    v = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 20).astype(np.int64)
    ids, block = np.arange(2000), topk.asked(list(range(0, 2000, 50)), v[::50].tolist(), 4)
    query, _, score = topk.heads(block, ids, v, 5)
    least = np.array([score[query == q].min() for q in block.ids], float)
    (query, vec, score), seen = topk.resolved(block, ids, v, least, 5)
    assert seen < 0.2 * 2000 * 40
    want = [(q, i, s) for q in block.ids for s, i in sorted(((int(v[q] @ v[i]), -i) for i in ids if i != q), reverse=True)[:5]]
    assert list(zip(query, vec, score, strict=True)) == [(q, -i, s) for q, i, s in want]
