"""Near-duplicates against all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import minhash
from skein.llm.common import documents

DIR = "/root/testdata/sf0.001"


def brute(rows, size, percent):
    """Component of each id by comparing all pairs of sets; ids None apart."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[doc_id] = s
    of = {k: k for k in sets}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return {k: (len(sets[k]), of[k]) for k in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(spark, size):
    docs = documents(spark, DIR)
    want = brute([(x.doc_id, x.text) for x in docs.collect()], size, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, size, 80).collect()}
    assert got == want


def test_odd_rows(odd, rows):
    want = brute([(x[0], x[1]) for x in rows], 2, 80)
    got = minhash.near_duplicates(odd, 2, 80).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id) == want[x.doc_id]
            assert x.kept == (x.doc_id == x.component_id)


def test_empty_table(none):
    assert minhash.near_duplicates(none, 2, 80).count() == 0
    assert minhash.deduplicated(none).columns == none.columns


def test_one_of_each_group_stays(odd):
    got = minhash.deduplicated(odd, 2, 80)
    assert got.columns == odd.columns
    ids = sorted(x.doc_id for x in got.where("doc_id is not null").collect())
    assert ids == [1, 3, 4, 5, 6, 8, 10, 11, 12]
    assert got.where("doc_id is null").count() == 2


def test_chains_link_through_members(spark):
    """Each text is near the next one only: all are one component, and the smallest id keeps it."""
    words = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join(words[2 * k : 2 * k + 40])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 2, 80).collect()}
    assert got == want and len({c for _, c in got.values()}) == 1


def test_stray_members_of_a_group(spark):
    """Texts near each other but not near the group's smallest id."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for k in range(60):
        w = list(base)
        for i in rng.choice(50, 5 if k else 14, replace=False):
            w[i] = f"x{k % 7}-{i}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_sketches_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 300, np.int64).astype(np.uint64))
    b = np.unique(np.concatenate([a[:240], rng.integers(0, 1 << 63, 60, np.int64).astype(np.uint64)]))
    s = minhash.sketches([a, b, a[:1]], 336)
    assert (s != np.iinfo(np.uint64).max).all()
    similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - similar) < 0.12


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 200, np.int64).astype(np.uint64))
    b = np.unique(np.concatenate([a[:150], rng.integers(0, 1 << 63, 50, np.int64).astype(np.uint64)]))
    x, y = (np.unpackbits(m.view(np.uint8)) for m in minhash.bitmaps([a, b]))
    assert int((x & ~y & 1).sum()) <= len(np.setdiff1d(a, b))


def test_words_that_weak_hashes_confuse(spark, twins):
    rows = [(1, twins[0]), (2, twins[1]), (3, f"{twins[0]} {twins[1]} {twins[0]} {twins[1]}"), (4, " ".join(twins))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_long_texts_are_read_in_windows(spark, monkeypatch):
    from skein.llm import common

    rows = [(1, "a bb Ccc dd " * 40 + "end"), (2, "x" * 100 + " y"), (3, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    whole = [minhash.shingle_sets(t, 2) for t in common.texts(batch)]
    monkeypatch.setattr(common, "WINDOW", 16)
    parts = [minhash.shingle_sets(t, 2) for t in common.texts(batch)]
    assert [[x.tolist() for x in s] for s in whole] == [[x.tolist() for x in s] for s in parts]
