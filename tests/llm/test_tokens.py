"""BPE and token counts against the libraries."""

import hashlib
import json
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bpe, token_counts
from skein.llm.common import documents

RANKS, VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TOKENS = bpe.read_ranks(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
CODEC = bpe.Codec(TOKENS, P.PATTERN)
KNOWN = token_counts.read_vocabulary(VOCABULARY)
COUNTER = token_counts.Counter(KNOWN, P.PATTERN)
REFERENCE = Tokenizer.from_file(VOCABULARY)
PIECES = st.lists(st.sampled_from(["a", "th", "he ", " ", "  ", "\n", "\t", "'", "'re", "'ll", "s", "l", "1", "23", "!", "<|endoftext|>", "<|", "end", "é", "日", "\U0001f600", "\x1c", "\x85", "ing"]), max_size=9).map("".join)


def count(text):
    return len(REFERENCE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=20)))
def test_ids_match_the_library(text):
    rows = [text, "", text + text]
    ids, bounds = CODEC.encode_texts(rows)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [LIBRARY.encode_ordinary(x) for x in rows]
    assert [bytes(x) for x in CODEC.decode(ids, bounds)] == [x.encode() for x in rows]


@settings(max_examples=200, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=12)))
def test_every_prefix_counts_right(text):
    rows = [text, "", text + " end"]
    want = [[count(x[:i]) for i in range(len(x) + 1)] for x in rows]
    assert [COUNTER.all_prefixes(x) for x in rows] == want
    place, counts = token_counts._tables(COUNTER, rows)
    assert place == [(0, 0, True), (1, 0, True), (2, 0, True)] and [x.tolist() for x in counts] == want


@settings(max_examples=200, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=12)), st.integers(1, 6))
def test_slices_count_on(text, size):
    before, token_counts.SLICE = token_counts.SLICE, size
    try:
        text = f"so {text} to say {text}"
        place, counts = token_counts._tables(COUNTER, [text])
        assert [p[2] for p in place] == [False] * (len(place) - 1) + [True]
        for (_, at, _), own in zip(place, counts, strict=True):
            assert own.tolist() == [count(text[: at + i]) for i in range(len(own))]
        assert len(place) > 1 and place[-1][1] + len(counts[-1]) - 1 == len(text)
    finally:
        token_counts.SLICE = before


@pytest.mark.parametrize("text", ["a" * 5000, " " * 4000, "ab" * 3000, "\n" * 3000, "日" * 2000])
def test_long_runs(text):
    assert CODEC.encode_texts([text])[0].tolist() == LIBRARY.encode_ordinary(text)
    assert token_counts._tables(COUNTER, [text])[1][0][-1] == count(text)


def test_digests(spark, odd, none):
    for docs in (documents(spark, "/root/testdata/sf0.001"), odd):
        want = []
        for x in docs.select("doc_id", "text").collect():
            ids = LIBRARY.encode_ordinary(x.text or "")
            want.append((str(x.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest()))
        got = [(str(x.doc_id), *x[1:]) for x in bpe.digests(docs, RANKS, P.PATTERN).collect()]
        assert sorted(got) == sorted(want)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


def test_long_texts_go_through_in_runs(monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "RUN", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["short", "a longer text, with more cuts than one run", None, "x" * 50])], ["doc_id", "text"])
    found = []
    for _, rows in bpe._texts(iter([batch])):
        found += zip(*bpe._digests(CODEC, rows), strict=True)
    want = [LIBRARY.encode_ordinary(x or "") for x in batch.column(1).to_pylist()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert found == [(len(i), sha(",".join(map(str, i)).encode()), sha((x or "").encode())) for i, x in zip(want, batch.column(1).to_pylist(), strict=True)]


def test_a_token_that_no_merges_reach():
    tokens = [bytes([b]) for b in range(256)] + [b"abc"]
    own = bpe.Codec(tokens, P.PATTERN)
    ids, bounds = own.encode_texts(["abc abc abcd", "abc"])
    library = tiktoken.Encoding("few", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [library.encode_ordinary(x) for x in ("abc abc abcd", "abc")]


def test_encode_and_decode_frames(odd):
    texts = {x.doc_id: x.text or "" for x in odd.where("doc_id is not null").collect()}
    out = bpe.decoded(bpe.encoded(odd.where("doc_id is not null"), RANKS, P.PATTERN), RANKS).collect()
    assert {x.doc_id: bytes(x.bytes).decode() for x in out} == texts


def test_counts(spark, odd, none):
    for docs in (documents(spark, "/root/testdata/sf0.001"), odd):
        want = sorted((str(x.doc_id), len((x.text or "").encode()), n := count(x.text or ""), n > 512) for x in docs.select("doc_id", "text").collect())
        assert sorted((str(x.doc_id), *x[1:]) for x in token_counts.counted(token_counts.stored_counts(docs, VOCABULARY, P.PATTERN)).collect()) == want
    assert token_counts.counted(token_counts.stored_counts(none, VOCABULARY, P.PATTERN)).count() == 0


def test_budgets(odd):
    table = token_counts.stored_counts(odd.where("doc_id in (1, 4, 10)"), VOCABULARY, P.PATTERN)
    text = {x.doc_id: x.text for x in odd.collect()}
    for budget in (0, 3, 1000):
        for x in token_counts.fitting(table, budget).collect():
            fits = [i for i in range(len(text[x.doc_id]) + 1) if count(text[x.doc_id][:i]) <= budget]
            assert x.n_points == max(fits)


def test_one_long_cut_takes_linear_time():
    start = time.process_time()
    assert len(COUNTER.prefixes(b"ab" * 50_000)) == 100_001
    assert time.process_time() - start < 4


def test_an_added_token_that_depends_on_its_neighbours_is_refused(tmp_path):
    data = json.load(open(VOCABULARY, encoding="utf-8"))
    data["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(str(tmp_path / "v.json"))
