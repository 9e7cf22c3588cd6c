"""Exact token counts at every prefix, by dynamic programming over a byte-level BPE vocabulary.

A sequence of tokens is what BPE makes of its bytes exactly if every two neighbours are what BPE makes of theirs. So the
last token of each prefix of a cut is the one vocabulary entry that ends there and gets along with the last token of the
prefix before it; the prefix's count is that prefix's count plus one. One pass over a cut gives the counts of all its
prefixes, and a text's counts are running sums over its cuts. Prefix counts answer where a text has to be truncated to
meet a budget, and how many tokens a span begins with, without encoding anything again.

Three kinds of prefixes are cut differently from the whole text, and are seen to: those that end in white space before
a word, those inside a contraction, and those inside a special string.

The table of prefix counts is what is stored: for each text rows of at most about SLICE code points, whose first count is
that of all before them, so a row is small however long the text is. Integers that grow by nothing or one are written as
packed differences, a few bits each. A text's token count, whether it exceeds a limit, and where it has to be truncated
are read from this table.

All cuts of an Arrow batch are made one array, of which the program runs over the distinct ones only; counts of all
prefixes are gathered from theirs.

Defined cases: a null text is the empty text, 0 tokens; an added token of the vocabulary inside a text is one token;
repeated rows and null ids are kept as they come; columns but doc_id and text are ignored. A vocabulary whose added
tokens take in the space around them, or stand for whole words only, is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import byte_characters
from skein.llm.common import for_python, texts
from skein.storage import stored

#: Entries of a worker's dictionary of cuts, and bytes of a cut that may enter it. A full dictionary becomes the old
#: one, from which cuts that occur again are taken over, so frequent cuts stay.
CACHE, CACHED_BYTES = 150_000, 64
#: Code points after which a text's table goes on in another row, and bytes of texts whose cuts are made distinct together.
SLICE, STEP = 1 << 16, 1 << 20
#: How the table is written: integers as packed differences.
PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
#: The contractions that the pattern cuts off whole.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Vocabulary(NamedTuple):
    """Tokens as bytes, bytes 0-255 first and then in the order of the merges; parts[i] are the two tokens that merge
    into token 256 + i; special strings."""

    tokens: list[bytes]
    parts: list[tuple[int, int]]
    special: list[str]


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's format."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    raw = {c: b for b, c in enumerate(byte_characters())}
    as_bytes = lambda s: bytes(raw[c] for c in s)
    tokens = [bytes([b]) for b in range(256)]
    index = {t: i for i, t in enumerate(tokens)}
    parts = []
    for merge in data["model"]["merges"]:
        a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
        if a + b in index:
            raise ValueError("two merges make the same token")
        index[a + b] = len(tokens)
        tokens.append(a + b)
        parts.append((index[a], index[b]))
    for x in data["added_tokens"]:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
            raise ValueError(f"added token {x['content']!r} depends on what stands around it")
    return Vocabulary(tokens, parts, [x["content"] for x in data["added_tokens"]])


class Counter:
    """Counts tokens of prefixes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import ahocorasick
        import regex

        # finds all tokens in a text in one pass; bytes stand as the characters of the same numbers
        self.tokens = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary.tokens):
            self.tokens.add_word(t.decode("latin-1"), i)
        self.tokens.make_automaton()
        self.size = list(map(len, vocabulary.tokens))
        self.left = [*range(256), *(a for a, _ in vocabulary.parts)]
        self.right = [*range(256), *(b for _, b in vocabulary.parts)]
        self.merged = {p: 256 + i for i, p in enumerate(vocabulary.parts)}
        self.cut = regex.compile(pattern).findall
        self.spaces = {chr(i) for i in range(0x3001) if regex.fullmatch(r"\s", chr(i))}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        # where a text can be cut in two without any cut or count changing: before a space between two others
        self.seam = regex.compile(r"(?<=\S) (?=\S)")
        self.agree: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _agrees(self, a: int, b: int) -> bool:
        """Whether BPE leaves the bytes of a and b as these two tokens: no merge across their border comes before the
        merges that build them. Walks back through the latest merge on either side of the border."""
        limit = len(self.left) + 1
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if b < 256 or a > b:
                limit, a = a, self.right[a]
            else:
                # at equal ranks the leftmost merge comes first, so a merge of b's rank across the border would win
                limit, b = b + 1, self.left[b]

    def prefixes(self, cut: bytes) -> list[int]:
        """The token count of each prefix of a cut's bytes, the empty one first."""
        size, agree = self.size, self.agree
        counts, last = [0] * (len(cut) + 1), [-1] * (len(cut) + 1)
        # the tokens that end at each prefix are tried as its last one, all prefixes before it being known by then
        for at, token in self.tokens.iter(cut.decode("latin-1")):
            end = at + 1
            if counts[end]:
                continue
            before = last[start := end - size[token]]
            if before >= 0:
                ok = agree.get(pair := before << 20 | token)
                if ok is None:
                    ok = agree[pair] = self._agrees(before, token)
                if not ok:
                    continue
            counts[end], last[end] = counts[start] + 1, token
        return counts

    def blank(self, text: str) -> bool:
        return self.spaces.issuperset(text)

    def _of_cuts(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all prefixes of each cut but the empty one, one after the other, and where each cut's begin."""
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        if len(self.agree) > 2 * CACHE:
            self.agree.clear()
        short, long = [], {}
        for i, cut in enumerate(cuts):
            if len(cut) > CACHED_BYTES:
                long[i] = np.array(self.prefixes(cut)[1:], np.int32)
                short.append(b"")
                continue
            found = self.known.get(cut)
            if found is None:
                found = self.old.get(cut)
                if found is None:
                    counts = self.prefixes(cut)[1:]
                    if len(cut) == 3 and cut.decode(errors="replace") in CONTRACTIONS:
                        # until it is complete it is cut in two
                        counts[1] = 2
                    found = bytes(counts)
                self.known[cut] = found
            short.append(found)
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        flat = np.zeros(int(bounds[-1]), np.int32)
        if not long:
            flat[:] = np.frombuffer(b"".join(short), np.uint8)
        else:
            held = np.repeat(size <= CACHED_BYTES, size)
            flat[held] = np.frombuffer(b"".join(short), np.uint8)
            for i, counts in long.items():
                flat[bounds[i] : bounds[i + 1]] = counts
        return flat, bounds

    def tables(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all prefixes of each text, by code points, the empty one first, and where each text's begin.
        No text may hold an added token."""
        cuts = [self.cut(x) for x in rows]
        coded = pa.array(list(chain.from_iterable(cuts)), pa.string()).dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        n_cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))])
        flat, bounds = self._of_cuts([w.encode() for w in words])
        size = np.diff(bounds)
        total = flat[bounds[1:] - 1] if len(words) else np.zeros(0, np.int32)
        # tokens of the row's cuts before each cut
        upto = np.concatenate([[0], np.cumsum(total[which])]).astype(np.int32)
        base = upto[:-1] - np.repeat(upto[n_cuts[:-1]], np.diff(n_cuts))
        many = size[which]
        ends = np.cumsum(many, dtype=np.int32)
        at = np.repeat(bounds[:-1][which] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        by_byte = flat[at] + np.repeat(base, many)
        raw = np.frombuffer("".join(rows).encode(), np.uint8)
        closes = np.ones(len(raw), bool)
        closes[:-1] = (raw[1:] & 0xC0) != 0x80
        by_point = by_byte[closes]
        # a text that ends in the first of a cut's characters, white space after white space, has all of that in one cut
        opens = np.array([w[0] in self.spaces for w in words], bool)
        blank = np.array([o and self.blank(w) for o, w in zip(opens, words, strict=True)], bool)
        if len(which) > 1 and blank.any():
            both = np.flatnonzero(blank[which[:-1]] & opens[which[1:]]) + 1
            both = both[~np.isin(both, n_cuts)]
            if len(both):
                pair, of = np.unique(which[both - 1].astype(np.int64) * len(words) + which[both], return_inverse=True)
                run = np.array([self.prefixes((words[p // len(words)] + words[p % len(words)][0]).encode())[-1] for p in pair])
                point = np.concatenate([[0], np.cumsum(closes)])[ends[both] - many[both]]
                by_point[point] = base[both - 1] + run[of]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.zeros(int(starts[-1]), np.int32)
        inside = np.ones(len(out), bool)
        inside[starts[:-1]] = False
        out[inside] = by_point
        return out, starts

    def slices(self, text: str) -> list[str]:
        """The text in parts of about SLICE code points that can be counted on their own."""
        out, at = [], 0
        while len(text) - at > SLICE:
            seam = self.seam.search(text, at + SLICE)
            if seam is None:
                break
            out.append(text[at : seam.start()])
            at = seam.start()
        return [*out, text[at:]]

    def all_prefixes(self, text: str) -> list[int]:
        """The token count of each prefix of a text, by code points, the empty one first."""
        out, start, border, before = [0], 0, 0, ""
        for i, piece in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                # until a special string is complete it is ordinary text, cut together with what stands before it
                inside = self._ordinary(before + piece)[len(before) + 1 : -1]
                border += 1
                out += [start + n for n in inside] + [border]
            else:
                own = self._ordinary(piece)
                out += [border + n for n in own[1:]]
                start, border, before = border, border + own[-1], piece
        return out

    def _ordinary(self, text: str) -> list[int]:
        out, base, before_space, space = [0], 0, 0, ""
        for c in self.cut(text):
            by_byte = self.prefixes(c.encode())
            own = [base + by_byte[e] for e in np.cumsum([len(x.encode()) for x in c])]
            if len(c) == 3 and c in CONTRACTIONS:
                own[1] = base + 2
            if space and c[0] in self.spaces:
                # a text that ends here has all this white space in one cut
                own[0] = before_space + self.prefixes((space + c[0]).encode())[-1]
            out += own
            before_space, space = base, c if self.blank(c) else ""
            base += by_byte[-1]
        return out


_counters: dict[bytes, Counter] = {}


def counter(vocabulary: Vocabulary, pattern: str) -> Counter:
    """The process's counter for this vocabulary; another vocabulary takes its place."""
    key = hashlib.blake2b(repr((vocabulary.parts, vocabulary.special, pattern)).encode()).digest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary, pattern)
    return _counters[key]


def _tables(own: Counter, rows: list[str]) -> tuple[list[tuple[int, int, bool]], list[np.ndarray]]:
    """For each slice of the rows its row, first code point and whether it is the last, and its counts."""
    place, parts = [], []
    for i, x in enumerate(rows):
        at, slices = 0, own.slices(x)
        for k, part in enumerate(slices):
            place.append((i, at, k == len(slices) - 1))
            parts.append(part)
            at += len(part)
    plain = [j for j, x in enumerate(parts) if not (own.special and own.special.search(x))]
    flat, bounds = own.tables([parts[j] for j in plain])
    counts: list = [None] * len(parts)
    for j, a, b in zip(plain, bounds, bounds[1:], strict=False):
        counts[j] = flat[a:b]
    base = 0
    for j, (_, at, _) in enumerate(place):
        if counts[j] is None:
            counts[j] = np.array(own.all_prefixes(parts[j]), np.int32)
        base = base if at else 0
        if base:
            counts[j] = counts[j] + np.int32(base)
        base = int(counts[j][-1])
    return place, counts


def prefix_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes, start, is_last, counts: counts[i] is the exact token count of the text's first start + i code
    points. A text has one row, or several, of which the last is marked."""
    known = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(known, pattern)
        for batch in batches:
            for t in texts(batch, step=STEP):
                place, counts = _tables(own, [x or "" for x in t.rows.column(1).to_pylist()])
                row, at, last = (np.array(x) for x in zip(*place, strict=True))
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in counts])])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(counts)))
                columns = [t.rows.column(0).take(pa.array(row)), pa.array(np.diff(t.bounds)[row]), pa.array(at, pa.int64()), pa.array(last, pa.bool_()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "start", "is_last", "counts"])

    schema = "doc_id long, n_bytes long, start long, is_last boolean, counts array<int>"
    return for_python(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def stored_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """prefix_counts() as a stored table."""
    return stored(prefix_counts(docs, vocabulary, pattern), "prefixes", PACKED)


def counted(table: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, from its table of prefix counts."""
    n = F.element_at("counts", -1).cast("long")
    return table.where("is_last").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def fitting(table: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_points: the code points of each text's longest prefix within a budget of tokens, from its table of prefix
    counts alone. Rows that share a doc_id count as one text."""
    fit = F.array_position(F.transform(F.reverse("counts"), lambda n: n <= budget), True)
    end = F.when(fit > 0, F.col("start") + F.size("counts") - fit)
    return table.groupBy("doc_id").agg(F.max(end).alias("n_points"))
