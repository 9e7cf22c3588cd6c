"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank vocabulary.

model_bytes() writes a sentencepiece BPE model directly: one piece for each token, in the order of the ranks, so a
piece's id is its rank. A piece is the token with each byte replaced by a printable character, its score the negative
rank, and the normaliser is the identity; merging the best-scored pair first is then merging the lowest rank first.
Texts are cut by the vocabulary's pattern, each cut's bytes are mapped and encoded; ids are decoded by the inverse map.

The vocabulary is read once on the driver and goes to the tasks with the function: its size is fixed. All cuts of an
Arrow batch are made one array, of which only the distinct ones are encoded; ids, their decimal text and the decoded
bytes are gathered from tables, so nothing is done in Python for each id and no worker keeps a dictionary of cuts. A text
over LONG characters goes through in runs of RUN cuts.

Defined cases: a null text is the empty text, which has no ids; special strings in texts are ordinary text; repeated
rows and null ids are kept as they come; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import for_python, texts

#: Bytes of texts whose cuts are made distinct together; characters of a text that is taken in runs, and cuts of a run.
STEP, LONG, RUN = 1 << 21, 1 << 22, 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which have to be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not consecutive from 0")
    return tokens


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    kept = set(own)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or bytes, by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model. ModelProto: pieces 1 (piece 1, score 2, type 3: 1 normal, 2 unknown),
    trainer_spec 2 (model_type 3: 2 BPE; vocab_size 4; unk_id 40; bos, eos, pad 41-43), normalizer_spec 3 (name 1,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5)."""
    char = byte_characters()
    pieces = [_field(1, _field(1, "".join(char[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, none) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.pattern = regex.compile(pattern)
        self.model = SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.characters = pa.array(byte_characters())
        self.tokens = pa.array(tokens, pa.binary())
        self.names = pa.array([f"{i}," for i in range(len(tokens))])
        # a cut that is a token is that token, also where no merges lead to it
        ids, bounds = self._merged(self.tokens)
        whole = (np.diff(bounds) == 1) & (ids[np.minimum(bounds[:-1], len(ids) - 1)] == np.arange(len(tokens)))
        self.unmerged = {tokens[i]: i for i in np.flatnonzero(~whole)}

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids that merging makes of each of the words' bytes, one after the other, and where each word's begin."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = words.buffers()
        at = np.frombuffer(raw[1], np.int32, len(words) + 1)
        data = np.frombuffer(raw[2], np.uint8)[: at[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
        mapped = self.characters.take(pa.array(data))
        ends = np.frombuffer(mapped.buffers()[1], np.int32)
        mapped = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(ends[at].copy()), mapped.buffers()[2]])
        ids = self.model.encode(mapped.to_pylist(), num_threads=1)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(bounds[-1])), bounds

    def encode(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of cuts, one after the other, and where each row's begin."""
        coded = pa.array(list(chain.from_iterable(rows)), pa.string()).dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        ids, bounds = self._merged(words)
        size, first = np.diff(bounds), bounds[:-1].copy()
        if self.unmerged:
            known = pc.index_in(words.cast(pa.binary()), pa.array(list(self.unmerged), pa.binary())).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~np.isnan(known))
            first[own], size[own] = len(ids) + known[own].astype(np.int64), 1
            ids = np.concatenate([ids, np.fromiter(self.unmerged.values(), np.int32)])
        many = size[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = ids[np.repeat(first[which] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])]

    def encode_texts(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode([self.pattern.findall(x) for x in rows])

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a long text, a run of cuts at a time."""
        cuts = self.pattern.finditer(text)
        while run := [m.group() for m in islice(cuts, RUN)]:
            yield self.encode([run])[0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each row of ids."""
        return _joined(self.tokens, ids, bounds)


def _joined(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """The entries of a table that each row of ids names, joined."""
    found = table.take(pa.array(ids))
    at = np.frombuffer(found.buffers()[1], np.int32)[bounds].tolist() if len(ids) else [0] * len(bounds)
    data = memoryview(found.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


_codecs: dict[bytes, Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """The process's codec for this vocabulary; another vocabulary takes its place."""
    key = hashlib.blake2b(b"\n".join(map(base64.b64encode, tokens)) + pattern.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """doc_ids and texts of rows that go through together: many short ones, or one long one alone."""
    for batch in batches:
        for t in texts(batch, step=STEP):
            rows = [x or "" for x in t.rows.column(1).to_pylist()]
            ids, at = t.rows.column(0), 0
            for i in [*(i for i, x in enumerate(rows) if len(x) > LONG), len(rows)]:
                if i > at:
                    yield ids.slice(at, i - at), rows[at:i]
                if i < len(rows):
                    yield ids.slice(i, 1), rows[i : i + 1]
                at = i + 1


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    tokens = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokens, pattern)
        for doc_ids, rows in _texts(batches):
            if len(rows[0]) > LONG:
                ids = np.concatenate(list(own.runs(rows[0])))
                bounds = np.array([0, len(ids)])
            else:
                ids, bounds = own.encode_texts(rows)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return for_python(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, bytes of every row of ids."""
    tokens = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(tokens, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                joined = _joined(table, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                out = [x.tobytes() if known else None for x, known in zip(joined, lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return for_python(rows).select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def _digests(own: Codec, rows: list[str]) -> tuple[list[int], list[str], list[str]]:
    """Counts, digests of the ids as decimal text, and digests of the bytes that the ids decode to."""
    if len(rows[0]) > LONG:
        count, names, back, comma = 0, hashlib.sha256(), hashlib.sha256(), b""
        for ids in own.runs(rows[0]):
            bounds = np.array([0, len(ids)])
            count += len(ids)
            names.update(comma)
            names.update(_joined(own.names, ids, bounds)[0][:-1])
            back.update(own.decode(ids, bounds)[0])
            comma = b","
        return [count], [names.hexdigest()], [back.hexdigest()]
    ids, bounds = own.encode_texts(rows)
    names = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(own.names, ids, bounds)]
    return np.diff(bounds).tolist(), names, [hashlib.sha256(x).hexdigest() for x in own.decode(ids, bounds)]


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, decodes the ids, and keeps digests of both, so
    that neither ids nor decoded texts leave the task."""
    tokens = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokens, pattern)
        for doc_ids, rows in _texts(batches):
            n, one, two = _digests(own, rows)
            columns = [doc_ids, pa.array(n, pa.int64()), pa.array(one), pa.array(two)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return for_python(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
