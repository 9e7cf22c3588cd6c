"""What the operators share: small Arrow batches, and exact numbers and digests of words over Arrow text buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.frontend.shipping import ship

#: A word is a run of bytes outside \x20 and \x09-\x0D, the same set whether read as bytes or as code points.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step handles at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch to a Python worker, where the session does not say otherwise. Texts are long, and JVM and
#: worker both hold batches.
BATCH_BYTES = "4m"
#: Bytes of text whose words are told apart at once.
WINDOW = 1 << 23


def for_python(df: DataFrame) -> DataFrame:
    """df, for a step in Python: this package goes to the workers, and Arrow batches are small from now on, unless the
    session has its own setting."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.conf().contains(key):
        spark.conf.set(key, BATCH_BYTES)
    ship(spark)
    return df


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as decimal text, the base of every held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Texts(NamedTuple):
    """Consecutive rows of a batch: their UTF-8 bytes in one array, bounds[i]:bounds[i + 1] being row i. A null is empty."""

    rows: pa.RecordBatch
    buf: np.ndarray
    bounds: np.ndarray
    valid: np.ndarray

    def bytes(self, i: int) -> bytes:
        return self.buf[self.bounds[i] : self.bounds[i + 1]].tobytes()


def texts(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[Texts]:
    """The batch in pieces of about `step` bytes of text."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    n = len(col)
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    valid = np.asarray(col.is_valid())
    cuts, last = [0], 0
    while last < n:
        last = max(last + 1, int(np.searchsorted(offsets, offsets[last] + step, "right")) - 1)
        cuts.append(min(last, n))
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = int(offsets[a]), int(offsets[b])
        yield Texts(batch.slice(a, b - a), data[lo:hi], offsets[a : b + 1] - lo, valid[a:b])
    # Arrow keeps what batches needed; a worker lives on and runs other steps
    pa.default_memory_pool().release_unused()


_BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words of a piece: first byte, byte after the last, 64-bit hash; of row i are first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def word_bounds(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and first of Words. Rows end words too."""
    inside = ~_SPACE[t.buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = t.bounds[1:-1]
    edges = edges[edges < len(inside)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    inner = edges[edges > 0] - 1
    after[inner] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, t.bounds)


def span_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the spans, which follow one another without overlap, and the distinct byte strings that the
    numbers stand for. Equal numbers mean equal bytes: nothing is hashed but in Arrow's own table, which compares bytes."""
    if not len(start):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    low, high = int(start[0]), int(end[-1])
    offsets = np.empty(2 * len(start) + 1, np.int32)
    offsets[:-1:2] = start - low
    offsets[1::2] = end - low
    offsets[-1] = high - low
    # every second item is what lies between two spans
    spans = pa.Array.from_buffers(pa.binary(), 2 * len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[low:high]))])
    coded = spans.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 64 bits of the BLAKE2b digest of each of the spans, which follow one another without overlap."""
    codes, distinct = span_codes(buf, start, end)
    digest = hashlib.blake2b
    digests = b"".join([digest(x, digest_size=8).digest() for x in distinct.to_pylist()])
    return np.frombuffer(digests, np.uint64)[codes]


def words(t: Texts, lower: bool = False) -> Words:
    """The words and their hashes; a long text is hashed in windows, so that only its words' numbers are held at once."""
    start, end, first = word_bounds(t)
    hashes = np.empty(len(start), np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(t.buf), WINDOW))
    for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True):
        if a < b:
            low, high = int(start[a]), int(end[b - 1])
            part = t.buf[low:high]
            hashes[a:b] = span_hashes(LOWER[part] if lower else part, start[a:b] - low, end[a:b] - low)
    return Words(start, end, hashes, first)


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the `size` words from each word on, and whether these all lie in one row."""
    n = len(w.hash)
    out = np.zeros(n, np.uint64)
    row_end = np.repeat(w.first[1:], np.diff(w.first))
    whole = np.arange(n) + size <= row_end
    with np.errstate(over="ignore"):
        for k in range(min(size, n)):
            out[: n - k] = out[: n - k] * _BASE + mix(w.hash[k:] + np.uint64(k + 1))
    return mix(out), whole
