"""Quality rules with an isolation forest over rule statistics.

Base statistics of a text, over words [^\\x20\\x09-\\x0D]+: n_words; word_chars, code points in words; n_symbols,
characters of [#*$%&|<>]; n_dup_lines, \\n-split lines with a word that equal an earlier line; n_repeat_words, words in
5-word windows that the text holds twice or more. Lines are compared by their bytes, words by 64 bits of their BLAKE2b
digests. A text fails the base rules with under 10 words or with more than 20 %
repeated words.

The forest sees ratios of these (and of upper case, marks, distinct words, words of marks alone) for texts that pass the
base rules. Its trees split random subsamples of SAMPLE rows at random values; rows that random splits set apart early are
anomalies. A tree's SAMPLE rows, which the method prescribes, are drawn from all of the table's rows that pass: no pool is
taken before. The threshold comes from all labelled rows: the highest anomaly scores are cut off where that agrees best with
the labels; nothing else bounds it. Texts are read once, their statistics stored.

Defined cases: a null text has no words and fails; without labelled rows of both kinds only the base rules decide;
labels that name a document twice or are null teach nothing; null ids and repeated rows are judged as they come, and each
of several rows with a labelled id counts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import Texts, for_python, span_codes, texts, window_hashes, words
from skein.storage import discard, stored

TREES, SAMPLE = 100, 256
#: Parts of the range of scores, each summed up for the driver.
BINS = 1 << 16
#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("symbols_a_word", "dup_lines", "repeat_words", "upper", "marks", "distinct", "marks_alone")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COLUMNS = "doc_id long, " + ", ".join(f"{k} long" for k in _BASE) + ", base_failed boolean"


def _count(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags hold in each span of bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _seen_before(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its row holds the same code earlier, and whether at all a second time."""
    order = np.lexsort((code, row))
    same = np.zeros(len(order), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (code[order][1:] == code[order][:-1])
    before, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    before[order] = same
    more = same.copy()
    more[:-1] |= same[1:]
    again[order] = more
    return before, again


def statistics(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics of each row, and the features [row, feature]."""
    n = len(t.bounds) - 1
    w = words(t)
    n_words = np.diff(w.first)
    row = np.repeat(np.arange(n), n_words)
    # code points are bytes that do not continue one
    points = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
    chars = points[w.end] - points[w.start]
    word_chars = np.bincount(row, chars, n).astype(np.int64)
    # lines, each row's last one included
    breaks = np.flatnonzero(t.buf == 10)
    line_start = np.sort(np.concatenate([t.bounds[:-1], breaks + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(n), np.searchsorted(t.bounds, breaks, "right") - 1]), kind="stable")
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:]
    line_end[-1:] = len(t.buf)
    # a line ends before its \n; a row's last line ends with the row
    last = np.ones(len(line_row), bool)
    last[:-1] = line_row[1:] != line_row[:-1]
    line_end = np.where(last, t.bounds[line_row + 1], line_end - 1)
    worded = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    dup, _ = _seen_before(line_row, span_codes(t.buf, line_start, line_end)[0])
    code, whole = window_hashes(w, 5)
    at = np.flatnonzero(whole)
    _, again = _seen_before(row[at], code[at])
    covered = np.zeros(len(row) + 1, np.int64)
    np.add.at(covered, at[again], 1)
    np.add.at(covered, at[again] + 5, -1)
    repeat = np.bincount(row, np.cumsum(covered)[:-1] > 0, n).astype(np.int64)
    base = {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": _count(_SYMBOL[t.buf], t.bounds),
        "n_dup_lines": np.bincount(line_row[dup], minlength=n).astype(np.int64),
        "n_repeat_words": repeat,
    }
    some, lines = np.maximum(n_words, 1), np.maximum(np.bincount(line_row, minlength=n), 1)
    letters = np.maximum(word_chars, 1)
    # a menu's words have marks on their own between them
    marks = np.concatenate([[0], np.cumsum(_MARK[t.buf])])
    alone = np.bincount(row, marks[w.end] - marks[w.start] == w.end - w.start, n)
    first_seen, _ = _seen_before(row, w.hash)
    distinct = np.bincount(row, ~first_seen, n)
    columns = (
        base["n_symbols"] / some,
        # one line again, as a frame has it, is no sign of anything
        np.maximum(base["n_dup_lines"] - 1, 0) / lines,
        repeat / some,
        _count(_UPPER[t.buf], t.bounds) / letters,
        _count(_MARK[t.buf], t.bounds) / some,
        # of long texts fewer words are new: hold that against the square root of the length
        distinct / some * np.sqrt(np.minimum(some, 400) / 400),
        alone / some,
    )
    return base, np.column_stack(columns).astype(np.float32)


class Forest(NamedTuple):
    """Trees as arrays [tree, node]: the feature to split (-1 in a leaf), the value, the path length of a leaf."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    depth: int
    norm: float


def _average_path(n: float) -> float:
    """The average path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 11) -> Forest:
    """A forest of complete binary trees; a node's children are 2 * node + 1 and 2 * node + 2."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    size = 2 ** (depth + 1) - 1
    feature, value, path = np.full((trees, size), -1), np.zeros((trees, size), np.float32), np.zeros((trees, size))
    # rows for all trees are dealt, fewer are drawn anew for each
    dealt = rng.permutation(len(rows))[: trees * sample].reshape(trees, sample) if len(rows) >= trees * sample else None
    for k in range(trees):
        todo = [(0, 0, rows[rng.choice(len(rows), sample, replace=False) if dealt is None else dealt[k]])]
        while todo:
            node, level, own = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(own) <= 1 or not len(open_):
                path[k, node] = level + _average_path(len(own))
                continue
            f = int(rng.choice(open_))
            cut = np.float32(rng.uniform(low[f], high[f]))
            left = own[:, f] <= cut
            if left.all() or not left.any():
                cut = low[f]
                left = own[:, f] <= cut
            feature[k, node], value[k, node] = f, cut
            todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
    return Forest(feature, value, path, depth, _average_path(sample) or 1.0)


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Scores in (0, 1): 2 ** -(average path length / that of a random search)."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for feature, value, path in zip(forest.feature, forest.value, forest.path, strict=True):
        node = np.zeros(len(rows), np.int64)
        for _ in range(forest.depth):
            f = feature[node]
            inner = f >= 0
            right = rows[every, np.maximum(f, 0)] > value[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        total += path[node]
    return 2.0 ** -(total / len(forest.path) / forest.norm)


class Model(NamedTuple):
    """The forest, and the anomaly score above which a text goes; none without a forest."""

    forest: Forest | None
    threshold: float


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold that agrees best with the labels."""
    if not len(scores) or good.all() or not good.any():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    # cutting off the first i rows: right are the bad ones among them and the good ones behind
    right = np.concatenate([[0], np.cumsum(np.where(g, -1, 1))])
    ends = np.concatenate([[True], s[:-1] > s[1:], [True]])
    best = int(np.argmax(np.where(ends, right, -len(s) - 1)))
    if not best:
        return np.inf
    return float((s[best - 1] + s[best]) / 2) if best < len(s) else -np.inf


def _base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the features x of every row: the one step that reads texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                base, x = statistics(t)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
                out = [t.rows.column(0), *(pa.array(base[k]) for k in _BASE), pa.array(_base_failed(base)), lists]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *_BASE, "base_failed", "x"])

    schema = f"{_COLUMNS}, x array<float>"
    return for_python(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _rows_of(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(flat.flatten(), np.float32).reshape(-1, len(FEATURES))


def _drawn(passing: DataFrame, n: int, most: int) -> np.ndarray:
    """The features of the `most` rows of n with the least hashes, by doc_id; of all rows where there are no more."""
    # hashes that far below their greatest value leave few rows to sort; where equal rows share too many, it grows
    share = (most + 8 * most**0.5) / n
    hashed = passing.select("doc_id", "x", F.xxhash64("doc_id", "x").alias("hash"))
    while True:
        few = hashed.where(F.col("hash") < int(-(2**63) + share * 2**64)) if share < 1 else hashed
        got = few.orderBy("hash", "doc_id", "x").limit(most).orderBy("doc_id", "x").toArrow()
        if got.num_rows >= min(most, n) or share >= 1:
            return _rows_of(got.column("x"))
        share *= 4


def threshold(scored: DataFrame) -> float:
    """calibrate() over a table (score, good) of any size: every row counts, and the driver gets a row a bin of scores."""
    net = F.sum(F.when(F.col("good"), -1).otherwise(1))
    each = scored.groupBy("score").agg(net.alias("net"), F.max("good").alias("good"), F.max(~F.col("good")).alias("bad"))
    each = each.withColumn("bin", F.floor(F.col("score") * BINS))
    above = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = each.withColumn("run", F.sum("net").over(above)).groupBy("bin")
    bins = bins.agg(F.sum("net").alias("net"), F.max(F.struct("run", "score")).alias("best"), F.max("good").alias("good"), F.max("bad").alias("bad"))
    got = bins.select("net", "best.run", "best.score", "good", "bad").orderBy(F.desc("score")).collect()
    if not any(b.good for b in got) or not any(b.bad for b in got):
        return np.inf
    right = np.cumsum([0] + [b.net for b in got[:-1]]) + [b.run for b in got]
    best = int(np.argmax(right))
    if right[best] <= 0:
        return np.inf
    at = got[best].score
    below = scored.where(F.col("score") < at).agg(F.max("score")).first()[0]
    return -np.inf if below is None else float((at + below) / 2)


def fit(measures: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The forest of a measured() table, and the threshold that all labelled rows call for. Reads the table a few times."""
    passing = measures.where("not base_failed")
    n = passing.count()
    if n < 2:
        return Model(None, np.inf)
    forest = grow(_drawn(passing, n, TREES * SAMPLE))
    own = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"), F.count("*").alias("n"))
    own = own.where("label = other and n = 1").select("doc_id", (F.col("label").cast("int") > 0).alias("good"))
    known = verdicts(passing.join(own, "doc_id", "left_semi"), Model(forest, np.inf)).select("doc_id", F.col("anomaly").alias("score"))
    scored = stored(known.join(own, "doc_id").select("score", "good"), "scored")
    found = threshold(scored)
    discard(scored)
    return Model(forest, found)


def verdicts(measures: DataFrame, model: Model) -> DataFrame:
    """judged() of a measured() table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, failed = _rows_of(batch.column(len(_BASE) + 2)), np.asarray(batch.column(len(_BASE) + 1).to_numpy(zero_copy_only=False), bool)
            score = anomaly(model.forest, x) if model.forest else np.zeros(len(x))
            out = [*batch.columns[:-1], pa.array(score, mask=failed), pa.array(~failed & (score <= model.threshold))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *_BASE, "base_failed", "anomaly", "kept"])

    schema = f"{_COLUMNS}, anomaly double, kept boolean"
    return for_python(measures).select("doc_id", *_BASE, "base_failed", "x").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The forest of docs and the threshold that the labels call for."""
    measures = stored(measured(docs), "measured")
    model = fit(measures, labels, label)
    discard(measures)
    return model


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (null for texts that fail the base rules), kept."""
    return verdicts(measured(docs), model)


def assessed(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """docs judged by the model that they and the labels train; texts are read once."""
    measures = stored(measured(docs), "measured")
    return verdicts(measures, fit(measures, labels, label))
