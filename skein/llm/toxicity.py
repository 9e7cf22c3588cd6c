"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words (runs of ASCII letters and non-ASCII bytes, A-Z as a-z) and their beginnings of 4
to 7 bytes, hashed to 2**22 numbers. The score is sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) over the terms
present, so two terms can weigh more, or less, together than apart.

Learning takes at most ROWS labelled documents, those with the least hash of doc_id, whole texts. Of their terms the
TERMS that tell the labels apart best become the model's; these bounds hold whatever the tables' sizes. Terms are
counted in Spark, and the driver gets the chosen terms of each sampled row only. The fit is deterministic.

Defined cases: a null or empty text has no terms and scores sigmoid(b); without labels of both kinds every score is the
share of toxic labels, or 0 without any; documents that `labels` names twice or with a null label teach nothing; repeated
rows and null ids are scored as they come; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LOWER, Texts, crc32_of_id, for_python, span_codes, texts
from skein.storage import stored

ROWS, TERMS, CLASSES = 12_000, 3_000, 1 << 22
BEGINNINGS = (4, 5, 6, 7)
RANK, STEPS, DECAY = 4, 400, 0.02
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Model(NamedTuple):
    """Terms in order, their weights and factors, and the bias."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float


def terms(t: Texts) -> list[np.ndarray]:
    """The sorted distinct terms of each row."""
    inside = np.zeros(len(t.buf) + 2, bool)
    inside[1:-1] = _LETTER[t.buf]
    edges = t.bounds[1:-1]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    # a run that goes on into the next row is two words
    cut = edges[inside[edges] & inside[edges + 1]]
    if len(cut):
        start, end = np.sort(np.concatenate([start, np.unique(cut)])), np.sort(np.concatenate([end, np.unique(cut)]))
    # hashed are distinct words and their beginnings
    which, distinct = span_codes(LOWER[t.buf], start, end)
    spelled = distinct.to_pylist()
    row = np.searchsorted(t.bounds, start, "right") - 1
    code, rows = [], []
    for n in (None, *BEGINNINGS):
        known = np.array([zlib.crc32(x[:n]) if n is None or len(x) > n else -1 for x in spelled], np.int64)
        found = known[which] if len(known) else np.zeros(0, np.int64)
        code.append((found[found >= 0] ^ (0 if n is None else n * 0x9E3779)) & (CLASSES - 1))
        rows.append(row[found >= 0])
    code, row = np.concatenate(code), np.concatenate(rows)
    both = np.unique(row * CLASSES + code)
    first = np.searchsorted(both, np.arange(len(t.bounds)) * CLASSES)
    code = (both & (CLASSES - 1)).astype(np.int32)
    return [code[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in texts(batch):
            found = terms(t)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([t.rows.column(0), t.rows.column(1), lists], ["doc_id", "label", "terms"])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


def _logits(w: np.ndarray, v: np.ndarray, bias: float, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = _sums(v[at], first)
    return bias + _sums(w[at], first) + 0.5 * ((mean**2).sum(1) - _sums((v[at] ** 2).sum(1), first)), mean


def fit(rows: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, steps: int = STEPS, decay: float = DECAY) -> Model:
    """rows: places in `chosen` of each row's terms. Adam on the mean log loss with weight decay, full batches."""
    n, k = len(rows), len(chosen)
    share = (labels.sum() + 0.5) / (n + 1)
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(k), rng.normal(0, 0.02, (k, RANK)), float(np.log(share / (1 - share)))
    at = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
    size = np.array([len(x) for x in rows], np.int64)
    first, of = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(n), size)
    parts = [w, v, np.array([bias])]
    one, two = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for step in range(1, steps + 1):
        logit, mean = _logits(parts[0], parts[1], parts[2][0], at, first)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n
        each = error[of]
        gw = np.bincount(at, each, k) + decay / n * parts[0]
        inner = each[:, None] * (mean[of] - parts[1][at])
        gv = np.stack([np.bincount(at, inner[:, j], k) for j in range(RANK)], axis=1) + decay / n * parts[1]
        for i, g in enumerate((gw, gv, np.array([error.sum()]))):
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.999 * two[i] + 0.001 * g * g
            parts[i] -= 0.05 * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, parts[0], parts[1], float(parts[2][0]))


def scores(model: Model, found: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(x) for x in found], np.int64)
    code = np.concatenate(found) if len(found) else np.zeros(0, np.int32)
    of = np.repeat(np.arange(len(found)), size)
    if len(model.terms):
        at = np.minimum(np.searchsorted(model.terms, code), len(model.terms) - 1)
        hit = model.terms[at] == code
        at, of = at[hit], of[hit]
    else:
        at, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(found)))])
    logit, _ = _logits(model.weights, model.factors, model.bias, at, first)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def learned(doc_id: Column) -> Column:
    """The rows that may teach: those outside the held-out fold."""
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(5)) != 0, F.lit(False))


def choose(counts: DataFrame, n: int, toxic: int, most: int = TERMS) -> DataFrame:
    """The terms (term, n rows, toxic rows) whose shares in toxic and other rows differ most for their error."""
    a, b = (F.col("toxic") + 0.1) / (toxic + 0.2), (F.col("n") - F.col("toxic") + 0.1) / (n - toxic + 0.2)
    p = (F.col("n") + 0.1) / (n + 0.2)
    z = F.abs(a - b) / F.sqrt(p * (1 - F.least(p, F.lit(0.999))) * (1 / (toxic + 0.2) + 1 / (n - toxic + 0.2)))
    return counts.where("n >= 2").withColumn("z", z).orderBy(F.desc("z"), "term").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    own = labels.where(learned(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id"))
    own = own.agg(F.min(label).alias("label"), F.max(label).alias("other"), F.count("*").alias("n")).where("label = other and n = 1")
    picked = own.select("id", F.col("label").cast("int")).orderBy(F.xxhash64("id"), "id").limit(rows)
    picked = stored(picked, "labelled")
    texts_of = for_python(docs).select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(picked), "id")
    found = texts_of.select(F.col("id").alias("doc_id"), "label", "text").mapInArrow(_terms_of, "doc_id long, label int, terms array<int>")
    found = stored(found, "terms")
    n, toxic = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == n:
        share = toxic / n if n else 0.0
        return Model(np.zeros(0, np.int32), np.zeros(0), np.zeros((0, RANK)), float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else (30 if share else -30), -30, 30)))
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    best = stored(choose(counts, n, toxic), "best").select("term")
    chosen = np.sort(np.array([x.term for x in best.toLocalIterator()], np.int32))
    small = found.select("doc_id", "label", F.array_intersect("terms", F.lit(chosen.tolist())).alias("terms")).orderBy("doc_id")
    got = small.toArrow()
    codes = [np.asarray(x, np.int32) for x in got.column("terms").to_pylist()]
    return fit([np.searchsorted(chosen, np.sort(x)) for x in codes], got.column("label").to_numpy().astype(float), chosen)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns `keep` under their names after an underscore."""
    text = keep.index("text") + 2 if "text" in keep else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, f"_{text}" if text >= 0 else "_text"):
                s = scores(model, terms(t))
                out = [t.rows.column(i) for i in range(len(keep) + 2)] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, [*(f"_{i}" for i in range(len(keep) + 2)), "score", "predicted"])

    held = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    first = [F.col("doc_id").cast("long").alias("_0"), held.alias("_1"), *[F.col(f"`{c}`").alias(f"_{i + 2}") for i, c in enumerate(keep)]]
    rows = for_python(docs).select(*first, *([] if text >= 0 else [F.col("text").alias("_text")]))
    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[: len(first)]]
    out = rows.mapInArrow(run, ", ".join([*kinds, "score double", "predicted int"]))
    return out.select(F.col("_0").alias("doc_id"), F.col("_1").alias("held_out"), "score", "predicted", *[F.col(f"_{i + 2}").alias(f"_{c}") for i, c in enumerate(keep)])


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their columns, that are not predicted toxic."""
    names = docs.columns
    return scored(docs, model, keep=tuple(names)).where("predicted = 0").select(*[F.col(f"`_{c}`").alias(c) for c in names])
