"""Exact top-k search: the three-phase uniform threshold algorithm over blocks of dimensions.

Vectors are turned into integers floor(256 * x); a score is the integer inner product. The dimensions form `parts`
blocks, each with its own list of partial scores, and a score is the sum over the blocks.

A task puts its rows into groups of near vectors. A group's centre and radius in a block of dimensions bound all partial
scores of its rows there (q * centre + |q| * radius), so a block's list is read group by group, the highest bound first.

1. Every task takes the head of each block's list for each query, the group with the highest bound, and resolves the
   scores of its rows alone; the k-th best of all tasks' rows is a lower bound t of the query's k-th best score.
2. t goes to all tasks. A row whose partial scores all lie below t / parts scores less than t. So groups whose bounds all
   lie below t / parts, or together below t, are passed over unread, and of the others' rows those are collected that
   have a partial score of t / parts or more.
3. The collected rows' scores are resolved exactly, and the k best stay, ties to the smaller vec_id.

How much the bounds save depends on how much the vectors cluster; on unrelated vectors all groups are read, once.

Queries come in blocks of about QUERIES rows, dealt by a hash (QUERIES * dimension * 8 bytes are broadcast, whatever the
table's size); each block reads all rows twice, and nothing but the k best rows of each task is shuffled.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates for it; rows without vec_id take no part. Of repeated query ids the vector
that sorts first asks; repeated candidate rows are candidates each. Components beyond 2**55 count as the largest or
smallest long when they are turned into integers, and scores beyond a long are the nearest long. Columns but vec_id and
embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import for_python
from skein.storage import stored

#: Queries of one block, rows that are grouped at a time, and rows that a group has on average.
QUERIES, ROWS, GROUP = 8192, 4096, 64

_FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(256 * x); only rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix for at most ROWS rows of one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = part.column(0).to_numpy()
            lists = part.column(1)
            sizes = np.asarray(lists.value_lengths())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                yield ids[rows], flat[starts[rows][:, None] + np.arange(size)]


class Block(NamedTuple):
    """Queries of one dimension: ids, integers, and both by block of dimensions as floats."""

    ids: np.ndarray
    whole: np.ndarray
    by_part: list[np.ndarray]
    norms: np.ndarray
    parts: list[np.ndarray]


def asked(ids: list[int], vectors: list[list[int]], parts: int) -> Block:
    whole = np.array(vectors, np.int64)
    cuts = np.array_split(np.arange(whole.shape[1]), parts)
    by_part = [whole[:, c].astype(np.float64) for c in cuts]
    return Block(np.array(ids, np.int64), whole, by_part, np.stack([np.linalg.norm(x, axis=1) for x in by_part]), cuts)


def _kind(q: np.ndarray, v: np.ndarray):
    """The type that holds all partial sums of q @ v exactly."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1]
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _grouped(v: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of near vectors: each row goes to the nearest of evenly spaced rows."""
    n = -(-len(v) // GROUP)
    x = v.astype(np.float64)
    pivots = x[np.linspace(0, len(v) - 1, n).astype(int)]
    nearest = (x @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    return [g for g in np.split(order, np.searchsorted(nearest[order], np.arange(1, n))) if len(g)]


def _bounds(block: Block, v: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the partial scores: [part, query, group]."""
    out = np.empty((len(block.parts), len(block.ids), len(groups)))
    for p, cut in enumerate(block.parts):
        x = v[:, cut].astype(np.float64)
        centre = np.stack([x[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre, strict=True)])
        out[p] = block.by_part[p] @ centre.T + block.norms[p][:, None] * radius
        # what rounding may have taken away
        out[p] += 1e-9 * block.norms[p][:, None] * (np.linalg.norm(centre, axis=1) + radius) + 1e-6
    return out


def _first(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(start, np.diff([*start, len(query)]))
    return query[place < k], vec[place < k], score[place < k]


def heads(block: Block, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 on some rows: query, vec_id and score of the k best rows among each list's first group."""
    groups, kind = _grouped(v), _kind(block.whole, v)
    bounds = _bounds(block, v, groups)
    chosen = np.zeros(bounds.shape[1:], bool)
    for by_query in bounds:
        chosen[np.arange(len(chosen)), by_query.argmax(axis=1)] = True
    found = []
    for g, rows in enumerate(groups):
        if len(of := np.flatnonzero(chosen[:, g])):
            whole = block.whole[of].astype(kind) @ v[rows].astype(kind).T
            q, r = np.nonzero(block.ids[of][:, None] != ids[rows])
            found.append((block.ids[of][q], ids[rows][r], _score(whole[q, r])))
    return _first(*map(np.concatenate, zip(*found, strict=True)), k)


def _score(x: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return x.astype(np.int64)
    low, high = -(2**63) + 1, 2**63 - 1
    return np.array([min(max(s, low), high) for s in x], np.int64)


def resolved(block: Block, ids: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Phases 2 and 3 on some rows: the k best rows of each query that reach its threshold `least` (-inf: none known),
    and how many (query, row) pairs were looked at."""
    groups, kind = _grouped(v), _kind(block.whole, v)
    bounds, share = _bounds(block, v, groups), least / len(block.parts)
    open_ = (bounds.sum(axis=0) >= least[:, None]) & (bounds >= share[None, :, None]).any(axis=0)
    if kind is object:
        open_[:] = True
    found, seen = [(np.zeros(0, np.int64),) * 3], 0
    for g, rows in enumerate(groups):
        if not len(of := np.flatnonzero(open_[:, g])):
            continue
        q, w = block.whole[of].astype(kind), v[rows].astype(kind)
        by_part = [q[:, c] @ w[:, c].T for c in block.parts]
        near = by_part[0] >= share[of][:, None]
        for x in by_part[1:]:
            near |= x >= share[of][:, None]
        qi, ri = np.nonzero(near)
        seen += near.size
        score = sum(x[qi, ri] for x in by_part)
        ok = (score >= least[of][qi]) & (block.ids[of][qi] != ids[rows][ri])
        found.append((block.ids[of][qi[ok]], ids[rows][ri[ok]], _score(score[ok])))
    return _first(*map(np.concatenate, zip(*found, strict=True)), k), seen


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    columns = _first(*map(np.concatenate, zip(*parts, strict=True)), k) if parts else (np.zeros(0, np.int64),) * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def _first_phase(blocks: dict[int, Block], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list = []
        for ids, v in _blocks(batches):
            if v.shape[1] in blocks:
                top.append(heads(blocks[v.shape[1]], ids, v, k))
            if len(top) > 8:
                top = [_first(*map(np.concatenate, zip(*top, strict=True)), k)]
        yield _merged(top, k)

    return run


def _other_phases(blocks: dict[int, Block], least: dict[int, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list = []
        # rounded down, where a long is no double
        cuts = {n: np.array([least.get(int(x), -np.inf) for x in b.ids], np.float64) for n, b in blocks.items()}
        cuts = {n: np.where(np.abs(x) < 2**52, x, x - np.abs(x) * 1e-12) for n, x in cuts.items()}
        for ids, v in _blocks(batches):
            if v.shape[1] in blocks:
                top.append(resolved(blocks[v.shape[1]], ids, v, cuts[v.shape[1]], k)[0])
            if len(top) > 8:
                top = [_first(*map(np.concatenate, zip(*top, strict=True)), k)]
        yield _merged(top, k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int = 4) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each row of `queries` its k best rows of `vectors`, itself apart."""
    rows = for_python(stored(integers(vectors), "vectors"))
    asks = integers(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    count = asks.count()
    blocks = max(1, -(-count // QUERIES))
    asks = stored(asks.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "asks")
    found = []
    for block in range(blocks):
        by_size: dict[int, tuple[list[int], list[list[int]]]] = {}
        for x in asks.where(F.col("block") == block).select("vec_id", "v").toLocalIterator():
            ids, v = by_size.setdefault(len(x.v), ([], []))
            ids.append(x.vec_id)
            v.append(x.v)
        own = {n: asked(ids, v, parts) for n, (ids, v) in by_size.items()}
        least = {x.query_id: x.score for x in _kth(rows.mapInArrow(_first_phase(own, k), _FOUND), k).toLocalIterator()}
        best = rows.mapInArrow(_other_phases(own, least, k), _FOUND)
        found.append(stored(best, "best") if blocks > 1 else best)
    out = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "score")
