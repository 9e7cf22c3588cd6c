"""MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

A document's set holds its distinct shingles of `size` words (the whole sequence as one shingle where it has fewer
words). Two documents are linked when their sets' Jaccard similarity is at least `percent` / 100.

Sketch: in round i every shingle is thrown into one of `bins` bins with a value in [i, i + 1); a bin keeps its least
value. The rounds after the first `bins` throw all shingles into one bin each, so every bin is full after 2 * bins
rounds whatever the set's size; nearly always a few rounds do. Agreement of two sketches concentrates around the
similarity. `bands` bands of `per_band` bins make the candidates: at similarity 0.8 the defaults miss a pair with a
chance of (1 - 0.8**6)**56 = 4e-8.

Defined cases: a null or wordless text has no set, links with nothing and is kept. Rows without doc_id are never linked
(component_id null, kept). Rows that repeat a doc_id are one document. Input columns other than doc_id and text are
ignored and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import Texts, for_python, mix, texts, window_hashes, words
from skein.storage import discard, stored

BINS, PER_BAND, BANDS = 336, 6, 56
#: Hash classes of the semi-join that thins out documents before their texts are shuffled: at most 2**20 longs, 8 MB.
CLASSES = 1 << 20
#: Words of the bitmaps that bound similarities from above.
MARKS = 32
#: Rows that are held against one copy of a leader's set; larger groups are dealt to more tasks.
GROUP = 128


def shingle_sets(t: Texts, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = words(t, lower=True)
    hashes, whole = window_hashes(w, size)
    out = []
    for i in range(len(t.bounds) - 1):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= size:
            out.append(np.unique(hashes[a:b][whole[a:b]]))
        elif b > a:
            code = np.frombuffer(hashlib.blake2b(w.hash[a:b].tobytes(), digest_size=8).digest(), np.uint64)
            out.append(code.copy())
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of `bins` values for each set; a set without elements has the largest value everywhere."""
    full = np.iinfo(np.uint64).max
    out = np.full((len(sets), bins), full, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    todo = np.flatnonzero(sizes)
    low = np.uint64(48)
    for i in range(2 * bins):
        if not len(todo):
            break
        items = np.concatenate([sets[k] for k in todo])
        row = np.repeat(todo, sizes[todo])
        h = mix(items ^ mix(np.array([i + 1], np.uint64)))
        where = (h >> np.uint64(32)) % np.uint64(bins) if i < bins else np.full(len(h), i - bins, np.uint64)
        value = (np.uint64(i) << low) | (mix(h) >> np.uint64(16))
        np.minimum.at(flat, row * bins + where.astype(np.int64), value)
        todo = todo[(out[todo] == full).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    n, bins = sketch.shape
    per = bins // bands
    part = sketch[:, : bands * per].reshape(n, bands, per)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(per):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j])
    return key.view(np.int64)


_SETS = "doc_id long, n_shingles long, digest binary, bands array<long>, marks array<long>"


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """MARKS * 64 bits for each set, those set that the hash of a shingle names."""
    bits = np.zeros((len(sets), MARKS * 64), np.uint8)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(row):
        bits[row, (np.concatenate(sets) % np.uint64(MARKS * 64)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _sets_of(size: int, bins: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                sets = shingle_sets(t, size)
                keys = band_keys(sketches(sets, bins), bands)
                n = np.array([len(s) for s in sets], np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                held = np.where(n > 0, bands, 0)
                offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys[n > 0].reshape(-1)))
                marks = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * MARKS, pa.array(bitmaps(sets).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [t.rows.column(0).cast(pa.int64()), pa.array(n), pa.array(digest, pa.binary()), lists, marks],
                    ["doc_id", "n_shingles", "digest", "bands", "marks"],
                )

    return run


def shingled(docs: DataFrame, size: int = 5, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, band keys, bitmap; digest is null and bands empty without a set."""
    return for_python(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_sets_of(size, bins, bands), _SETS)


def _compare(size: int, percent: int):
    """Rows come sorted by (a, salt), a's own text first; each other set is held against a's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, []
        for batch in batches:
            for t in texts(batch):
                left, right, found = t.rows.column(0).to_pylist(), t.rows.column(1).to_pylist(), []
                for a, b, s in zip(left, right, shingle_sets(t, size), strict=True):
                    if a != leader:
                        leader, own = a, []
                    if a == b:
                        own.append(s)
                        continue
                    for x in own:
                        if min(len(x), len(s)) * 100 < percent * max(len(x), len(s)):
                            continue
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(s) - both):
                            found.append((a, b))
                            break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, from the documents' texts.

    Members of one leader are dealt out in groups of GROUP, and the leader's text goes to each group, so a leader with
    very many members is shared among tasks and only one set is held at a time.
    """
    spark = pairs.sparkSession
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    members = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"))
    leaders = counts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    need = stored(members.unionByName(leaders), "need")
    classes = need.select(F.pmod(F.xxhash64("b"), F.lit(CLASSES)).alias("class")).distinct()
    thin = docs.select(F.col("doc_id").cast("long").alias("b"), "text").join(
        F.broadcast(classes), F.pmod(F.xxhash64("b"), F.lit(CLASSES)) == F.col("class"), "left_semi"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = need.join(thin, "b").repartition(parts, "a", "salt")
    dealt = dealt.sortWithinPartitions("a", "salt", (F.col("a") != F.col("b")), "b")
    found = for_python(dealt).select("a", "b", "text").mapInArrow(_compare(size, percent), "a long, b long").distinct()
    found = stored(found, "verified")
    discard(need)
    return found


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): each id of the edges (a, b) with the smallest id that it is connected with.

    Large-star and small-star steps in turn, until the edges stand still; every step is two joins on node ids with
    minima taken before the shuffle, and stored, so neither a large component nor a lost executor hurts.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        # stored, so that the joins deal out both sides anew and a hot node's rows can be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u > v").distinct(), "small")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now, large, least, low)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    1. One pass over the texts writes sets' sizes, digests and band keys. Equal sets fall together by their digest, and
       only the smallest doc_id of each set goes on.
    2. In each bucket of a band every member is held against the smallest one on the whole sets.
    3. Where a bucket's members still belong to several components, the pairs across components are held against each
       other as well, so the smallest member's part in it loses no link - save those whose sizes or bitmaps prove them
       too different: a bit of one set's bitmap that the other's lacks stands for a shingle that the other lacks.
    """
    sets = stored(shingled(docs, size, bins, bands), "sets")
    having = sets.where("digest is not null and doc_id is not null")
    reps = having.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    reps = stored(reps, "reps")
    banded = reps.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("size"))
    shared = stored(shared.where("lead < last").select("key", "lead", "size"), "shared")
    member = stored(banded.join(shared, "key").select("key", "id", "n", "lead", "size"), "member")
    stars = member.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    discard(shared)
    links = verified(stars, docs, size, percent)
    same = reps.join(having.select("digest", "doc_id"), "digest").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    named = having.select("doc_id", "digest").join(same, "doc_id").join(reps, "digest").where("rep > a").select("a", F.col("rep").alias("b"))
    links = links.union(named)
    labelled = stored(components(links), "labelled")
    left = member.where("size > 2").join(labelled, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # the bucket's commonest component is joined with the others, never with itself
    tally = left.groupBy("key", "component").agg(F.count("*").alias("rows"))
    mixed = tally.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1")
    # stored, so that the join deals the members out anew and a hot bucket's rows can be split
    mixed = stored(mixed, "mixed")
    marks = reps.select(F.col("rep").alias("id"), *[F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)])
    left = left.join(mixed.select("key", F.col("x.component").alias("main")), "key").select("key", "id", "n", "lead", "component", "main")
    left = stored(left.join(marks, "id"), "left")
    one, two = left.where("component <> main").alias("one"), left.alias("two")
    lacking = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    lacks = lambda a, b: reduce(add, [lacking(F.col(f"{a}.m{i}"), F.col(f"{b}.m{i}")) for i in range(MARKS)])
    most = F.least(F.col("one.n") - lacks("one", "two"), F.col("two.n") - lacks("two", "one"))
    across = one.join(
        two,
        (F.col("one.key") == F.col("two.key"))
        & (F.col("one.component") != F.col("two.component"))
        & ((F.col("two.component") == F.col("two.main")) | (F.col("one.id") < F.col("two.id")))
        & (F.col("one.id") != F.col("one.lead"))
        & (F.col("two.id") != F.col("two.lead"))
        & (F.least("one.n", "two.n") * 100 >= F.greatest("one.n", "two.n") * percent)
        & (most * 100 >= (F.col("one.n") + F.col("two.n") - most) * percent),
    )
    pair = (F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b"))
    across = stored(across.select(*pair).distinct(), "across")
    discard(member, mixed, left)
    if not across.isEmpty():
        more = verified(across, docs, size, percent)
        if not more.isEmpty():
            labelled = components(labelled.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))
    of_set = reps.join(labelled, reps.rep == labelled.id, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    own = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, of which one stays for each group of near copies: the one with the smallest
    doc_id. Of rows with one doc_id the one whose text sorts first stays; rows without doc_id all stay.

    Only rows whose id falls into a hash class of an id that has to go, or occurs twice, are shuffled.
    """
    found = stored(near_duplicates(docs, size, percent), "found").select("doc_id", "kept").where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    # a row goes through as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    doubtful = stored(ids.where("not kept or rows > 1").select(F.col("doc_id").alias("id"), "kept"), "doubtful")
    class_of = F.pmod(F.xxhash64("id"), F.lit(CLASSES))
    classes = F.broadcast(doubtful.select(class_of.alias("class")).distinct())
    sure = rows.join(classes, class_of == F.col("class"), "left_anti")
    rest = rows.join(classes, class_of == F.col("class"), "left_semi")
    rest = rest.join(doubtful, "id", "left").where(F.coalesce("kept", F.lit(True)))
    first = Window.partitionBy("id").orderBy("row.text")
    # ids that are null are all their own: they do not gather in one task
    none, rest = rest.where("id is null"), rest.where("id is not null").withColumn("at", F.row_number().over(first)).where("at = 1")
    return sure.select("row.*").unionByName(none.select("row.*")).unionByName(rest.select("row.*"))
