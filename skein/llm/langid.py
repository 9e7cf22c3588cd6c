"""Language identification by prediction by partial matching.

For each language a context tree over bytes counts which byte follows each context of up to `order` bytes. With escape
method C, byte c after a context costs -log2(count / (total + distinct)) bits where the longest context has seen c, and
an escape of -log2(distinct / (total + distinct)) bits for each longer context that has not. A text's cost under frozen
counts is the exact sum over its bytes, and the language with the least cost is predicted.

Bytes are read through a fixed table that makes ASCII letters lower case and all other ASCII bytes one separator, so
digits and marks tell nothing; runs of separators count once. The cost of a byte depends on the order + 1 last bytes
only: a step looks up each distinct (order + 1)-gram of its texts once.

Learning takes at most `per_language` documents of each language, those with the least hash of the id (rows that share an
id all teach), whole texts, whose grams are counted in the executors: the model's size is bounded by the number of
languages. Every labelled language is learned, however rare.

score is the winner's share when costs per byte are turned into odds: 1 / sum(2 ** -(cost - least cost) * sharpness).
Texts that are null or hold no letter get `und` with score 0. Rejected (in a pipeline) are `und` texts and those that
even the best language codes worse than `worst` bits a byte.

Defined cases: without any learned language every text with a letter is `und` too; ties go to the first language by
code point; repeated rows and null ids are kept; null lang teaches nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import STEP_BYTES, crc32_of_id, for_python, texts
from skein.storage import stored

ORDER, PER_LANGUAGE = 4, 400
#: How fast a difference of one bit a byte turns into odds, and bits a byte above which a text is no known language: bytes
#: that no language has cost 20 and more, short texts with keys or numbers among words stay under 7.
SHARPNESS, WORST = 8.0, 12.0
#: Bytes of the table: 0 is the separator.
_TABLE = np.zeros(256, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


class Model(NamedTuple):
    """Languages, and for each language and length n of a gram (1 .. order + 1): the grams' codes in order, the bits of
    their last byte after the rest, and for the rest as a context the bits of an escape."""

    languages: list[str]
    order: int
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    escapes: list[list[tuple[np.ndarray, np.ndarray]]]


def _symbols(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes through the table, single separators around each text's runs of letters, and the new bounds.

    Every text starts with a separator.
    """
    n = len(bounds) - 1
    seen = _TABLE[buf]
    at = bounds[:-1] + np.arange(n)
    out = np.zeros(len(buf) + n, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside] = seen
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[at] = True
    return out[keep], np.concatenate([np.cumsum(keep)[at] - 1, [int(keep.sum())]])


def _codes(symbols: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte but a text's first separator, the code of the order + 1 bytes that end there; texts' new bounds.

    Before its first byte a text has separators only.
    """
    n = len(symbols)
    code = np.zeros(n, np.uint64)
    row_start = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(n) - row_start
    for back in range(order + 1):
        part = np.zeros(n, np.uint64)
        part[back:] = symbols[: n - back] if back else symbols
        if back:
            part[place < back] = 0
        code |= part << np.uint64(8 * back)
    keep = np.ones(n, bool)
    keep[bounds[:-1]] = False
    return code[keep], bounds - np.arange(len(bounds))


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << (8 * length)) - 1)


def count(buf: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (order + 1)-grams of texts and how often each occurs."""
    code, _ = _codes(*_symbols(buf, bounds), order)
    return np.unique(code, return_counts=True)


def fit(counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The frozen counts of each language, from its (order + 1)-grams and their counts: a shorter gram occurs as often as
    all that end in it."""
    languages, grams, escapes = sorted(counted), [], []
    for name in languages:
        code, times = counted[name]
        by_length, by_context = [], []
        for length in range(1, order + 2):
            gram, which = np.unique(code & _mask(length), return_inverse=True)
            n = np.bincount(which, times)
            context, start = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(start, n), np.bincount(start)
            by_length.append((gram, -np.log2(n / (total + distinct)[start])))
            by_context.append((context, -np.log2(distinct / (total + distinct))))
        grams.append(by_length)
        escapes.append(by_context)
    return Model(languages, order, grams, escapes)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_costs(model: Model, grams: np.ndarray) -> np.ndarray:
    """Bits of each (order + 1)-gram's last byte under each language: [language, gram]."""
    out = np.zeros((len(model.languages), len(grams)))
    for k in range(len(model.languages)):
        open_ = np.arange(len(grams))
        for length in range(model.order + 1, 0, -1):
            here = grams[open_] & _mask(length)
            keys, bits = model.grams[k][length - 1]
            at, hit = _found(keys, here)
            out[k, open_[hit]] += bits[at[hit]]
            open_, here = open_[~hit], here[~hit]
            contexts, escape = model.escapes[k][length - 1]
            at, known = _found(contexts, here >> np.uint64(8))
            out[k, open_[known]] += escape[at[known]]
        out[k, open_] += 8.0
    return out


def costs(model: Model, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language [text, language], and the bytes that were coded."""
    code, bounds = _codes(*_symbols(buf, bounds), model.order)
    n = len(bounds) - 1
    out = np.zeros((n, len(model.languages)))
    # a long text's bytes go through in steps
    for at in range(0, len(code), STEP_BYTES):
        part = code[at : at + STEP_BYTES]
        distinct, which = np.unique(part, return_inverse=True)
        by_gram = gram_costs(model, distinct)
        row = np.searchsorted(bounds, np.arange(at, at + len(part)), "right") - 1
        for k in range(len(model.languages)):
            out[:, k] += np.bincount(row, by_gram[k][which], n)
    return out, np.diff(bounds)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram and count of each batch of lang, text."""
    for batch in batches:
        for t in texts(batch):
            langs, which = np.unique(np.array(t.rows.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for k, lang in enumerate(langs):
                rows = np.flatnonzero(which == k)
                raw = [t.bytes(i) for i in rows]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
                gram, n = count(np.frombuffer(b"".join(raw), np.uint8), bounds)
                columns = [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counted grams to learn from, of each language at most per_language rows, those with the least hash of doc_id.

    No language is gathered in one task, however many rows it has, and texts stay in the executors: the driver gets the
    sums of distinct grams, of which a language has the fewer the longer its texts are.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", F.col("lang").cast("string").alias("lang"))
    # of a large language only rows with a low hash go on: three times as many as wanted, so the least ones are among them
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    low = rows.join(counts, "lang").where(place.cast("double") * F.col("n") < 3.0 * per_language * (1 << 40))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = low.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("doc_id", "lang").distinct()
    lettered = docs.where(learn & has_letter(F.col("text")))
    picked = lettered.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    grams = for_python(picked).select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long")
    sums = stored(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams").orderBy("lang", "gram").toArrow()
    langs = sums.column("lang").combine_chunks().dictionary_encode()
    gram, n = sums.column("gram").to_numpy().view(np.uint64), sums.column("n").to_numpy()
    which = langs.indices.to_numpy()
    return {name: (gram[which == k], n[which == k]) for k, name in enumerate(langs.dictionary.to_pylist())}


def learned(doc_id: Column) -> Column:
    """The rows that may teach: those outside the held-out fold."""
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(4)) != 2, F.lit(False))


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (a byte, of the best language; null for `und`), and the columns
    `keep` under their names after an underscore."""
    size, text = len(model.languages), keep.index("text") + 2 if "text" in keep else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        column = f"_{text}" if text >= 0 else "_text"
        for batch in batches:
            for t in texts(batch, column):
                letter = np.asarray(t.rows.column(t.rows.schema.get_field_index("_letter")).to_numpy(zero_copy_only=False), bool)
                n = len(letter)
                best, score, bits = np.full(n, size), np.zeros(n), np.full(n, np.nan)
                if size and letter.any():
                    cost, coded = costs(model, t.buf, t.bounds)
                    per = cost / np.maximum(coded, 1)[:, None]
                    first = per.argmin(axis=1)
                    low = per[np.arange(n), first]
                    share = 1 / np.exp2(-(per - low[:, None]) * SHARPNESS).sum(axis=1)
                    best, score, bits = np.where(letter, first, size), np.where(letter, share, 0.0), np.where(letter, low, np.nan)
                out = [t.rows.column(i) for i in range(len(keep) + 2)]
                out += [pa.array(names[best], pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits))]
                yield pa.RecordBatch.from_arrays(out, [*(f"_{i}" for i in range(len(keep) + 2)), "lang_pred", "score", "bits"])

    held = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    first = [F.col("doc_id").cast("long").alias("_0"), held.alias("_1"), *[F.col(f"`{c}`").alias(f"_{i + 2}") for i, c in enumerate(keep)]]
    rest = [has_letter(F.col("text")).alias("_letter"), *([] if text >= 0 else [F.col("text").alias("_text")])]
    rows = for_python(docs).select(*first, *rest)
    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[: len(first)]]
    out = rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double", "bits double"]))
    return out.select(F.col("_0").alias("doc_id"), F.col("_1").alias("held_out"), "lang_pred", "score", "bits", *[F.col(f"_{i + 2}").alias(f"_{c}") for i, c in enumerate(keep)])


def accepted(docs: DataFrame, model: Model, worst: float = WORST) -> DataFrame:
    """The rows of docs, with their columns, that are in a learned language."""
    names = docs.columns
    found = identified(docs, model, keep=tuple(names)).where((F.col("lang_pred") != "und") & (F.col("bits") <= worst))
    return found.select(*[F.col(f"`_{c}`").alias(c) for c in names])
