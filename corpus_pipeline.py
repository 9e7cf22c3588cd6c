"""The corpus pipeline: documents in, token digests of the cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, langid, minhash, mixing, toxicity
from skein.llm.common import documents
from skein.storage import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own labels teach.

    Null, empty and letterless texts go, and texts that no learned language codes. Rows with null ids or null lang, long
    texts and repeated rows are judged as they come; ties between languages do not matter, as both accept. An empty table,
    or one without any label, gives an empty table. Columns of any name stay.
    """
    return langid.accepted(docs, langid.fit(langid.sample(docs, langid.learned(F.col("doc_id")))))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model of the labelled ones.

    Null and empty texts have no terms and stay, unless most labelled documents are toxic. A score of exactly 0.5 goes.
    Rows with null ids, long texts and repeated rows are judged as they come. Without labels of both kinds all rows stay if
    the labels hold none that is toxic. An empty table stays empty. Columns of any name stay.
    """
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more.

    The smallest doc_id of a group stays. Null, empty and wordless texts are no copies of anything and stay; rows without
    doc_id stay. Of rows with one doc_id the one whose text sorts first stays, nulls first. An empty table stays empty.
    Columns of any name stay.
    """
    return minhash.deduplicated(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them.

    Null, empty and wordless texts have no words and are never taken. Null sources are one source, the last. Rows without
    doc_id are told apart by their texts, equal rows by nothing. Ties at a source's cut are broken by a seeded hash. An
    empty table stays empty. Columns of any name stay.
    """
    return mixing.expanded(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to, for each row.

    A null text is the empty text, without ids. Null ids and repeated rows are kept as they come; long texts are encoded
    whole. An empty table stays empty. Columns but doc_id and text are dropped.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", not_toxic), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Model fits and sampled hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
