"""The pipeline's stages, each against a plain reading of what it should keep."""

import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe
from skein.llm.common import documents
from skein.storage import stored
from tests.llm.test_minhash import brute

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, seen = documents(spark, DIR), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DIR), name)
        seen[name] = (before, docs)
        if name != "encode":
            assert docs.dtypes == documents(spark, DIR).dtypes
            assert docs.exceptAll(before).dropDuplicates(["doc_id"]).join(before, "doc_id", "left_anti").count() == 0
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    before, after = seen["language"]
    assert after.count() >= 0.99 * before.count()
    before, after = seen["toxicity"]
    clean = before.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.01 * clean.count()
    before, after = seen["near_dedup"]
    want = brute([(x.doc_id, x.text) for x in before.collect()], 5, 80)
    assert sorted(x.doc_id for x in after.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    before, after = seen["encode"]
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    ids = [(x.doc_id, ",".join(map(str, lib.encode_ordinary(x.text)))) for x in before.collect()]
    assert sorted((x.doc_id, x.ids_sha256) for x in after.collect()) == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def through(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, DIR), name)
        assert after.columns == docs.columns
        docs = after
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, DIR)


def test_odd_rows_go_through(spark, odd):
    more = documents(spark, DIR).limit(300)
    for c in odd.columns[len(more.columns) :]:
        more = more.withColumn(c, F.lit(None).cast(odd.schema[c].dataType))
    docs, out = through(spark, odd.unionByName(more.withColumn("doc_id", F.col("doc_id") + 100_000)))
    got = out.collect()
    assert len(got) == docs.count() and not {x.doc_id for x in got} & {3, 4, 5, 11}
    assert all(x.text for x in docs.collect())


def test_empty_table_goes_through(spark, none):
    docs, out = through(spark, none)
    assert docs.count() == 0 and out.count() == 0
