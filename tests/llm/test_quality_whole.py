"""Quality learns from whole tables: every labelled row sets the threshold, every row may be drawn for a tree."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm import quality


def test_every_labelled_row_sets_the_threshold(spark):
    """Of 24,000 labelled rows the bad ones all come behind the 20,000 least hashes of ids."""
    n_marks = "if(pmod(xxhash64(id, 1), 8) = 0, 5 + pmod(xxhash64(id, 20), 60), pmod(xxhash64(id, 21), 4))"
    marks = F.expr(f"repeat('#', cast({n_marks} as int))")
    word = lambda i: F.concat(F.lit("w"), F.expr(f"pmod(xxhash64(id, {i}), 30)"))
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[word(i) for i in range(2, 15)], marks).alias("text"))
    ranked = spark.range(24_000).withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")))
    bad = F.expr(f"{n_marks} > 4 and rank > 20000")
    labels = ranked.select(F.col("id").alias("doc_id"), (~bad).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    rows = quality.judged(docs, model).join(labels, "doc_id").where("not base_failed").select("anomaly", "quality").toPandas()
    assert len(rows) > 20_000 and np.isfinite(model.threshold)
    assert model.threshold == quality.calibrate(rows.anomaly.to_numpy(), rows.quality.to_numpy() > 0)
    got = quality.assessed(docs, labels).where("kept").count()
    assert got == (rows.anomaly <= model.threshold).sum()


def test_thresholds_of_tables_as_of_arrays(spark):
    rng = np.random.default_rng(3)
    cases = [(rng.integers(1, 40, 300) / 64, rng.random(300) < p) for p in (0.1, 0.5, 0.9)]
    cases += [(rng.random(300), rng.random(300) < 0.5), (np.full(5, 0.5), np.arange(5) < 2), (np.full(5, 0.5), np.arange(5) < 3)]
    cases += [(np.array([0.9, 0.8, 0.2]), np.array([True, True, False])), (np.array([0.3, 0.4]), np.array([True, True]))]
    for scores, good in cases:
        table = spark.createDataFrame(list(zip(scores.tolist(), good.tolist(), strict=True)), "score double, good boolean")
        assert quality.threshold(table) == quality.calibrate(scores, good)


def test_trees_draw_from_all_rows():
    rows = np.arange(30_000, dtype=np.float32)[:, None]
    forest = quality.grow(rows)
    assert forest.feature.shape[0] == quality.TREES and np.ptp(forest.value[forest.feature >= 0]) > 29_000
