"""Quality: the labels alone set the threshold, and menus of words between marks go."""

import numpy as np

from skein.llm import quality
from skein.llm.common import documents

DIR = "/root/testdata/sf0.01"


def test_labels_alone_set_the_threshold():
    scores = np.concatenate([np.linspace(0.7, 0.9, 50), [0.85], np.linspace(0.3, 0.5, 49)])
    good = np.arange(100) >= 50
    # the best cut loses one good row of 50, 2 %
    assert 0.5 < quality.calibrate(scores, good) < 0.7


def test_bad_rows_go(spark):
    docs, labels = documents(spark, DIR), spark.read.parquet(f"{DIR}/labels.parquet")
    got = quality.judged(docs, quality.train(docs, labels)).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id")
    got = got.where("not base_failed").select("kept", "quality", "text").collect()
    bad = [x for x in got if x.quality == 0]
    menus = [x for x in bad if x.text.count(" | ") > 5]
    assert menus and not any(x.kept for x in menus)
    assert np.mean([x.kept for x in bad]) < 0.05
    assert np.mean([x.kept for x in got if x.quality == 1]) > 0.98
