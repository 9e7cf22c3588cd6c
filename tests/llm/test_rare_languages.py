"""Language identification: rare languages are learned too."""

import numpy as np
from pyspark.sql import functions as F

from skein.llm import langid


def test_a_language_of_one_document(spark):
    fi = "hyvää huomenta kaikille, tänään on kaunis päivä ja aurinko paistaa järven yllä"
    rows = [(i, f"the weather is fine today and number {i} of the ships sails over the sea", "en") for i in range(20)]
    docs = spark.createDataFrame([*rows, (20, fi, "fi")], "doc_id long, text string, lang string")
    samples = langid.sample(docs, F.lit(True))
    assert set(samples) == {"en", "fi"}
    assert samples["fi"][1].sum() == len(langid.count(np.frombuffer(fi.encode(), np.uint8), np.array([0, len(fi.encode())]))[1])
    asked = spark.createDataFrame([(1, "tänään aurinko paistaa"), (2, "the ships sail today")], "doc_id long, text string")
    assert {x.doc_id: x.lang_pred for x in langid.identified(asked, langid.fit(samples)).collect()} == {1: "fi", 2: "en"}
