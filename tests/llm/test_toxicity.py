import numpy as np
from pyspark.sql import functions as F

from courtside.llm import toxicity
from courtside.llm.common import held_out, table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    out = toxicity.predict(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"), 4, 3)).collect()
    assert np.mean([(r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in out]) > 0.95
    clean = [r for r in out if not r["toxic"]]
    assert np.mean([r["p_toxic"] >= 0.5 for r in clean]) < 0.02


def test_later_links_use_earlier_ones():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
    first = rng.integers(0, 2, 400)
    rows = [np.unique(np.r_[rng.choice(words[1:], 8), words[:1][: f]]) for f in first]
    links = toxicity.fit_chain(rows, np.stack([first, 1 - first], 1))
    assert links[1]["w"][len(links[1]["words"])] < -0.2
    extra = np.zeros((len(rows), 0))
    for link in links:
        extra = np.c_[extra, toxicity.probability(rows, extra, link)]
    assert np.mean((extra[:, 1] >= 0.5) == (first == 0)) > 0.99


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0, 1), (8, 1, 0), (11, 0, 0), (12, 1, 1), (12, 1, 1), (None, 1, 1), (3, None, 0)], "doc_id long, low_quality int, toxic int")
    links = toxicity.train(odd, labels)
    got = toxicity.predict(odd, links).collect()
    assert len(got) == odd.count() and all(0 <= r["p_toxic"] <= 1 for r in got)
    assert toxicity.predict(empty, links).collect() == []
    none = toxicity.train(odd, labels.where("false"))
    assert {r["p_toxic"] for r in toxicity.predict(odd, none).collect()} == {0.0}
