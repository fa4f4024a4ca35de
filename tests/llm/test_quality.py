import numpy as np

from courtside.llm import quality
from courtside.llm.common import held_out, table
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = quality.score(docs, quality.train(docs, labels))
    got = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"), 4, 2)).select("predicted", "quality", "score").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_descent_reaches_the_hinge_optimum():
    """Against plain subgradient steps on the primal, on a small problem."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    y = np.array([1.0 if 3 in x or 7 in x else -1.0 for x in rows])
    scale, cost = rng.uniform(0.5, 2, 20), np.full(60, 1.0)
    w = quality.dual_coordinate_descent(rows, y, scale, cost, epochs=200)
    x = np.zeros((60, 21))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
        x[i, 20] = 1

    def primal(v):
        return v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()

    v = np.zeros(21)
    best = primal(v)
    for t in range(1, 20000):
        v -= (v - ((y * (x @ v) < 1) * y) @ x) / t
        best = min(best, primal(v))
    assert primal(w) <= best * 1.01


def test_odd_rows_have_scores(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (8, 1), (11, 0), (12, 0), (12, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty, model).collect() == []
    none = quality.train(odd, labels.where("false"))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
