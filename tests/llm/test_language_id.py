import numpy as np
from pyspark.sql import functions as F

from courtside.llm import language_id
from courtside.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    got = language_id.predict(docs, language_id.train(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert len(got) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_sizes_are_those_of_a_compressor(spark):
    one = language_id.coder(b"some words of a language " * 40, 64)
    text = b"words of a language, some words and others" * 5
    assert language_id.sizes(text, [one], 64)[0] == sum(len(one.compress(text[i : i + 64])) for i in range(0, len(text), 64))


def test_odd_rows(odd, empty):
    model = language_id.train(odd, F.lit(True))
    got = language_id.predict(odd, model).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 12)) and by[4][0] == "en"
    assert language_id.predict(empty, model).collect() == []
    assert {r["lang_pred"] for r in language_id.predict(odd, {}).collect()} == {"und"}


def test_narrow_margins_are_rejected(spark):
    docs = spark.createDataFrame([(1, "words both know well")], "doc_id long, text string")
    same = b"words both know well and others too"
    assert [r["rejected"] for r in language_id.predict(docs, {"a": same, "b": same}).collect()] == [True]


def test_rows_that_teach_nothing_share_an_id_with_one_that_does(spark):
    rows = [(1, "learnt words", "en"), (1, "unlabelled words", None), (1, "mots appris", "fr"), (2, "held words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(docs, F.col("doc_id") == 1) == {"en": b"learnt words\n", "fr": b"mots appris\n"}


def test_learning_shuffles_no_text(spark, small, monkeypatch):
    plans = []
    monkeypatch.setattr(type(small), "collect", lambda df: plans.append(df) or [])
    language_id.train(small, F.lit(True))
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
