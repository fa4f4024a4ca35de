"""Dictionaries of languages with few long texts and with many."""

from pyspark.sql import functions as F

from courtside.llm import language_id


def test_few_long_texts_fill_their_dictionary(spark):
    long = [(k, " ".join(f"w{k}x{j}" for j in range(4000)), "aa") for k in range(3)]
    many = [(100 + k, f"text{k} " * 600, "bb") for k in range(60)]
    got = language_id.train(spark.createDataFrame(long + many, "doc_id long, text string, lang string"), F.lit(True))
    whole = sum(len(t) + 2 for _, t, _ in long)
    assert len(got["aa"]) >= min(whole, 110 << 10) - 100 and len(got["bb"]) == 110 << 10
    assert sum(b"text%d " % k in got["bb"] for k in range(60)) >= 27      # 4,096 bytes of each come before the rest of any


def test_all_of_a_text_counts(spark):
    text = " ".join(f"word{j}" for j in range(3000))
    got = language_id.train(spark.createDataFrame([(1, text, "aa")], "doc_id long, text string, lang string"), F.lit(True))
    assert sum(f"word{j}".encode() not in got["aa"] for j in range(3000)) <= 1 and len(got["aa"]) >= len(text)      # one word is cut by the share
