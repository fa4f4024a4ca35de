"""Registered queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import alignment, decontamination, fingerprints, language_id, line_dedup, near_dedup, packing, periodic_runs, pii, quality, substring_dedup, suffix_dedup, toxicity
from courtside.llm.common import held_out, shared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: How op2 and the pipeline compare lines: as sets of words, lines of fewer than five words as a whole.
LINES = {"width": 1, "whole": 5}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories, in its order, and the verdict."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    out = toxicity.predict(docs, toxicity.train(docs, labels))
    return out.select("doc_id", "p_low_quality", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    out = language_id.predict(docs, language_id.train(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, and for ids divisible by 100 the number of documents within 3 bits (themselves included)."""
    out = shared(fingerprints.with_next(table(spark, sf_dir, "documents")), "fingerprinted")
    asked = out.where("doc_id % 100 = 0").select("fingerprint")
    count = out.groupBy("fingerprint").agg(F.count("*").alias("n"))
    found = fingerprints.near(count, asked, radius=3).join(count, F.col("match") == F.col("fingerprint")).groupBy("query").agg(F.sum("n").alias("near_documents"))
    joined = out.join(found, (F.col("fingerprint") == F.col("query")) & (F.col("doc_id") % 100 == 0), "left")
    return joined.select(*out.columns, "near_documents")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), **LINES)
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("lines_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def _made_periodic(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end in every tenth document, as its id's checksum says; a null id counts as the empty text."""
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn, rest = words[a : a + p], n - a
    return words[:a] + (turn * (rest // p + 1))[:rest]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), alter=_made_periodic))


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), keep=False).withColumnRenamed("groups", "groups_sha256")
