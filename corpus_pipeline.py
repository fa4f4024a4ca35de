"""From raw documents to packed sequences: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import decontamination, line_dedup, near_dedup, packing, quality
from courtside.llm.common import shared, table
from courtside.llm.queries import LINES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more (op8 predicts 1 from 0.7; README has the counts of both); every row is scored in place, none is joined."""
    return quality.accepted(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).select(*COLUMNS)


def line_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one; `n_chars` is that of the text left. Documents with no text left go."""
    out = line_dedup.dedup_lines(docs, **LINES)
    changed = F.size("removed_lines") > 0
    return out.where(~changed | (F.trim("text") != "")).select(*[F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have an earlier near copy: five-word shingles of likeness 0.8 or more, or SimHash within 4 bits."""
    return near_dedup.without_copies(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", line_deduplicated),
    ("SimHash near-dedup", near_deduplicated),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: None of the stages can be said in SQL (a trained model, a tokenizer): tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
