"""The pipeline's stages on labels, odd rows and empty tables; test_near_copies.py compares each stage with a brute-force version."""

import numpy as np

import corpus_pipeline as cp
from courtside.llm import line_dedup, near_dedup
from courtside.llm.common import shared, table

from .conftest import SF


def test_quality_stage_keeps_what_is_marked_good(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    left = {r["doc_id"] for r in cp.good_quality(spark, docs, SF).collect()}
    assert np.mean([(r["doc_id"] in left) == bool(labels[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in labels]) > 0.9


def test_odd_rows_through_all_stages(spark, odd):
    docs = shared(odd, "odd-rows")
    for _, stage in cp.STAGES[1:-1]:
        docs = shared(stage(spark, docs, SF), "odd-rows")
        assert docs.columns == cp.COLUMNS
    left = {r["doc_id"] for r in docs.collect()}
    assert {1, 10, 11, None} <= left and not {2, 5} & left           # texts without words are one group, of which the least id stays
    assert {r["doc_id"] for r in cp.packed(spark, docs, SF).collect()} == left


def test_clashing_names(spark, odd):
    names = ["_flat", "line", "row", "removed_lines", "chunk", "rest"]
    docs = shared(odd.select("doc_id", "text", *[odd["fp"].alias(n) for n in names]), "clashes")
    out = near_dedup.without_copies(docs)
    assert out.columns == docs.columns and {r["_flat"] for r in out.collect()} == {"x"}
    assert line_dedup.dedup_lines(docs.drop("removed_lines")).columns == [*docs.drop("removed_lines").columns, "removed_lines"]


def test_empty_tables(spark, empty):
    docs = empty.select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).collect() == []
