"""Versioned tables: a write that fails or is refused leaves the old rows; files of lists with bad ones among them."""

import json

import pytest
from pyspark.sql import functions as F

from courtside.sources import landed, tables


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.published(spark, path)
    assert tables.publish(spark.range(5), path) == 5
    broken = spark.range(0, 40, 1, 4).withColumn("id", F.when(F.col("id") == 39, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        tables.publish(broken, path)
    assert ids(tables.published(spark, path)) == [0, 1, 2, 3, 4]
    with pytest.raises(tables.GuardFailed):
        tables.guarded_overwrite(spark.range(3), path, min_rows=4)
    assert ids(tables.published(spark, path)) == [0, 1, 2, 3, 4] and len(tables.manifest(spark, path).collect()) == 1
    old = tables.published(spark, path)
    assert tables.guarded_overwrite(spark.range(7, 9), path, min_rows=2) == 2
    assert ids(tables.published(spark, path)) == [7, 8] and ids(old) == [0, 1, 2, 3, 4]       # a reader at work keeps its version


def test_a_table_can_be_computed_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(2), path)
    for _ in range(2):
        tables.publish(tables.published(spark, path).unionByName(spark.range(9, 10)), path)
    assert ids(tables.published(spark, path)) == [0, 1, 9, 9]


def test_snapshots_have_versions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "s")
    m = spark.range(4).withColumn("status", F.lit("live"))
    tables.write_snapshot(m, "2024-01-01T10:00:00", path, "daily")
    tables.write_snapshot(m.where("id < 0"), "2024-01-02T10:00:00", path)
    tables.write_snapshot(m.where("id > 0"), "2024-01-01T10:00:00", path, "live")
    got = {(r["snapshot_at"], r["date"], r["producer"], r["count"]) for r in tables.snapshot_summary(spark, path).collect()}
    assert got == {("2024-01-01T10:00:00", "2024-01-01", "live", 3), ("2024-01-02T10:00:00", "2024-01-02", None, 0)}
    assert ids(tables.read_snapshot(spark, path, "2024-01-01T10:00:00")) == [1, 2, 3]
    assert tables.read_snapshot(spark, path, "2024-01-02T10:00:00").isEmpty()


def test_old_versions_are_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        tables.publish(spark.range(n), path, "a")
    tables.publish(spark.range(9), path, "b")
    tables.drop_versions(spark, path, keep=2)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3
    assert ids(tables.published(spark, path, "a")) == [0, 1, 2] and len(ids(tables.published(spark, path, "b"))) == 9


def test_lists_and_what_is_none(spark, tmp_path):
    files = {
        "a": json.dumps([{"key": "a", "winners": ["x", None]}, {"key": 5, "other": 1}, {"winners": "no list"}]), "b": '[{"key": "b", ', "c": '{"key": "c"}',
        "d": "[]", "e": "  \n[{\"key\": \"é\"}]\n", "f": "", "g": "null", "h": '[{"key": "h"}, {"key": }]',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = landed.read_parts(spark, str(tmp_path / "*.json"))
    name = F.regexp_extract("file", r"(\w)\.json", 1)
    assert sorted(map(tuple, good.select(name, "ordinal", "key", "winners").collect())) == [("a", 0, "a", ["x", None]), ("a", 1, "5", None), ("a", 2, None, None), ("e", 0, "é", None)]
    assert dict(map(tuple, bad.select(name, "problem").collect())) == {"b": "no JSON", "c": "no list", "g": "no list", "h": "no JSON"}


def test_lists_are_read_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"key": "a"}]')
    good, bad = landed.read_parts(spark, str(tmp_path / "*.json"))
    (tmp_path / "a.json").write_text("[")
    assert good.count() == 1 and bad.isEmpty()
