"""Keyed tables, snapshots, guarded and sliced writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from courtside.functions import lookups as lk
from courtside.operators.ordered import best_row


class GuardFailed(RuntimeError):
    """A write was refused because its check did not hold."""


# --- published tables -------------------------------------------------------------------------
#
# path/data/<id>/      the rows of one version, never written again
# path/manifest/       one row a published version; a version that is not listed does not exist for readers

MANIFEST = "label string, number long, folder string, rows long, producer string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All versions published below `path`: label, number, folder, rows, producer. None yet: no rows."""
    spot = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    known = spot.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spot)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if known else spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The manifest row of each label that counts: its last one."""
    return best_row(manifest(spark, path), ["label"], [F.col("number"), F.col("folder")])


def publish(df: DataFrame, path: str, label: str = "", producer: str | None = None, min_rows: int = 0) -> int:
    """Write `df` as a new version of the table `label` below `path` and give back its number of rows.

    Rows go to a folder of their own, are counted there (`df` is computed once), and only then is the version listed by
    one row in one new file of the manifest, which appears whole or not at all. A write that fails half-way, or that has
    fewer than `min_rows` rows (GuardFailed, its folder goes), leaves the version before it as it was.
    """
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/data/{folder}").count()
    if rows < min_rows:
        for spot in (f"{path}/data/{folder}", f"{path}/data", path):
            _delete(spark, spot, only_empty=not spot.endswith(folder))
        raise GuardFailed(f"{rows} rows, fewer than {min_rows}: not published")
    last = manifest(spark, path).where(F.col("label") == label).agg(F.max("number")).first()[0]
    entry = spark.createDataFrame([(label, (last or 0) + 1, folder, rows, producer)], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return rows


def published(spark: SparkSession, path: str, label: str = "") -> DataFrame:
    """Rows of the version of `label` that counts now."""
    row = current(spark, path).where(F.col("label") == label).first()
    if row is None:
        raise FileNotFoundError(f"nothing was published as {label!r} below {path}")
    return spark.read.parquet(f"{path}/data/{row['folder']}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the rows of all but the last `keep` versions of each label; readers of those may still be at work.

    The manifest keeps its rows. Folders that it does not list, those of failed writes and of writes under way, stay.
    """
    w = Window.partitionBy("label").orderBy(F.desc("number"), F.desc("folder"))
    old = manifest(spark, path).withColumn("rn", F.row_number().over(w)).where(F.col("rn") > keep)
    for row in old.select("folder").toLocalIterator():
        _delete(spark, f"{path}/data/{row['folder']}")


def _delete(spark: SparkSession, folder: str, only_empty: bool = False) -> None:
    spot = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = spot.getFileSystem(spark._jsc.hadoopConfiguration())
    if not only_empty or not fs.listStatus(spot):
        fs.delete(spot, True)


def write_snapshot(matches: DataFrame, snapshot_at: str, path: str, producer: str | None = None) -> int:
    """Publish a whole feed as the version of its snapshot; again for the same snapshot replaces it at once."""
    rows = matches.withColumn("snapshot_at", F.lit(snapshot_at)).withColumn("producer", F.lit(producer).cast("string"))
    return publish(rows, path, snapshot_at, producer)


def read_snapshot(spark: SparkSession, path: str, snapshot_at: str) -> DataFrame:
    return published(spark, path, snapshot_at)


def snapshot_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row a snapshot: snapshot_at, date, producer, count. It is read from the manifest, no rows are counted again."""
    return current(spark, path).select(
        F.col("label").alias("snapshot_at"), F.substring("label", 1, 10).alias("date"), "producer", F.col("rows").alias("count")
    )


def latest_by_key(
    changes: DataFrame, key: list[str], order: list[str], deleted: Column | None = None, created: str | None = None
) -> DataFrame:
    """Current rows of a change log: the last write per key, without deleted keys.

    `created` names a time column whose value survives updates: the first one since
    the key was last deleted. Each task is cut to the last write of a key before the shuffle,
    so a key that holds most of the log costs one row a task; times are aggregated apart from rows.
    """
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    values = [c for c in changes.columns if c not in key]
    at = F.struct(*order)
    last = best_row(changes.withColumn("_gone", gone), key, [F.col(c) for c in order])
    live = last.where(~F.col("_gone")).select(*key, *values)
    if created is None:
        return live
    gone_at = changes.where(gone).groupBy(*key).agg(F.max(at).alias("_deleted_at"))
    born = (
        changes.where(~gone).select(*dict.fromkeys([*key, *order, created]))
        .join(gone_at, key, "left")
        .where(F.col("_deleted_at").isNull() | (at > F.col("_deleted_at")))
        .groupBy(*key).agg(F.min(created).alias("created_at"))
    )
    return live.join(born, key)


def freshest(copies: DataFrame, prefer: str = "stamp") -> DataFrame:
    """Per key the served copy of two: key, origin ('d1' | 'static'), body, stamp.

    By stamp the newest wins, an unreadable stamp counts as oldest and a tie goes to
    the d1 copy; with prefer="d1" the d1 copy always wins. An empty copy never hides
    the other one.
    """
    zero = F.lit("1970-01-01T00:00:00Z").cast("timestamp")
    copy = F.struct(F.coalesce(F.col("stamp").try_cast("timestamp"), zero).alias("at"), "stamp", "body")
    by = copies.groupBy("key").agg(
        F.max(F.when(F.col("origin") == "d1", copy)).alias("d"),
        F.max(F.when(F.col("origin") == "static", copy)).alias("s"),
    )
    stamp = lambda side: F.coalesce(F.col(f"{side}.at"), zero)
    d1_wins = F.lit(True) if prefer == "d1" else stamp("d") >= stamp("s")
    use_d1 = d1_wins & F.col("d.body").isNotNull()
    return by.select(
        "key", F.when(use_d1, F.col("d.body")).otherwise(F.col("s.body")).alias("body"),
        F.when(use_d1, "d1").when(F.col("s.body").isNotNull(), "static").otherwise("none").alias("origin"),
    )


def body_stamp(body: Column) -> Column:
    """generatedAt / generated_at of a published JSON text, wherever it stands."""
    return F.nullif(
        F.regexp_extract(body, r'"generated_?[aA]t"\s*:\s*"([^"]+)"', 1), F.lit("")
    )


def require(check: DataFrame, rule: Column, message: str) -> None:
    """Refuse to go on unless every row of the (one-row) check satisfies the rule."""
    if not check.where(~F.coalesce(rule, F.lit(False))).isEmpty() or check.isEmpty():
        raise GuardFailed(message)


def guarded_overwrite(df: DataFrame, path: str, min_rows: int = lk.MIN_CALENDAR_EVENTS) -> int:
    """Replace a published table only when the new content has enough rows (`publish`); read it with `published`."""
    return publish(df, path, min_rows=min_rows)


def replace_slice(old: DataFrame, new: DataFrame, in_slice: Column) -> DataFrame:
    """`old` without the slice, plus `new`. Running it again changes nothing."""
    kept = old.where(~F.coalesce(in_slice, F.lit(False)))
    return kept.unionByName(new, allowMissingColumns=True)


def write_slices(new: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in `new`."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
