"""Archive files: one JSON document per tournament."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.functions.labels import circuit
from courtside.schema import ARCHIVE_FILE


def read_archive(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw archive documents with an explicit schema, one a file or a line; unreadable ones keep `_corrupt_record`."""
    return (
        spark.read.schema(ARCHIVE_FILE).option("mode", "PERMISSIVE").option("multiLine", multi_line)
        .json(path).withColumn("file", F.input_file_name())
    )


def archive_tournaments(docs: DataFrame) -> DataFrame:
    """One row per tournament with the number of its matches."""
    return docs.where("key is not null").select(
        "key", "name", "federation", "tour", "source", "category",
        F.col("start").try_cast("date").alias("start"), F.col("end").try_cast("date").alias("end"),
        "venue", "address", "organizer", F.col("organizerUrl").alias("organizer_url"),
        F.col("noOrganizer").alias("no_organizer"),
        F.coalesce(F.size("matches"), F.lit(0)).alias("n"),
    )


def sets_of(rows: Column) -> Column:
    """[["6","2"], …] as structs."""
    return F.transform(rows, lambda s: F.struct(F.get(s, F.lit(0)).alias("a"), F.get(s, F.lit(1)).alias("b")))


def archive_matches(docs: DataFrame) -> DataFrame:
    """One row per match, in file order (`ordinal`)."""
    rows = docs.select("key", "source", "federation", F.posexplode("matches").alias("ordinal", "m"))
    return rows.select(
        "key", "source", "federation", "ordinal",
        F.col("m.className").alias("class_name"), "m.round", "m.court", "m.status", "m.teams",
        F.struct(sets_of(F.col("m.score.sets")).alias("sets"), F.col("m.score.winner").alias("winner")).alias("score"),
    )


def archive_index(modern: DataFrame, historic: DataFrame) -> DataFrame:
    """The browsable list: modern tournaments plus historic ones that have matches.

    Both inputs hold key, name, federation, tour, start, end, n.
    """
    cols = ["key", "name", "federation", "tour", "start", "end", "n"]
    old = historic.where("n > 0").withColumn("federation", F.lit("FIP")).withColumn(
        "tour", F.coalesce("tour", F.lit("WPT"))
    ).withColumn("end", F.col("start"))
    rows = modern.select(*cols).unionByName(old.select(*cols))
    return rows.withColumn("circuit", circuit(F.col("tour"), F.col("federation")))
