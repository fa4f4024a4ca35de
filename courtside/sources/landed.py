"""Landed payloads and raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.schema import API_PAYLOAD, EXTRACTED_ROUND, FINAL_ROW
from courtside.session import cut


def read_landed(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Landed JSON with an explicit schema. Lines or files that do not fit are kept apart, not lost."""
    return (
        spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line)
        .json(path).withColumn("file", F.input_file_name())
    )


def api_matches(payloads: DataFrame) -> DataFrame:
    """Matches of match-API payloads, with their place in the payload."""
    return payloads.select("event_id", F.posexplode("Matches").alias("ordinal", "m")).select(
        "event_id", "ordinal", "m.*"
    )


def read_api_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One payload a file, or a line."""
    return read_landed(spark, path, API_PAYLOAD, multi_line)


def read_lists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON list: file, problem, ordinal and the columns of `schema`.

    A file that is no JSON or no list gives one row that names its problem and has nulls else; it never stops the others.
    An empty list gives no row, nor does a file of no bytes, which Spark never opens. Both kinds of rows come from one pass over the files, a row a file, and nothing is joined
    or shuffled to tell them apart. An element that does not fit the schema has nulls where it does not.
    """
    rows = f"array<struct<{schema}>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    problem = F.when(F.json_array_length("value").isNull(), F.when(F.ltrim("value").startswith("["), "no JSON").otherwise("no list"))
    read = files.withColumn("problem", problem).withColumn("rows", F.when(F.col("problem").isNull(), F.from_json("value", rows)))
    out = read.where(F.col("problem").isNotNull() | (F.size("rows") > 0))
    return out.select("file", "problem", F.posexplode_outer("rows").alias("ordinal", "_r")).select("file", "problem", "ordinal", "_r.*")


def quarantined(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the good files, file and problem of the bad ones) of `read_lists`; the files are read once for both."""
    stored = cut(lists)
    return stored.where("problem is null").drop("problem"), stored.where("problem is not null").select("file", "problem")


def read_final_rows(spark: SparkSession, path: str) -> DataFrame:
    """Finals of a circuit, one list a file; a payload that is not a list yields no rows."""
    return read_lists(spark, path, FINAL_ROW).where(
        "problem is null and (tournament is not null or winner_player is not null)"
    ).drop("problem")


def read_parts(spark: SparkSession, glob: str, schema: str = EXTRACTED_ROUND) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad files with their problem) of part files; one bad file never stops the others."""
    return quarantined(read_lists(spark, glob, schema))


def write_bronze(df: DataFrame, path: str, by: str = "year") -> None:
    """Keep raw rows for later replays, one folder per `by` value."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replay_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
