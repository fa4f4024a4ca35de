"""Session defaults for tests and local runs, and lineage cuts that outlive an executor."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "courtside") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("COURTSIDE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_folder(sc, prefix: str) -> str:
    """A folder of this machine, which no executor of a cluster can see: refused unless the master is local."""
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master (tests) may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    sc.setCheckpointDir(shared or local_folder(sc, "courtside-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in reliable storage and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a table of the shared checkpoint folder, and its path: cuts lineage as `cut` does, in a fraction of the disk."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table made by `stored` that nothing reads any more."""
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    spot.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spot, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind; else these stay until the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is shuffled and sorted, so never sent whole to the driver.

    Spark judges a table by the bytes of its files, and repeated values make these far smaller than the rows.
    """
    return df.hint("merge")


class rounds:
    """A table of the shared checkpoint folder that an iterative job adds to, a folder a round; nothing is written twice."""

    def __init__(self, spark: SparkSession, name: str, like: DataFrame):
        ensure_checkpoint_dir(spark)
        self.spark, self.schema, self.n = spark, like.schema, 0
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the next round and gives it back."""
        df.select(*self.schema.names).write.parquet(f"{self.path}/round={self.n}")
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.n - 1}")

    def rows(self) -> DataFrame:
        """The rows of all rounds until now."""
        done = [f"{self.path}/round={k}" for k in range(self.n)]
        return self.spark.read.schema(self.schema).parquet(*done) if done else self.spark.createDataFrame([], self.schema)
