"""Shared-folder staging: cut lineage, keep intermediate tables where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows from which on ``staged_by_size`` writes Parquet: a checkpoint is not compressed, but keeps partitions and their order.
PARQUET_ROWS = 1_000_000
#: Shuffle files of a query go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for local masters without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="gearsight-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read files instead of recomputing, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_by_size(df: DataFrame, n: int) -> DataFrame:
    """Staged as a checkpoint, or as Parquet if it has ``n`` rows and they are many; then without its shuffle files."""
    if n <= PARQUET_ROWS:
        return staged(df)
    spark = df.sparkSession
    path = scratch(spark, "staged")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the Parquet files of a staged table that nothing reads any more. Spark removes checkpoints."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, folder)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
