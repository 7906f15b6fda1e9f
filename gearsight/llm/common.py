"""Helpers the operators share: staged tables, rows packed against name clashes, joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.sources.staging import scratch

#: A key is hot when it holds at least this part of all rows, so there are at most 500 hot keys.
HOT_SHARE = 500
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh Parquet folder in the shared checkpoint folder and read it back.

    The shuffle files of the write go as soon as it is done: the table is what later steps and retries read.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **made: Column) -> DataFrame:
    """The input row as one struct ``row`` beside the columns made from it: no input name can clash with them."""
    return df.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in made.items()))


def unpacked(df: DataFrame, row_fields: list[str], *made: str, keep: list[str] | None = None) -> DataFrame:
    """Input columns, then ``made``; a made column replaces an input column of its name."""
    old = [f for f in (keep or row_fields) if f.lower() not in {m.lower() for m in made}]
    return df.select(*(F.col("row")[f].alias(f) for f in old), *(col(m) for m in made))


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, cold_key: Column) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``), however many rows a key holds.

    ``weight`` says how many rows hold the key. At most 500 keys can hold a 500th of ``total`` each; those are
    broadcast. Their rows then go through the shuffle under ``cold_key``, a value that is spread and fits no key.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    hot = (F.col(weight) * HOT_SHARE >= F.lit(max(1, total))) & F.col(key).isNotNull()
    side = F.struct(*values)
    first = rows.join(F.broadcast(table.filter(hot).select(F.col(key), side.alias("_hot"))), key, "left")
    moved = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(cold_key))
    rest = table.filter(~hot).select(F.col(key).alias("_key"), side.alias("_cold"))
    out = moved.join(rest, "_key", "left").withColumn("_side", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *(F.col("_side")[v].alias(v) for v in values))
