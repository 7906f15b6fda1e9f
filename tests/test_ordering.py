"""The blocked paths must give what one plain window over the whole series gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gearsight.operators.ordering import Order, Series, global_index


@pytest.fixture(scope="module")
def rows(spark):
    # series 1 holds a third of all rows; timestamps repeat so only (t, id) is unique; x has nulls
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 37 + 2).cast("bigint").alias("m"),
        F.floor(F.col("id") * 7919 % 1000 / 5).cast("bigint").alias("t"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 31 % 97).cast("double")).alias("x"),
    ).persist()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left, right = (sorted(map(tuple, d.select(cols).collect()), key=str) for d in (a, b))
    assert left == right


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_position_matches_plain_window(rows, parts):
    df = rows.repartition(parts)
    order = Order(df, ["t", "id"], rows_per_bucket=100)
    assert order.n_buckets > 10
    plain = rows.withColumn("position", F.row_number().over(Window.orderBy("t", "id")).cast("bigint") - 1)
    same(order.with_position(), plain)


def test_position_when_one_key_value_dominates(spark):
    df = spark.range(2000).select("id", F.lit(5).cast("bigint").alias("t"))
    got = Order(df, ["t", "id"], rows_per_bucket=50).with_position()
    assert got.filter("position != id").count() == 0


def test_running_sums(rows):
    df = rows.fillna(0.0)
    got = Order(df, ["m", "t", "id"], rows_per_bucket=90).with_running_sums({"s": "x"})
    w = Window.orderBy("m", "t", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(got, df.withColumn("s", F.sum(F.col("x").cast("bigint")).over(w)))


def rolling(df, window):
    w = window().rowsBetween(-4, 0)
    return df.withColumns({"mean": F.round(F.avg("x").over(w), 9), "lag": F.lag("x", 2).over(window())})


@pytest.mark.parametrize("series,limit", [(["m"], 100), (["m"], 5), ([], 50)])
def test_blocks_equal_plain(rows, spark, series, limit):
    spark.conf.set("spark.gearsight.rowsPerBucket", "200")
    try:
        plain = Series(rows, series, ["t", "id"])
        cut = Series(rows, series, ["t", "id"], max_rows=limit)
        assert plain.long == "none" and cut.long != "none"
        same(cut.apply(rows, 4, rolling), plain.apply(rows, 4, rolling))
        ints = rows.withColumn("one", (F.col("id") % 5 == 0).cast("int"))
        same(cut.running_sum(ints, "one", "run"), plain.running_sum(ints, "one", "run"))
        same(cut.backfill(rows, ["x"]), plain.backfill(rows, ["x"]))
        same(cut.forwardfill(rows, ["x"]), plain.forwardfill(rows, ["x"]))
    finally:
        spark.conf.unset("spark.gearsight.rowsPerBucket")


def test_no_single_task_for_rows(rows):
    plan = Order(rows, ["t", "id"], rows_per_bucket=100).with_position()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_global_index_empty(spark):
    df = spark.createDataFrame([], "t bigint, id bigint")
    assert global_index(df, ["t", "id"]).count() == 0
