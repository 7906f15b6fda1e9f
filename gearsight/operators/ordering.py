"""Ordered computation over long series without a single-task window.

A plain ``Window.partitionBy(series)`` puts a whole series into one task, and a window without partition
puts the whole table there. Here the rows are cut by sampled split points over the full ordering key, so
a series of any length (or the whole table) is spread evenly:

* ``Order``            split points, bucket sizes, global position, running sums;
* ``Series``           ordered windows per series; short series use a plain window, long ones are cut into
                       blocks that carry the last rows of the block before.

Split points and bucket totals are fixed as literals when the plan is built, so a lost executor or a
second evaluation of the plan sees the same buckets.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 20_000
MAX_BUCKETS = 20_000
SAMPLE_PER_BUCKET = 24
MAX_SERIES_ROWS = 2_000_000
MAX_STREAM_ROWS = 50_000
MAX_LONG_SERIES = 10_000


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.gearsight.{name}", str(default)))


def _sort_key(df: DataFrame, name: str) -> Column:
    """Key column in a form whose JSON literal keeps the sort order."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
        return F.col(name).cast("bigint")
    if isinstance(kind, T.FloatType):
        return F.col(name).cast("double")
    if isinstance(kind, (T.LongType, T.DoubleType, T.StringType)):
        return F.col(name)
    raise TypeError(f"cannot order by {name}: {kind.simpleString()}")


class Order:
    """A total order over ``keys`` (ascending, unique together), cut into balanced buckets."""

    def __init__(self, df: DataFrame, keys: list[str], rows_per_bucket: int | None = None,
                 n_rows: int | None = None):
        spark = df.sparkSession
        per = rows_per_bucket or _setting(spark, "rowsPerBucket", ROWS_PER_BUCKET)
        self.df, self.keys = df, list(keys)
        key_frame = df.select([_sort_key(df, k).alias(f"k{i}") for i, k in enumerate(keys)])
        self._key_type = key_frame.schema
        self.n_rows = key_frame.count() if n_rows is None else n_rows
        wanted = min(MAX_BUCKETS, math.ceil(self.n_rows / per)) if self.n_rows else 1
        self._splits = self._sample_splits(key_frame, wanted)
        self._counts: list[int] | None = [self.n_rows] if not self._splits else None

    def _sample_splits(self, key_frame: DataFrame, wanted: int) -> list[list]:
        if wanted < 2:
            return []
        size = wanted * SAMPLE_PER_BUCKET
        fraction = min(1.0, size / self.n_rows)
        rows = sorted([list(r) for r in key_frame.sample(fraction, seed=7).collect()],
                      key=lambda r: [(v is not None, v) for v in r])
        step = len(rows) / wanted
        picks = [rows[int(i * step)] for i in range(1, wanted)] if step >= 1 else rows
        return [p for i, p in enumerate(picks) if i == 0 or p != picks[i - 1]]

    @property
    def n_buckets(self) -> int:
        return len(self._splits) + 1

    def bucket(self) -> Column:
        """Bucket of a row: binary search of its key among the split points, O(log buckets)."""
        if not self._splits:
            return F.lit(0)
        kind = T.ArrayType(self._key_type)
        names = self._key_type.names
        literal = json.dumps([dict(zip(names, s)) for s in self._splits])
        splits = F.from_json(F.lit(literal), kind)
        key = F.struct(*[_sort_key(self.df, k).alias(n) for k, n in zip(self.keys, names)])
        n = len(self._splits)
        steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
        probe = lambda pos, s: F.when((pos + s <= n) & (F.get(splits, pos + s - 1) <= key), pos + s).otherwise(pos)
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)

    def _ordered(self) -> WindowSpec:
        return Window.partitionBy("_bucket").orderBy(*self.keys)

    def _bucket_sums(self, values: dict[str, Column]) -> dict[str, list[int]]:
        """Totals per bucket in one pass; at most MAX_BUCKETS rows reach the driver."""
        totals = (self.df.select(self.bucket().alias("_bucket"), *[v.alias(n) for n, v in values.items()])
                  .groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in values]).collect())
        by = {r["_bucket"]: r for r in totals}
        return {n: [by[b][n] or 0 if b in by else 0 for b in range(self.n_buckets)] for n in values}

    @staticmethod
    def _offsets(sums: list[int]) -> Column:
        """What all earlier buckets add up to."""
        before = [0, *itertools.accumulate(sums)][:-1]
        if len(before) == 1:
            return F.lit(0).cast("bigint")
        return F.get(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), F.col("_bucket"))

    def with_position(self, name: str = "position") -> DataFrame:
        """Global 0-based row number: offset of the bucket plus row number inside it."""
        if self._counts is None:
            self._counts = self._bucket_sums({"n": F.lit(1).cast("bigint")})["n"]
        local = F.row_number().over(self._ordered()).cast("bigint") - 1
        return (self.df.withColumn("_bucket", self.bucket())
                .withColumn(name, self._offsets(self._counts) + local).drop("_bucket"))

    def with_running_sums(self, values: dict[str, str]) -> DataFrame:
        """Running sums of whole-number columns in key order: new name -> column."""
        out = self.df.withColumn("_bucket", self.bucket())
        upto = self._ordered().rowsBetween(Window.unboundedPreceding, 0)
        whole = {name: F.col(src).cast("bigint") for name, src in values.items()}
        sums = self._bucket_sums(whole) if self._splits else {name: [0] for name in whole}
        return out.withColumns({name: self._offsets(sums[name]) + F.sum(v).over(upto)
                                for name, v in whole.items()}).drop("_bucket")


def global_index(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Distributed global row number in key order."""
    return Order(df, keys).with_position(name)


class Series:
    """Ordered rows per series. An empty ``series`` list means the table is one long series."""

    def __init__(self, df: DataFrame, series: list[str], order: list[str], max_rows: int | None = None):
        spark = df.sparkSession
        self.series, self.order = list(series), list(order)
        # one continuous stream has no other parallelism than its blocks, so these are smaller
        self.max_rows = max_rows or (_setting(spark, "maxSeriesRows", MAX_SERIES_ROWS) if series
                                     else _setting(spark, "maxStreamRows", MAX_STREAM_ROWS))
        self.n_rows: int | None = None
        self.long = self._find_long(df)

    def _find_long(self, df: DataFrame) -> str:
        """'none', 'all', or 'some' (then the long series are listed)."""
        if not self.series:
            self.n_rows = df.count()
            return "all" if self.n_rows > self.max_rows else "none"
        sizes = df.groupBy(*self.series).count().filter(F.col("count") > self.max_rows).select(*self.series)
        listed = sizes.limit(MAX_LONG_SERIES + 1).collect()
        if not listed:
            return "none"
        if len(listed) > MAX_LONG_SERIES:
            return "all"
        self._long_keys = df.sparkSession.createDataFrame(listed, sizes.schema)
        return "some"

    def window(self, extra: list[str] | None = None, descending: bool = False) -> WindowSpec:
        order = [F.col(c).desc() for c in self.order] if descending else [F.col(c) for c in self.order]
        return Window.partitionBy(*self.series, *(extra or [])).orderBy(*order)

    def _split(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """(short series, long series); the key list holds at most MAX_LONG_SERIES rows."""
        if self.long == "none":
            return df, None
        if self.long == "all":
            return None, df
        keys = F.broadcast(self._long_keys)
        same = [df[c].eqNullSafe(keys[c]) for c in self.series]
        return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")

    def _blocks(self, df: DataFrame, lookback: int) -> DataFrame:
        """Equal blocks in key order; the last ``lookback`` rows of a block are repeated in the next one."""
        size = max(self.max_rows, 4 * lookback, 1)
        placed = Order(df, self.series + self.order, n_rows=self.n_rows).with_position("_pos")
        block = F.floor(F.col("_pos") / size)
        late = F.col("_pos") % size >= size - lookback
        homes = F.when(late, F.array(block, block + 1)).otherwise(F.array(block)) if lookback else F.array(block)
        return (placed.withColumn("_block", F.explode(homes))
                .withColumn("_carried", F.col("_block") != block))

    def apply(self, df: DataFrame, lookback: int, compute: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
        """Run ``compute(df, window)`` where its frames reach at most ``lookback`` rows back.

        ``window(extra)`` returns the ordered window spec, optionally partitioned further by ``extra``.
        """
        short, long = self._split(df)
        parts = []
        if short is not None:
            parts.append(compute(short, self.window))
        if long is not None:
            blocks = self._blocks(long, lookback)
            spec = lambda extra=None: self.window(["_block", *(extra or [])])
            parts.append(compute(blocks, spec).filter(~F.col("_carried"))
                         .drop("_pos", "_block", "_carried"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def running_sum(self, df: DataFrame, value: str, name: str) -> DataFrame:
        return self.running_sums(df, {name: value})

    def running_sums(self, df: DataFrame, values: dict[str, str]) -> DataFrame:
        """Running sums of whole-number columns inside each series: new name -> column."""
        short, long = self._split(df)
        totals = {name: F.sum(F.col(src).cast("bigint")) for name, src in values.items()}
        upto = (Window.unboundedPreceding, 0)
        parts = []
        if short is not None:
            w = self.window().rowsBetween(*upto)
            parts.append(short.withColumns({name: t.over(w) for name, t in totals.items()}))
        if long is not None:
            order = Order(long, self.series + self.order, n_rows=self.n_rows)
            cut = long.withColumn("_bucket", order.bucket())
            before = lambda w: F.struct(*[F.sum(F.col(f"_sums.{n}")).over(
                w.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n in totals])
            carry = self._carry(cut, F.struct(*[t.alias(n) for n, t in totals.items()]).alias("_sums"), before, ["_bucket"])
            w = self.window(["_bucket"]).rowsBetween(*upto)
            local = cut.withColumns({f"_local_{n}": t.over(w) for n, t in totals.items()})
            parts.append(self._join_carry(local, carry)
                         .withColumns({n: F.col(f"_local_{n}") + F.coalesce(f"_carry.{n}", F.lit(0)) for n in totals})
                         .drop("_bucket", "_carry", *[f"_local_{n}" for n in totals]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def backfill(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Fill nulls with the next non-null value of the same series."""
        return self._fill(df, cols, backward=True)

    def forwardfill(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Fill nulls with the last non-null value before them in the same series."""
        return self._fill(df, cols, backward=False)

    def _fill(self, df: DataFrame, cols: list[str], backward: bool) -> DataFrame:
        short, long = self._split(df)
        upto = (Window.unboundedPreceding, 0)
        parts = []
        if short is not None:
            w = self.window(descending=backward).rowsBetween(*upto)
            parts.append(short.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}))
        if long is not None:
            order = Order(long, self.series + self.order, n_rows=self.n_rows)
            cut = long.withColumn("_bucket", order.bucket())
            w = self.window(["_bucket"], descending=backward).rowsBetween(*upto)
            key = F.struct(*self.order)
            # what a bucket hands on: the value nearest to the bucket that is filled from it
            nearest = F.min_by if backward else F.max_by
            edge = F.struct(*[nearest(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in cols])
            passed = lambda win: F.struct(*[F.last(F.col(f"_edge.{c}"), ignorenulls=True).over(
                win.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in cols])
            by = F.col("_bucket").desc() if backward else F.col("_bucket")
            carry = self._carry(cut, edge.alias("_edge"), passed, [by])
            local = cut.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
            parts.append(self._join_carry(local, carry)
                         .withColumns({c: F.coalesce(F.col(c), F.col(f"_carry.{c}")) for c in cols})
                         .drop("_bucket", "_carry"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _carry(self, cut: DataFrame, total: Column, reach: Callable, by: list) -> DataFrame:
        """What reaches each (series, bucket) from the other buckets; a few rows per long series."""
        small = cut.groupBy(*self.series, "_bucket").agg(total)
        w = Window.partitionBy(*self.series).orderBy(*by)
        return small.select(*self.series, "_bucket", reach(w).alias("_carry"))

    def _join_carry(self, local: DataFrame, carry: DataFrame) -> DataFrame:
        keys = [*self.series, "_bucket"]
        renamed = carry.select([F.col(k).alias(f"_r_{k}") for k in keys] + ["_carry"])
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        return local.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])
