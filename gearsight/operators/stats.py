"""Whole-table statistics attached to rows, and exact quantiles that never gather a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of one bracket in one pass.
PARTS = 65_536


def with_stats(df: DataFrame, stats: dict[str, Column], name: str = "_stats") -> DataFrame:
    """Add one struct column of whole-table aggregates (an uncorrelated scalar subquery, computed once)."""
    one = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    return df.withColumn(name, one.scalar())


def moments(cols: list[str]) -> dict[str, Column]:
    out = {}
    for c in cols:
        out[f"{c}_mean"] = F.avg(c)
        out[f"{c}_sd"] = F.stddev_samp(c)
    return out


def safe_corr(a: str, b: str) -> Column:
    """Pearson r, null for a constant column (ANSI `corr` raises there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def stack(df: DataFrame, ids: list[str], cols: list[str], key: str = "column", value: str = "value") -> DataFrame:
    """Long form: one row per (row, column)."""
    same = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return same.unpivot(ids, cols, key, value)


def magnitude(value: Column) -> Column:
    """A bucket that never falls as the value grows: sign and a sixteenth of its power of two; NaN is the largest."""
    power = F.floor(F.log2(F.abs(value)) * 16) + 20_000
    return (F.when(F.isnan(value), 60_000).when(value == float("inf"), 50_000).when(value == float("-inf"), -50_000)
            .when(value > 0, power).when(value < 0, -power).otherwise(0).cast("bigint"))


def quantiles(df: DataFrame, cols: list[str], qs: list[float],
              by: list[str] | None = None) -> dict[tuple, dict[float, float]]:
    """Exact linear-interpolated quantiles: (by values..., column) -> {q: value}.

    A column without values has the quantile None; NaN is the largest value, as in Spark's order.

    Every quantile of every column and group is narrowed at once. A pass counts the values of each bracket in up to
    PARTS buckets (in the tasks, before the shuffle) and keeps the bucket that holds the wanted rank, from its smallest
    value to its largest. The first pass cuts by magnitude, so the later ones, which cut a bracket evenly, part any two
    doubles after three more at most; columns of few digits need one or two. No value list is ever gathered, the driver
    sees one row per quantile, and there is one path for all sizes.
    """
    by = by or []
    keys, value = [*by, "column"], F.col("value")
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "column", "value")
    counted = long.groupBy(*keys, magnitude(value).alias("_part"), value.isNull().alias("_none")).agg(
        F.count("value").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(F.col("_none").desc(), "_part").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_all") - 1
    ranks = [F.struct(F.lit(i).alias("i"), F.least(F.floor(F.lit(q) * last) + up, last).alias("rank"))
             for i, q in enumerate(map(float, qs)) for up in (0, 1)]
    run = counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(group))
    targets: dict[tuple, dict] = {}
    groups = {}
    for r in _holding(run, F.array(*ranks), [*keys, "_all", "_none"]).collect():
        key = tuple(r[k] for k in keys)
        groups[key] = r["_all"]
        if r["t"] is not None:
            targets[key, r["t"]["i"], r["t"]["rank"]] = {"lo": r["_lo"], "hi": r["_hi"], "below": r["_below"]}
    spark = df.sparkSession
    while live := {t: b for t, b in targets.items() if not _same(b["lo"], b["hi"])}:
        ids = {bracket: i for i, bracket in enumerate(dict.fromkeys((t[0], b["lo"], b["hi"]) for t, b in live.items()))}
        names = [f"_k{i}" for i in range(len(keys))]
        # as many brackets as groups, columns and quantiles at most
        table = spark.createDataFrame([(i, *key, lo, hi) for (key, lo, hi), i in ids.items()],
                                      T.StructType([T.StructField("_id", T.IntegerType()),
                                                    *(T.StructField(n, long.schema[k].dataType) for n, k in zip(names, keys)),
                                                    T.StructField("_from", T.DoubleType()), T.StructField("_to", T.DoubleType())]))
        same = [long[k].eqNullSafe(table[n]) for n, k in zip(names, keys)]
        inside = long.join(F.broadcast(table), same).filter(value.between(F.col("_from"), F.col("_to")))
        part = F.floor((value - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS)
        counted = inside.groupBy("_id", part.alias("_part")).agg(
            F.count("value").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        run = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_id").orderBy("_part").rowsBetween(
            Window.unboundedPreceding, 0)))
        asked: dict[int, list] = {}
        for (key, i, rank), b in live.items():
            asked.setdefault(ids[key, b["lo"], b["hi"]], []).append((i, rank, rank - b["below"]))
        wanted = spark.createDataFrame(list(asked.items()), "_id int, _asked array<struct<i: int, place: bigint, rank: bigint>>")
        back = {i: key for (key, _, _), i in ids.items()}
        for r in _holding(run.join(F.broadcast(wanted), "_id"), F.col("_asked"), ["_id"]).filter("t is not null").collect():
            b = targets[back[r["_id"]], r["t"]["i"], r["t"]["place"]]
            b.update(lo=r["_lo"], hi=r["_hi"], below=b["below"] + r["_below"])
    out: dict[tuple, dict[float, float]] = {}
    for g in dict.fromkeys(key[:-1] for key in groups) if by else [()]:
        for c in cols:
            n = groups.get((*g, c), 0)
            out[(*g, c)] = {q: _between(targets, (*g, c), i, float(q) * (n - 1), n) for i, q in enumerate(qs)}
    return out


def _holding(run: DataFrame, ranks: Column, keep: list[str]) -> DataFrame:
    """The buckets that hold a wanted rank, one row per rank ``t``; a bucket of nulls has one row without a rank."""
    before = F.col("_upto") - F.col("_n")
    held = F.filter(ranks, lambda t: (t["rank"] >= before) & (t["rank"] < F.col("_upto")))
    rows = run.select(*keep, "_lo", "_hi", before.alias("_below"), F.explode_outer(held).alias("t"))
    return rows.filter(F.col("t").isNotNull() | F.col("_none")) if "_none" in keep else rows


def _between(targets: dict, key: tuple, i: int, rank: float, n: int) -> float | None:
    if not n:
        return None
    low = targets[key, i, int(rank)]["lo"]
    high = targets[key, i, min(int(rank) + 1, n - 1)]["lo"]
    part = rank - int(rank)
    return low if not part or _same(low, high) else low + (high - low) * part


def _same(a: float, b: float) -> bool:
    """Equal, with NaN equal to itself as in Spark's order."""
    return a == b or (a != a and b != b)
