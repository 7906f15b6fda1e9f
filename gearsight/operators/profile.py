"""Data inspection and failure profiling; every report is a tidy table (one row per subject)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.stats import quantiles, safe_corr, stack, with_stats

Q4 = [0.25, 0.5, 0.75]
#: Values whose distances to the density grid are computed at a time.
KDE_VALUES = 1024


def column_report(df: DataFrame, cols: list[str], measures: dict[str, Callable[[str], Column]],
                  key: str = "column") -> DataFrame:
    """One row per column from a single pass: no unpivot, no shuffle beyond the partial results."""
    rows = F.array(*[F.struct(F.lit(c).alias(key), *[m(c).alias(n) for n, m in measures.items()]) for c in cols])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def profile_shape(df: DataFrame) -> DataFrame:
    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"),
                              F.count(F.lit(1)).alias("n_rows")) for i, (n, t) in enumerate(types)])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def describe_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    q = quantiles(df, cols, Q4)
    part = lambda p: lambda c: F.lit(q[(c,)][p]).cast("double")
    return column_report(df, cols, {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min,
        "q25": part(0.25), "q50": part(0.5), "q75": part(0.75), "max": F.max})


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return column_report(df, cols or df.columns, {"n_missing": lambda c: F.count_if(F.col(c).isNull())})


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row."""
    groups = df.groupBy(*(cols or df.columns)).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def class_balance(df: DataFrame) -> DataFrame:
    out = with_stats(df, {"ok": F.count_if(F.col(C.TARGET) == 0), "bad": F.count_if(F.col(C.TARGET) == 1)})
    return (out.groupBy(C.TARGET).agg(F.count(F.lit(1)).alias("n"), F.any_value("_stats").alias("_s"))
            .select(C.TARGET, "n", F.round(X.ratio(F.col("_s.ok"), F.col("_s.bad")), 1).alias("imbalance_ratio")))


def failure_mode_counts(df: DataFrame) -> DataFrame:
    failed = F.sum(F.col(C.TARGET).cast("bigint"))
    return column_report(df, C.MODES, {
        "n": lambda m: F.sum(F.col(m).cast("bigint")),
        "share_of_failures": lambda m: X.ratio(F.sum(F.col(m) * F.col(C.TARGET)), failed)}, "mode"
    ).orderBy(F.desc("n"), "mode")


def rate_by(df: DataFrame, key: str) -> DataFrame:
    """Failure rate in percent per key value, next to the overall rate."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                 (F.avg(C.TARGET) * 100).alias("failure_rate_pct"))
    return groups.withColumn("overall_rate_pct", df.agg(F.avg(C.TARGET) * 100).scalar())


def cooccurrence(df: DataFrame, modes: list[str] = C.MODES) -> DataFrame:
    """How often two failure modes are active in one row: all cells from one pass."""
    cells = F.array(*[F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b"),
                               F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("n"))
                      for a in modes for b in modes])
    return df.agg(cells.alias("c")).select(F.inline("c"))


def iqr_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    q = quantiles(df, cols, [0.25, 0.75])
    lo = lambda c: q[(c,)][0.25] - 1.5 * (q[(c,)][0.75] - q[(c,)][0.25])
    hi = lambda c: q[(c,)][0.75] + 1.5 * (q[(c,)][0.75] - q[(c,)][0.25])
    return column_report(df, cols, {
        "q1": lambda c: F.lit(q[(c,)][0.25]), "q3": lambda c: F.lit(q[(c,)][0.75]),
        "n_outliers": lambda c: F.count_if((F.col(c) < lo(c)) | (F.col(c) > hi(c)))})


def multi_mode_counts(df: DataFrame) -> DataFrame:
    """Failed rows by number of active modes."""
    active = sum((F.col(m) for m in C.MODES), F.lit(0))
    return (df.filter(F.col(C.TARGET) == 1).groupBy(active.alias("n_modes"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def flag_effectiveness(df: DataFrame, flags: list[str]) -> DataFrame:
    rate = lambda v: lambda f: F.avg(F.when(F.col(f) == v, F.col(C.TARGET))) * 100
    return column_report(df, flags, {"rate_flag_1": rate(1), "rate_flag_0": rate(0)}, "flag")


def flag_precision(df: DataFrame, flags: list[str]) -> DataFrame:
    n = lambda f: F.sum(F.col(f).cast("bigint"))
    caught = lambda f: F.sum((F.col(f) * F.col(C.TARGET)).cast("bigint"))
    return column_report(df, flags, {
        "n_flagged": n,
        "pct_rows": lambda f: X.ratio(n(f), F.count(F.lit(1))) * 100,
        "failures_caught": caught,
        "precision_pct": lambda f: F.coalesce(X.ratio(caught(f), n(f)) * 100, F.lit(0.0))}, "flag")


def zscore_report(df: DataFrame) -> DataFrame:
    return column_report(df, list(C.ZSCORES), {
        "n_extreme": lambda c: F.count_if(F.abs(c) > 3), "mean": F.avg, "std": F.stddev_samp})


def box_stats(df: DataFrame, cols: list[str], by: list[str] | None = None, pooled: bool = False) -> DataFrame:
    """Quartiles and whiskers (most extreme values inside 1.5 IQR) per column, or of all columns pooled."""
    by = by or []
    long = stack(df, by, cols)
    if pooled:
        long = long.withColumn("column", F.lit("pooled"))
        q = quantiles(long, ["value"], Q4, by)
        q = {(*k[:-1], "pooled"): v for k, v in q.items()}
    else:
        q = quantiles(df, cols, Q4, by)
    keys = [*by, "column"]
    table = [(*k, v[0.25], v[0.5], v[0.75]) for k, v in q.items()]
    types = ", ".join(f"_{b} {df.schema[b].dataType.simpleString()}" for b in by)
    limits = df.sparkSession.createDataFrame(
        table, f"{types + ', ' if types else ''}_column string, q1 double, median double, q3 double")
    same = [F.col(f"_{k}").eqNullSafe(long[k]) for k in keys]
    # one limits row per (group, column): a handful
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    kept = F.when(inside, F.col("value"))
    return long.join(F.broadcast(limits), same).groupBy(*keys).agg(
        F.count("value").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(kept).alias("whisker_lo"), F.max(kept).alias("whisker_hi"))


def correlations(df: DataFrame, cols: list[str], target: str = C.TARGET) -> DataFrame:
    return column_report(df, cols, {"r": lambda c: safe_corr(c, target)})


def target_correlation(df: DataFrame, cols: list[str], k: int | None = None, target: str = C.TARGET) -> DataFrame:
    """Pearson r with the target, strongest first; constant columns have no r and come last."""
    out = correlations(df, cols, target).withColumn("abs_r", F.abs("r"))
    out = out.orderBy(F.desc_nulls_last(F.round("abs_r", 9)), "column")
    return out if k is None else out.limit(k)


def env_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """As ``target_correlation``, with 0 for a (nearly) constant column."""
    report = column_report(df, cols, {
        "correlation": lambda c: F.when(F.stddev_samp(c) > 1e-9, F.coalesce(safe_corr(c, target), F.lit(0.0)))
        .otherwise(0.0)}, "field")
    return report.orderBy(F.desc(F.round(F.abs("correlation"), 9)), "field")


def fusion_lift(df: DataFrame, external: list[str],
                composites: tuple[str, ...] = ("vibration_torque_impact", "total_stress_index", "thermal_strain")
                ) -> DataFrame:
    """How much better the best fused feature correlates than the best external one."""
    r = correlations(df, [*external, *composites])
    best = r.agg(F.max(F.when(F.col("column").isin(external), F.abs("r"))).alias("best_external_r"),
                 F.max(F.when(F.col("column").isin(list(composites)), F.col("r"))).alias("best_composite_r"))
    return best.withColumn("lift", X.ratio(F.col("best_composite_r"), F.col("best_external_r")) - 1)


def class_means(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean")) for c in cols])
    return df.groupBy(C.TARGET).agg(rows.alias("r")).select(C.TARGET, F.inline("r"))


def right_closed_bin(col: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """0-based bin with edges[i] < x <= edges[i+1]; null outside."""
    first = (col >= edges[0]) if include_lowest else (col > edges[0])
    out = F.when(~first, None)
    for i, hi in enumerate(edges[1:]):
        out = out.when(col <= F.lit(float(hi)), i)
    return out


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with a costly ``col`` computed once per row: grouping keys would otherwise repeat its formula
    at every mention."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def quantile_edges(df: DataFrame, cols: list[str], n: int) -> list[list[float]]:
    """Distinct quantile edges of several columns from one pass."""
    found = quantiles(df, cols, [i / n for i in range(n + 1)])
    return [sorted(set(found[(c,)].values())) for c in cols]


def interaction_grid(df: DataFrame, a: str, b: str, n: int = 5) -> DataFrame:
    """Failure rate per (quantile bin of a, quantile bin of b); empty cells are kept with a null rate."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    used = df.select(F.when(both, F.col(a)).alias(a), F.when(both, F.col(b)).alias(b), C.TARGET)
    ea, eb = quantile_edges(used, [a, b], n)
    cells = used.groupBy(once(F.col(a), lambda v: right_closed_bin(v, ea, True)).alias("bin_a"),
                         once(F.col(b), lambda v: right_closed_bin(v, eb, True)).alias("bin_b")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(C.TARGET) * 100).alias("failure_rate_pct"))
    names = [(i, j, ea[i], ea[i + 1], eb[j], eb[j + 1]) for i in range(len(ea) - 1) for j in range(len(eb) - 1)]
    grid = df.sparkSession.createDataFrame(
        names, "bin_a int, bin_b int, a_lo double, a_hi double, b_lo double, b_hi double")
    return grid.join(cells, ["bin_a", "bin_b"], "left").fillna(0, ["n"])


def bucket_rate(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Failure rate per right-closed bucket; values outside the edges are not counted."""
    out = df.withColumn("bucket", right_closed_bin(F.col(col), edges)).filter(F.col("bucket").isNotNull())
    return (out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.avg(C.TARGET) * 100).alias("failure_rate_pct"))
            .withColumns({"lo": X.lookup(F.col("bucket"), {i: float(e) for i, e in enumerate(edges[:-1])}),
                          "hi": X.lookup(F.col("bucket"), {i: float(e) for i, e in enumerate(edges[1:])}),
                          "band": rate_band(F.col("failure_rate_pct"))}))


def rate_band(rate: Column) -> Column:
    return F.when(rate > 10, "high").when(rate > 5, "medium").otherwise("low")


def equal_width_rate(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Failure rate per equal-width right-closed bin; the first edge is lowered by 0.1 % of the range.

    A constant column gets a range of 0.1 % of its value to each side, 0.001 around 0.
    """
    flat, pad = F.min(col) == F.max(col), F.when(F.min(col) == 0, 0.001).otherwise(0.001 * F.abs(F.min(col)))
    out = with_stats(df, {"lo": F.when(flat, F.min(col) - pad).otherwise(F.min(col)),
                          "hi": F.when(flat, F.max(col) + pad).otherwise(F.max(col))})
    lo, hi = F.col("_stats.lo"), F.col("_stats.hi")
    width = (hi - lo) / n
    raw = F.ceil(X.ratio(F.col(col) - lo, width)) - 1
    idx = F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("int")
    binned = out.withColumn("bucket", idx).filter(F.col(col).isNotNull())
    agg = binned.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"),
                                       (F.avg(C.TARGET) * 100).alias("failure_rate_pct"),
                                       F.any_value("_stats").alias("_stats"))
    edge = lo + F.col("bucket") * width
    return agg.select("bucket", "n", "failure_rate_pct",
                      F.when(F.col("bucket") == 0, lo - 0.001 * (hi - lo)).otherwise(edge).alias("lo"),
                      (edge + width).alias("hi"))


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts over equal bins of [lo, hi], the last one closed; empty bins are kept."""
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    used = df.filter(F.col(col).between(lo, hi))
    counts = used.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = counts.agg(F.sum("n")).scalar()
    return (frame.join(counts, "bin", "left").fillna(0, ["n"])
            .select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n",
                    X.ratio(F.col("n"), total * width).alias("density")))


def cycle_risk_class(failures: Column) -> Column:
    return F.when(failures > 5, "high").when(failures > 2, "medium").otherwise("low")


def cycle_stats(df: DataFrame, by: list[str] = ("machine_id",)) -> DataFrame:
    out = df.groupBy(*by, "tool_cycle").agg(
        F.sum(F.col(C.TARGET).cast("bigint")).alias("n_failures"), F.count(F.lit(1)).alias("n_rows"),
        F.avg(C.TARGET).alias("failure_rate"), F.max("tool_wear").alias("lifespan"))
    return out.withColumn("risk_class", cycle_risk_class(F.col("n_failures")))


def cycle_summary(cycles: DataFrame) -> DataFrame:
    return cycles.agg(F.count(F.lit(1)).alias("n_cycles"),
                      F.countDistinct("tool_cycle").alias("n_cycle_numbers"),
                      F.avg("n_failures").alias("failures_per_cycle"), F.avg("lifespan").alias("mean_lifespan"))


def worst_cycles(cycles: DataFrame, k: int = 3, by: list[str] = ("machine_id",)) -> DataFrame:
    return cycles.orderBy(F.desc("n_failures"), *by, "tool_cycle").limit(k)


def normal_ranges(df: DataFrame, cols: list[str] = C.SENSORS) -> DataFrame:
    q = quantiles(df, cols, [0.05, 0.95])
    return column_report(df, cols, {"p5": lambda c: F.lit(q[(c,)][0.05]), "p95": lambda c: F.lit(q[(c,)][0.95]),
                                    "min": F.min, "max": F.max}, "sensor")


def outside_normal(what_if: DataFrame, ranges: DataFrame, ids: list[str]) -> DataFrame:
    """Each entered value against its normal range (one range row per sensor)."""
    long = stack(what_if, ids, C.SENSORS, "sensor", "entered")
    position = (F.when(F.col("entered") < F.col("p5"), "below").when(F.col("entered") > F.col("p95"), "above")
                .otherwise("inside"))
    return long.join(F.broadcast(ranges), "sensor").select(
        *ids, "sensor", "entered", "p5", "p95", position.alias("position"))


def kde_by_class(df: DataFrame, col: str, n_grid: int = 300, factor: float = 0.3) -> DataFrame:
    """Gaussian density per class on an even grid, bandwidth = factor x sample sd of the class.

    A task adds its rows into one array per class, so no row is multiplied by the grid and each task sends one row per
    class and grid point, however many rows it has.
    """
    used = df.select(C.TARGET, F.col(col).cast("double").alias("v")).dropna()
    stats = {r[C.TARGET]: r for r in used.groupBy(C.TARGET).agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.stddev_samp("v").alias("sd")).collect()}
    usable = {k: r for k, r in stats.items() if r["n"] > 1 and r["sd"]}
    per_class = lambda f: X.lookup(F.col(C.TARGET), {k: float(f(r)) for k, r in usable.items()})
    if not usable:
        raise ValueError(f"{col} has no spread in any class")
    grids = {k: (r["lo"] + np.arange(n_grid) * ((r["hi"] - r["lo"]) / (n_grid - 1)), factor * r["sd"])
             for k, r in usable.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(n_grid) for k in grids}
        for b in batches:
            label, value = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k, (x, bw) in grids.items():
                distinct, times = np.unique(value[label == k], return_counts=True)
                for at in range(0, len(distinct), KDE_VALUES):
                    u = (x[None, :] - distinct[at:at + KDE_VALUES, None]) / bw
                    total[k] += times[at:at + KDE_VALUES] @ np.exp(-0.5 * u * u)
        for k, sums in total.items():
            yield pa.RecordBatch.from_pydict({
                C.TARGET: pa.array([k] * n_grid, pa.int32()), "grid": pa.array(range(n_grid), pa.int32()), "s": sums})

    lo, step = per_class(lambda r: r["lo"]), per_class(lambda r: (r["hi"] - r["lo"]) / (n_grid - 1))
    bw, n = per_class(lambda r: factor * r["sd"]), per_class(lambda r: r["n"])
    parts = used.select(F.col(C.TARGET).cast("int").alias(C.TARGET), "v").mapInArrow(add, f"{C.TARGET} int, grid int, s double")
    sums = parts.groupBy(C.TARGET, "grid").agg(F.sum("s").alias("_s"))
    return sums.select(C.TARGET, "grid", (lo + F.col("grid") * step).alias("x"),
                       (F.col("_s") / (n * bw * F.sqrt(2 * F.pi()))).alias("density"))


def failure_events(df: DataFrame) -> DataFrame:
    return df.filter(F.col(C.TARGET) == 1).select("event_id", "machine_id", "ts", *C.SENSORS)


def mode_events(df: DataFrame) -> DataFrame:
    """One row per active failure mode and reading."""
    active = F.array_compact(F.array(*[F.when(F.col(m) == 1, F.lit(m)) for m in C.MODES]))
    return df.select("event_id", "machine_id", "ts", F.explode(active).alias("mode"))


def inspection_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    ratio = F.round(X.ratio(F.count_if(F.col(C.TARGET) == 0), F.count_if(F.col(C.TARGET) == 1)), 1)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.cast("bigint").alias("n_missing"),
                 ratio.alias("class_ratio"))
    return one.select("n_rows", F.lit(len(cols)).alias("n_columns"), "n_missing",
                      duplicate_count(df, cols).scalar().alias("n_duplicates"), "class_ratio")


def valid_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def label_agreement(df: DataFrame) -> DataFrame:
    """Share of rows whose label equals the OR of the failure modes."""
    agrees = (F.col(C.TARGET) == F.greatest(*C.MODES)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.avg(agrees) * 100).alias("agreement_pct"))
