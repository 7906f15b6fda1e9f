"""Ordered features per machine: cycles, rolling statistics, lags, causal buffer.

Every operator takes ``by`` (the series columns) and orders rows by (ts, event_id). ``by=[]`` treats the
table as one continuous stream. Long series are cut into blocks (see ``ordering.Series``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.operators.ordering import Order, Series, global_index

ORDER = ["ts", "event_id"]


def series(df: DataFrame, by: list[str] | None = None) -> Series:
    return Series(df, ["machine_id"] if by is None else by, ORDER)


def tool_cycle(df: DataFrame, reset_threshold: float = 0, by: list[str] | None = None,
               layout: Series | None = None) -> DataFrame:
    """Number of wear drops so far; a drop is a change below ``reset_threshold``."""
    layout = layout or series(df, by)

    def drops(rows, window):
        change = F.col("tool_wear") - F.lag("tool_wear").over(window())
        return rows.withColumn("_drop", F.when(change < reset_threshold, 1).otherwise(0))

    return layout.running_sum(layout.apply(df, 1, drops), "_drop", "tool_cycle").drop("_drop")


def buffer_session(df: DataFrame, by: list[str] | None = None, layout: Series | None = None) -> DataFrame:
    """Running count of rows in cycle 0 (needs ``tool_cycle``)."""
    layout = layout or series(df, by)
    marked = df.withColumn("_start", (F.col("tool_cycle") == 0).cast("int"))
    return layout.running_sum(marked, "_start", "buffer_session").drop("_start")


def rolling_features(df: DataFrame, cols: list[str], windows: tuple[int, ...] = C.WINDOWS, scope: str = "global",
                     by: list[str] | None = None, layout: Series | None = None) -> DataFrame:
    """Rolling mean and sample sd (0 for one row); ``scope="tool"`` restarts per cycle and adds deviations."""
    layout = layout or series(df, by)
    extra = ["tool_cycle"] if scope == "tool" else None

    def roll(rows, window):
        out = {}
        for n in windows:
            w = window(extra).rowsBetween(-(n - 1), 0)
            for c in cols:
                mean = F.avg(c).over(w)
                out[f"{c}_{scope}_mean_{n}"] = mean
                out[f"{c}_{scope}_std_{n}"] = F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))
                if scope == "tool":
                    out[f"{c}_tool_dev_{n}"] = F.col(c) - mean
        return rows.withColumns(out)

    return layout.apply(df, max(windows) - 1, roll)


def lag_features(df: DataFrame, ruleset: str = "research", cols: list[str] = C.LAG_SIGNALS,
                 lags: tuple[int, ...] = (1, 2), by: list[str] | None = None,
                 layout: Series | None = None) -> DataFrame:
    """Previous values. At the start: back-filled (research) or the row's own value (causal)."""
    layout = layout or series(df, by)
    names = {f"{c}_lag_{k}": (c, k) for k in lags for c in cols}

    def shift(rows, window):
        w = window()
        causal = ruleset != "research"
        return rows.withColumns({
            name: F.when(F.row_number().over(w) > k, F.lag(c, k).over(w)).otherwise(F.col(c)) if causal
            else F.lag(c, k).over(w) for name, (c, k) in names.items()})

    out = layout.apply(df, max(lags), shift)
    return layout.backfill(out, list(names)) if ruleset == "research" else out


def rolling_context(df: DataFrame, windows: tuple[int, ...] = C.CONTEXT_WINDOWS, by: list[str] | None = None,
                    layout: Series | None = None) -> DataFrame:
    """Full-window variance and mean of the temperatures and dust mean, back-filled at the start."""
    layout = layout or series(df, by)
    names = {}
    for n in windows:
        for c, label in (("air_temp", "air_temp"), ("process_temp", "process_temp")):
            names[f"{label}_var_{n}"] = (F.var_samp, c, n)
            names[f"{label}_mean_{n}"] = (F.avg, c, n)
        names[f"dust_exposure_mean_{n}"] = (F.avg, "particulate_matter_pm10", n)

    def roll(rows, window):
        out = {}
        for name, (agg, c, n) in names.items():
            w = window().rowsBetween(-(n - 1), 0)
            out[name] = F.when(F.count(c).over(w) == n, agg(c).over(w))
        return rows.withColumns(out)

    return layout.backfill(layout.apply(df, max(windows) - 1, roll), list(names))


def causal_features(df: DataFrame, by: list[str] | None = None, layout: Series | None = None) -> DataFrame:
    """Buffer features of the causal track over instant features; all share one sort per series."""
    layout = layout or series(df, by)

    def roll(rows, window):
        base = window()
        out = {}
        for n in C.WINDOWS:
            w = base.rowsBetween(-(n - 1), 0)
            for c in C.CORE_SIGNALS:
                out[f"{c}_mean_{n}"] = F.avg(c).over(w)
                out[f"{c}_std_{n}"] = F.stddev_pop(c).over(w)
        recent = base.rowsBetween(-(max(C.WINDOWS) - 1), 0)
        out["_wear_mean"], out["_wear_std"] = F.avg("tool_wear").over(recent), F.stddev_pop("tool_wear").over(recent)
        out["readings_seen"] = F.count(F.lit(1)).over(base.rowsBetween(-(C.BUFFER_LEN - 1), 0)).cast("int")
        rows = rows.withColumns(out)
        seen = F.col("readings_seen")
        rows = rows.withColumns({f"{c}_lag_{k}": F.when(seen > k, F.lag(c, k).over(base)).otherwise(F.col(c))
                                 for c in C.LAG_SIGNALS for k in (1, 2)})
        return rolling_zscores(rows)

    return layout.apply(df, C.BUFFER_LEN - 1, roll)


def rolling_zscores(rows: DataFrame) -> DataFrame:
    """z against the 15-row window; 0 where the window is (nearly) constant."""
    sources = {c: (f"{c}_mean_15", f"{c}_std_15") for c in ("torque", "rpm", "power", "temp_diff")}
    sources["tool_wear"] = ("_wear_mean", "_wear_std")
    return rows.withColumns({
        f"{c}_zscore": F.when(F.col(s) > 1e-6, (F.col(c) - F.col(m)) / F.col(s)).otherwise(0.0)
        for c, (m, s) in sources.items()}).drop("_wear_mean", "_wear_std")


CAUSAL_DERIVED = ([f"{c}_{s}_{n}" for n in C.WINDOWS for c in C.CORE_SIGNALS for s in ("mean", "std")]
                  + [f"{c}_lag_{k}" for c in C.LAG_SIGNALS for k in (1, 2)]
                  + [f"{c}_zscore" for c in ("torque", "rpm", "power", "tool_wear", "temp_diff")])


def rolling_failures(df: DataFrame, n: int = 200, by: list[str] | None = None,
                     layout: Series | None = None) -> DataFrame:
    """Failures among the last ``n`` rows: difference of two running counts, one step per row.

    Inside a block the running count starts anywhere, which the difference cancels.
    """
    layout = layout or series(df, by)

    def count(rows, window):
        run = F.sum(F.col(C.TARGET).cast("bigint")).over(window().rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("_run", run).withColumn(
            "failure_rolling", F.col("_run") - F.coalesce(F.lag("_run", n).over(window()), F.lit(0)))

    return layout.apply(df, n, count).drop("_run")


def lag_pairs(df: DataFrame, cols: list[str], lags: tuple[int, ...] = (1, 2), by: list[str] | None = None,
              layout: Series | None = None) -> DataFrame:
    """Scatter pairs (signal, lag, value before, value now, label); rows without a past value are left out."""
    layout = layout or series(df, by)
    shifted = layout.apply(df, max(lags), lambda rows, window: rows.withColumns(
        {f"_{c}_{k}": F.lag(c, k).over(window()) for c in cols for k in lags}))
    pair = lambda c, k: F.struct(F.lit(c).alias("signal"), F.lit(k).alias("lag"),
                                 F.col(f"_{c}_{k}").alias("x_before"), F.col(c).alias("x_now"))
    pairs = F.explode(F.array(*[pair(c, k) for c in cols for k in lags])).alias("p")
    return (shifted.select("event_id", C.TARGET, pairs).select("event_id", "p.*", C.TARGET)
            .filter(F.col("x_before").isNotNull()))


def assign_timeline(df: DataFrame, start: str = "2026-01-01 00:00:00", step_seconds: int = 60) -> DataFrame:
    """Sequence id and evenly spaced timestamps in (ts, event_id) order."""
    placed = global_index(df, ORDER, "cycle_id")
    at = F.unix_timestamp(F.lit(start)) + F.col("cycle_id") * step_seconds
    return placed.withColumn("timeline_ts", F.timestamp_seconds(at).cast("timestamp_ntz"))


def session_blocks(df: DataFrame, n: int = C.N_SESSIONS, remainder: str = "last") -> DataFrame:
    """Equal contiguous row blocks; the remainder joins the last block or is dropped."""
    order = Order(df, ORDER)
    size = order.n_rows // n
    if size == 0:
        raise ValueError(f"{order.n_rows} rows cannot fill {n} sessions")
    placed = order.with_position("_pos").withColumn("session_index", F.floor(F.col("_pos") / size).cast("int"))
    if remainder == "last":
        placed = placed.withColumn("session_index", F.least(F.col("session_index"), F.lit(n - 1)))
    elif remainder == "drop":
        placed = placed.filter(F.col("session_index") < n)
    else:
        raise ValueError("remainder must be 'last' or 'drop'")
    return placed.drop("_pos")
