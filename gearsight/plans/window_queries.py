"""Cycles, rolling statistics, lags and the causal buffer."""

from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators import features as FE
from gearsight.operators import windows as W
from gearsight.plans.feature_queries import fused, instant
from gearsight.plans.registry import query
from gearsight.sources import telemetry as S

BY_MACHINE = "PARTITION BY machine_id ORDER BY ts, event_id"
BY_CYCLE = "PARTITION BY machine_id, tool_cycle ORDER BY ts, event_id"
STREAM = "ORDER BY ts, event_id"


def frame(over: str, n: int) -> str:
    return f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def physics(spark, d):
    return FE.physics_features(S.telemetry(spark, d))


@query("tool_cycle", "SELECT event_id, tool_cycle FROM cycles")
def tool_cycle(spark, d):
    return W.tool_cycle(S.telemetry(spark, d)).select("event_id", "tool_cycle")


@query("tool_cycle_deep_reset", f"""SELECT event_id, CAST(sum(f) OVER ({BY_MACHINE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tool_cycle
  FROM (SELECT *, CASE WHEN tool_wear - lag(tool_wear) OVER ({BY_MACHINE}) < -50 THEN 1 ELSE 0 END AS f FROM telemetry)""")
def tool_cycle_deep_reset(spark, d):
    return W.tool_cycle(S.telemetry(spark, d), reset_threshold=-50).select("event_id", "tool_cycle")


@query("tool_cycle_stream", f"""SELECT event_id, CAST(sum(f) OVER ({STREAM} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tool_cycle
  FROM (SELECT *, CASE WHEN tool_wear - lag(tool_wear) OVER ({STREAM}) < 0 THEN 1 ELSE 0 END AS f FROM telemetry)""")
def tool_cycle_stream(spark, d):
    return W.tool_cycle(S.telemetry(spark, d), by=[]).select("event_id", "tool_cycle")


@query("buffer_session", f"""SELECT event_id, CAST(sum(CASE WHEN tool_cycle = 0 THEN 1 ELSE 0 END)
  OVER ({BY_MACHINE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS buffer_session FROM cycles""")
def buffer_session(spark, d):
    rows = S.telemetry(spark, d)
    layout = W.series(rows)
    return W.buffer_session(W.tool_cycle(rows, layout=layout), layout=layout).select("event_id", "buffer_session")



def _rolling_sql(over: str, scope: str, cols: list[str], source: str) -> str:
    parts = ["event_id"]
    for n in C.WINDOWS:
        for c in cols:
            f = frame(over, n)
            parts.append(f"round(avg({c}) {f}, 4) AS {c}_{scope}_mean_{n}")
            parts.append(f"round(coalesce(stddev_samp({c}) {f}, 0), 4) AS {c}_{scope}_std_{n}")
            if scope == "tool":
                parts.append(f"round({c} - avg({c}) {f}, 4) AS {c}_tool_dev_{n}")
    return f"SELECT {', '.join(parts)} FROM {source}"


def _round_all(df, digits=4):
    return df.select("event_id", *X.rounded([c for c in df.columns if c != "event_id"], digits))


@query("rolling_global", _rolling_sql(BY_MACHINE, "global", C.CORE_SIGNALS, "physics"))
def rolling_global(spark, d):
    names = [f"{c}_global_{s}_{n}" for n in C.WINDOWS for c in C.CORE_SIGNALS for s in ("mean", "std")]
    return _round_all(W.rolling_features(physics(spark, d), C.CORE_SIGNALS).select("event_id", *names))


@query("rolling_tool", _rolling_sql(BY_CYCLE, "tool", C.CORE_SIGNALS, "cycles"))
def rolling_tool(spark, d):
    rows = physics(spark, d)
    layout = W.series(rows)
    out = W.rolling_features(W.tool_cycle(rows, layout=layout), C.CORE_SIGNALS, scope="tool", layout=layout)
    names = [f"{c}_tool_{s}_{n}" for n in C.WINDOWS for c in C.CORE_SIGNALS for s in ("mean", "std", "dev")]
    return _round_all(out.select("event_id", *names))


@query("rolling_stream", _rolling_sql(STREAM, "global", C.CORE_SIGNALS, "physics"))
def rolling_stream(spark, d):
    names = [f"{c}_global_{s}_{n}" for n in C.WINDOWS for c in C.CORE_SIGNALS for s in ("mean", "std")]
    return _round_all(W.rolling_features(physics(spark, d), C.CORE_SIGNALS, by=[]).select("event_id", *names))


_BFILL = ", ".join(
    f"round(coalesce(lag({c}, {k}) OVER ({BY_MACHINE}), first_value({c}) OVER ({BY_MACHINE})), 6) AS {c}_lag_{k}"
    for k in (1, 2) for c in C.LAG_SIGNALS)


@query("lag_features", f"""SELECT * FROM (SELECT event_id, {_BFILL},
  count(*) OVER (PARTITION BY machine_id) AS n, row_number() OVER ({BY_MACHINE}) AS i FROM physics)""".replace(
    "SELECT * FROM", "SELECT event_id, " + ", ".join(
        f"CASE WHEN n > {k} THEN {c}_lag_{k} END AS {c}_lag_{k}" for k in (1, 2) for c in C.LAG_SIGNALS) + " FROM"))
def lag_features(spark, d):
    names = [f"{c}_lag_{k}" for k in (1, 2) for c in C.LAG_SIGNALS]
    return _round_all(W.lag_features(physics(spark, d)).select("event_id", *names), 6)


@query("lag_features_causal", "SELECT event_id, " + ", ".join(
    f"round(coalesce(lag({c}, {k}) OVER ({BY_MACHINE}), {c}), 6) AS {c}_lag_{k}" for k in (1, 2) for c in C.LAG_SIGNALS)
       + " FROM physics")
def lag_features_causal(spark, d):
    names = [f"{c}_lag_{k}" for k in (1, 2) for c in C.LAG_SIGNALS]
    return _round_all(W.lag_features(physics(spark, d), "causal").select("event_id", *names), 6)


def _context_sql() -> str:
    inner, outer = ["event_id", "machine_id", "ts"], ["event_id"]
    for n in C.CONTEXT_WINDOWS:
        f = frame(BY_MACHINE, n)
        for c, agg, name in (("air_temp", "var_samp", f"air_temp_var_{n}"), ("air_temp", "avg", f"air_temp_mean_{n}"),
                             ("process_temp", "var_samp", f"process_temp_var_{n}"),
                             ("process_temp", "avg", f"process_temp_mean_{n}"),
                             ("particulate_matter_pm10", "avg", f"dust_exposure_mean_{n}")):
            inner.append(f"CASE WHEN count({c}) {f} = {n} THEN {agg}({c}) {f} END AS {name}")
            outer.append(f"round(first_value({name} IGNORE NULLS) OVER ({BY_MACHINE} "
                         f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS {name}")
    return f"SELECT {', '.join(outer)} FROM (SELECT {', '.join(inner)} FROM context)"


@query("rolling_context", _context_sql())
def rolling_context(spark, d):
    names = [f"{c}_{n}" for n in C.CONTEXT_WINDOWS for c in (
        "air_temp_var", "air_temp_mean", "process_temp_var", "process_temp_mean", "dust_exposure_mean")]
    return _round_all(W.rolling_context(fused(spark, d)).select("event_id", *names))


def causal_sql(source: str = "instant") -> str:
    parts = ["event_id", "machine_id"]
    for n in C.WINDOWS:
        f = frame(BY_MACHINE, n)
        for c in C.CORE_SIGNALS:
            parts += [f"round(avg({c}) {f}, 4) AS {c}_mean_{n}", f"round(stddev_pop({c}) {f}, 4) AS {c}_std_{n}"]
    for c in C.LAG_SIGNALS:
        parts += [f"round(coalesce(lag({c}, {k}) OVER ({BY_MACHINE}), {c}), 4) AS {c}_lag_{k}" for k in (1, 2)]
    f = frame(BY_MACHINE, 15)
    for c in ("torque", "rpm", "power", "tool_wear", "temp_diff"):
        parts.append(f"round(CASE WHEN stddev_pop({c}) {f} > 1e-6 THEN ({c} - avg({c}) {f}) / (stddev_pop({c}) {f}) "
                     f"ELSE 0 END, 9) AS {c}_zscore")
    parts.append(f"CAST(least(row_number() OVER ({BY_MACHINE}), 30) AS INTEGER) AS readings_seen")
    return f"SELECT {', '.join(parts)} FROM {source}"


def rounded_causal():
    """z-scores are small ratios that may end exactly on a fifth digit, so they keep more digits."""
    z = [c for c in W.CAUSAL_DERIVED if c.endswith("_zscore")]
    return [*X.rounded([c for c in W.CAUSAL_DERIVED if c not in z], 4), *X.rounded(z, 9)]


@query("causal_features", causal_sql())
def causal_features(spark, d):
    layout = W.series(S.telemetry(spark, d))  # the joined context does not change how long the series are
    out = W.causal_features(instant(spark, d), layout=layout)
    return out.select("event_id", "machine_id", "readings_seen", *rounded_causal())


@query("rolling_failures", f"""SELECT event_id, CAST(sum(machine_failure) OVER ({STREAM}
  ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS BIGINT) AS failure_rolling FROM telemetry""")
def rolling_failures(spark, d):
    return W.rolling_failures(S.telemetry(spark, d), 200, by=[]).select("event_id", "failure_rolling")


@query("lag_pairs", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT event_id, '{c}' AS signal, {k} AS lag, lag({c}, {k}) OVER ({BY_MACHINE}) AS x_before,
  {c} AS x_now, machine_failure FROM physics) WHERE x_before IS NOT NULL"""
    for c in C.LAG_SIGNALS for k in (1, 2)))
def lag_pairs(spark, d):
    return W.lag_pairs(physics(spark, d), C.LAG_SIGNALS)


@query("assign_timeline", f"""SELECT event_id, cycle_id, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(cycle_id) AS timeline_ts
  FROM (SELECT event_id, row_number() OVER ({STREAM}) - 1 AS cycle_id FROM events)""")
def assign_timeline(spark, d):
    rows = S.events(spark, d).select("event_id", "ts")
    return W.assign_timeline(rows).select("event_id", "cycle_id", "timeline_ts")
