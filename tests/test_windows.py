"""Ordered features against an independent plain-Python buffer, with short and cut series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.operators import fleet as FL
from gearsight.operators import windows as W
from gearsight.operators.features import instant_features
from gearsight.operators.ordering import Series


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    rows, wear = [], {m: 0.0 for m in range(6)}
    for i in range(700):
        m = 0 if i % 3 == 0 else rng.randrange(1, 6)  # machine 0 holds a third of the rows
        wear[m] = 0.0 if rng.random() < 0.03 else wear[m] + rng.randrange(1, 5)
        rows.append((i, m, 1_700_000_000 + rng.randrange(0, 4000), "LMH"[m % 3], 295 + rng.random() * 10,
                     305 + rng.random() * 10, float(rng.randrange(1200, 1900)), 25 + rng.random() * 40, wear[m],
                     int(rng.random() < 0.1)))
    df = spark.createDataFrame(rows, "event_id bigint, machine_id bigint, sec bigint, type string, air_temp double, "
                                     "process_temp double, rpm double, torque double, tool_wear double, machine_failure int")
    return df.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec").persist()


def cut(df, by=("machine_id",), rows=20):
    return Series(df, list(by), W.ORDER, max_rows=rows)


def as_dict(df, cols, digits=7):
    tidy = lambda v: round(v, digits) if isinstance(v, float) else v
    return {r["event_id"]: tuple(tidy(r[c]) for c in cols) for r in df.collect()}


def python_buffer(rows):
    """One machine's readings in time order -> expected causal features, straight from the definition."""
    out, seen = {}, []
    for r in rows:
        x = {c: r[c] for c in ("air_temp", "process_temp", "rpm", "torque", "tool_wear")}
        x["power"], x["temp_diff"] = r["torque"] * r["rpm"], r["process_temp"] - r["air_temp"]
        seen.append(x)
        f = {}
        for w in (5, 15):
            for c in C.CORE_SIGNALS:
                vals = [s[c] for s in seen[-w:]]
                f[f"{c}_mean_{w}"], f[f"{c}_std_{w}"] = float(np.mean(vals)), float(np.std(vals))
        for c in C.LAG_SIGNALS:
            for k in (1, 2):
                f[f"{c}_lag_{k}"] = seen[-1 - k][c] if len(seen) > k else x[c]
        for c in ("torque", "rpm", "power", "tool_wear", "temp_diff"):
            vals = [s[c] for s in seen[-15:]]
            s = float(np.std(vals))
            f[f"{c}_zscore"] = (x[c] - float(np.mean(vals))) / s if s > 1e-6 else 0.0
        f["readings_seen"] = min(len(seen), 30)
        out[r["event_id"]] = f
    return out


def expected_causal(df):
    out = {}
    rows = sorted(df.collect(), key=lambda r: (r["ts"], r["event_id"]))
    for m in {r["machine_id"] for r in rows}:
        out.update(python_buffer([r for r in rows if r["machine_id"] == m]))
    return out


@pytest.mark.parametrize("max_rows", [None, 20])
def test_causal_features(readings, max_rows):
    base = instant_features(readings)
    got = W.causal_features(base, layout=Series(base, ["machine_id"], W.ORDER, max_rows=max_rows))
    cols = [*W.CAUSAL_DERIVED, "readings_seen"]
    want = expected_causal(readings)
    for r in got.collect():
        for c in cols:
            assert r[c] == pytest.approx(want[r["event_id"]][c], rel=1e-7, abs=1e-6), c


def test_causal_means_no_future(readings):
    base = instant_features(readings)
    cutoff = sorted(r["ts"] for r in readings.select("ts").collect())[400]
    full = as_dict(W.causal_features(base).filter(F.col("ts") < F.lit(cutoff)), W.CAUSAL_DERIVED)
    past = as_dict(W.causal_features(base.filter(F.col("ts") < F.lit(cutoff))), W.CAUSAL_DERIVED)
    assert full == past


def variants(readings):
    dusty = readings.withColumn("particulate_matter_pm10", F.col("torque") * 2)
    power = readings.withColumns({"power": F.col("torque") * F.col("rpm"),
                                  "temp_diff": F.col("process_temp") - F.col("air_temp")})
    return {
        "tool_cycle": (readings, lambda d, l: W.tool_cycle(d, layout=l), ["tool_cycle"]),
        "deep": (readings, lambda d, l: W.tool_cycle(d, -50, layout=l), ["tool_cycle"]),
        "session": (readings, lambda d, l: W.buffer_session(W.tool_cycle(d, layout=l), layout=l), ["buffer_session"]),
        "rolling": (power, lambda d, l: W.rolling_features(d, ["torque", "power"], layout=l),
                    ["torque_global_mean_5", "power_global_std_15"]),
        "tool": (power, lambda d, l: W.rolling_features(W.tool_cycle(d, layout=l), ["torque"], scope="tool", layout=l),
                 ["torque_tool_mean_15", "torque_tool_std_5", "torque_tool_dev_5"]),
        "lags": (power, lambda d, l: W.lag_features(d, layout=l), ["torque_lag_1", "power_lag_2"]),
        "lags causal": (power, lambda d, l: W.lag_features(d, "causal", layout=l), ["torque_lag_1", "power_lag_2"]),
        "context": (dusty, lambda d, l: W.rolling_context(d, layout=l), ["air_temp_var_5", "dust_exposure_mean_30"]),
        "failures": (readings, lambda d, l: W.rolling_failures(d, 30, layout=l), ["failure_rolling"]),
    }


@pytest.mark.parametrize("name", ["tool_cycle", "deep", "session", "rolling", "tool", "lags", "lags causal", "context",
                                  "failures"])
@pytest.mark.parametrize("by", [("machine_id",), ()])
def test_cut_series_equal_whole_series(spark, readings, name, by):
    spark.conf.set("spark.gearsight.rowsPerBucket", "60")
    try:
        df, run, cols = variants(readings)[name]
        whole, pieces = Series(df, list(by), W.ORDER), cut(df, by)
        assert whole.long == "none" and pieces.long in ("some", "all")
        assert as_dict(run(df, pieces), cols) == as_dict(run(df, whole), cols)
    finally:
        spark.conf.unset("spark.gearsight.rowsPerBucket")


def test_single_row_per_machine(spark):
    df = spark.createDataFrame([(1, 7, 300.0, 310.0, 1500.0, 40.0, 10.0, "M")],
                               "event_id bigint, machine_id bigint, air_temp double, process_temp double, rpm double, "
                               "torque double, tool_wear double, type string").withColumn("ts", F.lit("2026-01-01").cast("timestamp_ntz"))
    row = W.causal_features(instant_features(df)).first()
    assert row["torque_std_5"] == 0 and row["torque_lag_2"] == 40.0 and row["torque_zscore"] == 0 and row["readings_seen"] == 1
    power = df.withColumn("power", F.lit(1.0))
    assert W.lag_features(power).first()["torque_lag_1"] is None
    assert W.rolling_features(df, ["torque"]).first()["torque_global_std_5"] == 0


def test_reset_threshold(spark):
    rows = [(i, 1, w) for i, w in enumerate([10.0, 60.0, 59.0, 100.0, 40.0])]
    df = spark.createDataFrame(rows, "event_id bigint, machine_id bigint, tool_wear double").withColumn(
        "ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    assert [r[0] for r in W.tool_cycle(df).orderBy("event_id").select("tool_cycle").collect()] == [0, 0, 1, 1, 2]
    assert [r[0] for r in W.tool_cycle(df, -50).orderBy("event_id").select("tool_cycle").collect()] == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("n,k", [(83, 40), (40, 40), (10, 3)])
def test_session_blocks(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    sizes = {r[0]: r[1] for r in W.session_blocks(df, k).groupBy("session_index").count().collect()}
    assert sizes == {i: n // k + (n % k if i == k - 1 else 0) for i in range(k)}
    assert W.session_blocks(df, k, "drop").count() == n // k * k
    with pytest.raises(ValueError):
        W.session_blocks(df, n + 1)


def test_borrowed_history_rules(spark, readings):
    rows = sorted(readings.filter("machine_id = 0").collect(), key=lambda r: (r["ts"], r["event_id"]))
    ask = lambda i, at, kind="L": (i, 0, at, 300.0, 308.0, 1300.0, 55.0, 210.0, kind)
    import datetime as dt
    what_if = spark.createDataFrame(
        [ask(1, None), ask(2, rows[100]["ts"]), ask(3, rows[2]["ts"]), ask(4, dt.datetime(1999, 1, 1)), ask(5, rows[0]["ts"])],
        "whatif_id bigint, machine_id bigint, borrow_ts timestamp_ntz, air_temp double, process_temp double, rpm double, "
        "torque double, tool_wear double, type string")
    got = {r["whatif_id"]: r for r in FL.whatif_features(what_if, readings).collect()}
    before = lambda r: sum(x["ts"] < r["ts"] for x in rows)
    assert [got[i]["history_rows"] for i in (1, 2, 3, 4, 5)] == [0, 29, before(rows[2]), 0, 0]
    assert [got[i]["borrow_ts_found"] for i in (1, 2, 3, 4)] == [None, 1, 1, 0]
    assert [got[i]["cold_start_warning"] for i in (1, 2, 4, 5)] == [1, 0, 1, 1]
    entered = rows[:before(rows[100])] + [what_if.filter("whatif_id = 2").first().asDict() | {"event_id": -1}]
    want = python_buffer([r if isinstance(r, dict) else r.asDict() for r in entered])[-1]
    for c in W.CAUSAL_DERIVED:
        assert got[2][c] == pytest.approx(want[c], rel=1e-7, abs=1e-6), c
    cycle0 = {r["whatif_id"]: r["history_rows"] for r in FL.whatif_features(what_if, readings, "cycle0").collect()}
    assert cycle0[3] == 0 and cycle0[2] == 29


def test_newest_rows_are_limited_before_the_shuffle(readings):
    plan = FL.last_n(readings, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
