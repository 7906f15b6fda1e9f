import math

import pytest
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators import clean as K
from gearsight.operators import features as FE
from gearsight.operators import fusion as FU
from gearsight.operators import noise as N


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(1, 300.0, 308.6, 1380.0, 50.0, 200.0, "L", 1), (2, 300.0, 300.0, 1400.0, 50.0, 0.0, "H", 0),
            (3, 300.0, 308.0, 1300.0, 60.0, 241.0, "X", 1), (4, 298.5, 308.9, 1450.0, 45.0, 120.0, "M", 0)]
    return spark.createDataFrame(rows, "event_id bigint, air_temp double, process_temp double, rpm double, "
                                       "torque double, tool_wear double, type string, machine_failure int")


def by_id(df, *cols):
    return {r["event_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_type_codes(readings):
    assert by_id(K.encode_type(readings), "type_code") == {1: (0,), 2: (2,), 3: (None,), 4: (1,)}
    assert by_id(K.encode_type(readings, 1), "type_code")[3] == (1,)
    assert by_id(K.decode_type(K.encode_type(readings)), "type_label")[1] == ("L (Low)",)


def test_flag_rulesets_differ(readings):
    research = by_id(FE.threshold_flags(readings, "research"), *C.RISK_FLAGS)
    causal = by_id(FE.threshold_flags(readings, "causal"), *C.RISK_FLAGS)
    # twf: >= 200 against 200..240; pwf: research watts-free band against the narrow one; osf unknown grade
    assert research[1][0] == causal[1][0] == 1
    assert research[3][0] == 1 and causal[3][0] == 0
    assert research[4][2] == 0 and causal[4][2] == 1
    assert research[3][3] == 0 and causal[3][3] == 1  # unknown grade: no limit / 12000
    watts = by_id(FE.threshold_flags(readings, "causal_watts"), "pwf_risk_flag")
    assert watts[4] == (0,)  # 45 * 1450 * 2 pi / 60 = 6833 W
    with pytest.raises(ValueError):
        FE.threshold_flags(readings, "other")


def test_zero_temperature_difference(readings):
    assert by_id(FE.physics_features(readings, "causal"), "power_per_temp")[2] == (50.0 * 1400 / 0.1,)


def test_context_defaults(readings, spark):
    out = FE.instant_features(readings.withColumn("ambient_temp", F.when(F.col("event_id") == 1, 291.0)))
    got = by_id(out, "ambient_temp", "operator_skill_proxy", "particulate_matter_pm10")
    assert got[1] == (291.0, 3, 40.0) and got[2] == (293.0, 3, 40.0)


def test_zscore_of_constant_column_is_null(readings):
    out = FE.zscore_features(FE.physics_features(readings.withColumn("rpm", F.lit(1500.0))))
    assert by_id(out, "rpm_zscore") == {i: (None,) for i in (1, 2, 3, 4)}


def test_polynomials(readings):
    out = by_id(FE.polynomial_features(FE.physics_features(readings)), "sqrt_wear", "log_strain", "torque_squared")
    assert out[4] == (math.sqrt(120.0), pytest.approx(math.log1p(5400.0)), 2025.0)


def test_tier_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.2,), (0.5,), (1.0,), (None,)], "p double")
    tiers = [r["t"] for r in df.select(X.risk_tier(F.col("p")).alias("t")).collect()]
    assert tiers == ["Low", "Medium", "High", "Critical", "Critical", None]


def test_trend(spark):
    df = spark.createDataFrame([(0.002,), (0.001,), (-0.002,), (0.0,)], "d double")
    assert [r[0] for r in df.select(X.trend_label(F.col("d"))).collect()] == ["up", "flat", "down", "flat"]


def test_round_is_half_even(spark):
    df = spark.createDataFrame([(0.85625, 3), (2.5, 4)], "a double, b int")
    assert [r["a"] for r in K.round_numeric(df, 4).collect()] == [0.8562, 2.5]
    assert K.round_numeric(df, 0).collect()[1]["a"] == 2.0


def test_coerce(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, "2")], "a string, b string")
    assert [tuple(r) for r in K.coerce_numeric(df, ["a", "b"]).collect()] == [(1.5, 0.0), (0.0, 2.0)]


def test_quality_gate(spark, readings):
    good = readings.drop("type")
    assert K.require_quality(good) is good
    with pytest.raises(ValueError):
        K.require_quality(readings)  # a text column
    with pytest.raises(ValueError):
        K.require_quality(good.withColumn("rpm", F.when(F.col("event_id") > 1, F.col("rpm"))))
    with pytest.raises(KeyError):
        K.quality_gate(good.drop(C.TARGET))


@pytest.mark.parametrize("rows", ["TRUE", "FALSE"])
def test_gate_of_a_written_matrix(spark, readings, tmp_path, rows):
    matrix = readings.filter(rows).withColumn("rpm", F.when(F.col("event_id") > 1, F.col("rpm")))
    got = K.write_gated(matrix, str(tmp_path / "matrix"))
    assert got == K.quality_gate(matrix).first().asDict()
    written = spark.read.schema(matrix.schema).parquet(str(tmp_path / "matrix"))
    assert sorted(map(str, written.collect())) == sorted(map(str, matrix.collect()))


def test_gate_of_stream_batches(spark, readings, tmp_path):
    readings.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(lambda batch, i: seen.update({i: K.write_gated(batch, str(tmp_path / f"out{i}"))})).option(
        "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination(60)
    assert sum(g["n_rows"] for g in seen.values()) == readings.count() and all(not g["passed"] for g in seen.values())


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3)], "`Torque [Nm]` double, `a--b` double, TWF int")
    assert K.normalize_names(df).columns == ["Torque_Nm", "a_b", "TWF"]
    assert K.leakage_firewall(df).columns == ["Torque [Nm]", "a--b"]
    assert K.align_columns(df, ["Torque_Nm"]).columns == ["Torque_Nm"]
    with pytest.raises(KeyError):
        K.align_columns(df, ["Torque_Nm", "gone"])
    assert K.sensor_columns(["Torque_Nm", "RPM_mean", "power", "tool_wear"]) == ["Torque_Nm", "RPM_mean", "tool_wear"]


def test_catalog_and_constants(readings):
    after = FE.type_indicators(readings)
    kinds = {r["column"]: r["kind"] for r in K.feature_catalog(readings, after).collect()}
    assert kinds["is_low_quality"] == "engineered" and kinds["rpm"] == "original"
    dead = after.withColumns({"c": F.lit(1), "n": F.lit(None).cast("double"),
                              "half": F.when(F.col("event_id") == 1, 5)})
    kept = K.drop_constant(dead, ["c", "n", "half", "rpm"]).columns
    assert "c" not in kept and "n" not in kept and "half" in kept and "rpm" in kept


def test_hash_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 977).alias("ts"))
    runs = [sorted(map(str, FU.synthetic_context(df.repartition(p)).collect())) for p in (1, 7)]
    assert runs[0] == runs[1]
    z = df.select(X.normal("event_id", "s").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.15 and abs(z[1] - 1) < 0.1


def test_noise(readings):
    out = by_id(N.inject_noise(readings, ["torque"], 0.05), "torque", "rpm")
    base = by_id(readings, "torque", "rpm")
    assert all(out[i][0] != base[i][0] and out[i][1] == base[i][1] for i in base)
    with pytest.raises(KeyError):
        N.inject_noise(readings, ["nope"], 0.05)


def test_asof(spark):
    env = spark.createDataFrame([("2026-01-01 00:30:00", 1.0), ("2026-01-01 05:00:00", 2.0)], "t string, v double"
                                ).select(F.to_timestamp_ntz("t").alias("env_ts"), "v")
    at = ["2026-01-01 00:29:59", "2026-01-01 00:30:00", "2026-01-01 04:59:59", "2026-01-01 05:00:00", "2026-01-02 09:00:00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "event_id int, t string"
                                 ).select("event_id", F.to_timestamp_ntz("t").alias("ts"))
    assert by_id(FU.asof_environment(rows, env), "v") == {0: (None,), 1: (1.0,), 2: (1.0,), 3: (2.0,), 4: (2.0,)}
    near = by_id(FU.asof_environment(rows, env, tolerance="2 hours"), "v")
    assert near == {0: (None,), 1: (1.0,), 2: (None,), 3: (2.0,), 4: (None,)}


def test_fused_rows_never_multiply(spark):
    env = spark.createDataFrame([("2026-01-01 03:10:00", 1.0), ("2026-01-01 03:50:00", 2.0), ("2026-01-01 03:50:00", 2.0)],
                                "t string, v double").select(F.to_timestamp_ntz("t").alias("env_ts"), "v")
    rows = spark.createDataFrame([(1, "2026-01-01 03:05:00"), (2, "2026-01-01 03:05:00"), (3, "2026-01-01 04:00:00")],
                                 "event_id int, t string").select("event_id", F.to_timestamp_ntz("t").alias("ts"))
    assert by_id(FU.fuse_environment(rows, env), "v") == {1: (2.0,), 2: (2.0,), 3: (None,)}


@pytest.mark.parametrize("block", [None, 7])
def test_asof_over_blocks_equals_brute_force(spark, block):
    """A third of all rows at one time, gaps longer than a block, equal environment times, no time, repeated rows."""
    at = [None, 0, 1, 1, 5, *[50] * 40, *range(60, 100), 400, 400, 1000]
    rows = spark.createDataFrame([(i // 2 if i < 6 else i, t) for i, t in enumerate(at)], "event_id bigint, s bigint")
    env_rows = [(1, 1.0), (1, 2.0), (49, 3.0), (50, 4.0), (70, None), (300, 6.0), (None, 9.0), (2000, 7.0)]
    env = spark.createDataFrame(env_rows, "s bigint, v double").select(F.timestamp_seconds("s").alias("env_ts"), "v")
    before = spark.conf.get("spark.gearsight.maxStreamRows", None), spark.conf.get("spark.gearsight.rowsPerBucket", None)
    try:
        if block:
            spark.conf.set("spark.gearsight.maxStreamRows", str(block))
            spark.conf.set("spark.gearsight.rowsPerBucket", str(block))
        readings = rows.withColumn("ts", F.timestamp_seconds("s"))
        for limit in (None, 30):
            out = FU.asof_environment(readings, env, tolerance=limit and f"{limit} seconds")
            got = out.select("event_id", "s", F.unix_seconds("matched_env_ts"), "v").collect()
            want = []
            for i, t in rows.collect():
                past = [(e, v) for e, v in env_rows if None not in (e, t) and e <= t and (limit is None or t - e <= limit)]
                want.append((i, t, *max(past, key=lambda p: (p[0], p[1] or 0.0), default=(None, None))))
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        none = FU.asof_environment(readings, env.limit(0))
        assert none.count() == len(at) and none.filter("matched_env_ts is not null").count() == 0
        assert FU.asof_environment(readings.limit(0), env).count() == 0
    finally:
        for name, value in zip(("maxStreamRows", "rowsPerBucket"), before):
            spark.conf.unset(f"spark.gearsight.{name}") if value is None else spark.conf.set(f"spark.gearsight.{name}", value)
