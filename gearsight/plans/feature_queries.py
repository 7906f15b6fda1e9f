"""Row features, cleaning and environment fusion."""

from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators import clean as K
from gearsight.operators import features as FE
from gearsight.operators import fusion as FU
from gearsight.plans.registry import query
from gearsight.sources import io
from gearsight.sources import telemetry as S
from gearsight.sources.staging import scratch


@query("scan_telemetry", """SELECT event_id, machine_id, type, air_temp, process_temp, rpm, torque, tool_wear,
  twf, hdf, pwf, osf, rnf, machine_failure FROM telemetry""")
def scan_telemetry(spark, d):
    return S.telemetry(spark, d).select("event_id", "machine_id", "type", *C.SENSORS, *C.MODES, C.TARGET)


@query("replay_source", """SELECT event_id, tool_wear, machine_failure, machine_failure AS machine_failure_label,
  twf AS twf_label, hdf AS hdf_label, pwf AS pwf_label, osf AS osf_label, rnf AS rnf_label FROM telemetry""")
def replay_source(spark, d):
    return io.replay_source(S.telemetry(spark, d)).select(
        "event_id", "tool_wear", C.TARGET, "machine_failure_label", *[f"{m}_label" for m in C.MODES])


@query("stage_round_trip", "SELECT event_id, type, round(power, 6) AS power, machine_failure FROM physics")
def stage_round_trip(spark, d):
    path = scratch(spark, "stage")
    rows = FE.physics_features(S.telemetry(spark, d)).withColumn("day", F.to_date("ts"))
    io.write_stage(rows, path, ["day"])
    return io.read_telemetry(spark, path).select("event_id", "type", F.round("power", 6).alias("power"), C.TARGET)


@query("clean", """SELECT event_id, CASE type WHEN 'L' THEN 0 WHEN 'M' THEN 1 WHEN 'H' THEN 2 END AS type_code,
  air_temp, process_temp, rpm, torque, tool_wear, machine_failure FROM telemetry""")
def clean(spark, d):
    raw = S.telemetry(spark, d).withColumns({"udi": F.col("event_id") + 1, "product_id": F.concat("type", "machine_id")})
    return K.clean(raw).select("event_id", "type_code", *C.SENSORS, C.TARGET)


@query("physics_features", """SELECT event_id, round(power, 6) AS power, round(temp_diff, 6) AS temp_diff,
  round(wear_rate, 6) AS wear_rate, round(torque_per_wear, 9) AS torque_per_wear,
  round(strain_index, 6) AS strain_index, round(power_per_temp, 6) AS power_per_temp FROM physics""")
def physics_features(spark, d):
    cols = ["power", "temp_diff", "wear_rate", "strain_index", "power_per_temp"]
    return FE.physics_features(S.telemetry(spark, d)).select("event_id", *X.rounded(cols), *X.rounded(["torque_per_wear"], 9))


@query("interaction_features", """SELECT event_id, round(torque * process_temp, 4) AS thermal_torque_stress,
  round(rpm * torque * tool_wear, 4) AS rotational_load_on_worn_tool, round(power * tool_wear, 4) AS power_absorbed_by_wear,
  round(temp_diff * tool_wear, 4) AS thermal_stress_on_worn_tool, round(rpm * temp_diff, 4) AS speed_heat_imbalance
  FROM physics""")
def interaction_features(spark, d):
    cols = ["thermal_torque_stress", "rotational_load_on_worn_tool", "power_absorbed_by_wear",
            "thermal_stress_on_worn_tool", "speed_heat_imbalance"]
    return FE.interaction_features(S.telemetry(spark, d)).select("event_id", *X.rounded(cols, 4))


@query("type_indicators", """SELECT event_id, CASE WHEN type = 'L' THEN 1 ELSE 0 END AS is_low_quality,
  CASE WHEN type = 'H' THEN 1 ELSE 0 END AS is_high_quality FROM telemetry""")
def type_indicators(spark, d):
    return FE.type_indicators(S.telemetry(spark, d)).select("event_id", "is_low_quality", "is_high_quality")


@query("threshold_flags", "SELECT event_id, hdf_risk_flag, pwf_risk_flag, osf_risk_flag, twf_risk_flag FROM physics")
def threshold_flags(spark, d):
    return FE.threshold_flags(S.telemetry(spark, d)).select("event_id", *C.RISK_FLAGS)


@query("threshold_flags_watts", """SELECT event_id,
  CASE WHEN torque * rpm * 2 * pi() / 60 < 3500 OR torque * rpm * 2 * pi() / 60 > 9000 THEN 1 ELSE 0 END AS pwf_risk_flag,
  CASE WHEN tool_wear BETWEEN 200 AND 240 THEN 1 ELSE 0 END AS twf_risk_flag FROM telemetry""")
def threshold_flags_watts(spark, d):
    return FE.threshold_flags(S.telemetry(spark, d), "causal_watts").select("event_id", "pwf_risk_flag", "twf_risk_flag")


@query("instant_features", """SELECT event_id, air_temp, process_temp, rpm, torque, tool_wear, type_code,
  round(power, 6) AS power, round(temp_diff, 6) AS temp_diff, round(torque_per_wear, 9) AS torque_per_wear,
  round(strain_index, 6) AS strain_index, round(power_per_temp, 6) AS power_per_temp, twf_risk_flag, hdf_risk_flag,
  pwf_risk_flag, osf_risk_flag, twf_risk_flag + hdf_risk_flag + pwf_risk_flag + osf_risk_flag AS risk_score,
  ambient_temp, ambient_humidity, atmospheric_pressure, grid_voltage_fluctuation, factory_load_density,
  operator_skill_proxy, particulate_matter_pm10, ambient_vibration_noise FROM instant""")
def instant_features(spark, d):
    cols = ["power", "temp_diff", "strain_index", "power_per_temp"]
    return instant(spark, d).select("event_id", *C.SENSORS, "type_code", *X.rounded(cols),
                                    *X.rounded(["torque_per_wear"], 9), *C.RISK_FLAGS, "risk_score", *C.ENV_FIELDS)


def instant(spark, d):
    fused = FU.fuse_environment(S.telemetry(spark, d), S.environment(spark, d))
    return FE.instant_features(fused)


def fused(spark, d):
    """Scored telemetry with all eight context signals and the cross-domain features."""
    return FE.fusion_features(FU.synthetic_context(FE.physics_features(S.scored(spark, d))))


@query("polynomial_features", """SELECT event_id, round(torque * torque, 4) AS torque_squared,
  round(tool_wear * tool_wear, 4) AS wear_squared, round(power * power, 2) AS power_squared,
  round(temp_diff * temp_diff, 4) AS temp_diff_squared, round(sqrt(power), 6) AS sqrt_power,
  round(sqrt(tool_wear), 6) AS sqrt_wear, round(ln(1 + power), 6) AS log_power,
  round(ln(1 + strain_index), 6) AS log_strain FROM physics""")
def polynomial_features(spark, d):
    out = FE.polynomial_features(FE.physics_features(S.telemetry(spark, d)))
    return out.select("event_id", *X.rounded(["torque_squared", "wear_squared", "temp_diff_squared"], 4),
                      *X.rounded(["power_squared"], 2),
                      *X.rounded(["sqrt_power", "sqrt_wear", "log_power", "log_strain"]))


@query("failure_proximity", """SELECT event_id, 200 - tool_wear AS distance_to_twf,
  round(temp_diff - 8.6e0, 6) AS distance_to_hdf_temp, rpm - 1380 AS distance_to_hdf_rpm,
  round(power - 40000, 6) AS distance_to_pwf_lower, round(80000 - power, 6) AS distance_to_pwf_upper,
  round(CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 ELSE 13000 END - strain_index, 6) AS distance_to_osf,
  hdf_risk_flag + pwf_risk_flag + osf_risk_flag + twf_risk_flag AS risk_score FROM physics""")
def failure_proximity(spark, d):
    out = FE.failure_proximity(FE.threshold_flags(S.telemetry(spark, d)))
    return out.select("event_id", "distance_to_twf", "distance_to_hdf_rpm", "risk_score", *X.rounded(
        ["distance_to_hdf_temp", "distance_to_pwf_lower", "distance_to_pwf_upper", "distance_to_osf"]))


@query("general_flags", """SELECT event_id, high_wear_flag, high_torque_flag, low_rpm_flag, high_temp_flag,
  power_anomaly_flag FROM flagged""")
def general_flags(spark, d):
    return FE.general_flags(FE.physics_features(S.telemetry(spark, d))).select("event_id", *C.GENERAL_FLAGS)


@query("zscore_features", """SELECT event_id, round(rpm_zscore, 6) AS rpm_zscore, round(torque_zscore, 6) AS torque_zscore,
  round(power_zscore, 6) AS power_zscore, round(wear_zscore, 6) AS wear_zscore,
  round(temp_diff_zscore, 6) AS temp_diff_zscore FROM zscored""")
def zscore_features(spark, d):
    return FE.zscore_features(FE.physics_features(S.telemetry(spark, d))).select("event_id", *X.rounded(list(C.ZSCORES)))


@query("iqr_flags", """SELECT event_id,
  CASE WHEN power < a1 - 1.5e0 * (b1 - a1) OR power > b1 + 1.5e0 * (b1 - a1) THEN 1 ELSE 0 END AS power_outlier_flag,
  CASE WHEN torque_per_wear < a2 - 1.5e0 * (b2 - a2) OR torque_per_wear > b2 + 1.5e0 * (b2 - a2) THEN 1 ELSE 0 END
    AS torque_per_wear_outlier_flag
  FROM physics, (SELECT quantile_cont(power, 0.25) a1, quantile_cont(power, 0.75) b1,
    quantile_cont(torque_per_wear, 0.25) a2, quantile_cont(torque_per_wear, 0.75) b2 FROM physics)""")
def iqr_flags(spark, d):
    out = FE.iqr_flags(FE.physics_features(S.telemetry(spark, d)), ["power", "torque_per_wear"])
    return out.select("event_id", "power_outlier_flag", "torque_per_wear_outlier_flag")


@query("fusion_features", """SELECT event_id, round(thermal_strain, 6) AS thermal_strain,
  round(total_stress_index, 6) AS total_stress_index, round(thermal_gradient_ratio, 6) AS thermal_gradient_ratio,
  round(vibration_torque_impact, 6) AS vibration_torque_impact,
  round(electrical_thermal_stress, 6) AS electrical_thermal_stress FROM fused""")
def fusion_features(spark, d):
    return fused(spark, d).select("event_id", *X.rounded(C.COMPOSITES))


@query("rounded_features", """SELECT event_id, round_even(wear_rate, 4) AS wear_rate,
  round_even(torque_per_wear, 4) AS torque_per_wear, round_even(power_per_temp, 4) AS power_per_temp FROM physics""")
def rounded_features(spark, d):
    out = FE.physics_features(S.telemetry(spark, d)).select("event_id", "wear_rate", "torque_per_wear", "power_per_temp")
    return K.round_numeric(out)


@query("feature_matrix", """SELECT event_id, machine_failure, air_temp, hdf_risk_flag, osf_risk_flag, round(power, 6) AS power,
  round(power_per_temp, 6) AS power_per_temp, process_temp, pwf_risk_flag, rpm,
  round(strain_index, 6) AS strain_index, round(temp_diff, 6) AS temp_diff, tool_wear, torque,
  round(torque_per_wear, 9) AS torque_per_wear, twf_risk_flag, type_code, round(wear_rate, 6) AS wear_rate FROM scored""")
def feature_matrix(spark, d):
    out = FE.physics_features(K.encode_type(S.scored(spark, d)))
    matrix = K.feature_matrix(out, ["event_id", C.TARGET])
    soft = ["power", "power_per_temp", "strain_index", "temp_diff", "wear_rate"]
    return matrix.withColumns({**{c: F.round(c, 6) for c in soft}, "torque_per_wear": F.round("torque_per_wear", 9)})


def _texts(spark, d):
    """Sensor columns as text with unreadable and missing entries, as a CSV feed may deliver them."""
    return S.telemetry(spark, d).select(
        "event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("torque").cast("string")).alias("torque"),
        F.when(F.col("event_type") != "signup", F.col("rpm").cast("string")).alias("rpm"), F.col("event_type"))


@query("coerce_numeric", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE torque END AS torque,
  CASE WHEN event_type <> 'signup' THEN rpm ELSE 0 END AS rpm, 0.0e0 AS event_type FROM telemetry""")
def coerce_numeric(spark, d):
    return K.coerce_numeric(_texts(spark, d), ["torque", "rpm", "event_type"])


GATE = """SELECT count(*) AS n_rows, 13 AS n_features,
  CAST(sum(CASE WHEN ambient_temp IS NULL THEN 5 ELSE 0 END) AS BIGINT) AS n_nulls, 1 AS n_non_numeric,
  CAST(sum(machine_failure) AS BIGINT) AS n_failures, 0 AS passed
  FROM telemetry t LEFT JOIN environment e ON date_trunc('hour', t.ts) = e.env_ts"""


def _gated(spark, d):
    joined = FU.fuse_environment(S.telemetry(spark, d), S.environment(spark, d))
    return joined.select("event_id", "machine_id", "type", *C.SENSORS, "ambient_temp", "ambient_humidity",
                         "atmospheric_pressure", "factory_load_density", "operator_skill_proxy", C.TARGET)


@query("quality_gate", GATE)
def quality_gate(spark, d):
    return K.quality_gate(_gated(spark, d))


@query("quality_gate_written", GATE)
def quality_gate_written(spark, d):
    """The same, observed while the matrix is written as a stage."""
    found = K.write_gated(_gated(spark, d), scratch(spark, "matrix"))
    return spark.createDataFrame([found], "n_rows long, n_features int, n_nulls long, n_non_numeric int, "
                                 "n_failures long, passed int")


@query("drop_constant", "SELECT event_id, torque, tool_wear FROM telemetry")
def drop_constant(spark, d):
    rows = S.telemetry(spark, d).select("event_id", "torque", "tool_wear",
                                        X.flag(X.temp_diff() > 15).alias("high_temp_flag"))
    return K.drop_constant(rows)


@query("time_context", """SELECT event_id, round(298.15e0 + 6.0e0 * cos(2 * pi() * (hour(ts) - 14) / 24), 6) AS ambient_temp,
  round(60.0e0 - 12.0e0 * cos(2 * pi() * (hour(ts) - 14) / 24), 6) AS ambient_humidity,
  round(1013.25e0 + 3.0e0 * sin(2 * pi() * dayofmonth(ts) / 5), 6) AS atmospheric_pressure,
  CASE WHEN hour(ts) >= 8 AND hour(ts) < 16 THEN 1 WHEN hour(ts) >= 16 THEN 2 ELSE 3 END AS operator_skill_proxy
  FROM events""")
def time_context(spark, d):
    out = FU.time_context(S.events(spark, d).select("event_id", "ts"))
    return out.select("event_id", "operator_skill_proxy",
                      *X.rounded(["ambient_temp", "ambient_humidity", "atmospheric_pressure"]))


@query("synthetic_context", """SELECT event_id, round(ambient_temp, 6) AS ambient_temp,
  round(ambient_humidity, 6) AS ambient_humidity, round(atmospheric_pressure, 6) AS atmospheric_pressure,
  round(grid_voltage_fluctuation, 6) AS grid_voltage_fluctuation, round(factory_load_density, 6) AS factory_load_density,
  operator_skill_proxy, round(particulate_matter_pm10, 6) AS particulate_matter_pm10,
  round(ambient_vibration_noise, 6) AS ambient_vibration_noise FROM context""")
def synthetic_context(spark, d):
    out = FU.synthetic_context(S.events(spark, d).select("event_id", "ts"))
    return out.select("event_id", "operator_skill_proxy",
                      *X.rounded([c for c in C.ENV_FIELDS if c != "operator_skill_proxy"]))


@query("fuse_environment", """SELECT t.event_id, e.ambient_temp, e.ambient_humidity, e.atmospheric_pressure,
  e.factory_load_density, e.operator_skill_proxy FROM telemetry t LEFT JOIN environment e ON date_trunc('hour', t.ts) = e.env_ts""")
def fuse_environment(spark, d):
    return FU.fuse_environment(S.telemetry(spark, d), S.environment(spark, d)).select(
        "event_id", "ambient_temp", "ambient_humidity", "atmospheric_pressure", "factory_load_density",
        "operator_skill_proxy")


@query("asof_environment", """SELECT t.event_id, epoch(e.env_ts)::BIGINT AS matched_epoch, e.ambient_temp, e.operator_skill_proxy
  FROM telemetry t ASOF LEFT JOIN environment e ON t.ts >= e.env_ts""")
def asof_environment(spark, d):
    out = FU.asof_environment(S.telemetry(spark, d), S.environment(spark, d))
    return out.select("event_id", F.col("matched_env_ts").cast("timestamp").cast("bigint").alias("matched_epoch"),
                      "ambient_temp", "operator_skill_proxy")


@query("asof_environment_tolerance", """SELECT t.event_id,
  CASE WHEN t.ts <= e.env_ts + INTERVAL 70 MINUTE THEN epoch(e.env_ts)::BIGINT END AS matched_epoch
  FROM telemetry t ASOF LEFT JOIN environment e ON t.ts >= e.env_ts""")
def asof_environment_tolerance(spark, d):
    out = FU.asof_environment(S.telemetry(spark, d), S.environment(spark, d), tolerance="70 minutes")
    return out.select("event_id", F.col("matched_env_ts").cast("timestamp").cast("bigint").alias("matched_epoch"))
