"""Named queries over the driver tables and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Dependency order of the shared views.
VIEWS: dict[str, str] = {
    "telemetry": """
SELECT *, greatest(twf, hdf, pwf, osf, rnf) AS machine_failure FROM (
 SELECT *,
  CASE WHEN tool_wear >= 200 AND event_id % 8 = 0 THEN 1 ELSE 0 END AS twf,
  CASE WHEN process_temp - air_temp < 8.55e0 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf,
  CASE WHEN torque * rpm < 33000 OR torque * rpm > 106500 THEN 1 ELSE 0 END AS pwf,
  CASE WHEN torque * tool_wear > CASE type WHEN 'L' THEN 11800 WHEN 'M' THEN 12000 ELSE 13000 END THEN 1 ELSE 0 END AS osf,
  CASE WHEN event_id % 500 = 7 THEN 1 ELSE 0 END AS rnf
 FROM (SELECT event_id, user_id AS machine_id, ts, event_type, value,
  CASE WHEN user_id % 10 < 6 THEN 'L' WHEN user_id % 10 < 9 THEN 'M' ELSE 'H' END AS type,
  295.0e0 + (event_id * 7919 % 100) / 10.0e0 AS air_temp,
  303.0e0 + (event_id * 7919 % 100) / 10.0e0 + (event_id * 104729 % 50) / 10.0e0 AS process_temp,
  CAST(1250 + (event_id * 15485863 % 600) AS DOUBLE) AS rpm,
  25.0e0 + (event_id * 32452843 % 350) / 10.0e0 AS torque,
  CAST(CAST(floor(event_id / 8.0e0) AS BIGINT) % 220 AS DOUBLE) AS tool_wear
  FROM events))""",
    "environment": """
SELECT env_ts,
  round(298.15e0 + 6.0e0 * cos(2 * pi() * (hour(env_ts) - 14) / 24), 6) AS ambient_temp,
  round(60.0e0 - 12.0e0 * cos(2 * pi() * (hour(env_ts) - 14) / 24), 6) AS ambient_humidity,
  round(1013.25e0 + 3.0e0 * sin(2 * pi() * dayofmonth(env_ts) / 5), 6) AS atmospheric_pressure,
  CASE WHEN hour(env_ts) BETWEEN 8 AND 20 THEN 0.85e0 ELSE 0.42e0 END AS factory_load_density,
  CASE WHEN hour(env_ts) >= 8 AND hour(env_ts) < 16 THEN 1 WHEN hour(env_ts) >= 16 THEN 2 ELSE 3 END AS operator_skill_proxy
FROM (SELECT DISTINCT date_trunc('hour', ts) AS env_ts FROM events) h
WHERE (dayofmonth(env_ts) * 24 + hour(env_ts)) % 5 <> 0""",
    # research physics and flags
    "physics": """
SELECT *, torque * rpm AS power, process_temp - air_temp AS temp_diff, tool_wear / (rpm + 1) AS wear_rate,
  torque / (tool_wear + 1) AS torque_per_wear, torque * tool_wear AS strain_index,
  torque * rpm / process_temp AS power_per_temp,
  CASE type WHEN 'L' THEN 0 WHEN 'M' THEN 1 WHEN 'H' THEN 2 END AS type_code,
  CASE WHEN process_temp - air_temp < 8.6e0 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf_risk_flag,
  CASE WHEN torque * rpm < 40000 OR torque * rpm > 80000 THEN 1 ELSE 0 END AS pwf_risk_flag,
  CASE WHEN torque * tool_wear > CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 ELSE 13000 END THEN 1 ELSE 0 END AS osf_risk_flag,
  CASE WHEN tool_wear >= 200 THEN 1 ELSE 0 END AS twf_risk_flag
FROM telemetry""",
    "scored": """
SELECT *, round(1.0e0 / (1.0e0 + exp(-(-3.0e0 + 2.5e0 * hdf_risk_flag + 1.0e0 * pwf_risk_flag
   + 1.5e0 * osf_risk_flag + 1.0e0 * twf_risk_flag + (torque - 42.5e0) / 20.0e0))), 6) AS score FROM physics""",
    "tiers": """
SELECT *, CASE WHEN score < 0.05e0 THEN 'Low' WHEN score < 0.2e0 THEN 'Medium' WHEN score < 0.5e0 THEN 'High'
  ELSE 'Critical' END AS risk_tier FROM scored""",
    "cycles": """
SELECT *, CAST(sum(drop_flag) OVER (PARTITION BY machine_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tool_cycle
FROM (SELECT *, CASE WHEN tool_wear - lag(tool_wear) OVER (PARTITION BY machine_id ORDER BY ts, event_id) < 0
    THEN 1 ELSE 0 END AS drop_flag FROM physics)""",
}


def uniform_sql(salt: str, row_id: str = "event_id", seed: int = 42) -> str:
    return (f"(CAST('0x' || substr(md5(concat_ws('|', CAST({row_id} AS VARCHAR), '{salt}', '{seed}')), 1, 8) AS BIGINT)"
            " / 4294967296e0)")


def normal_sql(salt: str, row_id: str = "event_id", seed: int = 42) -> str:
    a, b = uniform_sql(salt + "-a", row_id, seed), uniform_sql(salt + "-b", row_id, seed)
    return f"(sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b}))"


_LOAD = (f"CASE WHEN hour(ts) BETWEEN 8 AND 20 THEN 0.75e0 + 0.2e0 * {uniform_sql('load')}"
         f" ELSE 0.3e0 + 0.25e0 * {uniform_sql('load')} END")
VIEWS["context"] = f"""
SELECT *, 35.0e0 + factory_load_density * 25.0e0 - 5.0e0 * ln(1 - {uniform_sql('dust')}) AS particulate_matter_pm10,
  45.0e0 + factory_load_density * 15.0e0 + 1.2e0 * {normal_sql('vibration')} AS ambient_vibration_noise
FROM (SELECT *,
  298.15e0 + 6.0e0 * cos(2 * pi() * (hour(ts) - 14) / 24) + 0.4e0 * {normal_sql('temp')} AS ambient_temp,
  60.0e0 - 12.0e0 * cos(2 * pi() * (hour(ts) - 14) / 24) + 1.0e0 * {normal_sql('humidity')} AS ambient_humidity,
  1013.25e0 + 3.0e0 * sin(2 * pi() * dayofmonth(ts) / 5) + 0.5e0 * {normal_sql('pressure')} AS atmospheric_pressure,
  1.5e0 * {normal_sql('grid')} + CASE WHEN {uniform_sql('dip')} > 0.98e0 THEN -5.0e0 + 3.0e0 * {uniform_sql('depth')}
    ELSE 0 END AS grid_voltage_fluctuation,
  {_LOAD} AS factory_load_density,
  CASE WHEN hour(ts) >= 8 AND hour(ts) < 16 THEN 1 WHEN hour(ts) >= 16 THEN 2 ELSE 3 END AS operator_skill_proxy
  FROM scored)"""
VIEWS["fused"] = """
SELECT *, process_temp - ambient_temp AS thermal_strain, torque * factory_load_density AS total_stress_index,
  air_temp / ambient_temp AS thermal_gradient_ratio, torque * ambient_vibration_noise AS vibration_torque_impact,
  abs(grid_voltage_fluctuation) * process_temp AS electrical_thermal_stress FROM context"""
VIEWS["zscored"] = """
SELECT p.*, (rpm - m1) / s1 AS rpm_zscore, (torque - m2) / s2 AS torque_zscore, (power - m3) / s3 AS power_zscore,
  (tool_wear - m4) / s4 AS wear_zscore, (temp_diff - m5) / s5 AS temp_diff_zscore
FROM physics p, (SELECT avg(rpm) m1, stddev_samp(rpm) s1, avg(torque) m2, stddev_samp(torque) s2, avg(power) m3,
  stddev_samp(power) s3, avg(tool_wear) m4, stddev_samp(tool_wear) s4, avg(temp_diff) m5, stddev_samp(temp_diff) s5
  FROM physics)"""
VIEWS["flagged"] = """
SELECT p.*, CASE WHEN tool_wear > 200 THEN 1 ELSE 0 END AS high_wear_flag,
  CASE WHEN torque > 60 THEN 1 ELSE 0 END AS high_torque_flag, CASE WHEN rpm < 1400 THEN 1 ELSE 0 END AS low_rpm_flag,
  CASE WHEN temp_diff > 15 THEN 1 ELSE 0 END AS high_temp_flag,
  CASE WHEN power < m - 2 * s OR power > m + 2 * s THEN 1 ELSE 0 END AS power_anomaly_flag
FROM physics p, (SELECT avg(power) m, stddev_samp(power) s FROM physics)"""
# causal instant features on hourly environment, missing context filled
VIEWS["instant"] = """
SELECT t.event_id, t.machine_id, t.ts, t.machine_failure, air_temp, process_temp, rpm, torque, tool_wear,
  CASE type WHEN 'L' THEN 0 WHEN 'H' THEN 2 ELSE 1 END AS type_code, torque * rpm AS power,
  process_temp - air_temp AS temp_diff, torque / (tool_wear + 1) AS torque_per_wear, torque * tool_wear AS strain_index,
  torque * rpm / CASE WHEN process_temp - air_temp <> 0 THEN process_temp - air_temp ELSE 0.1e0 END AS power_per_temp,
  CASE WHEN tool_wear BETWEEN 200 AND 240 THEN 1 ELSE 0 END AS twf_risk_flag,
  CASE WHEN process_temp - air_temp < 8.6e0 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf_risk_flag,
  CASE WHEN torque * rpm < 3500 OR torque * rpm > 9000 THEN 1 ELSE 0 END AS pwf_risk_flag,
  CASE WHEN torque * tool_wear > CASE type WHEN 'L' THEN 11000 WHEN 'H' THEN 13000 ELSE 12000 END THEN 1 ELSE 0 END AS osf_risk_flag,
  coalesce(ambient_temp, 293.0e0) AS ambient_temp, coalesce(ambient_humidity, 55.0e0) AS ambient_humidity,
  coalesce(atmospheric_pressure, 1013.0e0) AS atmospheric_pressure, 0.0e0 AS grid_voltage_fluctuation,
  coalesce(factory_load_density, 0.5e0) AS factory_load_density, coalesce(operator_skill_proxy, 3) AS operator_skill_proxy,
  40.0e0 AS particulate_matter_pm10, 1.0e0 AS ambient_vibration_noise
FROM telemetry t LEFT JOIN environment e ON date_trunc('hour', t.ts) = e.env_ts"""

_NEEDS = {
    "telemetry": [], "environment": [], "physics": ["telemetry"], "scored": ["physics"], "tiers": ["scored"],
    "cycles": ["physics"], "context": ["scored"], "fused": ["context"], "zscored": ["physics"], "flagged": ["physics"],
    "instant": ["telemetry", "environment"],
}


def with_views(body: str) -> str:
    """Put the views the text mentions (and what they need) in front of it."""
    used: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", body):
            add(name)
    text = body.strip()
    if not used:
        return text
    head = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def load_all() -> None:
    from gearsight.plans import (feature_queries, fleet_queries, model_queries, profile_queries,  # noqa: F401
                                 serving_queries, stream_queries, window_queries)
