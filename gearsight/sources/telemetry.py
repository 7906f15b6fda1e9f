"""Telemetry, environment and rule-score views derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.functions import expressions as X


def use_utc(spark: SparkSession) -> None:
    """Hour and day functions must not depend on where the driver runs."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def from_events(events: DataFrame) -> DataFrame:
    """Map an event feed to readings: five sensors, the machine grade and the failure labels."""
    eid = F.col("event_id")
    grade = F.col("user_id") % 10
    base = events.select(
        "event_id",
        F.col("user_id").alias("machine_id"),
        "ts",
        "event_type",
        "value",
        F.when(grade < 6, "L").when(grade < 9, "M").otherwise("H").alias("type"),
        (F.lit(295.0) + (eid * 7919 % 100) / 10.0).alias("air_temp"),
        (F.lit(303.0) + (eid * 7919 % 100) / 10.0 + (eid * 104729 % 50) / 10.0).alias("process_temp"),
        (F.lit(1250) + (eid * 15485863 % 600)).cast("double").alias("rpm"),
        (F.lit(25.0) + (eid * 32452843 % 350) / 10.0).alias("torque"),
        (F.floor(eid / 8.0).cast("bigint") % 220).cast("double").alias("tool_wear"),
    )
    power, strain = X.power(), X.strain()
    osf_label = F.when(F.col("type") == "L", 11800).when(F.col("type") == "M", 12000).otherwise(13000)
    labelled = base.select(
        "*",
        X.flag((F.col("tool_wear") >= 200) & (eid % 8 == 0)).alias("twf"),
        X.flag((X.temp_diff() < 8.55) & (F.col("rpm") < 1380)).alias("hdf"),
        X.flag((power < 33000) | (power > 106500)).alias("pwf"),
        X.flag(strain > osf_label).alias("osf"),
        X.flag(eid % 500 == 7).alias("rnf"),
    )
    return labelled.withColumn("machine_failure", F.greatest("twf", "hdf", "pwf", "osf", "rnf"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(events(spark, sf_dir))


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly site context; every fifth hour is missing so that joins meet gaps."""
    hours = events(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("env_ts")).distinct()
    h, day = F.hour("env_ts"), F.dayofmonth("env_ts")
    angle = 2 * F.pi() * (h - 14) / 24
    return hours.filter((day * 24 + h) % 5 != 0).select(
        "env_ts",
        F.round(F.lit(298.15) + F.lit(6.0) * F.cos(angle), 6).alias("ambient_temp"),
        F.round(F.lit(60.0) - F.lit(12.0) * F.cos(angle), 6).alias("ambient_humidity"),
        F.round(F.lit(1013.25) + F.lit(3.0) * F.sin(2 * F.pi() * day / 5), 6).alias("atmospheric_pressure"),
        F.when(h.between(8, 20), 0.85).otherwise(0.42).alias("factory_load_density"),
        F.when((h >= 8) & (h < 16), 1).when(h >= 16, 2).otherwise(3).alias("operator_skill_proxy"),
    )


def rule_score(readings: DataFrame) -> DataFrame:
    """Attach the research flags and a logistic score of them; stands in for a learned probability."""
    flagged = readings.withColumns(X.risk_flags("research"))
    margin = (F.lit(-3.0) + 2.5 * F.col("hdf_risk_flag") + 1.0 * F.col("pwf_risk_flag")
              + 1.5 * F.col("osf_risk_flag") + 1.0 * F.col("twf_risk_flag") + (F.col("torque") - 42.5) / 20.0)
    return flagged.withColumn("score", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 6))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_score(telemetry(spark, sf_dir))
