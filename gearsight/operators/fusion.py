"""Environment context: derived from time, synthesised, and joined by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearsight.functions import expressions as X
from gearsight.operators.ordering import Series


def time_context(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Diurnal temperature and humidity, pressure wave and shift number of the row's time."""
    h, day = F.hour(ts), F.dayofmonth(ts)
    angle = 2 * F.pi() * (h - 14) / 24
    return df.withColumns({
        "ambient_temp": F.lit(298.15) + F.lit(6.0) * F.cos(angle),
        "ambient_humidity": F.lit(60.0) - F.lit(12.0) * F.cos(angle),
        "atmospheric_pressure": F.lit(1013.25) + F.lit(3.0) * F.sin(2 * F.pi() * day / 5),
        "operator_skill_proxy": F.when((h >= 8) & (h < 16), 1).when(h >= 16, 2).otherwise(3),
    })


def synthetic_context(df: DataFrame, seed: int = 42, row_id: str = "event_id", ts: str = "ts") -> DataFrame:
    """Noisy context signals. Draws are keyed by row id, so they do not depend on partitioning."""
    u = lambda salt: X.uniform(row_id, salt, seed)
    z = lambda salt: X.normal(row_id, salt, seed)
    day_shift = F.hour(ts).between(8, 20)
    out = time_context(df, ts).withColumns({
        "ambient_temp": F.col("ambient_temp") + 0.4 * z("temp"),
        "ambient_humidity": F.col("ambient_humidity") + 1.0 * z("humidity"),
        "atmospheric_pressure": F.col("atmospheric_pressure") + 0.5 * z("pressure"),
        "grid_voltage_fluctuation": 1.5 * z("grid") + F.when(u("dip") > 0.98, -5.0 + 3.0 * u("depth")).otherwise(0.0),
        "factory_load_density": F.when(day_shift, 0.75 + 0.2 * u("load")).otherwise(0.3 + 0.25 * u("load")),
    })
    load = F.col("factory_load_density")
    return out.withColumns({
        "particulate_matter_pm10": 35.0 + load * 25.0 - 5.0 * F.log(1 - u("dust")),
        "ambient_vibration_noise": 45.0 + load * 15.0 + 1.2 * z("vibration"),
    })


def fuse_environment(df: DataFrame, env: DataFrame, ts: str = "ts", env_ts: str = "env_ts",
                     unit: str = "hour") -> DataFrame:
    """Left equi-join on the time bucket; the newest environment row of a bucket counts, so readings never
    multiply. The optimizer broadcasts ``env`` only when it is measurably small."""
    fields = [c for c in env.columns if c != env_ts]
    newest = F.max_by(F.struct(*fields), F.struct(env_ts, *fields)).alias("_e")
    keyed = env.groupBy(F.date_trunc(unit, env_ts).alias("_bucket")).agg(newest).select("_bucket", "_e.*")
    return (df.withColumn("_bucket", F.date_trunc(unit, ts))
            .join(keyed, "_bucket", "left").drop("_bucket"))


def asof_environment(df: DataFrame, env: DataFrame, tolerance: str | None = None, ts: str = "ts",
                     env_ts: str = "env_ts") -> DataFrame:
    """Latest environment row at or before each reading, no older than ``tolerance``.

    Readings and environment rows become one time-ordered stream in which every reading takes the last environment row
    before it. The stream is cut into even blocks and a block starts with what the ones before it end with, so each row
    is moved once and none meets a candidate. Readings of one time are parted by a hash of the row. Of environment rows
    with one time the largest counts; a reading without a time, or with nothing before it, gets nulls.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fields = [c for c in env.columns if c != env_ts]
    one = env.filter(F.col(env_ts).isNotNull()).groupBy(env_ts).agg(F.max(F.struct(*fields)).alias("_f"))
    context = one.select(micros(env_ts).alias("_at"), F.lit(0).alias("_reading"), F.lit(0).cast("bigint").alias("_tie"),
                         F.struct(micros(env_ts).alias("at"), F.col(env_ts).alias("ts"), F.col("_f").alias("f")).alias("_env"))
    hashed = [c.name for c in df.schema if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    rows = df.select(micros(ts).alias("_at"), F.lit(1).alias("_reading"), F.xxhash64(*hashed).alias("_tie"),
                     F.struct(*df.columns).alias("_row"))
    stream = rows.unionByName(context, allowMissingColumns=True)
    filled = Series(stream, [], ["_at", "_reading", "_tie"]).forwardfill(stream, ["_env"])
    last = F.col("_env")
    if tolerance is not None:
        span = F.expr(f"unix_micros(timestamp_seconds(0) + interval {tolerance})")
        last = F.when(F.col("_at") - F.col("_env.at") <= span, last)
    met = filled.filter(F.col("_reading") == 1).withColumn("_env", last)
    return met.select("_row.*", F.col("_env.ts").alias("matched_env_ts"), "_env.f.*")
