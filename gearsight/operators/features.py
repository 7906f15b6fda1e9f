"""Row-level features: physics, interactions, flags, polynomials, distances, fusion, z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.stats import moments, quantiles, with_stats


def physics_features(df: DataFrame, ruleset: str = "research") -> DataFrame:
    """power, temp_diff, wear_rate, torque_per_wear, strain_index, power_per_temp."""
    power, diff = X.power(), X.temp_diff()
    per_temp = (X.ratio(power, F.col("process_temp")) if ruleset == "research"
                else power / F.when(diff != 0, diff).otherwise(0.1))
    return df.withColumns({
        "power": power,
        "temp_diff": diff,
        "wear_rate": F.col("tool_wear") / (F.col("rpm") + 1),
        "torque_per_wear": F.col("torque") / (F.col("tool_wear") + 1),
        "strain_index": X.strain(),
        "power_per_temp": per_temp,
    })


def interaction_features(df: DataFrame) -> DataFrame:
    power, diff, wear = X.power(), X.temp_diff(), F.col("tool_wear")
    return df.withColumns({
        "thermal_torque_stress": F.col("torque") * F.col("process_temp"),
        "rotational_load_on_worn_tool": F.col("rpm") * F.col("torque") * wear,
        "power_absorbed_by_wear": power * wear,
        "thermal_stress_on_worn_tool": diff * wear,
        "speed_heat_imbalance": F.col("rpm") * diff,
    })


def type_indicators(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_low_quality": X.flag(F.col("type") == "L"),
                           "is_high_quality": X.flag(F.col("type") == "H")})


def threshold_flags(df: DataFrame, ruleset: str = "research") -> DataFrame:
    return df.withColumns(X.risk_flags(ruleset))


def with_risk_score(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_score", sum((F.col(f) for f in C.RISK_FLAGS), F.lit(0)))


def fill_context(df: DataFrame) -> DataFrame:
    """Context columns, with the default where the column or its value is missing."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
                           for c, d in C.ENV_DEFAULTS.items()})


def instant_features(df: DataFrame, ruleset: str = "causal") -> DataFrame:
    """Everything the causal track derives from a single reading."""
    coded = df.withColumn("type_code", X.type_code(unknown=1))
    out = physics_features(coded, "causal").drop("wear_rate").withColumns(X.risk_flags(ruleset, F.col("type_code")))
    return fill_context(with_risk_score(out))


def polynomial_features(df: DataFrame) -> DataFrame:
    """Squares, roots and logs of the physics columns (which must be present)."""
    squares = {"torque": "torque_squared", "tool_wear": "wear_squared", "power": "power_squared",
               "temp_diff": "temp_diff_squared"}
    return df.withColumns({
        **{name: F.col(c) * F.col(c) for c, name in squares.items()},
        "sqrt_power": F.sqrt("power"),
        "sqrt_wear": F.sqrt("tool_wear"),
        "log_power": F.log1p("power"),
        "log_strain": F.log1p("strain_index"),
    })


def failure_proximity(df: DataFrame) -> DataFrame:
    """Distance of each reading to the failure thresholds; risk_score where the flags are present."""
    power = X.power()
    out = df.withColumns({
        "distance_to_twf": 200 - F.col("tool_wear"),
        "distance_to_hdf_temp": X.temp_diff() - 8.6,
        "distance_to_hdf_rpm": F.col("rpm") - 1380,
        "distance_to_pwf_lower": power - 40000,
        "distance_to_pwf_upper": 80000 - power,
        "distance_to_osf": X.osf_limit(X.type_code()) - X.strain(),
    })
    return with_risk_score(out) if set(C.RISK_FLAGS) <= set(df.columns) else out


def general_flags(df: DataFrame) -> DataFrame:
    """Fixed-limit flags plus power outside mean +- 2 sd of the whole table (needs physics columns)."""
    out = with_stats(df, {"m": F.avg("power"), "s": F.stddev_samp("power")})
    far = 2 * F.col("_stats.s")
    return out.withColumns({
        "high_wear_flag": X.flag(F.col("tool_wear") > 200),
        "high_torque_flag": X.flag(F.col("torque") > 60),
        "low_rpm_flag": X.flag(F.col("rpm") < 1400),
        "high_temp_flag": X.flag(F.col("temp_diff") > 15),
        "power_anomaly_flag": X.flag((F.col("power") < F.col("_stats.m") - far)
                                     | (F.col("power") > F.col("_stats.m") + far)),
    }).drop("_stats")


def zscore_features(df: DataFrame) -> DataFrame:
    """Whole-table z-scores (sample sd); null for a constant column."""
    out = with_stats(df, moments(list(C.ZSCORES.values())))
    return out.withColumns({
        z: X.ratio(F.col(c) - F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_sd"))
        for z, c in C.ZSCORES.items()}).drop("_stats")


def iqr_flags(df: DataFrame, cols: list[str] = ("rpm", "torque")) -> DataFrame:
    """1 where a value lies more than 1.5 interquartile ranges outside the quartiles; 0 in a column without values."""
    found = quantiles(df, list(cols), [0.25, 0.75])
    flags = {}
    for c in cols:
        q1, q3 = found[(c,)][0.25], found[(c,)][0.75]
        if q1 is None:
            flags[f"{c}_outlier_flag"] = X.flag(F.lit(False))
            continue
        flags[f"{c}_outlier_flag"] = X.flag((F.col(c) < F.lit(q1 - 1.5 * (q3 - q1)))
                                            | (F.col(c) > F.lit(q3 + 1.5 * (q3 - q1))))
    return df.withColumns(flags)


def fusion_features(df: DataFrame) -> DataFrame:
    """Cross-domain features of sensors and context."""
    return df.withColumns({
        "thermal_strain": F.col("process_temp") - F.col("ambient_temp"),
        "total_stress_index": F.col("torque") * F.col("factory_load_density"),
        "thermal_gradient_ratio": X.ratio(F.col("air_temp"), F.col("ambient_temp")),
        "vibration_torque_impact": F.col("torque") * F.col("ambient_vibration_noise"),
        "electrical_thermal_stress": F.abs("grid_voltage_fluctuation") * F.col("process_temp"),
    })


def static_features(df: DataFrame) -> DataFrame:
    """All static research features, in dependency order."""
    out = threshold_flags(physics_features(df))
    out = type_indicators(interaction_features(iqr_flags(out)))
    return failure_proximity(polynomial_features(general_flags(zscore_features(out))))
