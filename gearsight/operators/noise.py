"""Sensor-noise stress tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.evaluate import binary_metrics, pr_curve
from gearsight.operators.stats import with_stats


def inject_noise(df: DataFrame, cols: list[str], level: float, seed: int = 42, row_id: str = "event_id") -> DataFrame:
    """Add Gaussian noise of ``level`` x column sd. Draws are keyed by row id and column."""
    _require(df, cols)
    if level == 0:
        return df
    out = with_stats(df, {c: F.stddev_samp(c) for c in cols})
    return out.withColumns({
        c: F.col(c) + F.lit(level) * F.col(f"_stats.{c}") * X.normal(row_id, f"noise-{c}", seed) for c in cols
    }).drop("_stats")


def noisy_scores(df: DataFrame, cols: list[str], score: Callable[[DataFrame], DataFrame],
                 tiers: list[tuple[str, float]], seed: int) -> DataFrame:
    """(tier, noise_level, label, score) of all tiers from one scan: the draws of a row are made once and
    scaled per tier. Only these columns survive to the shuffle."""
    _require(df, cols)
    drawn = with_stats(df, {c: F.stddev_samp(c) for c in cols}).withColumns(
        {f"_z_{c}": X.normal("event_id", f"noise-{c}", seed) for c in cols})
    levels = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(float(v)).alias("level")) for n, v in tiers])
    level = F.col("_tier.level")
    noisy = drawn.withColumn("_tier", F.explode(levels)).withColumns({
        c: F.when(level == 0, F.col(c)).otherwise(F.col(c) + level * F.col(f"_stats.{c}") * F.col(f"_z_{c}")) for c in cols})
    return score(noisy.drop("_stats", *[f"_z_{c}" for c in cols])).select(
        F.col("_tier.tier").alias("tier"), F.col("_tier.level").alias("noise_level"), C.TARGET, "score")


def _require(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def robustness_report(df: DataFrame, cols: list[str], score: Callable[[DataFrame], DataFrame], threshold: float,
                      tiers: list[tuple[str, float]] = C.NOISE_TIERS, seed: int = 42) -> DataFrame:
    """Metrics per noise tier with a frozen scorer and threshold; all tiers in one aggregation."""
    rows = noisy_scores(df, cols, score, tiers, seed)
    return binary_metrics(rows, threshold, by=["tier", "noise_level"]).select(
        "tier", "noise_level", "accuracy", "precision", "recall", "f1")


def noise_pr_curves(df: DataFrame, cols: list[str], score: Callable[[DataFrame], DataFrame],
                    tiers: list[tuple[str, float]] = C.NOISE_TIERS, seed: int = 42) -> DataFrame:
    return pr_curve(noisy_scores(df, cols, score, tiers, seed), by=["tier"])
