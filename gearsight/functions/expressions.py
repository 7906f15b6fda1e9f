"""Column expressions: one definition of each formula, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gearsight.functions import constants as C


def flag(condition: Column) -> Column:
    """1 where the condition holds, otherwise 0 (null counts as 0)."""
    return F.when(condition, 1).otherwise(0)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small fixed table as a CASE expression; no join needed."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def type_code(type_col: str = "type", unknown: int | None = None) -> Column:
    return lookup(F.col(type_col), C.TYPE_CODES, unknown).cast("int")


def osf_limit(code: Column, unknown: int | None = None) -> Column:
    return lookup(code, C.OSF_LIMIT, unknown)


def power() -> Column:
    return F.col("torque") * F.col("rpm")


def temp_diff() -> Column:
    return F.col("process_temp") - F.col("air_temp")


def strain() -> Column:
    return F.col("torque") * F.col("tool_wear")


def risk_flags(ruleset: str = "research", code: Column | None = None) -> dict[str, Column]:
    """The four threshold flags. ``causal_watts`` converts power to watts before the causal band test."""
    if ruleset not in ("research", "causal", "causal_watts"):
        raise ValueError(f"unknown ruleset {ruleset!r}")
    research = ruleset == "research"
    if code is None:
        code = type_code(unknown=None if research else 1)
    p = power()
    if ruleset == "causal_watts":
        p = p * 2 * F.pi() / 60
    lo, hi = (40000, 80000) if research else (3500, 9000)
    worn = F.col("tool_wear") >= 200
    if not research:
        worn = worn & (F.col("tool_wear") <= 240)
    limit = osf_limit(code, None if research else C.OSF_LIMIT_UNKNOWN)
    return {
        "twf_risk_flag": flag(worn),
        "hdf_risk_flag": flag((temp_diff() < 8.6) & (F.col("rpm") < 1380)),
        "pwf_risk_flag": flag((p < lo) | (p > hi)),
        "osf_risk_flag": flag(strain() > limit),
    }


def risk_tier(score: Column) -> Column:
    out = None
    for cutoff, name in C.RISK_TIERS:
        out = F.when(score < cutoff, name) if out is None else out.when(score < cutoff, name)
    return F.when(score.isNotNull(), out.otherwise(C.TOP_TIER))


def trend_label(delta: Column) -> Column:
    return F.when(delta > 0.001, "up").when(delta < -0.001, "down").otherwise("flat")


def uniform(id_col: str, salt: str, seed: int = 42) -> Column:
    """Uniform in [0, 1) keyed by row id: the same value under any partitioning or retry."""
    return F.expr(_uniform(id_col, salt, seed))


def _uniform(id_col: str, salt: str, seed: int) -> str:
    return (f"cast(conv(substr(md5(concat_ws('|', cast({id_col} as string), '{salt}', '{seed}')), 1, 8), 16, 10)"
            " as bigint) / 4294967296e0")


def normal(id_col: str, salt: str, seed: int = 42) -> Column:
    """Standard normal keyed by row id (Box-Muller over two uniforms)."""
    u1, u2 = _uniform(id_col, salt + "-a", seed), _uniform(id_col, salt + "-b", seed)
    return F.expr(f"sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * ({u2}))")


def rounded(cols: list[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 (ANSI division would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))
