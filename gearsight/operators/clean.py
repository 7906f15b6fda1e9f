"""Cleaning, encoding and feature-matrix preparation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.sources.schema import CSV_NAMES


def drop_ids(df: DataFrame) -> DataFrame:
    return df.drop(*C.ID_COLUMNS)


def encode_type(df: DataFrame, unknown: int | None = None) -> DataFrame:
    """Ordinal grade L/M/H -> 0/1/2; other grades become ``unknown``."""
    return df.withColumn("type_code", X.type_code(unknown=unknown))


def decode_type(df: DataFrame) -> DataFrame:
    return df.withColumn("type_label", X.lookup(F.col("type_code"), C.TYPE_LABELS))


def clean(df: DataFrame, unknown: int | None = None) -> DataFrame:
    """Identifier columns removed, grade as an ordinal."""
    return encode_type(drop_ids(df), unknown).drop("type")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def round_numeric(df: DataFrame, digits: int = 4) -> DataFrame:
    """Half-even rounding of every fractional column: scale, nearest even, unscale (whole numbers are left alone)."""
    scale = float(10 ** digits)
    return df.withColumns({f.name: F.rint(F.col(f.name) * scale) / scale for f in df.schema.fields
                           if isinstance(f.dataType, T.FractionalType)})


def leakage_firewall(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Drop target, failure modes, identifiers and timestamps, whatever their letter case."""
    banned = {C.TARGET, "machine failure", "udi", "product_id", "product id", "timestamp", "timestamp.1", "ts",
              "index", "event_id", "machine_id", *C.MODES, *[e.lower() for e in extra or []]}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in banned])


def tidy_name(header: str) -> str:
    return re.sub(r"_{2,}", "_", re.sub(r"[^a-zA-Z0-9_]", "_", header)).strip("_")


def normalize_names(df: DataFrame) -> DataFrame:
    """Header names reduced to letters, digits and single underscores."""
    return df.toDF(*map(tidy_name, df.columns))


def align_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Model feature names onto table columns; a CSV header stands for its tidy name. Raises on a miss."""
    present = set(df.columns)
    headers = {tidy_name(h): h for h in CSV_NAMES if h in present}
    missing = [n for n in names if n not in present and n not in headers]
    if missing:
        raise KeyError(f"features without a matching column: {missing}")
    return df.select(*(F.col(f"`{n if n in present else headers[n]}`").alias(n) for n in names))


def numeric_or_zero(col: Column) -> Column:
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text or missing values become 0."""
    return df.withColumns({c: numeric_or_zero(F.col(c)) for c in cols})


def _gate_sums(df: DataFrame, target: str) -> tuple[list[Column], int, int]:
    """Sums over the rows, the number of features, and how many of them are not numeric."""
    if target not in df.columns:
        raise KeyError(f"target column {target!r} not found")
    features = [f for f in df.schema.fields if f.name != target]
    text = sum(not isinstance(f.dataType, T.NumericType) for f in features)
    nulls = sum((F.count_if(F.col(f"`{f.name}`").isNull()) for f in features), F.lit(0))
    return [F.count(F.lit(1)).alias("n_rows"), nulls.cast("bigint").alias("n_nulls"),
            F.sum(F.col(target).cast("bigint")).alias("n_failures")], len(features), text


def quality_gate(df: DataFrame, target: str = C.TARGET) -> DataFrame:
    """One row: rows, features, nulls, non-numeric columns, and whether the matrix may be trained on."""
    sums, features, text = _gate_sums(df, target)
    return df.agg(*sums).select(
        "n_rows", F.lit(features).alias("n_features"), "n_nulls",
        F.lit(text).alias("n_non_numeric"), "n_failures",
        ((F.col("n_nulls") == 0) & F.lit(text == 0)).cast("int").alias("passed"))


def write_gated(df: DataFrame, path: str, target: str = C.TARGET) -> dict[str, int | None]:
    """Write the matrix as Parquet and return the row of ``quality_gate``, observed in the writing tasks themselves.

    There is no second scan, and a batch of a stream (``foreachBatch``) can be written so. Nothing is shuffled between the
    observation and the files, so a task that is run again is counted once. The caller decides what becomes of a table
    that fails.
    """
    sums, features, text = _gate_sums(df, target)
    seen = Observation()
    df.observe(seen, *sums).write.mode("overwrite").parquet(path)
    found = seen.get
    return {"n_rows": found["n_rows"], "n_features": features, "n_nulls": found["n_nulls"], "n_non_numeric": text,
            "n_failures": found["n_failures"], "passed": int(found["n_nulls"] == 0 and text == 0)}


def require_quality(df: DataFrame, target: str = C.TARGET) -> DataFrame:
    """Hard stop before training when the gate fails."""
    row = quality_gate(df, target).first()
    if not row["passed"]:
        raise ValueError(f"quality gate failed: {row['n_nulls']} nulls, {row['n_non_numeric']} non-numeric columns")
    return df


def sensor_columns(names: list[str], keywords: list[str] = C.NOISE_KEYWORDS) -> list[str]:
    return [n for n in names if any(k.lower() in n.lower() for k in keywords)]


def feature_columns(df: DataFrame) -> list[str]:
    """Deterministic model input order: sorted, without meta columns."""
    meta = {"machine_id", "readings_seen", "type", "event_id", "ts", "event_type", "value", "score", C.TARGET, *C.MODES}
    return sorted(c for c in numeric_columns(df) if c not in meta)


def feature_matrix(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Numeric, leak-free, tidy-named columns in model order; ``keep`` columns come first."""
    keep = keep or []
    safe = normalize_names(numeric_only(leakage_firewall(df.drop(*keep))))
    names = feature_columns(safe)
    return df.select(*keep, *names)


def feature_catalog(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which columns were engineered; schema only, no data is read."""
    old = set(before.columns)
    rows = [(i + 1, c, "original" if c in old else "engineered") for i, c in enumerate(after.columns)]
    return after.sparkSession.createDataFrame(rows, "position int, column string, kind string")


def drop_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop columns that hold one value only (one pass of min and max)."""
    cols = cols or df.columns
    row = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"),
                            F.count(F.lit(1)).alias("rows")).alias(c) for c in cols]).first()
    dead = [c for c in cols if row[c]["n"] in (0, row[c]["rows"]) and row[c]["lo"] == row[c]["hi"]]
    return df.drop(*dead)


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing feature values become 0 (rolling features of very short series): the filling of training and scoring."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
