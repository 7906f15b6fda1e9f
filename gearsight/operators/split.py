"""Splits, samples and fleet assignment: all keyed by row order or row id, never by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.ordering import Order
from gearsight.operators.windows import ORDER


def chrono_split(df: DataFrame, share: float = 0.8, order: list[str] = ORDER) -> DataFrame:
    """Mark the first ``int(share * n)`` rows in time order as train, the rest as test."""
    line = Order(df, order)
    cut = int(share * line.n_rows)
    return (line.with_position("_pos")
            .withColumn("split", F.when(F.col("_pos") < cut, "train").otherwise("test")).drop("_pos"))


def shuffle_key(row_id: str, salt: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(salt), F.lit(str(seed))))


def class_ranks(df: DataFrame, salt: str, seed: int, label: str, row_id: str) -> tuple[DataFrame, dict]:
    """Shuffled rank of each row inside its class as ``_rank``, and the class sizes."""
    keyed = df.withColumn("_shuffle", shuffle_key(row_id, salt, seed))
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    start, run = {}, 0
    for value in sorted(sizes):
        start[value] = run
        run += sizes[value]
    placed = Order(keyed, [label, "_shuffle", row_id]).with_position("_pos")
    return placed.withColumn("_rank", F.col("_pos") - X.lookup(F.col(label), start)).drop("_pos", "_shuffle"), sizes


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, label: str = C.TARGET,
                     row_id: str = "event_id") -> DataFrame:
    """Shuffled folds with the class mix of the whole: rank inside the class modulo ``k``."""
    ranked, _ = class_ranks(df, "fold", seed, label, row_id)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, label: str = C.TARGET,
                     row_id: str = "event_id") -> DataFrame:
    """Stratified train/test marks: of each class the first ``round(test_share * size)`` shuffled rows are test."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    ranked, sizes = class_ranks(df, "fold", seed, label, row_id)
    n_test = {value: int(test_share * size + 0.5) for value, size in sizes.items()}
    is_test = F.col("_rank") < X.lookup(F.col(label), n_test)
    return ranked.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_rank")


def hash_sample(df: DataFrame, n: int, seed: int = 42, row_id: str = "event_id") -> DataFrame:
    """``n`` rows without replacement: the smallest hashes; each task forwards at most ``n`` rows."""
    return df.withColumn("_key", shuffle_key(row_id, "sample", seed)).orderBy("_key", row_id).limit(n).drop("_key")


def assign_fleet(sessions: DataFrame, n: int = C.FLEET_SIZE, seed: int = 42) -> DataFrame:
    """Pick ``n`` sessions as virtual machines named M-001, M-002, ..."""
    blocks = sessions.select("session_index").distinct()
    # at most ``n`` picked blocks: this window numbers a dozen rows
    picked = hash_sample(blocks, n, seed, "session_index")
    named = picked.select("session_index", F.format_string("M-%03d", F.row_number().over(
        Window.orderBy("session_index"))).alias("fleet_id"))
    return sessions.join(F.broadcast(named), "session_index")


def thin(df: DataFrame, position: str, n_rows: int, n: int = 60) -> DataFrame:
    """Evenly spaced rows by position (both ends kept); everything when there are at most ``n`` rows."""
    if n_rows <= n:
        return df
    keep = sorted({(j * (n_rows - 1)) // (n - 1) for j in range(n)})
    return df.filter(F.col(position).isin(keep))
