"""Exact dedup: a counting Bloom filter finds hashes that may repeat; only their rows are shuffled.

Pass 1 counts every text hash into cells that stop at two. A hash whose cells all reached two may repeat, any other
hash surely occurs once. Pass 2 sends rows of single hashes straight through and groups the rest by SHA-256. False
positives cost a shuffled row, never a wrong answer.

Defined results: a null text counts as empty; empty texts are equal to each other; null ids lose against any other id,
and a group of null ids only has keep_id null; rows equal in id and text are all marked kept (``kept_rows`` leaves one
of them); an empty table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import attach, col, packed, stage, unpacked

CELLS_PER_KEY = 8
PROBES = 3
#: Cells of one merged piece of the filter.
PIECE = 1 << 20
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def probes(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cells of each hash: distinct ones, as the step is odd and the number of cells a power of two."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(PROBES)])


def set_bits(bitmap: np.ndarray, cells: np.ndarray) -> None:
    """Set distinct, sorted cells."""
    if len(cells):
        byte = (cells >> np.uint64(3)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        bits = np.left_shift(np.uint8(1), (cells & np.uint64(7)).astype(np.uint8))
        bitmap[byte[start]] |= np.bitwise_or.reduceat(bits, start)


def has_bits(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeat_filter(hashes: DataFrame, rows: int, filter_mb: int) -> np.ndarray:
    """Bitmap of the cells that at least two hashes of column ``h`` fall on.

    ``filter_mb`` bounds what is merged, brought to the driver and broadcast; past it the filter only lets more rows
    through. Each of at most 64 tasks sends its filter in pieces, which are merged piece by piece.
    """
    cells = PIECE
    while cells < CELLS_PER_KEY * rows and cells // 8 < filter_mb << 20:
        cells *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in batches:
            found, times = np.unique(probes(batch.column(0).to_numpy(zero_copy_only=False), cells), return_counts=True)
            set_bits(twice, found[(times > 1) | has_bits(once, found)])
            set_bits(once, found)
        for at in range(0, cells // 8, PIECE // 8):
            part = slice(at, at + PIECE // 8)
            if once[part].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([at], pa.int64()),
                                                  "once": [once[part].tobytes()], "twice": [twice[part].tobytes()]})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(PIECE // 8, np.uint8), np.zeros(PIECE // 8, np.uint8)
        for a, b in zip(parts["once"], parts["twice"]):
            new = np.frombuffer(a, np.uint8)
            twice |= (once & new) | np.frombuffer(b, np.uint8)
            once |= new
        return pd.DataFrame({"piece": [key[0]], "twice": [twice.tobytes()]})

    pieces = (hashes.coalesce(64).mapInArrow(count, "piece long, once binary, twice binary")
              .groupBy("piece").applyInPandas(merge, "piece long, twice binary"))
    bitmap = np.zeros(cells // 8, np.uint8)
    for piece, twice in pieces.toLocalIterator():
        bitmap[piece:piece + PIECE // 8] = np.frombuffer(twice, np.uint8)
    return bitmap


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 32) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256. The largest id of equal texts stays."""
    return _marked(docs, id_col, text_col, filter_mb)[0]


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with the columns of ``docs``."""
    return _marked(docs, id_col, text_col, filter_mb)[1]


def _marked(docs: DataFrame, id_col: str, text_col: str, filter_mb: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    hashes = stage(docs.select(F.xxhash64(text).alias("h")), "text-hashes")
    rows = hashes.count()
    bitmap = spark.sparkContext.broadcast(repeat_filter(hashes, rows, filter_mb))

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        cells = probes(h.to_numpy(), len(bitmap.value) * 8)
        return pd.Series(np.logical_and.reduce([has_bits(bitmap.value, c) for c in cells]))

    all_rows = packed(docs, id=col(id_col), h=F.xxhash64(text), sha=F.unhex(F.sha2(text, 256)))
    all_rows = all_rows.withColumn("maybe", may_repeat("h"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    single = all_rows.filter(~F.col("maybe")).select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    maybe = all_rows.filter("maybe")
    groups = stage(maybe.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                   .withColumn("weight", F.col("group_size")), "text-groups")
    spread = F.unhex(F.hex(F.xxhash64("id", "h", F.monotonically_increasing_id())))
    joined = attach(maybe.select("row", "id", "h", "sha"), groups, "sha", "weight", rows, spread)
    grouped = joined.select("row", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), sha)
    marked = unpacked(single.unionByName(grouped), docs.columns, *MADE)
    once = grouped.filter("kept").dropDuplicates(["text_sha256"])
    return marked, single.select("row.*").unionByName(once.select("row.*"))
