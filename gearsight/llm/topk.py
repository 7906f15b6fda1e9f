"""Exact top-k search: tiles of queries x shards, partial selection in each tile, tree merging of the top lists.

Vectors are integers. Queries are packed into blocks and candidates into shards, both by hash, so that sizes are even;
every block meets every shard once, as one row with two matrices. A tile is multiplied in slices, keeps k per query,
and the lists of a query are merged 16 at a time until one is left: no step holds more than 16 lists of a query.

Products are taken in doubles while they are exact (below 2^53), else in Python integers; a score beyond a long is
held at its limit. Ties go to the smaller id.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part, nor does a
component beyond 2^53 in size; vectors meet only vectors of their length; of several rows with one id the smallest
vector is used; a query never finds its own id; with less than k others it gets them all; an empty side gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.llm.common import col, stage

#: Rows of a candidate shard, of a block of queries, and queries multiplied at a time within a tile.
SHARD_ROWS, BLOCK_ROWS, SLICE_ROWS = 16_384, 4_096, 256
#: Lists of a query that are merged at a time.
FAN_IN = 16
EXACT = 1 << 53
LONG = (1 << 63) - 1
FOUND = "array<struct<score:long,vec_id:long>>"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null where the vector can take no part."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (
        F.abs(x.cast("double")) * scale <= float(EXACT)))
    return F.when(F.coalesce(usable, F.lit(False)), scaled)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest of each row, earlier columns first among equals."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > least, scores == least
    open_places = k - above.sum(axis=1, keepdims=True)
    return above | (equal & (np.cumsum(equal, axis=1) <= open_places))


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray,
         k: int) -> Iterator[tuple[int, list[dict]]]:
    """The k best candidates of each query. ``ids`` ascend."""
    largest = [max(1, *(abs(int(v)) for v in (m.min(), m.max()))) if m.size else 1 for m in (queries, shard)]
    exact = largest[0] * largest[1] * max(1, queries.shape[1]) < EXACT
    kind = np.float64 if exact else object
    right = shard.astype(kind).T
    own = np.searchsorted(ids, query_ids)
    for at in range(0, len(query_ids), SLICE_ROWS):
        scores = queries[at:at + SLICE_ROWS].astype(kind) @ right
        part = own[at:at + SLICE_ROWS]
        is_own = np.flatnonzero((part < len(ids)) & (ids[np.minimum(part, len(ids) - 1)] == query_ids[at:at + SLICE_ROWS]))
        if exact:
            scores[is_own, part[is_own]] = -np.inf
            masks = best(scores, k)
        for i in range(len(scores)):
            if exact:
                found = np.flatnonzero(masks[i] & (scores[i] > -np.inf))
                found = found[np.lexsort((ids[found], -scores[i, found]))]
            else:
                found = [j for j in range(len(ids)) if ids[j] != query_ids[at + i]]
                found = sorted(found, key=lambda j: (-scores[i, j], ids[j]))[:k]
            yield int(query_ids[at + i]), [{"score": max(-LONG - 1, min(LONG, int(scores[i, j]))), "vec_id": int(ids[j])}
                                           for j in found]


def blocks(vectors: DataFrame, count: int, name: str) -> DataFrame:
    """Vectors (id, vector, dims) packed by hash of the id: one row per block and length, ids ascending."""
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        matrix = np.stack([np.asarray(v, np.int64) for v in rows["vector"]])
        return pd.DataFrame({"dims": [key[0]], name: [key[1]], f"{name}_ids": [rows["id"].to_numpy(np.int64).tobytes()],
                             f"{name}_matrix": [matrix.tobytes()]})

    return (vectors.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(count)).cast("int"))
            .groupBy("dims", name).applyInPandas(pack, f"dims int, {name} int, {name}_ids binary, {name}_matrix binary"))


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Rows query_id, rank from 1, vec_id, score. Both inputs have ``id`` (long) and ``vector`` (array of long)."""
    spark = queries.sparkSession

    def ready(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).groupBy("id").agg(
            F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
        rows = stage(rows, name)
        return rows, rows.count()

    (left, n_left), (right, n_right) = ready(queries, "queries"), ready(candidates, "candidates")
    spread = spark.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n_left // BLOCK_ROWS))
    n_shards = max(-(-n_right // SHARD_ROWS), min(spread, -(-n_right // 1024)), 1)
    block = blocks(left, n_blocks, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    shard = blocks(right, n_shards, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tiles = block.join(shard.hint("shuffle_hash"), ["dims", "block", "shard"])
    kind = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims, part, *data = (batch.column(c)[row].as_py() for c in range(6))
                qids, q, ids, m = (np.frombuffer(d, np.int64) for d in data)
                found = list(tile(qids, q.reshape(len(qids), dims), ids, m.reshape(len(ids), dims), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([part] * len(found), pa.int32()),
                     pa.array([f[1] for f in found], kind)], names=["query_id", "part", "found"])

    lists = tiles.select("dims", "shard", "block_ids", "block_matrix", "shard_ids", "shard_matrix").mapInArrow(
        multiply, f"query_id long, part int, found {FOUND}")
    parts = n_shards
    while True:
        parts = -(-parts // FAN_IN)
        lists = lists.groupBy("query_id", (F.col("part") / FAN_IN).cast("int").alias("part")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list(F.transform(
                "found", lambda f: F.struct((-1 - f["score"]).alias("low"), f["vec_id"].alias("vec_id")))))), 1, k)
            .alias("found")).select("query_id", "part", F.transform("found", lambda f: F.struct(
                (-1 - f["low"]).alias("score"), f["vec_id"].alias("vec_id"))).alias("found"))
        if parts <= 1:
            break
    return lists.select("query_id", F.posexplode("found")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Rows whose id is divisible by ``every`` against all rows, on components floor(scale * x)."""
    rows = vectors.select(col(id_col).cast("long").alias("id"), quantised(col(vector_col), scale).alias("vector"))
    return exact_topk(rows.filter(F.col("id") % every == 0), rows, k)
