"""Minority oversampling on the line to a near neighbour, with an exact distributed neighbour search.

The search never pairs all minority rows and never gathers them:

1. copies of one point are reduced to the ``k + 1`` smallest ids (no other copy can be a neighbour);
2. sampled points are pivots (driver, at most MAX_CELLS), every point goes to the cell of its nearest pivot;
3. each cell finds the neighbours of its own points, which bounds the neighbour distance;
4. a point asks another cell only if the triangle inequality leaves room for a nearer point there: the cell's radius
   around its pivot and the plane half way between both pivots give two lower bounds. The answers are merged.

Distances are over all columns at once, so columns that are mostly zero or mostly equal neither pile points into one
cell nor open others: only equal points share a place, and of those ``k + 1`` are left. Large cells are cut in the task by
pivots of their own in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.ordering import Order
from gearsight.sources.staging import staged

CELL_ROWS = 2_000
MAX_CELLS = 16_384
#: Points drawn per pivot wanted, so that a few are left over.
PIVOT_DRAW = 4
#: What rounding may add to a bound, as a share of the distances in it.
SLACK = 1e-9
COPIES_PER_TASK_ROW = 100_000
#: New rows from which on they take their base point after their neighbour's number: one shuffle less carries all columns.
NARROW_ROWS = 1_000_000
CHUNK = 256


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over columns in order, so that equal inputs give bit-equal results everywhere."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return total


def matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, 0))


def closest(q: np.ndarray, pts: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of the ``k`` best of ``pts`` by (distance, id); missing ones are infinite.

    Distances by a product of matrices, each with a bound of its rounding, leave a few candidates per point; those are
    measured column by column, so that the answer is that of measuring all.
    """
    d2, nn = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    order = np.argsort(ids, kind="stable")
    pts, ids, take = pts[order], ids[order], min(k, len(ids))
    with np.errstate(over="ignore", invalid="ignore"):
        middle = pts.mean(axis=0) if len(pts) else 0.0
        near, far = q - middle, pts - middle
        near_norm, far_norm = (near * near).sum(axis=1), (far * far).sum(axis=1)
        # how much a distance by the product and the measured one may differ, in sum
        wrong = 16 * (pts.shape[1] + 8) * np.finfo(float).eps * (near_norm + far_norm.max(initial=0.0))
    bounded = len(ids) > 4 * k and np.isfinite(wrong).all()
    for at in range(0, len(q), CHUNK):
        part = slice(at, at + CHUNK)
        if not bounded:
            dist = squared_distances(q[part], pts)
            best = np.argsort(dist, axis=1, kind="stable")[:, :take]
            d2[part, :take] = np.take_along_axis(dist, best, 1)
            nn[part, :take] = ids[best]
            continue
        about = near_norm[part, None] + far_norm - 2 * (near[part] @ far.T)
        limit = np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * wrong[part]
        row, col = np.nonzero(about <= limit[:, None])
        dist = np.zeros(len(row))
        for j in range(pts.shape[1]):
            d = q[at + row, j] - pts[col, j]
            dist += d * d
        by = np.lexsort((col, dist, row))
        row, col, dist = row[by], col[by], dist[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        some = rank < k
        d2[at + row[some], rank[some]], nn[at + row[some], rank[some]] = dist[some], ids[col[some]]
    return d2, nn


class Pivots:
    """A partition of space by the nearest pivot, ties to the first one."""

    def __init__(self, at: np.ndarray):
        self.at = at

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(squared_distances(points, self.at))

    def in_reach(self, points: np.ndarray, home: np.ndarray, reach: np.ndarray,
                 radius: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, row numbers of the points that may have a point nearer than ``reach`` in it), home cells left out.

        ``radius`` is the largest distance of a cell's points from its pivot, negative for an empty cell. The bounds are
        taken a little smaller than computed, as rounding must not lose a cell.
        """
        far = self.distances(points)
        own = far[np.arange(len(points)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            homes, which = np.unique(home, return_inverse=True)
            plane = (far * far - own * own) / (2 * self.distances(self.at[homes])[which])
        plane[~np.isfinite(plane)] = 0
        slack = SLACK * (far + own)
        visit = (np.maximum(far - radius, plane) - slack <= reach[:, None]) & (radius >= 0)
        visit[np.arange(len(points)), home] = False
        for cell in np.flatnonzero(visit.any(axis=0)):
            yield int(cell), np.flatnonzero(visit[:, cell])


def chunks(n: int) -> Iterator[slice]:
    return (slice(at, at + CHUNK) for at in range(0, n, CHUNK))


def closest_in_leaves(q: np.ndarray, pts: np.ndarray, ids: np.ndarray, k: int, leaf_rows: int):
    """As ``closest`` for a crowded cell: the same bound-then-visit search over pivots inside the task."""
    if len(pts) <= 2 * leaf_rows:
        return closest(q, pts, ids, k)
    distinct = np.unique(pts, axis=0)
    step = max(1, len(distinct) // math.ceil(len(pts) / leaf_rows))
    pivots = Pivots(np.random.default_rng(13).permutation(distinct)[::step])
    near = [pivots.distances(pts[c]) for c in chunks(len(pts))]
    leaf = np.concatenate([n.argmin(axis=1) for n in near])
    radius = np.full(len(pivots.at), -1.0)
    np.maximum.at(radius, leaf, np.concatenate([n.min(axis=1) for n in near]))
    order = np.argsort(leaf, kind="stable")
    edge = np.searchsorted(leaf[order], np.arange(len(pivots.at) + 1))
    d2, nn = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def visit(cell: int, rows: np.ndarray) -> None:
        own = order[edge[cell]:edge[cell + 1]]
        more_d, more_n = closest(q[rows], pts[own], ids[own], k)
        all_d, all_n = np.hstack([d2[rows], more_d]), np.hstack([nn[rows], more_n])
        by_id = np.argsort(all_n, axis=1, kind="stable")
        all_d, all_n = np.take_along_axis(all_d, by_id, 1), np.take_along_axis(all_n, by_id, 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :k]
        d2[rows], nn[rows] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_n, best, 1)

    home = np.concatenate([pivots.distances(q[c]).argmin(axis=1) for c in chunks(len(q))])
    for cell in np.unique(home):
        visit(int(cell), np.flatnonzero(home == cell))
    for c in chunks(len(q)):
        rows = np.arange(len(q))[c]
        for cell, some in pivots.in_reach(q[c], home[c], np.sqrt(d2[c, -1]), radius):
            visit(cell, rows[some])
    return d2, nn


def nearest(asked: pd.DataFrame, found: pd.DataFrame, k: int, leaf_rows: int = CELL_ROWS) -> pd.DataFrame:
    """The ``k`` best candidates of ``found`` per asked point."""
    if not len(asked) or not len(found):
        return pd.DataFrame({"point": [], "nn_id": [], "d2": []})
    d2, nn = closest_in_leaves(matrix(asked), matrix(found), found["id"].to_numpy(), k, leaf_rows)
    out = pd.DataFrame({"point": np.repeat(asked["point"].to_numpy(), k), "nn_id": nn.ravel(), "d2": d2.ravel()})
    return out[np.isfinite(out["d2"])]


PAIRS = "point bigint, nn_id bigint, d2 double"


def nearest_neighbours(df: DataFrame, cols: list[str], k: int, row_id: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(row_id, rank 1..k, nn_id): the exact ``k`` nearest other rows by (distance, id)."""
    # the coordinates travel as one array column, which is also the key of equal points
    base = df.select(F.col(row_id).cast("bigint").alias("id"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    same = Window.partitionBy("x").orderBy("id")
    upto = same.rowsBetween(Window.unboundedPreceding, 0)
    points = (base.withColumn("_copy", F.row_number().over(same)).withColumn("point", F.first("id").over(upto))
              .filter(F.col("_copy") <= k + 1).drop("_copy"))
    # the first copy of each point holds the cell's shape; all are read by three branches
    points = staged(points)
    n = points.count()
    wanted = min(MAX_CELLS, max(1, math.ceil(n / cell_rows)))
    pivots = _sampled_pivots(points, wanted, n) if wanted > 1 else None

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far = [pivots.distances(matrix(b.iloc[c])) for c in chunks(len(b))]
            yield b.assign(cell=np.concatenate([f.argmin(axis=1) for f in far]).astype("int32"),
                           off=np.concatenate([f.min(axis=1) for f in far]))

    def own(cell: pd.DataFrame) -> pd.DataFrame:
        return nearest(cell[cell["id"] == cell["point"]], cell, k + 1)

    placed = points.withColumn("cell", F.lit(0)) if pivots is None else staged(points.mapInPandas(
        place, "id bigint, x array<double>, point bigint, cell int, off double"))
    answers = placed.groupBy("cell").applyInPandas(own, PAIRS)
    if pivots is not None:
        # read by two branches: stage it, so that cells are searched once
        answers = staged(answers)
        radius = np.full(len(pivots.at), -1.0)
        for r in placed.groupBy("cell").agg(F.max("off").alias("off")).collect():  # at most MAX_CELLS rows
            radius[r["cell"]] = r["off"]
        bound = answers.groupBy("point").agg(F.max("d2").alias("far"), F.count(F.lit(1)).alias("m"))
        reach = F.when(F.col("m") > k, F.col("far")).otherwise(F.lit(float("inf")))
        asked = placed.filter(F.col("id") == F.col("point"))
        balls = asked.join(bound.select("point", reach.alias("far")), "point").select("point", "cell", "x", "far")

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for c in chunks(len(batch)):
                    b = batch.iloc[c].reset_index(drop=True)
                    for cell, rows in pivots.in_reach(matrix(b), b["cell"].to_numpy(), np.sqrt(b["far"].to_numpy()), radius):
                        yield b.iloc[rows][["point", "x"]].assign(cell=cell)

        guests = staged(balls.mapInPandas(visit, "point bigint, x array<double>, cell int"))
        answers = answers.unionByName(_ask_cells(guests, placed.select("id", "x", "point", "cell"), k, cell_rows))
    # per point: k + 1 answers from its own cell and from each cell it reached
    best = Window.partitionBy("point").orderBy("d2", "nn_id")
    merged = answers.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    every = base.join(points.filter(F.col("id") == F.col("point")).select("point", "x"), "x").select("id", "point")
    others = every.join(merged, "point").filter(F.col("nn_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nn_id"))
    return (others.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select(F.col("id").alias(row_id), "rank", "nn_id"))


def _sampled_pivots(points: DataFrame, wanted: int, n: int) -> Pivots:
    """About ``wanted`` different points, drawn by a hash of their id; at least one."""
    first = points.filter(F.col("id") == F.col("point"))
    share = F.lit(int(min(1.0, PIVOT_DRAW * wanted / n) * (1 << 31)))
    drawn = first.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 31)) < share).orderBy(
        F.xxhash64("id", F.lit(17)), "id").limit(wanted).select("x").toPandas()
    return Pivots(matrix(drawn if len(drawn) else first.orderBy("id").limit(1).select("x").toPandas()))


def _ask_cells(guests: DataFrame, placed: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """Answers of the reached cells; a cell asked by many points is copied so that its guests are split."""
    crowd = guests.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(20 * cell_rows)).cast("int").alias("copies"))
    salt = F.pmod(F.hash("point"), F.col("copies"))
    left = guests.join(crowd, "cell").withColumn("salt", salt).drop("copies")
    right = (placed.join(crowd, "cell")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"))

    def answer(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return nearest(g, c, k + 1)

    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(answer, PAIRS)


def smote(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42, label: str = C.TARGET,
          row_id: str = "event_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add synthetic rows of the rarer class until both are equal: x + u (neighbour - x).

    New rows are spread evenly over the minority rows in id order; neighbour and ``u`` are drawn from a hash of
    (row id, copy). Result: ``row_id`` (base row for synthetic ones), ``copy`` (null for real rows), ``cols``, label.
    """
    real = df.select(row_id, F.lit(None).cast("bigint").alias("copy"),
                     *[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("int").alias(label))
    made = synthetic_rows(df, cols, k, seed, label, row_id, cell_rows)
    return real if made is None else real.unionByName(made)


def synthetic_rows(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42, label: str = C.TARGET,
                   row_id: str = "event_id", cell_rows: int = CELL_ROWS) -> DataFrame | None:
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) != 2:
        if len(counts) < 2:
            return None
        raise ValueError("oversampling needs a label of two classes")
    rare = min(counts, key=lambda value: (counts[value], -value))
    n_min = counts[rare]
    n_new = max(counts.values()) - n_min
    if n_new == 0:
        return None
    if n_min < 2:
        raise ValueError("oversampling needs at least two minority rows")
    k = min(k, n_min - 1)
    # read many times by the neighbour search; the upstream features are computed once
    minority = staged(df.filter(F.col(label) == rare).select(row_id, *[F.col(c).cast("double").alias(c) for c in cols]))
    neighbours = nearest_neighbours(minority, cols, k, row_id, cell_rows)
    placed = Order(minority, [row_id]).with_position("_pos")
    share, extra = divmod(n_new, n_min)
    todo = placed.withColumn("_n", F.lit(share) + F.when(F.col("_pos") < extra, 1).otherwise(0)).filter("_n > 0")
    # many copies of few rows: start points first, spread over tasks, then the copies
    starts = todo.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1,
                                                           F.lit(COPIES_PER_TASK_ROW).cast("bigint"))))
    if share >= COPIES_PER_TASK_ROW:
        starts = starts.repartition(row_id, "_from")
    last = F.least(F.col("_from") + COPIES_PER_TASK_ROW, F.col("_n")) - 1
    copies = starts.withColumn("copy", F.explode(F.sequence(F.col("_from"), last)))
    drawn = copies.withColumn("_draw", F.concat_ws("-", F.col(row_id), F.col("copy"))).withColumns({
        "rank": (F.floor(X.uniform("_draw", "neighbour", seed) * k) + 1).cast("int"),
        "_u": X.uniform("_draw", "step", seed)})
    target = minority.select(F.col(row_id).alias("nn_id"), *[F.col(c).alias(f"_nn_{c}") for c in cols])
    if n_new > NARROW_ROWS:
        found = drawn.select("_pos", row_id, "copy", "rank", "_u").join(neighbours, [row_id, "rank"])
        joined = found.join(placed.select("_pos", *cols), "_pos").join(target, "nn_id")
    else:
        joined = drawn.join(neighbours, [row_id, "rank"]).join(target, "nn_id")
    return joined.select(row_id, "copy", *[(F.col(c) + F.col("_u") * (F.col(f"_nn_{c}") - F.col(c))).alias(c)
                                           for c in cols], F.lit(rare).cast("int").alias(label))
