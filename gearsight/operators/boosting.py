"""Boosted trees for large training tables: the booster of Spark ML on rows that are binned once.

Loss, bins, sampling of rows per tree and of columns per node, limits and leaf values are those of ``GBTClassifier``, and the
result is its model. What differs is how a tree level is counted:

1. columns of few bins share one 16-bit code, so that a row has some half as many codes as columns, one byte a column;
2. a node's rows are counted by code and the counts split by column afterwards;
3. of two sister nodes only the smaller one is counted, the other is the difference to their mother;
4. a task sends the sums of the counted nodes, and keeps nothing but the codes and the margins of its rows.

A level is one job over staged codes, a lost task is run again from them. Such a job costs some 0.1 s however little it counts,
so a table of up to ONE_TASK_ROWS rows is one partition, whose task grows all trees: fits of folds run in a task each. The drawn
rows follow from (seed, tree, partition) and the columns from (seed, tree, node). Splits of equal gain, up to rounding, go to
the first column and bin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.sources.staging import discard, scratch, shared_dir, staged

#: Columns of one code take so many bits together.
CODE_BITS = 10
#: Rows that the bin limits are found on, about, and at least the square of the bins.
LIMIT_ROWS = 10_000
#: A gain below this share of what it is the difference of is rounding, and so is a smaller difference of two gains.
ROUNDING = 1e-12
TIE = 1e-9
#: Rows of a table that one task fits; about 200 bytes each.
ONE_TASK_ROWS = 2_000_000
#: Trees between two checkpoints of the margins.
CHECKPOINT_TREES = 10
#: One element per partition on both sides of a zip.
ONE = BatchedSerializer(CPickleSerializer(), 1)


def limits_of(values: np.ndarray, weights: np.ndarray, expected: float, bins: int) -> np.ndarray:
    """Limits between at most ``bins`` bins of about equal weight, from a sample whose expected weight is ``expected``.

    As in Spark ML, the weight of zeros is what the other values leave of the expected weight.
    """
    some = values != 0
    at, which = np.unique(values[some], return_inverse=True)
    weight = np.bincount(which, weights=weights[some], minlength=len(at)) if len(at) else np.zeros(0)
    if expected - weight.sum() > np.finfo(float).eps * some.sum() * 100:
        place = np.searchsorted(at, 0.0)
        at, weight = np.insert(at, place, 0.0), np.insert(weight, place, expected - weight.sum())
    if len(at) < 2:
        return np.zeros(0)
    middle = (at[:-1] + at[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride = expected / bins
    seen, target, out = weight[0], stride, []
    for i in range(1, len(at)):
        before, seen = seen, seen + weight[i]
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


@dataclass(frozen=True)
class Codes:
    """Where the bin of each column lies: (code, shift, bits); a column of one bin has no bits."""
    place: list[tuple[int, int, int]]
    widths: list[int]

    def of(self, codes: np.ndarray, feature: int, rows: np.ndarray) -> np.ndarray:
        code, shift, bits = self.place[feature]
        if not bits:
            return np.zeros(len(rows), np.uint16)
        return (codes[code].take(rows) >> np.uint16(shift)) & np.uint16((1 << bits) - 1)

    def by_feature(self, sums: list[np.ndarray], bins: int) -> np.ndarray:
        """(feature, bin) sums of sums by code."""
        out = np.zeros((len(self.place), bins))
        total = sums[0].sum() if sums else 0.0
        for f, (code, shift, bits) in enumerate(self.place):
            if bits:
                own = sums[code].reshape(-1, 1 << bits, 1 << shift).sum(axis=(0, 2))[:bins]
                out[f, :len(own)] = own
            else:
                out[f, 0] = total
        return out


def codes_for(limits: list[np.ndarray]) -> Codes:
    place, widths = [], []
    for some in limits:
        bits = len(some).bit_length()
        if not bits:
            place.append((0, 0, 0))
            continue
        code = next((i for i, w in enumerate(widths) if w + bits <= CODE_BITS), len(widths))
        if code == len(widths):
            widths.append(0)
        place.append((code, widths[code], bits))
        widths[code] += bits
    return Codes(place, widths or [0])


def coded(columns: list[np.ndarray], limits: list[np.ndarray], codes: Codes) -> np.ndarray:
    out = np.zeros((len(codes.widths), len(columns[0])), np.uint16)
    for values, some, (code, shift, bits) in zip(columns, limits, codes.place):
        if not np.isfinite(values).all():
            raise ValueError("features must not be NaN or infinite")
        if bits:
            out[code] |= np.searchsorted(some, values).astype(np.uint16) << np.uint16(shift)
    return out


@dataclass
class Part:
    """The rows of one partition: codes by column group, labels -1 and 1, weights if there are any."""
    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray | None


@dataclass
class Grown:
    """A tree while it grows: nodes are numbered 1, 2 and 3, 4 to 7 and so on; ``sums`` has (rows, weight, sum) of each."""
    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    squares: dict[int, float] = field(default_factory=dict)

    @property
    def leaves(self) -> list[int]:
        return sorted(set(self.sums) - set(self.splits))

    def value(self, node: int) -> float:
        _, weight, total = self.sums[node]
        return float(total / weight) if weight else 0.0


@dataclass(frozen=True)
class Settings:
    trees: int
    step: float
    depth: int
    bins: int
    min_rows: int
    row_share: float
    columns: int
    seed: int


def columns_per_node(strategy: str, n: int) -> int:
    named = {"all": n, "auto": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))),
             "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), n)
    return math.ceil(float(strategy) * n)


# --- in the tasks -----------------------------------------------------------------------------

def drawn_rows(n: int, share: float, seed: int, tree: int, partition: int) -> np.ndarray:
    if share >= 1:
        return np.arange(n)
    return np.flatnonzero(np.random.default_rng([seed, tree, partition]).random(n) < share)


def residuals(part: Part, margin: np.ndarray, tree: int) -> np.ndarray:
    """What tree ``tree`` is fitted to: the labels, then the negative gradient of the logistic loss."""
    if tree == 0:
        return part.label.astype(float)
    with np.errstate(over="ignore"):
        return 4.0 * part.label / (1.0 + np.exp(2.0 * part.label * margin))


def routed(part: Part, codes: Codes, rows: np.ndarray, splits: dict[int, tuple[int, int]],
           wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its rows) of the nodes without a split, or of the wanted nodes."""
    onway = None if wanted is None else {w >> s for w in wanted for s in range(w.bit_length())}
    todo = [(1, rows)]
    while todo:
        node, some = todo.pop()
        if wanted is not None and node in wanted or node not in splits:
            yield node, some
            continue
        f, last = splits[node]
        left = codes.of(part.codes, f, some) <= last
        for child, mask in ((2 * node, left), (2 * node + 1, ~left)):
            if onway is None or child in onway:
                todo.append((child, some[mask]))


def counted(part: Part, codes: Codes, target: np.ndarray, nodes: list[int], found: Iterator[tuple[int, np.ndarray]],
            bins: int) -> np.ndarray:
    """(node, kind, feature, bin): rows, weights and weighted target, of the nodes in their order."""
    out = np.zeros((len(nodes), 3 if part.weight is not None else 2, len(codes.place), bins))
    at = {node: i for i, node in enumerate(nodes)}
    for node, rows in found:
        own = target.take(rows)
        kinds = [None, own]
        if part.weight is not None:
            weight = part.weight.take(rows)
            kinds = [None, weight, weight * own]
        sums = [[] for _ in kinds]
        for code, width in zip(part.codes, codes.widths):
            of_rows = code.take(rows).astype(np.intp)
            for into, weights in zip(sums, kinds):
                into.append(np.bincount(of_rows, weights, 1 << width))
        for kind, some in enumerate(sums):
            out[at[node], kind] = codes.by_feature(some, bins)
    return out


def moved(part: Part, codes: Codes, tree: Grown, step: float, margin: np.ndarray, drawn: np.ndarray,
          target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins after ``tree``, and the weighted sum of squares of the rows drawn for it by leaf."""
    leaves, place = tree.leaves, np.zeros(len(part.label), np.intp)
    index = {leaf: i for i, leaf in enumerate(leaves)}
    for node, rows in routed(part, codes, np.arange(len(part.label)), tree.splits):
        place[rows] = index[node]
    y = target.take(drawn)
    squares = y * y if part.weight is None else part.weight.take(drawn) * y * y
    values = np.array([tree.value(leaf) for leaf in leaves])
    return margin + step * values.take(place), np.bincount(place.take(drawn), squares, len(leaves))


def fitted_here(part: Part, codes: Codes, limits: list[np.ndarray], s: Settings) -> list[Grown]:
    """All trees on the rows of one partition."""
    trees, margin = [], np.zeros(len(part.label))
    for number in range(s.trees):
        drawn = drawn_rows(len(part.label), s.row_share, s.seed, number, 0)
        target = residuals(part, margin, number)
        rows_of = {1: drawn}

        def counts(splits, nodes):
            for node in sorted(splits):
                if node in rows_of:  # its halves have not been asked for
                    f, last = splits[node]
                    some = rows_of.pop(node)
                    left = codes.of(part.codes, f, some) <= last
                    rows_of[2 * node], rows_of[2 * node + 1] = some[left], some[~left]
            return with_weights(counted(part, codes, target, nodes, ((n, rows_of[n]) for n in nodes), s.bins))

        tree = pruned(grown(counts, limits, s, number))
        margin, squares = moved(part, codes, tree, s.step if number else 1.0, margin, drawn, target)
        add_squares(tree, squares)
        trees.append(tree)
    return trees


def with_weights(sums: np.ndarray) -> np.ndarray:
    """(rows, weight, sum) by node: without weights a row weighs 1."""
    return sums if sums.shape[1] == 3 else np.concatenate([sums[:, :1], sums], axis=1)


def add_squares(tree: Grown, squares: np.ndarray) -> None:
    for node, x in zip(tree.leaves, squares):
        tree.squares[node] = tree.squares.get(node, 0.0) + float(x)


# --- of one tree --------------------------------------------------------------------------------

def best_split(sums: np.ndarray, limits: list[np.ndarray], allowed: np.ndarray, min_rows: int):
    """(gain, feature, bin, left sums, right sums) of a node from its (rows, weight, sum) by feature and bin, or None."""
    left = np.cumsum(sums[:, allowed], axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    n_splits = np.array([len(limits[f]) for f in allowed])
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[2] ** 2 / left[1] + right[2] ** 2 / right[1]
        gain = parts - whole[2] ** 2 / whole[1]
    valid = (left[0] >= min_rows) & (right[0] >= min_rows) & (left[1] > 0) & (right[1] > 0)
    valid &= np.arange(left.shape[2])[None, :] < n_splits[:, None]
    gain = np.where(valid, gain, -np.inf)
    best = gain.max(initial=-np.inf)
    if not np.isfinite(best):
        return None
    i, b = np.unravel_index(int(np.argmax(gain >= best - TIE * abs(best))), gain.shape)
    if gain[i, b] <= ROUNDING * parts[i, b]:
        return None
    return float(gain[i, b] / whole[1, i, 0]), int(allowed[i]), int(b), left[:, i, b], right[:, i, b]


def grown(counts, limits: list[np.ndarray], s: Settings, tree: int) -> Grown:
    """One tree; ``counts(splits, nodes)`` gives the (rows, weight, sum) by feature and bin of nodes."""
    out, known, level, depth = Grown(), {}, [1], 0
    while level:
        ask, rest = [], []
        for node in level:
            sister = node ^ 1
            if sister in level and node > 1 and node >> 1 in known:
                (ask if (out.sums[node][0], node) <= (out.sums[sister][0], sister) else rest).append(node)
            else:
                ask.append(node)
        got = dict(zip(ask, counts(out.splits, ask)))
        for node in rest:
            got[node] = known[node >> 1] - got[node ^ 1]
        if not depth:
            out.sums[1] = got[1][:, 0].sum(axis=1)
        following = []
        for node in level:
            pick = np.random.default_rng([s.seed, tree, node, 1])
            allowed = np.sort(pick.choice(len(limits), s.columns, replace=False))
            if (split := best_split(got[node], limits, allowed, s.min_rows)) is None:
                continue
            gain, f, b, left, right = split
            out.splits[node], out.gains[node] = (f, b), gain
            out.sums[2 * node], out.sums[2 * node + 1] = left, right
            # a node is read if one of its halves could be a leaf of its own
            following += [c for c in (2 * node, 2 * node + 1) if out.sums[c][0] >= max(2, 2 * s.min_rows)]
        known, depth = got, depth + 1
        level = following if depth < s.depth else []
    return out


def pruned(tree: Grown) -> Grown:
    """Sister leaves of one value are one leaf, as in Spark ML."""
    for node in sorted(tree.splits, reverse=True):
        a, b = 2 * node, 2 * node + 1
        if a not in tree.splits and b not in tree.splits and tree.value(a) == tree.value(b):
            del tree.splits[node], tree.gains[node], tree.sums[a], tree.sums[b]
    return tree


def node_rows(number: int, tree: Grown, limits: list[np.ndarray]) -> list[tuple]:
    """Rows of the saved model, numbered from the root, left before right."""
    squares = dict(tree.squares)
    for node in sorted(tree.splits, reverse=True):
        squares[node] = squares[2 * node] + squares[2 * node + 1]
    out: list[tuple] = []

    def add(node: int) -> int:
        at = len(out)
        out.append(())
        rows, weight, total = map(float, tree.sums[node])
        impurity = (squares[node] - total * total / weight) / weight if weight else 0.0
        gain, left, right, split = -1.0, -1, -1, (-1, [], -1)
        if node in tree.splits:
            f, b = tree.splits[node]
            gain, split = tree.gains[node], (f, [float(limits[f][b])], -1)
            left, right = add(2 * node), add(2 * node + 1)
        out[at] = (number, (at, tree.value(node), impurity, [weight, total, squares[node]], int(rows), gain, left, right, split))
        return at

    add(1)
    return out


NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
         "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
         "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")
_TREE_PARAMS = {"labelCol", "maxDepth", "minInstancesPerNode", "seed", "cacheNodeIds", "checkpointInterval", "featuresCol",
                "impurity", "leafCol", "maxBins", "maxMemoryInMB", "minInfoGain", "minWeightFractionPerNode", "predictionCol"}


def as_model(spark: SparkSession, gbt: GBTClassifier, trees: list[Grown], limits: list[np.ndarray], step: float) -> GBTClassificationModel:
    """The trees as Spark ML's model, through the files that it is saved in."""
    path = scratch(spark, "boosted")
    gbt.write().save(f"{path}/estimator")
    about = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    about = {k: about[k] for k in ("timestamp", "sparkVersion", "uid", "paramMap", "defaultParamMap")}
    package = "org.apache.spark.ml."

    def text(rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).coalesce(1)

    one = about | {"class": f"{package}regression.DecisionTreeRegressionModel"} | {
        k: {p: v for p, v in about[k].items() if p in _TREE_PARAMS} for k in ("paramMap", "defaultParamMap")}
    whole = about | {"class": f"{package}classification.GBTClassificationModel", "numFeatures": len(limits), "numTrees": len(trees)}
    text([(json.dumps(whole),)], "value string").write.text(f"{path}/model/metadata")
    text([(i, json.dumps(one | {"uid": f"dtr_{about['uid'].split('_')[-1]}_{i}"}), step if i else 1.0) for i in range(len(trees))],
         "_1 int, _2 string, _3 double").write.parquet(f"{path}/model/treesMetadata")
    text([row for i, tree in enumerate(trees) for row in node_rows(i, tree, limits)], NODES).write.parquet(f"{path}/model/data")
    return GBTClassificationModel.load(f"{path}/model")


def limits_from(rows: DataFrame, features: list[str], row_id: list[str], n: int, weight: str | None, bins: int) -> list[np.ndarray]:
    """Bin limits from about LIMIT_ROWS rows, drawn by a hash of their id."""
    share = min(1.0, max(LIMIT_ROWS, bins * bins) / n)
    drawn = rows.filter(F.pmod(F.xxhash64(*row_id, F.lit(23)), F.lit(1 << 31)) < F.lit(int(share * (1 << 31))))
    total = float(n) if weight is None else float(rows.agg(F.sum(weight)).first()[0])
    table = drawn.select(*features, *([weight] if weight else [])).toPandas()
    weights = table[weight].to_numpy(float) if weight else np.ones(len(table))
    return [limits_of(table[c].to_numpy(float), weights, share * total, bins) for c in features]


def _blocks(rows: DataFrame, features: list[str], label: str, weight: str | None, limits: list[np.ndarray], codes: Codes,
            tasks: int) -> DataFrame:
    """Staged codes: one row per Arrow batch, dealt evenly."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            labels = b.column(label).to_numpy(zero_copy_only=False).astype(float)
            if not np.isin(labels, (0.0, 1.0)).all():
                raise ValueError("the label must be 0 or 1")
            weights = b.column(weight).to_numpy(zero_copy_only=False).astype(float).tobytes() if weight else b""
            packed = coded([b.column(c).to_numpy(zero_copy_only=False) for c in features], limits, codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.binary()) for v in (packed.tobytes(), (2 * labels - 1).astype(np.int8).tobytes(), weights)],
                ["codes", "label", "weight"])

    wanted = rows.select(*[F.col(c).cast("double").alias(c) for c in features], label, *([weight] if weight else []))
    return staged(wanted.mapInArrow(code, "codes binary, label binary, weight binary").repartition(tasks))


def _parts(blocks: DataFrame, codes: Codes, weighted: bool) -> RDD:
    """One ``Part`` per partition, kept on the executors."""
    groups = len(codes.widths)

    def part(rows) -> Iterator[Part]:
        some = list(rows)
        pieces = [np.frombuffer(bytes(r["codes"]), np.uint16).reshape(groups, -1) for r in some]
        whole = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in some), kind)
        yield Part(np.concatenate([np.zeros((groups, 0), np.uint16), *pieces], axis=1), whole("label", np.int8),
                   whole("weight", np.float64) if weighted else None)

    return blocks.rdd.mapPartitions(part)._reserialize(ONE).persist(StorageLevel.MEMORY_AND_DISK_DESER)


def fit(gbt: GBTClassifier, rows: DataFrame, features: list[str], label: str, row_id: list[str], n: int,
        weight: str | None = None) -> GBTClassificationModel:
    """The model of ``gbt``'s settings on about ``n`` rows, told apart by ``row_id``.

    ``rows`` is read twice: for the bin limits, and for the codes.
    """
    spark = rows.sparkSession
    tasks = 1 if n <= ONE_TASK_ROWS else max(spark.sparkContext.defaultParallelism, math.ceil(n / ONE_TASK_ROWS))
    s = Settings(gbt.getMaxIter(), gbt.getStepSize(), gbt.getMaxDepth(), gbt.getMaxBins(), gbt.getMinInstancesPerNode(),
                 gbt.getSubsamplingRate(), columns_per_node(gbt.getFeatureSubsetStrategy(), len(features)), gbt.getSeed())
    shared_dir(spark)
    limits = limits_from(rows, features, row_id, n, weight, s.bins)
    codes = codes_for(limits)
    blocks = _blocks(rows, features, label, weight, limits, codes, tasks)
    parts = _parts(blocks, codes, weight is not None)
    try:
        if tasks == 1:
            trees = parts.map(lambda part: fitted_here(part, codes, limits, s)).first()
        else:
            trees = _fitted_by_level(parts, codes, limits, s)
    finally:
        parts.unpersist()
    return as_model(spark, gbt, trees, limits, s.step)


def _fitted_by_level(parts: RDD, codes: Codes, limits: list[np.ndarray], s: Settings) -> list[Grown]:
    """All trees, a job per level; margins are kept on the executors and checkpointed now and then."""
    trees: list[Grown] = []
    state = parts.map(lambda p: (np.zeros(len(p.label)), None))._reserialize(ONE)
    before, kept = None, None
    for number in range(s.trees):
        pairs = parts.zip(state)

        def counts(splits, nodes, pairs=pairs, number=number):
            def count(at, it):
                for part, (margin, squares) in it:
                    drawn = drawn_rows(len(part.label), s.row_share, s.seed, number, at)
                    found = routed(part, codes, drawn, splits, set(nodes))
                    yield counted(part, codes, residuals(part, margin, number), nodes, found, s.bins), squares

            total = None
            for sums, squares in pairs.mapPartitionsWithIndex(count).collect():
                total = sums if total is None else total + sums
                if number and nodes == [1]:
                    add_squares(trees[-1], squares)
            return with_weights(total)

        tree = pruned(grown(counts, limits, s, number))
        trees.append(tree)
        if before is not None:
            before.unpersist()
        before = state if number else None
        state = _next_state(pairs, codes, tree, s, number).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT_TREES == 0 and number + 1 < s.trees:
            state.checkpoint()
            state.count()
            old, kept = kept, state.getCheckpointFile()
            if old:
                discard(SparkSession.getActiveSession(), old)
    for squares in state.map(lambda x: x[1]).collect():
        add_squares(trees[-1], squares)
    for rdd in (state, before):
        if rdd is not None:
            rdd.unpersist()
    return trees


def _next_state(pairs: RDD, codes: Codes, tree: Grown, s: Settings, number: int) -> RDD:
    """(margins, sums of squares by leaf) after ``tree``."""

    def move(at, it):
        for part, (margin, _) in it:
            drawn = drawn_rows(len(part.label), s.row_share, s.seed, number, at)
            yield moved(part, codes, tree, s.step if number else 1.0, margin, drawn, residuals(part, margin, number))

    return pairs.mapPartitionsWithIndex(move)._reserialize(ONE)
