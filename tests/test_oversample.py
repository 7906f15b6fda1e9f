import numpy as np
import pytest
from pyspark.sql import functions as F

from gearsight.operators import oversample
from gearsight.operators.oversample import Pivots, closest, closest_in_leaves, nearest_neighbours, smote, synthetic_rows


def brute(pdf, cols, k):
    pts, ids = pdf[cols].to_numpy(), pdf["id"].to_numpy()
    out = set()
    for i, p in enumerate(pts):
        d = np.zeros(len(pts))
        for j in range(len(cols)):
            d += (p[j] - pts[:, j]) ** 2
        near = sorted((dd, ii) for dd, ii in zip(d, ids) if ii != ids[i])[:k]
        out |= {(int(ids[i]), r + 1, int(ii)) for r, (_, ii) in enumerate(near)}
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    # a third of the rows are copies of one point, the rest lie on a coarse lattice with many ties
    return spark.range(900).select("id", *[
        F.when(F.col("id") % 3 == 0, 4.0).otherwise((F.col("id") * p % m).cast("double")).alias(c)
        for c, p, m in (("a", 37, 11), ("b", 53, 101), ("c", 71, 7))]).persist()


@pytest.mark.parametrize("cell_rows,parts", [(10_000, 1), (40, 7), (15, 3)])
def test_neighbours_exact(cloud, cell_rows, parts):
    got = nearest_neighbours(cloud.repartition(parts), ["a", "b", "c"], 5, "id", cell_rows)
    assert {tuple(r) for r in got.collect()} == brute(cloud.toPandas(), ["a", "b", "c"], 5)


def test_every_cell_is_reached_by_an_infinite_ball():
    rng = np.random.default_rng(0)
    pivots, radius = Pivots(rng.random((8, 2))), np.ones(8)
    hit = {c for c, _ in pivots.in_reach(rng.random((1, 2)), np.array([3]), np.array([np.inf]), radius)}
    assert hit == set(range(8)) - {3}


def zero_inflated(n=20_000, columns=59):
    """One column that varies, others that are zero in nine rows of ten, flags, and two wide ones."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random((n, columns)) < 0.9, 0.0, rng.random((n, columns)))
    x[:, 0], x[:, 1] = rng.normal(60_000, 10_000, n), rng.integers(0, 12_000, n)
    x[:, 2:8] = rng.random(x[:, 2:8].shape) < 0.03
    return x


def test_zero_inflated_columns_spread_evenly_and_visit_few_cells():
    x = zero_inflated()
    pivots = Pivots(x[::625])
    near = np.concatenate([pivots.distances(x[c]) for c in oversample.chunks(len(x))])
    home, cells = near.argmin(axis=1), len(pivots.at)
    sizes = np.bincount(home, minlength=cells)
    assert cells == 32 and sizes.max() < 4 * len(x) / cells and (sizes > 0).all()
    radius = np.array([near[home == c, c].max() for c in range(cells)])
    asked = np.arange(0, len(x), 40)
    d2, _ = closest(x[asked], x, np.arange(len(x)), 6)
    visits = sum(len(r) for _, r in pivots.in_reach(x[asked], home[asked], np.sqrt(d2[:, -1]), radius))
    assert visits / len(asked) < cells / 8


def test_neighbours_of_mostly_equal_columns(spark):
    x = zero_inflated(600, 6)
    x[:, 0], x[:, 1] = np.where(x[:, 3] > 0, 1.0, 0.0), 0.0
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *"abcdef"])
    got = nearest_neighbours(rows, list("abcdef"), 5, "id", 40)
    assert {tuple(r) for r in got.collect()} == brute(rows.toPandas(), list("abcdef"), 5)


def test_either_class_may_be_the_rarer_one(spark):
    df = spark.range(90).select(F.col("id").alias("event_id"), (F.col("id") % 13).cast("double").alias("x"),
                                (F.col("id") % 9 != 0).cast("int").alias("machine_failure"))
    made = smote(df, ["x"]).filter("copy is not null")
    assert made.count() == 70 and made.select("machine_failure").distinct().collect() == [(0,)]
    assert synthetic_rows(df.filter("machine_failure = 1"), ["x"]) is None


def test_smote_balances_and_stays_on_segments(spark):
    df = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 31).cast("double").alias("x"),
                                 (F.col("id") * 11 % 17).cast("double").alias("y"),
                                 (F.col("id") % 16 == 0).cast("int").alias("machine_failure"))
    out = smote(df, ["x", "y"])
    counts = dict(out.groupBy("machine_failure").count().collect())
    assert counts[0] == counts[1] == 375
    near = {}
    for i, _, n in brute(df.filter("machine_failure = 1").toPandas().rename(columns={"event_id": "id"}), ["x", "y"], 5):
        near.setdefault(i, []).append(n)
    at = {r["event_id"]: np.array([r["x"], r["y"]]) for r in df.collect()}
    for r in out.filter("copy is not null").collect():
        p, base = np.array([r["x"], r["y"]]), at[r["event_id"]]
        cross = lambda a, b: a[0] * b[1] - a[1] * b[0]
        assert any(abs(cross(at[n] - base, p - base)) < 1e-9 and
                   -1e-9 <= np.dot(p - base, at[n] - base) <= np.dot(at[n] - base, at[n] - base) + 1e-9
                   for n in near[r["event_id"]])


def test_few_minority_rows(spark):
    df = spark.range(30).select(F.col("id").alias("event_id"), F.col("id").cast("double").alias("x"),
                                (F.col("id") < 3).cast("int").alias("machine_failure"))
    assert smote(df, ["x"]).filter("machine_failure = 1").count() == 27
    with pytest.raises(ValueError):
        smote(df.filter("event_id = 0 or event_id > 2"), ["x"])
    assert synthetic_rows(df.filter("event_id < 3"), ["x"]) is None


def test_partition_invariant(cloud):
    df = cloud.select(F.col("id").alias("event_id"), "a", "b", (F.col("id") % 9 == 1).cast("int").alias("machine_failure"))
    runs = [sorted(map(tuple, smote(df.repartition(p), ["a", "b"], cell_rows=c).collect()), key=str)
            for p, c in ((1, 2000), (7, 20))]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("dims,leaf", [(2, 10), (5, 25), (3, 400)])
def test_leaf_search_equals_brute_force(dims, leaf):
    rng = np.random.RandomState(dims)
    pts = np.vstack([np.round(rng.rand(700, dims) * 6), np.tile(rng.rand(1, dims), (6, 1))])
    ids = rng.permutation(len(pts)).astype("int64")
    for got, want in zip(closest_in_leaves(pts, pts, ids, 6, leaf), closest(pts, pts, ids, 6)):
        assert (got == want).all()
