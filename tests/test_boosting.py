"""Trees grown on packed codes are those of Spark ML, and a large fit takes this way."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gearsight.operators import boosting as B
from gearsight.operators import explain as EX
from gearsight.operators import oversample as O
from gearsight.plans import training as T
from gearsight.sources.staging import staged, staged_by_size, unstage

COLUMNS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    """Two columns of many values, zeros, three values, two values, one value."""
    return staged(spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("event_id"), F.rand(1).alias("x0"), (F.rand(2) * 1e5 - 10).alias("x1"),
        F.when(F.rand(3) < 0.6, 0.0).otherwise(F.rand(4)).alias("x2"), F.floor(F.rand(5) * 3).cast("double").alias("x3"),
        F.floor(F.rand(6) * 2).cast("double").alias("x4"), F.lit(4.0).alias("x5")).withColumn(
        "machine_failure", F.expr("CAST(x0 + x1 / 1e5 * x2 - 0.2 * x3 + 0.3 * x4 + 0.3 * rand(7) > 0.9 AS INT)")))


@pytest.mark.parametrize("one_task", [100, 10_000])
@pytest.mark.parametrize("balance", [False, True])
def test_same_trees_as_spark_ml(rows, monkeypatch, one_task, balance):
    params = T.Boosting(trees=11, step=0.2, depth=5, min_rows=8, row_share=1.0, column_share="1.0", balance=balance)
    # weights without rounding: a limit half way between two values would follow the order of sums
    monkeypatch.setattr(T, "with_class_weights", lambda df, label: df.withColumn(
        "_weight", F.when(F.col(label) == 1, 3.0).otherwise(0.5)))
    wanted = T.train(rows, COLUMNS, params, oversample=False)
    monkeypatch.setattr(B, "ONE_TASK_ROWS", one_task)
    monkeypatch.setattr(T, "SPARK_ML_ROWS", 0)
    got = T.train(rows, COLUMNS, params, oversample=False)
    a, b = (EX.tree_table(m).sort_values(["tree", "node"]).fillna(-1).reset_index(drop=True) for m in (wanted, got))
    assert len(a) > 300 and len(a) == len(b)
    for c in a.columns:
        assert a[c].to_numpy(float) == pytest.approx(b[c].to_numpy(float), rel=1e-9, abs=1e-9), c
    importance = [m.stages[-1].featureImportances.toArray() for m in (wanted, got)]
    assert importance[0] == pytest.approx(importance[1], abs=1e-9)


def test_a_large_fit_is_not_a_job_a_level(spark, rows, monkeypatch, tmp_path):
    """Draws, oversampling and all trees; the model is saved and loaded as any."""
    monkeypatch.setattr(T, "SPARK_ML_ROWS", 0)
    spark.sparkContext.setJobGroup("large-fit", "")
    try:
        model = T.train(rows, COLUMNS, T.Boosting(trees=40, min_rows=5))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("large-fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 100 and model.stages[-1].getNumTrees == 40
    scored = T.score(model, rows).groupBy("machine_failure").agg(F.avg("score").alias("s")).orderBy("machine_failure").collect()
    assert scored[1]["s"] - scored[0]["s"] > 0.3
    model.write().save(str(tmp_path / "m"))
    again = T.score(PipelineModel.load(str(tmp_path / "m")), rows, "again").join(T.score(model, rows), "event_id")
    assert again.filter("score <> again").count() == 0


def test_labels_and_features_are_checked(rows, monkeypatch):
    monkeypatch.setattr(T, "SPARK_ML_ROWS", 0)
    for broken in (rows.withColumn("machine_failure", F.col("machine_failure") * 2),
                   rows.withColumn("x0", F.lit(float("nan")))):
        with pytest.raises(Exception, match="must"):
            T.train(broken, COLUMNS, T.Boosting(trees=2), oversample=False)


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "far"])
def test_closest_equals_measuring_all(kind):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(700, 20)) * rng.choice([1, 100, 1e5], 20)
    if kind == "ties":
        pts = rng.integers(0, 2, pts.shape).astype(float)
    if kind == "copies":
        pts[::2] = pts[1::2]
    if kind == "far":
        pts = pts * 1e-3 + 1e8
    ids, q = rng.permutation(len(pts)), pts[::5]
    dist = O.squared_distances(q, pts)
    order = np.array([np.lexsort((ids, d))[:6] for d in dist])
    d2, nn = O.closest(q, pts, ids, 6)
    assert (d2 == np.take_along_axis(dist, order, 1)).all() and (nn == ids[order]).all()


def test_closest_measures_few_pairs(monkeypatch):
    """Only candidates are measured column by column."""
    pts = np.random.default_rng(4).normal(size=(600, 8))
    monkeypatch.setattr(O, "squared_distances", None)
    d2, nn = O.closest(pts[:50], pts, np.arange(600), 3)
    assert (nn[:, 0] == np.arange(50)).all() and (d2[:, 0] == 0).all()


def test_late_base_points_give_the_same_rows(spark, rows, monkeypatch):
    def made():
        return sorted(map(tuple, O.synthetic_rows(rows, COLUMNS).collect()))

    wanted = made()
    monkeypatch.setattr(O, "NARROW_ROWS", 0)
    assert wanted and made() == wanted


def test_large_tables_are_staged_compressed(spark, rows):
    small, large = staged_by_size(rows, 4000), staged_by_size(rows, 10_000_000)
    assert not small.inputFiles() and large.inputFiles() and large.dtypes == rows.dtypes
    assert large.exceptAll(rows).count() == 0 and rows.exceptAll(large).count() == 0
    unstage(small)
    unstage(large)
    with pytest.raises(Exception):
        large.collect()
    assert small.count() == 4000
