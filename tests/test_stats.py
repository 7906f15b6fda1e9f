import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearsight.operators import evaluate as E
from gearsight.operators import profile as P
from gearsight.operators import features, stats
from gearsight.operators.stats import quantiles


@pytest.fixture(scope="module")
def values(spark):
    # g = 1 has half of its values equal; b has nulls
    return spark.range(4000).select(
        (F.col("id") % 2).alias("g"), F.when((F.col("id") % 4) == 1, 7.0).otherwise((F.col("id") * 7919 % 1009) / 3).alias("a"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 31 % 257 / 7).alias("b")).persist()


@pytest.mark.parametrize("parts", [65_536, 3])
def test_quantiles_exact(values, monkeypatch, parts):
    monkeypatch.setattr(stats, "PARTS", parts)
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles(values, ["a", "b"], qs, ["g"])
    pdf = values.toPandas()
    for g in (0, 1):
        for c in ("a", "b"):
            want = pdf[pdf.g == g][c].quantile(qs)
            for q in qs:
                assert got[(g, c)][q] == pytest.approx(want[q], abs=1e-9), (parts, g, c, q)


def test_quantiles_of_one_value(spark):
    df = spark.range(100).select(F.lit(3.0).alias("a"))
    assert quantiles(df, ["a"], [0.25, 0.75]) == {("a",): {0.25: 3.0, 0.75: 3.0}}


def test_quantiles_of_every_magnitude(spark):
    """Neighbouring doubles, subnormal and huge ones, both signs, infinities: each order statistic is found exactly."""
    base = [0.0, -0.0, 5e-324, 1e-320, 2.0 ** -1022, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 1e308, math.inf]
    base += [float(x) for x in np.float64(65_000) + np.arange(40) * np.spacing(65_000.0)]
    rows = sorted(float(x) for x in base + [-x for x in base])
    df = spark.createDataFrame([(x,) for x in rows], "a double").repartition(5)
    qs = [i / (len(rows) - 1) for i in range(len(rows))]
    got = quantiles(df, ["a"], qs)[("a",)]
    for i, q in enumerate(qs):
        rank = q * (len(rows) - 1)
        low, high = rows[int(rank)], rows[min(int(rank) + 1, len(rows) - 1)]
        assert got[q] == low or low <= got[q] <= high or not np.isfinite(high - low)
        if rank == int(rank):
            assert got[q] == rows[int(rank)]


def test_quantiles_of_odd_columns(spark):
    df = spark.range(200).select(
        F.lit(None).cast("double").alias("none"), (F.col("id") % 2 * 5.0).alias("two"),
        F.when(F.col("id") % 10 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("some"))
    got = quantiles(df, ["none", "two", "some"], [0.25, 0.95, 1.0])
    assert got[("none",)] == {0.25: None, 0.95: None, 1.0: None}
    assert got[("two",)] == {0.25: 0.0, 0.95: 5.0, 1.0: 5.0}
    values = sorted(float(i) for i in range(200) if i % 10)
    want = values[49] + (values[50] - values[49]) * 0.75
    assert got[("some",)][0.25] == pytest.approx(want)
    assert all(got[("some",)][q] != got[("some",)][q] for q in (0.95, 1.0))
    assert quantiles(df.limit(0), ["two"], [0.5]) == {("two",): {0.5: None}}


def test_quantiles_of_groups_without_values_or_name(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, None), (2, 7.0), (2, None)], "g int, a double")
    assert quantiles(df, ["a"], [0.5], ["g"]) == {(None, "a"): {0.5: 2.0}, (1, "a"): {0.5: None}, (2, "a"): {0.5: 7.0}}


def test_a_pass_sends_one_row_per_bucket_to_the_shuffle(spark):
    """Counting happens before the shuffle, and no window is without partition."""
    df = spark.range(1000).select((F.col("id") % 50).cast("double").alias("a"))
    seen = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self)
        quantiles(df, ["a"], [0.5])
    finally:
        type(df).collect = collect
    assert seen and all("partial_count" in plan and "SinglePartition" not in plan for plan in seen)


def test_reports_of_a_column_without_values(spark):
    df = spark.range(50).select(F.lit(None).cast("double").alias("rpm"), F.col("id").cast("double").alias("torque"))
    rows = {r["column"]: r for r in P.describe_columns(df, ["rpm", "torque"]).collect()}
    flags = features.iqr_flags(df).agg(F.max("rpm_outlier_flag"), F.max("torque_outlier_flag")).first()
    assert rows["rpm"]["q50"] is None and rows["torque"]["q50"] == 24.5
    assert tuple(flags) == (0, 0)


def test_right_closed_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (50.0, 0), (50.1, 0), (-300.0, 1), (300.0, 0)], "d double, machine_failure int")
    got = {r["bucket"]: r["n"] for r in P.bucket_rate(df, "d", [-300, 0, 50, 100, 150, 300]).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 4: 1}


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.999,), (1.0,), (1.2,)], "s double")
    got = {r["bin"]: r["n"] for r in P.histogram(df, "s", 20, 0.0, 1.0).collect()}
    assert got[0] == 1 and got[1] == 1 and got[19] == 2 and sum(got.values()) == 4 and len(got) == 20


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (3.0, 5.0, 1)], "x double, k double, machine_failure int")
    got = {r["column"]: r["r"] for r in P.target_correlation(df, ["x", "k"]).collect()}
    assert got["k"] is None and got["x"] == pytest.approx(0.8660254)
    env = {r["field"]: r["correlation"] for r in P.env_correlation(df, ["x", "k"], "machine_failure").collect()}
    assert env["k"] == 0.0


def test_repeated_quantile_edges_merge(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("double").alias("p"), F.col("id").cast("double").alias("x"),
                                 F.lit(0).alias("machine_failure"))
    grid = P.interaction_grid(df, "x", "p").collect()
    assert {r["bin_b"] for r in grid} == {0, 1} and sum(r["n"] for r in grid) == 100


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert P.duplicate_count(df).first()[0] == 2


def score_frame(spark, pairs):
    return spark.createDataFrame(pairs, "machine_failure int, score double")


def test_tied_scores(spark):
    df = score_frame(spark, [(0, 0.3), (1, 0.3), (0, 0.3), (1, 0.3)])
    assert E.roc_auc(df).first()[0] == 0.5
    assert [tuple(r) for r in E.pr_curve(df).select("tp", "fp", "precision", "recall").collect()] == [(2, 2, 0.5, 1.0)]


def test_one_class_and_no_positives(spark):
    df = score_frame(spark, [(0, 0.1), (0, 0.2)])
    assert E.roc_auc(df).first()[0] is None
    m = E.binary_metrics(df, 0.9).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert E.class_report(df, 0.9).count() == 4


@pytest.mark.parametrize("stream_rows", [50_000, 7])
def test_curve_against_direct_count(spark, stream_rows):
    rng = np.random.RandomState(1)
    pairs = [(int(rng.rand() < 0.3), float(round(rng.rand(), 2))) for _ in range(500)]
    spark.conf.set("spark.gearsight.maxStreamRows", str(stream_rows))
    spark.conf.set("spark.gearsight.rowsPerBucket", "9")
    try:
        df = score_frame(spark, pairs)
        got = {r["threshold"]: (r["tp"], r["fp"]) for r in E.pr_curve(df).collect()}
        auc = E.roc_auc(df).first()[0]
        thin = E.roc_curve(df, points=20).collect()
    finally:
        spark.conf.unset("spark.gearsight.maxStreamRows")
        spark.conf.unset("spark.gearsight.rowsPerBucket")
    for t, (tp, fp) in got.items():
        assert tp == sum(y for y, s in pairs if s >= t) and fp == sum(1 - y for y, s in pairs if s >= t)
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    assert auc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    assert len(thin) == 20


def test_equal_width_rate_of_a_constant_column(spark):
    from gearsight.operators.profile import equal_width_rate

    rows = spark.createDataFrame([(5.0, 1), (5.0, 0), (5.0, 0), (None, 1)], "x double, machine_failure int")
    got = equal_width_rate(rows, "x").collect()
    assert [r.n for r in got] == [3] and got[0].bucket == 2 and got[0].lo < 5.0 < got[0].hi


@pytest.mark.parametrize("share", [0.3, 0.7])
def test_stratified_split_takes_the_share(spark, share):
    from gearsight.operators.split import stratified_split

    rows = spark.range(1000).selectExpr("id AS event_id", "CAST(id % 10 = 0 AS int) AS machine_failure")
    got = {(r.machine_failure, r.split): r["count"] for r in stratified_split(rows, share).groupBy(
        "machine_failure", "split").count().collect()}
    assert got[1, "test"] == round(100 * share) and got[0, "test"] == round(900 * share)
    with pytest.raises(ValueError):
        stratified_split(rows, 1.0)


def test_density_does_not_multiply_rows(spark):
    rows = spark.range(5000).repartition(4).select(
        (F.col("id") % 7 == 0).cast("int").alias("machine_failure"), (F.col("id") * 37 % 501 / 10).alias("v"))
    made = P.kde_by_class(rows, "v", 50, 0.3)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    pdf, got = rows.toPandas(), made.toPandas()
    assert len(got) == 100
    for label in (0, 1):
        v = pdf[pdf.machine_failure == label]["v"].to_numpy()
        part = got[got.machine_failure == label].sort_values("grid")
        x, bw = np.linspace(v.min(), v.max(), 50), 0.3 * v.std(ddof=1)
        want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * np.sqrt(2 * np.pi))
        assert part["x"].to_numpy() == pytest.approx(x) and part["density"].to_numpy() == pytest.approx(want)
