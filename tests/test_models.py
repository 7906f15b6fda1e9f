import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paths import SMALL
from gearsight.functions import constants as C
from gearsight.operators import evaluate as E
from gearsight.operators import explain as EX
from gearsight.operators import features as FE
from gearsight.operators import split as SP
from gearsight.plans import stages
from gearsight.plans import training as T
from gearsight.sources import io
from gearsight.sources import telemetry as S
from gearsight.sources.schema import CSV_NAMES, CSV_SCHEMA, RAW_SCHEMA

FEATURES = [*C.SENSORS, "power", "temp_diff", "strain_index"]
SMALL_TREES = T.Boosting(trees=5, step=0.3, depth=3, min_rows=5)


@pytest.fixture(scope="module")
def rows(spark):
    return FE.physics_features(S.telemetry(spark, SMALL)).persist()


@pytest.fixture(scope="module")
def model(rows):
    return T.train(rows, FEATURES, SMALL_TREES)


def test_model_beats_chance(rows, model):
    assert E.roc_auc(T.score(model, rows)).first()[0] > 0.8


def test_attribution_adds_up(rows, model):
    got = EX.row_drivers(model, rows, k=len(FEATURES))
    raw = model.transform(rows).select("event_id", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("raw"))
    joined = got.join(raw, "event_id").withColumn(
        "total", F.aggregate("top_drivers", F.lit(0.0), lambda a, d: a + d["impact"]))
    worst = joined.agg(F.max(F.abs(F.col("margin") - F.col("raw"))), F.max(F.abs(F.col("base") + F.col("total") - F.col("margin")))).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9


def random_tree(rng, features, depth):
    """Arrays of a tree whose paths may split on a feature twice, and the rows that reached each node."""
    nodes = []

    def grow(level, cover):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rng.normal(), cover])
        if level < depth and cover > 1 and rng.random() < 0.9:
            left = int(rng.integers(1, cover))
            nodes[at][:2] = int(rng.integers(features)), rng.normal()
            nodes[at][2] = grow(level + 1, left)
            nodes[at][3] = grow(level + 1, cover - left)
        return at

    grow(0, 200)
    f, t, left, right, value, cover = map(np.array, zip(*nodes))
    return EX.Tree(float(rng.random()), f, t, left, right, value, cover)


def brute_shapley(tree, x):
    """Mean marginal effect over all orders of the features, by the expectation of the tree for each known set."""
    from itertools import permutations

    def mean(known, node=0):
        if tree.left[node] < 0:
            return tree.weight * tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return mean(known, a if x[tree.feature[node]] <= tree.threshold[node] else b)
        return (tree.cover[a] * mean(known, a) + tree.cover[b] * mean(known, b)) / tree.cover[node]

    orders = list(permutations(range(len(x))))
    out = np.zeros(len(x))
    for order in orders:
        for i, f in enumerate(order):
            out[f] += (mean(set(order[:i + 1])) - mean(set(order[:i]))) / len(orders)
    return out, mean(set())


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    trees, x = [random_tree(rng, 4, 5) for _ in range(3)], rng.normal(size=(8, 4))
    impact, base = EX.shapley_values(trees, x)
    for row, got in zip(x, impact):
        wants = [brute_shapley(t, row) for t in trees]
        assert got == pytest.approx(sum(w for w, _ in wants)) and base == pytest.approx(sum(b for _, b in wants))


def test_shapley_values_by_hand():
    # two features, equal branches: the first split is worth 1 each way, the second half of its branch
    tree = EX.Tree(1.0, np.array([0, -1, 1, -1, -1]), np.array([0.5, 0, 3.0, 0, 0]), np.array([1, -1, 3, -1, -1]),
                   np.array([2, -1, 4, -1, -1]), np.array([0, 0.0, 0, 2.0, 4.0]), np.array([8, 4, 4, 2, 2]))
    impact, base = EX.shapley_values([tree], np.array([[0.5, 9.0], [0.6, 3.0], [0.6, 4.0]]))
    assert base == pytest.approx(1.5)
    assert impact.tolist() == [pytest.approx([-1.75, 0.25]), pytest.approx([1.25, -0.75]), pytest.approx([1.75, 0.75])]


def test_drivers_of_rows_with_missing_features(rows, model):
    holes = rows.limit(5).withColumn(FEATURES[0], F.lit(None).cast("double"))
    assert EX.row_drivers(model, holes).filter("size(top_drivers) > 0").count() == 5


def test_range_drivers_mean(rows, model):
    per_row = EX.row_drivers(model, rows, k=len(FEATURES)).select(F.explode("top_drivers").alias("d"))
    want = {r[0]: r[1] for r in per_row.groupBy("d.feature").agg(F.avg(F.abs("d.impact"))).collect()}
    got = EX.range_drivers(model, rows, 5).collect()
    assert len(got) == 5 and all(r["avg_abs_impact"] == pytest.approx(want[r["feature"]]) for r in got)


def test_out_of_fold_covers_every_row_once(rows):
    out = T.oof_scores(rows, FEATURES, 3, SMALL_TREES)
    assert out.count() == 1000 and out.select("event_id").distinct().count() == 1000


def test_calibrate_and_load(rows, tmp_path):
    path = str(tmp_path / "artifact")
    report = T.calibrate_and_seal(rows, FEATURES, path, 2, SMALL_TREES)
    threshold = report.first()["threshold"]
    model, loaded, names = io.load_artifact(path)
    assert loaded == threshold and names == FEATURES
    assert T.score(model, rows).filter(F.col("score").between(0, 1)).count() == 1000


def test_class_weights(rows):
    out = T.with_class_weights(rows).groupBy(C.TARGET).agg(F.sum("_weight").alias("w")).collect()
    assert out[0]["w"] == pytest.approx(out[1]["w"])


@pytest.mark.parametrize("stage,strict,leaky", [("alpha", 5, 11), ("beta", 49, 55), ("gamma", 117, 123), ("delta", 140, 146)])
def test_stage_columns(spark, stage, strict, leaky):
    table = stages.build(S.telemetry(spark, SMALL), stage)
    assert len(stages.model_columns(table)) == strict and len(stages.model_columns(table, leaky=True)) == leaky
    assert not set(stages.model_columns(table)) & {*C.MODES, C.TARGET}


def test_ablation_row(spark):
    out = T.ablation(S.telemetry(spark, SMALL), "strict", ["alpha"], trees=3).collect()
    assert len(out) == 1 and out[0]["n_features"] == 5 and 0 <= out[0]["accuracy"] <= 1
    with pytest.raises(ValueError):
        T.ablation(S.telemetry(spark, SMALL), "other")


@pytest.mark.parametrize("parts", [1, 7])
def test_splits_do_not_depend_on_partitions(spark, rows, parts):
    spark.conf.set("spark.gearsight.rowsPerBucket", "100")
    try:
        moved = rows.repartition(parts)
        folds = SP.stratified_folds(moved)
        sizes = {(r["machine_failure"], r["fold"]): r["count"] for r in folds.groupBy("machine_failure", "fold").count().collect()}
        for y in (0, 1):
            per_fold = [sizes[(y, f)] for f in range(5)]
            assert max(per_fold) - min(per_fold) <= 1
        assert SP.chrono_split(moved).filter("split = 'train'").count() == 800
        sample = {r["event_id"] for r in SP.hash_sample(moved, 50).collect()}
    finally:
        spark.conf.unset("spark.gearsight.rowsPerBucket")
    assert sample == {r["event_id"] for r in SP.hash_sample(rows, 50).collect()} and len(sample) == 50


def test_csv_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(1, "M14860", "M", 298.1, 308.6, 1551.0, 42.8, 0.0, 0, 0, 0, 0, 0, 0)], RAW_SCHEMA)
    header = {v: k for k, v in CSV_NAMES.items()}
    path = str(tmp_path / "csv")
    io.write_stage(raw.select([F.col(c).alias(header[c]) for c in raw.columns]), path, fmt="csv")
    back = io.read_telemetry(spark, path, "csv")
    assert back.columns == raw.columns and back.collect() == raw.collect()
    assert CSV_SCHEMA.names[3] == "Air temperature [K]"


def test_stage_partitions_prune(spark, rows, tmp_path):
    path = str(tmp_path / "stage")
    io.write_stage(rows.withColumn("day", F.to_date("ts")), path, ["day"])
    back = io.read_telemetry(spark, path)
    assert back.count() == 1000
    plan = back.filter(F.col("day") == F.lit("2024-01-05").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_report_round_trip(spark, tmp_path):
    io.write_report(spark.createDataFrame([("a", 1.5)], "metric string, value double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["value"] == 1.5


def test_insight_bundle(spark, rows, model, tmp_path):
    from gearsight.operators.fusion import synthetic_context
    from gearsight.plans.insights import global_insights, write_insights
    reports = global_insights(synthetic_context(S.rule_score(rows)), model)
    write_insights(reports, str(tmp_path))
    assert set(reports) == {"metrics", "roc_auc", "roc_curve", "probability_histogram", "failure_type_counts",
                            "score_spread", "env_correlation", "feature_importance"}
    assert sum(r["n"] for r in spark.read.json(str(tmp_path / "probability_histogram")).collect()) == 1000


def test_reason_from_driver(spark):
    from gearsight.operators.fleet import explain_reason
    df = spark.createDataFrame([(0, 1, 0, 1, "torque"), (0, 0, 0, 0, "tool_wear_zscore"), (0, 0, 0, 0, "rpm_mean_5"),
                                (0, 0, 0, 0, None), (0, 0, 0, 0, "power_per_temp")],
                               "twf_risk_flag int, hdf_risk_flag int, pwf_risk_flag int, osf_risk_flag int, top string")
    got = [(r["primary_reason"], r["recommended_action"], r["active_risk_flags"]) for r in explain_reason(df, "top").collect()]
    assert got[0] == (C.REASONS["hdf_risk_flag"], C.ACTIONS["hdf_risk_flag"], ["hdf_risk_flag", "osf_risk_flag"])
    assert got[1][1] == C.ACTIONS["tool_wear"] and "'tool_wear_zscore'" in got[1][0]
    assert got[2][1] == C.NO_ACTION and got[3][:2] == (C.NOMINAL_REASON, C.NOMINAL_ACTION)
    assert got[4][1] == C.ACTIONS["power"]


def test_checkpoint_folder_comes_from_the_session(spark):
    from gearsight.sources.staging import scratch, shared_dir
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.conf.get("spark.checkpoint.dir").split(":")[-1] in spark.sparkContext.getCheckpointDir()
    assert scratch(spark, "x").startswith(shared_dir(spark))


@pytest.mark.parametrize("name,trees,columns", [
    ("gbt_metrics", 150, 59), ("oof_scores", 150, 59), ("calibrate", 150, 59), ("robustness_model", 150, 59),
    ("feature_importance", 150, 59), ("ablation_leaky", 100, 11), ("ablation_strict", 100, 5), ("ablation_tuned", 100, 5)])
def test_queries_fit_in_full(spark, monkeypatch, name, trees, columns):
    """What a registered query asks of its first fit: all trees of the preset, all columns."""
    from gearsight.plans import registry

    registry.load_all()

    class Asked(Exception):
        pass

    def fitted(features, params=T.Boosting(), label=C.TARGET):
        raise Asked(len(features), params.trees)

    monkeypatch.setattr(T, "gbt_pipeline", fitted)
    with pytest.raises(Asked) as asked:
        registry.QUERIES[name](spark, SMALL)
    assert asked.value.args == (columns, trees)


def test_a_fit_has_no_more_tasks_than_cores(spark, rows, monkeypatch):
    seen = []

    class Fit:
        def fit(self, matrix):
            seen.append((matrix.rdd.getNumPartitions(), matrix.count()))

    monkeypatch.setattr(T, "gbt_pipeline", lambda *a: Fit())
    monkeypatch.setattr(T, "ROWS_PER_TASK", 10)
    T.train(rows, FEATURES, SMALL_TREES)
    T.train(rows, FEATURES, SMALL_TREES, oversample=False)
    stable = rows.filter("machine_failure = 0").count()
    assert seen == [(spark.sparkContext.defaultParallelism, 2 * stable), (spark.sparkContext.defaultParallelism, 1000)]


def test_fits_share_the_cluster():
    assert [T.tasks_for(n, 12) for n in (0, 1, 150_000, 9_000_000, 13_000_000)] == [1, 1, 3, 12, 24]
    assert [T.fits_at_once(n, 59) for n in (0, 150_000, 2_000_000, 9_000_000)] == [6, 6, 6, 1]
