"""Training, out-of-fold scoring, calibration, ablation."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators import boosting
from gearsight.operators import evaluate as E
from gearsight.operators.clean import filled
from gearsight.operators.oversample import smote
from gearsight.operators.split import chrono_split, stratified_folds, stratified_split
from gearsight.plans import serving, stages
from gearsight.sources.staging import staged


#: Rows of a training matrix that one task holds while there are idle cores. A tree level is a job in which every task sends
#: the statistics of all its nodes and bins, so a small table in many tasks takes longer (measured, 152,620 rows of 59 columns
#: and 6 trees: 15.9 core seconds in 7 tasks, 10.4 in 4), and more tasks than cores only add their fixed cost.
ROWS_PER_TASK = 50_000
#: Rows that one task may hold at all.
MOST_ROWS_PER_TASK = 1_000_000
#: Fits that run side by side; each keeps its binned rows on the executors.
FITS = 6
#: Rows up to which Spark ML's booster fits. With two tasks at most its sums, and so its splits, do not depend on the order in
#: which tasks end; beyond, ``boosting`` counts the same levels on packed codes, in a fixed order.
SPARK_ML_ROWS = 2 * ROWS_PER_TASK
#: Bytes of binned rows that fits side by side may keep. A larger fit keeps all cores busy by itself.
BINNED_BYTES = 4 << 30


def tasks_for(rows: int, cores: int) -> int:
    """Tasks of a fit: no more than it has work for, then one per core, then whole rounds of them."""
    if rows <= cores * MOST_ROWS_PER_TASK:
        return max(1, min(math.ceil(rows / ROWS_PER_TASK), cores))
    return cores * math.ceil(rows / (cores * MOST_ROWS_PER_TASK))


def fits_at_once(rows: int, columns: int) -> int:
    """Fits of ``rows`` rows that may run together; a binned row takes 4 bytes a column and some 100 around them."""
    return max(1, min(FITS, BINNED_BYTES // (max(1, rows) * (4 * columns + 100))))


def side_by_side(jobs: list[Callable[[], Any]], at_once: int = FITS) -> list[Any]:
    """Results of independent Spark jobs, started together: a fit is a chain of short jobs that leaves most cores idle."""
    in_session = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(in_session(job)) for job in jobs]]


@dataclass(frozen=True)
class Boosting:
    """Booster settings (defaults: the regularised production model)."""
    trees: int = 150
    step: float = 0.05
    depth: int = 6
    min_rows: int = 50
    row_share: float = 0.8
    column_share: str = "0.8"
    balance: bool = False
    seed: int = 42


def gbt_pipeline(features: list[str], params: Boosting = Boosting(), label: str = C.TARGET) -> Pipeline:
    """Assembler plus gradient-boosted trees; column sampling is per node, rows per tree."""
    gbt = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=params.trees, stepSize=params.step, maxDepth=params.depth,
        minInstancesPerNode=params.min_rows, subsamplingRate=params.row_share,
        featureSubsetStrategy=params.column_share, seed=params.seed)
    if params.balance:
        gbt = gbt.setWeightCol("_weight")
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, gbt])


def with_class_weights(df: DataFrame, label: str = C.TARGET) -> DataFrame:
    """Weights that give both classes the same total."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    return df.withColumn("_weight", X.lookup(F.col(label), {k: total / (len(counts) * n) for k, n in counts.items()}))


def train(df: DataFrame, features: list[str], params: Boosting = Boosting(), oversample: bool = True,
          label: str = C.TARGET) -> PipelineModel:
    """Fit on ``df``; oversampling, when asked for, sees these rows only.

    A small training matrix is dealt evenly and staged in that form: the booster passes over it once per tree level, and the
    tasks of these short jobs carry no plan behind the staged rows. Of a large one only the bins are staged.
    """
    rows = filled(df, features)
    counts = [r["count"] for r in df.groupBy(label).count().collect()]
    n = 2 * max(counts) if oversample and len(counts) == 2 else sum(counts)
    pipeline = gbt_pipeline(features, params, label)
    if n > SPARK_ML_ROWS:
        rows = smote(rows, features, label=label) if oversample else rows.select("event_id", *features, label)
        if params.balance:
            rows = with_class_weights(rows, label)
        row_id = ["event_id", "copy"] if oversample else ["event_id"]
        assembler, gbt = pipeline.getStages()
        model = boosting.fit(gbt, rows, features, label, row_id, n, "_weight" if params.balance else None)
        return PipelineModel([assembler, model])
    rows = smote(rows, features, label=label).select(*features, label) if oversample else rows.select(*features, label)
    if params.balance:
        rows = with_class_weights(rows, label)
    tasks = tasks_for(n, df.sparkSession.sparkContext.defaultParallelism)
    return pipeline.fit(staged(rows.repartition(tasks)))


def score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Failure probability per row."""
    features = model.stages[0].getInputCols()
    out = model.transform(filled(df, features))
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction")


def _fold_scores(folds: DataFrame, features: list[str], fold: int, params: Boosting, oversample: bool) -> DataFrame:
    model = train(folds.filter(F.col("fold") != fold), features, params, oversample)
    return score(model, folds.filter(F.col("fold") == fold)).select("event_id", "fold", C.TARGET, "score")


def _fitted_rows(df: DataFrame, oversample: bool) -> int:
    """Rows of a fit on all of ``df``, at most."""
    return df.count() * (2 if oversample else 1)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def oof_scores(df: DataFrame, features: list[str], k: int = 5, params: Boosting = Boosting(),
               oversample: bool = True) -> DataFrame:
    """Each row scored by a model that never saw it; oversampling happens inside the training part.

    The rows are staged once; a fold is a filter on them, and the folds are fitted side by side.
    """
    folds = staged(stratified_folds(df, k))
    at_once = fits_at_once(_fitted_rows(folds, oversample), len(features))
    return _union(side_by_side([lambda i=i: _fold_scores(folds, features, i, params, oversample) for i in range(k)], at_once))


def calibrate_and_seal(df: DataFrame, features: list[str], path: str, k: int = 5,
                       params: Boosting = Boosting(), oversample: bool = True) -> DataFrame:
    """Out-of-fold scores -> best-F1 threshold -> final fit on all rows -> saved artifact. Returns the report.

    The final fit needs no threshold, so it runs beside the folds.
    """
    folds = staged(stratified_folds(df, k))
    jobs = [lambda i=i: _fold_scores(folds, features, i, params, oversample) for i in range(k)]
    at_once = fits_at_once(_fitted_rows(folds, oversample), len(features))
    *parts, model = side_by_side([*jobs, lambda: train(folds, features, params, oversample)], at_once)
    scores = staged(_union(parts))
    best = E.best_threshold(scores).first()
    serving.seal(model, path, best["threshold"])
    return E.class_report(scores, best["threshold"]).withColumn("threshold", F.lit(best["threshold"]))


# fixed values: settings and decision thresholds of the tuned ablation
TUNED = {
    "alpha": (dict(trees=100, step=0.05, balance=True), 0.35),
    "beta": (dict(trees=100, step=0.05, balance=True), 0.38),
    "gamma": (dict(trees=150, step=0.04, depth=5, min_rows=15), 0.22),
    "delta": (dict(trees=150, step=0.03, depth=3, min_rows=12, row_share=0.8), 0.21),
}


def ablation(readings: DataFrame, mode: str = "strict", names: list[str] = stages.STAGES,
             trees: int | None = None) -> DataFrame:
    """One metrics row per feature stage.

    ``leaky``  failure modes among the inputs, random stratified split, oversampling;
    ``strict`` leak-free inputs, chronological split, oversampling;
    ``tuned``  as strict with per-stage settings and thresholds, without oversampling.
    """
    if mode not in ("leaky", "strict", "tuned"):
        raise ValueError(f"unknown mode {mode!r}")
    def one(name: str) -> DataFrame:
        table = stages.build(readings, name)
        features = stages.model_columns(table, leaky=mode == "leaky")
        split = stratified_split(table) if mode == "leaky" else chrono_split(table)
        rows = staged(split.select("event_id", "split", C.TARGET, *features))
        options, threshold = TUNED[name] if mode == "tuned" else (dict(trees=100), 0.5)
        if trees is not None:
            options = {**options, "trees": trees}
        model = train(rows.filter(F.col("split") == "train"), features, Boosting(**options), mode != "tuned")
        tested = score(model, rows.filter(F.col("split") == "test"))
        return E.binary_metrics(tested, threshold).select(
            F.lit(name).alias("stage"), F.lit(len(features)).alias("n_features"),
            "accuracy", "precision", "recall", "f1")

    # the widest stage has some 150 columns
    at_once = fits_at_once(_fitted_rows(readings, mode != "tuned"), 150)
    return _union(side_by_side([lambda name=name: one(name) for name in names], at_once))
