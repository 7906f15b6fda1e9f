"""Binary-classification curves and metrics over a scored table (label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.ordering import Order, Series
from gearsight.operators.split import thin
from gearsight.sources.staging import staged


def score_groups(df: DataFrame, score: str = "score", label: str = C.TARGET, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score; combined map-side before the shuffle."""
    return df.groupBy(*(by or []), F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def cumulative(df: DataFrame, score: str = "score", label: str = C.TARGET, by: list[str] | None = None) -> DataFrame:
    """True and false positives when everything at or above a threshold is called positive.

    The counts per score are staged: scoring the rows is the expensive part and happens once.
    """
    by = by or []
    groups = staged(score_groups(df, score, label, by)).withColumn("_desc", -F.col("threshold"))
    out = Series(groups, by, ["_desc"]).running_sums(groups, {"tp": "pos", "fp": "neg"})
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if by:
        return out.join(totals, by)
    both = totals.select(F.struct("n_pos", "n_neg")).scalar()
    return out.withColumn("_t", both).withColumns({"n_pos": F.col("_t.n_pos"), "n_neg": F.col("_t.n_neg")}).drop("_t")


def pr_curve(df: DataFrame, score: str = "score", label: str = C.TARGET, by: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score (per ``by`` group)."""
    points = cumulative(df, score, label, by)
    return points.select(*(by or []), "threshold", "tp", "fp",
                         X.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                         F.coalesce(X.ratio(F.col("tp"), F.col("n_pos")), F.lit(0.0)).alias("recall"))


def roc_curve(df: DataFrame, score: str = "score", label: str = C.TARGET, points: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score (collinear points kept), optionally thinned."""
    curve = cumulative(df, score, label)
    out = curve.select("threshold", "_desc", X.ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
                       X.ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    if points is None:
        return out.drop("_desc")
    order = Order(out, ["_desc"])
    return thin(order.with_position("position"), "position", order.n_rows, points).drop("_desc")


def roc_auc(df: DataFrame, score: str = "score", label: str = C.TARGET) -> DataFrame:
    """Probability that a failure outranks a healthy row, ties counting half."""
    points = cumulative(df, score, label)
    wins = F.col("pos") * (F.col("n_neg") - F.col("fp")) + F.col("pos") * F.col("neg") / 2
    return points.agg(X.ratio(F.sum(wins), F.max("n_pos").cast("double") * F.max("n_neg")).alias("roc_auc"))


def best_threshold(df: DataFrame, score: str = "score", label: str = C.TARGET) -> DataFrame:
    """Threshold of the highest F1; ties go to the lowest threshold."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * (p * r) / (p + r + 1e-10)
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                    F.struct(F.round("f1", 9), -F.col("threshold")))
    return pr_curve(df, score, label).withColumn("f1", f1).agg(best.alias("b")).select("b.*")


def confusion(predicted: Column, label: Column) -> dict[str, Column]:
    hit = lambda y, p: F.count_if((label == y) & (predicted == p))
    return {"tn": hit(0, 0), "fp": hit(0, 1), "fn": hit(1, 0), "tp": hit(1, 1)}


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from confusion counts; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda num, den: F.coalesce(X.ratio(num, den), F.lit(0.0))
    return df.withColumns({
        "accuracy": zero(tp + tn, tp + tn + fp + fn), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn),
        "f1": zero(2 * tp, 2 * tp + fp + fn)})


def binary_metrics(df: DataFrame, threshold: float, score: str = "score", label: str = C.TARGET,
                   by: list[str] | None = None) -> DataFrame:
    predicted = (F.col(score) >= threshold).cast("int")
    counts = confusion(predicted, F.col(label))
    return with_rates(df.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in counts.items()]))


def class_report(df: DataFrame, threshold: float, score: str = "score", label: str = C.TARGET) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    m = binary_metrics(df, threshold, score, label)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda num, den: F.coalesce(X.ratio(num, den), F.lit(0.0))

    def entry(name, hit, wrong, missed):
        return F.struct(F.lit(name).alias("class"), zero(hit, hit + wrong).alias("precision"),
                        zero(hit, hit + missed).alias("recall"),
                        zero(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))

    one = m.select(entry("Stable", tn, fn, fp).alias("a"), entry("Failure", tp, fp, fn).alias("b"))

    def average(name, wa, wb):
        total = wa + wb
        mean = lambda f: zero(F.col(f"a.{f}") * wa + F.col(f"b.{f}") * wb, total).alias(f)
        return F.struct(F.lit(name).alias("class"), mean("precision"), mean("recall"), mean("f1"),
                        (F.col("a.support") + F.col("b.support")).alias("support"))

    rows = F.array("a", "b", average("macro avg", F.lit(1), F.lit(1)),
                   average("weighted avg", F.col("a.support"), F.col("b.support")))
    return one.select(F.inline(rows))


def score_spread(df: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """Is the score spread out, or does everything fall in one class?"""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                  F.avg(score).alias("mean_score"), F.count_if(F.col(score) >= threshold).alias("n_predicted_failure"),
                  F.count_if(F.col(score) < threshold).alias("n_predicted_stable"))
