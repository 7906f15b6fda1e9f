"""Splits, oversampling, curves, metrics, noise tests and boosted-tree models."""

from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.operators import evaluate as E
from gearsight.operators import explain as EX
from gearsight.operators import features as FE
from gearsight.operators import fleet as FL
from gearsight.operators import fusion as FU
from gearsight.operators import noise as N
from gearsight.operators import split as SP
from gearsight.operators import windows as W
from gearsight.operators.oversample import smote as oversample
from gearsight.plans import training as T
from gearsight.plans.fleet_queries import md5_sql
from gearsight.plans.registry import normal_sql, query, uniform_sql
from gearsight.plans.window_queries import STREAM
from gearsight.sources import telemetry as S
from gearsight.sources.staging import scratch, staged, staged_by_size, unstage


def digits(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


# --- splits and oversampling ---------------------------------------------------------------

_CHRONO = f"""SELECT *, CASE WHEN row_number() OVER ({STREAM}) <= CAST(floor(0.8e0 * (SELECT count(*) FROM events)) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split FROM telemetry"""


@query("chrono_split", f"SELECT event_id, machine_failure, split FROM ({_CHRONO})")
def chrono_split(spark, d):
    return SP.chrono_split(S.telemetry(spark, d)).select("event_id", C.TARGET, "split")


_FOLDS = f"""SELECT event_id, machine_failure, CAST((row_number() OVER (PARTITION BY machine_failure
  ORDER BY {md5_sql('event_id', 'fold')}, event_id) - 1) % 5 AS INTEGER) AS fold FROM telemetry"""


@query("stratified_folds", _FOLDS)
def stratified_folds(spark, d):
    return SP.stratified_folds(S.telemetry(spark, d)).select("event_id", C.TARGET, "fold")


def _split_sql(share: float) -> str:
    return f"""SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY machine_failure
  ORDER BY {md5_sql('event_id', 'fold')}, event_id) - 1 < floor({share}e0 * count(*) OVER (PARTITION BY machine_failure) + 0.5e0)
  THEN 'test' ELSE 'train' END AS split FROM telemetry"""


@query("stratified_split", _split_sql(0.2))
def stratified_split(spark, d):
    return SP.stratified_split(S.telemetry(spark, d)).select("event_id", "split")


@query("stratified_split_30", _split_sql(0.3))
def stratified_split_30(spark, d):
    return SP.stratified_split(S.telemetry(spark, d), 0.3).select("event_id", "split")


def _smote_sql() -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in C.SENSORS)
    draw = "concat_ws('-', base.event_id, copy)"
    return f"""WITH train AS (SELECT * FROM ({_CHRONO}) WHERE split = 'train'),
  minority AS (SELECT event_id, {', '.join(C.SENSORS)}, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM train
    WHERE machine_failure = 1),
  n AS (SELECT count(*) FILTER (WHERE machine_failure = 1) AS n_min,
    count(*) FILTER (WHERE machine_failure = 0) - count(*) FILTER (WHERE machine_failure = 1) AS n_new FROM train),
  near AS (SELECT a.event_id, b.event_id AS nn_id, row_number() OVER (PARTITION BY a.event_id ORDER BY {d2}, b.event_id) AS rank
    FROM minority a JOIN minority b ON a.event_id <> b.event_id),
  base AS (SELECT m.*, unnest(generate_series(0, n_new // n_min - 1 + CASE WHEN pos < n_new % n_min THEN 1 ELSE 0 END)) AS copy
    FROM minority m, n),
  drawn AS (SELECT base.*, CAST(floor({uniform_sql('neighbour', draw)} * 5) + 1 AS INTEGER) AS rank,
    {uniform_sql('step', draw)} AS u FROM base)
  SELECT d.event_id, d.copy, {', '.join(f'round(d.{c} + u * (m.{c} - d.{c}), 6) AS {c}' for c in C.SENSORS)}, 1 AS machine_failure
  FROM drawn d JOIN near USING (event_id, rank) JOIN minority m ON m.event_id = near.nn_id
  UNION ALL SELECT event_id, NULL, {', '.join(f'round({c}, 6)' for c in C.SENSORS)}, machine_failure FROM train"""


@query("smote", _smote_sql())
def smote(spark, d):
    train = SP.chrono_split(S.telemetry(spark, d)).filter(F.col("split") == "train")
    return digits(oversample(train, C.SENSORS), C.SENSORS)


# --- curves and metrics on the rule score ----------------------------------------------------

def _curve_sql(source: str) -> str:
    return f"""SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, pos, neg,
  CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg FROM (SELECT score AS threshold,
  sum(machine_failure) AS pos, sum(1 - machine_failure) AS neg FROM {source} GROUP BY score)
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)"""


_CURVE = _curve_sql("scored")


def _pr_sql(curve: str) -> str:
    return f"SELECT threshold, tp, fp, round(tp * 1e0 / (tp + fp), 9) AS precision, round(tp * 1e0 / n_pos, 9) AS recall FROM ({curve})"


@query("pr_curve", _pr_sql(_CURVE))
def pr_curve(spark, d):
    return digits(E.pr_curve(S.scored(spark, d)), ["precision", "recall"], 9)


@query("roc_curve", f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS position, count(*) OVER () AS n
    FROM ({_CURVE})) SELECT position, threshold, round(fp * 1e0 / n_neg, 9) AS fpr, round(tp * 1e0 / n_pos, 9) AS tpr
  FROM c WHERE position IN (SELECT (j * (n - 1)) // 59 FROM generate_series(0, 59) t(j)) OR n <= 60""")
def roc_curve(spark, d):
    return digits(E.roc_curve(S.scored(spark, d), points=60), ["fpr", "tpr"], 9)


@query("roc_curve_full", f"""SELECT threshold, round(fp * 1e0 / n_neg, 9) AS fpr, round(tp * 1e0 / n_pos, 9) AS tpr FROM ({_CURVE})""")
def roc_curve_full(spark, d):
    return digits(E.roc_curve(S.scored(spark, d)), ["fpr", "tpr"], 9)


@query("roc_auc", f"""SELECT round(sum(pos * (n_neg - fp) + pos * neg / 2e0) / (any_value(n_pos) * 1e0 * any_value(n_neg)), 9) AS roc_auc
  FROM ({_CURVE})""")
def roc_auc(spark, d):
    return digits(E.roc_auc(S.scored(spark, d)), ["roc_auc"], 9)


@query("best_threshold", f"""SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM
  (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-10) AS f1 FROM (SELECT threshold,
  tp * 1e0 / (tp + fp) AS precision, tp * 1e0 / n_pos AS recall FROM ({_CURVE}))) ORDER BY round(f1, 9) DESC, threshold LIMIT 1""")
def best_threshold(spark, d):
    return digits(E.best_threshold(S.scored(spark, d)), ["precision", "recall", "f1"], 9)


def _counts_sql(source: str, threshold: float) -> str:
    hit = lambda y, p: f"count(*) FILTER (WHERE machine_failure = {y} AND score {'>=' if p else '<'} {threshold}e0)"
    return f"SELECT {hit(0, 0)} AS tn, {hit(0, 1)} AS fp, {hit(1, 0)} AS fn, {hit(1, 1)} AS tp FROM {source}"


_RATES = """round((tp + tn) * 1e0 / (tp + tn + fp + fn), 9) AS accuracy,
  round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"""
_RATE_NAMES = ["accuracy", "precision", "recall", "f1"]


@query("binary_metrics", f"SELECT tn, fp, fn, tp, {_RATES} FROM ({_counts_sql('scored', 0.3)})")
def binary_metrics(spark, d):
    return digits(E.binary_metrics(S.scored(spark, d), 0.3), _RATE_NAMES, 9)


def _class_row(name: str, hit: str, wrong: str, missed: str) -> str:
    return f"""SELECT '{name}' AS "class", coalesce({hit} * 1e0 / nullif({hit} + {wrong}, 0), 0) AS precision,
  coalesce({hit} * 1e0 / nullif({hit} + {missed}, 0), 0) AS recall,
  coalesce(2e0 * {hit} / nullif(2 * {hit} + {wrong} + {missed}, 0), 0) AS f1, {hit} + {missed} AS support FROM m"""


@query("class_report", f"""WITH m AS ({_counts_sql('scored', 0.3)}),
  c AS ({_class_row('Stable', 'tn', 'fn', 'fp')} UNION ALL {_class_row('Failure', 'tp', 'fp', 'fn')}),
  r AS (SELECT * FROM c UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c)
  SELECT "class", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r""")
def class_report(spark, d):
    return digits(E.class_report(S.scored(spark, d), 0.3), ["precision", "recall", "f1"], 9)


@query("score_spread", """SELECT count(*) AS n, min(score) AS min_score, max(score) AS max_score, round(avg(score), 9) AS mean_score,
  count(*) FILTER (WHERE score >= 0.5e0) AS n_predicted_failure, count(*) FILTER (WHERE score < 0.5e0) AS n_predicted_stable FROM scored""")
def score_spread(spark, d):
    return digits(E.score_spread(S.scored(spark, d)), ["mean_score"], 9)


# --- noise ----------------------------------------------------------------------------------

def _noisy_sql(level: float) -> str:
    cols = ", ".join(f"{c} + {level}e0 * s_{c} * {normal_sql('noise-' + c)} AS {c}" for c in C.SENSORS)
    sds = ", ".join(f"stddev_samp({c}) AS s_{c}" for c in C.SENSORS)
    return f"SELECT event_id, type, machine_failure, {cols} FROM telemetry, (SELECT {sds} FROM telemetry)"


def _noisy_scored_sql(level: float) -> str:
    source = _noisy_sql(level) if level else "SELECT * FROM telemetry"
    return f"""SELECT event_id, machine_failure, round(1.0e0 / (1.0e0 + exp(-(-3.0e0
    + 2.5e0 * CASE WHEN process_temp - air_temp < 8.6e0 AND rpm < 1380 THEN 1 ELSE 0 END
    + 1.0e0 * CASE WHEN torque * rpm < 40000 OR torque * rpm > 80000 THEN 1 ELSE 0 END
    + 1.5e0 * CASE WHEN torque * tool_wear > CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 ELSE 13000 END THEN 1 ELSE 0 END
    + 1.0e0 * CASE WHEN tool_wear >= 200 THEN 1 ELSE 0 END + (torque - 42.5e0) / 20.0e0))), 6) AS score FROM ({source})"""


@query("inject_noise", f"SELECT event_id, {', '.join(f'round({c}, 6) AS {c}' for c in C.SENSORS)} FROM ({_noisy_sql(0.05)})")
def inject_noise(spark, d):
    return digits(N.inject_noise(S.telemetry(spark, d), C.SENSORS, 0.05), C.SENSORS).select("event_id", *C.SENSORS)


@query("robustness_report", " UNION ALL ".join(
    f"SELECT '{name}' AS tier, {level}e0 AS noise_level, {_RATES} FROM ({_counts_sql('(' + _noisy_scored_sql(level) + ')', 0.3)})"
    for name, level in C.NOISE_TIERS))
def robustness_report(spark, d):
    return digits(N.robustness_report(S.telemetry(spark, d), C.SENSORS, S.rule_score, 0.3), _RATE_NAMES, 9)


@query("noise_pr", " UNION ALL ".join(
    f"SELECT '{name}' AS tier, * FROM ({_pr_sql(_curve_sql('(' + _noisy_scored_sql(level) + ')'))})" for name, level in C.NOISE_TIERS))
def noise_pr(spark, d):
    return digits(N.noise_pr_curves(S.telemetry(spark, d), C.SENSORS, S.rule_score), ["precision", "recall"], 9)


# --- learned models ---------------------------------------------------------------------------

#: What the serving model reads: the reading, what follows from it alone, its context, and the buffer features.
CAUSAL = sorted([*C.SENSORS, "type_code", "power", "temp_diff", "torque_per_wear", "strain_index", "power_per_temp",
                 *C.RISK_FLAGS, "risk_score", *C.ENV_FIELDS, *W.CAUSAL_DERIVED])


def _readings(spark, d):
    return FU.fuse_environment(S.telemetry(spark, d), S.environment(spark, d))


def _causal(readings, by=None):
    return W.causal_features(FE.instant_features(readings), by)


def _rows(spark, d):
    return staged_by_size(_causal(_readings(spark, d)), S.events(spark, d).count())


def _fitted(spark, d):
    """(model on the first 80 %, all rows with their split mark)."""
    readings = _rows(spark, d)
    rows = staged_by_size(SP.chrono_split(readings), readings.count())
    unstage(readings)
    return T.train(rows.filter(F.col("split") == "train"), CAUSAL), rows


@query("gbt_score")
def gbt_score(spark, d):
    model, rows = _fitted(spark, d)
    out = FL.with_tier(T.score(model, rows.filter(F.col("split") == "test")))
    return out.select("event_id", "machine_id", C.TARGET, "score", "risk_tier")


@query("gbt_metrics")
def gbt_metrics(spark, d):
    model, rows = _fitted(spark, d)
    return E.binary_metrics(T.score(model, rows.filter(F.col("split") == "test")), 0.5)


@query("oof_scores")
def oof_scores(spark, d):
    return T.oof_scores(_rows(spark, d), CAUSAL)


@query("calibrate")
def calibrate(spark, d):
    return T.calibrate_and_seal(_rows(spark, d), CAUSAL, scratch(spark, "artifact"))


def _ablation(mode):
    def run(spark, d):
        return T.ablation(S.telemetry(spark, d), mode)
    return run


for _mode in ("leaky", "strict", "tuned"):
    query(f"ablation_{_mode}")(_ablation(_mode))


@query("robustness_model")
def robustness_model(spark, d):
    """Noise on all readings, so that a row's history is noisy too; only held-out rows, unseen in training, are scored."""
    rows = staged(SP.stratified_split(_readings(spark, d)))
    model = T.train(_causal(rows).filter(F.col("split") == "train"), CAUSAL)

    def scored(noisy):
        marked = _causal(noisy.withColumn("_noise", F.col("_tier.tier")), ["machine_id", "_noise"])
        return T.score(model, marked.filter(F.col("split") == "test"))

    return N.robustness_report(rows, C.SENSORS, scored, 0.5)


@query("feature_importance")
def feature_importance(spark, d):
    return EX.feature_importance(_fitted(spark, d)[0])


@query("row_drivers")
def row_drivers(spark, d):
    """Reason and action per row, from the flags or else the strongest model driver."""
    model, rows = _fitted(spark, d)
    drivers = EX.row_drivers(model, rows).withColumn("_top", F.get("top_drivers", F.lit(0))["feature"])
    flags = rows.select("event_id", *C.RISK_FLAGS)
    explained = FL.explain_reason(drivers.join(flags, "event_id"), "_top")
    return explained.select("event_id", "margin", "base", "top_drivers", "primary_reason", "recommended_action")


@query("range_drivers")
def range_drivers(spark, d):
    model, rows = _fitted(spark, d)
    return EX.range_drivers(model, FL.between_ts(rows, "2024-01-08 00:00:00", "2024-01-22 12:00:00"))
