"""Inspection and failure-profile reports."""

from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators import clean as K
from gearsight.operators import features as FE
from gearsight.operators import profile as P
from gearsight.operators import windows as W
from gearsight.plans.feature_queries import fused
from gearsight.plans.registry import query
from gearsight.sources import telemetry as S

PROFILED = [*C.SENSORS, *C.MODES, C.TARGET]


def union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def physics(spark, d):
    return FE.physics_features(S.telemetry(spark, d))


def digits(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


_SHAPE = [("event_id", "bigint"), ("machine_id", "bigint"), ("ts", "timestamp_ntz"), ("type", "string"),
          ("torque", "double"), ("machine_failure", "int")]


@query("profile_shape", union([f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows FROM telemetry"
                               for i, (c, t) in enumerate(_SHAPE)]))
def profile_shape(spark, d):
    return P.profile_shape(S.telemetry(spark, d).select(*[c for c, _ in _SHAPE]))


_PHYS = [*C.SENSORS, "power", "temp_diff", "wear_rate", "torque_per_wear", "strain_index", "power_per_temp"]


@query("describe_columns", union([f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
  round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max
  FROM physics""" for c in _PHYS]))
def describe_columns(spark, d):
    out = P.describe_columns(physics(spark, d), _PHYS)
    return digits(out, ["mean", "std", "min", "q25", "q50", "q75", "max"], 4)


_MISSING = ["ambient_temp", "ambient_humidity", "torque", "ts"]


@query("missing_counts", union([f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS n_missing
  FROM telemetry t LEFT JOIN environment e ON date_trunc('hour', t.ts) = e.env_ts""" for c in _MISSING]))
def missing_counts(spark, d):
    from gearsight.operators.fusion import fuse_environment
    return P.missing_counts(fuse_environment(S.telemetry(spark, d), S.environment(spark, d)), _MISSING)


@query("duplicate_count", f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM
  (SELECT count(*) AS n FROM telemetry GROUP BY type, {', '.join(PROFILED)})""")
def duplicate_count(spark, d):
    return P.duplicate_count(S.telemetry(spark, d), ["type", *PROFILED])


@query("class_balance", """SELECT machine_failure, count(*) AS n, any_value(r) AS imbalance_ratio FROM telemetry,
  (SELECT round(count(*) FILTER (WHERE machine_failure = 0) * 1e0 / count(*) FILTER (WHERE machine_failure = 1), 1) AS r
   FROM telemetry) GROUP BY machine_failure""")
def class_balance(spark, d):
    return P.class_balance(S.telemetry(spark, d))


@query("failure_mode_counts", union([f"""SELECT '{m}' AS mode, CAST(sum({m}) AS BIGINT) AS n,
  round(sum({m} * machine_failure) * 1e0 / sum(machine_failure), 6) AS share_of_failures FROM telemetry""" for m in C.MODES]))
def failure_mode_counts(spark, d):
    return digits(P.failure_mode_counts(S.telemetry(spark, d)), ["share_of_failures"])


@query("rate_by_type", """SELECT type_label, count(*) AS n, round(avg(machine_failure) * 100, 6) AS failure_rate_pct,
  any_value(o) AS overall_rate_pct FROM (SELECT *, CASE type WHEN 'L' THEN 'L (Low)' WHEN 'M' THEN 'M (Medium)'
  ELSE 'H (High)' END AS type_label FROM telemetry), (SELECT round(avg(machine_failure) * 100, 6) AS o FROM telemetry)
  GROUP BY type_label""")
def rate_by_type(spark, d):
    rows = K.decode_type(K.encode_type(S.telemetry(spark, d)))
    return digits(P.rate_by(rows, "type_label"), ["failure_rate_pct", "overall_rate_pct"])


@query("failure_cooccurrence", union([f"""SELECT '{a}' AS mode_a, '{b}' AS mode_b,
  count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS n FROM telemetry""" for a in C.MODES for b in C.MODES]))
def failure_cooccurrence(spark, d):
    return P.cooccurrence(S.telemetry(spark, d))


_IQR = ["rpm", "torque", "power", "torque_per_wear", "power_per_temp"]


@query("iqr_outliers", union([f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
  count(*) FILTER (WHERE {c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) AS n_outliers
  FROM physics, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM physics) GROUP BY q1, q3"""
                              for c in _IQR]))
def iqr_outliers(spark, d):
    return digits(P.iqr_outliers(physics(spark, d), _IQR), ["q1", "q3"])


_FLAGS = [*C.RISK_FLAGS, "high_wear_flag", "high_torque_flag", "low_rpm_flag", "power_anomaly_flag"]


def flagged(spark, d):
    return FE.general_flags(FE.threshold_flags(physics(spark, d)))


@query("flag_effectiveness", union([f"""SELECT '{f}' AS flag,
  round(avg(CASE WHEN {f} = 1 THEN machine_failure END) * 100, 6) AS rate_flag_1,
  round(avg(CASE WHEN {f} = 0 THEN machine_failure END) * 100, 6) AS rate_flag_0 FROM flagged""" for f in _FLAGS]))
def flag_effectiveness(spark, d):
    return digits(P.flag_effectiveness(flagged(spark, d), _FLAGS), ["rate_flag_1", "rate_flag_0"])


@query("multi_mode_counts", """SELECT twf + hdf + pwf + osf + rnf AS n_modes, count(*) AS n_rows FROM telemetry
  WHERE machine_failure = 1 GROUP BY 1""")
def multi_mode_counts(spark, d):
    return P.multi_mode_counts(S.telemetry(spark, d))


@query("rate_by_risk_score", """SELECT risk_score, count(*) AS n, round(avg(machine_failure) * 100, 6) AS failure_rate_pct,
  any_value(o) AS overall_rate_pct FROM (SELECT *, hdf_risk_flag + pwf_risk_flag + osf_risk_flag + twf_risk_flag AS risk_score
  FROM physics), (SELECT round(avg(machine_failure) * 100, 6) AS o FROM telemetry) GROUP BY risk_score""")
def rate_by_risk_score(spark, d):
    rows = FE.with_risk_score(FE.threshold_flags(S.telemetry(spark, d)))
    return digits(P.rate_by(rows, "risk_score"), ["failure_rate_pct", "overall_rate_pct"])


@query("flag_precision", union([f"""SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS n_flagged,
  round(sum({f}) * 1e0 / count(*) * 100, 6) AS pct_rows, CAST(sum({f} * machine_failure) AS BIGINT) AS failures_caught,
  round(coalesce(sum({f} * machine_failure) * 1e0 / nullif(sum({f}), 0) * 100, 0), 6) AS precision_pct FROM flagged"""
                                for f in C.GENERAL_FLAGS]))
def flag_precision(spark, d):
    return digits(P.flag_precision(flagged(spark, d), C.GENERAL_FLAGS), ["pct_rows", "precision_pct"])


@query("zscore_report", union([f"""SELECT '{z}' AS "column", count(*) FILTER (WHERE abs({z}) > 3) AS n_extreme,
  abs(round(avg({z}), 6)) AS mean, round(stddev_samp({z}), 6) AS std FROM zscored""" for z in C.ZSCORES]))
def zscore_report(spark, d):
    out = P.zscore_report(FE.zscore_features(physics(spark, d)))
    return digits(out, ["mean", "std"]).withColumn("mean", F.abs("mean"))


def _box_sql(source: str, keys: str, on: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3, round(min(CASE WHEN value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) THEN value END), 6) AS whisker_hi
  FROM {source} JOIN (SELECT {on}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY {on}) q USING ({on}) GROUP BY {keys}"""


_BOX = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]


@query("pooled_box_stats", f"""WITH long AS ({union([f"SELECT machine_failure, {z} AS value FROM zscored" for z in C.ZSCORES])})
  {_box_sql('long', "machine_failure, 'pooled' AS \"column\"", 'machine_failure').replace('GROUP BY machine_failure, ' + chr(39) + 'pooled' + chr(39) + ' AS "column"', 'GROUP BY machine_failure')}""")
def pooled_box_stats(spark, d):
    out = P.box_stats(FE.zscore_features(physics(spark, d)), list(C.ZSCORES), ["machine_failure"], pooled=True)
    return digits(out, _BOX)


@query("sensor_box_stats", f"""WITH long AS ({union([f"SELECT '{c}' AS col, {c} AS value FROM telemetry" for c in C.SENSORS])})
  SELECT col AS "column", n, q1, median, q3, whisker_lo, whisker_hi FROM ({_box_sql('long', 'col', 'col')})""")
def sensor_box_stats(spark, d):
    return digits(P.box_stats(S.telemetry(spark, d), C.SENSORS), _BOX)


_CORR = [*C.SENSORS, "power", "temp_diff", "wear_rate", "torque_per_wear", "strain_index", *C.RISK_FLAGS,
         "ambient_temp", "grid_voltage_fluctuation", *C.COMPOSITES]
# a constant column has no correlation: NaN in DuckDB, which would sort first
_CORR_SQL = union([f"""SELECT '{c}' AS "column", CASE WHEN min({c}) < max({c}) THEN corr({c}, machine_failure) END AS r
  FROM fused""" for c in _CORR])


@query("target_correlation", f"""WITH r AS ({_CORR_SQL}) SELECT "column", round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM r
  ORDER BY abs(r) DESC NULLS LAST, "column" LIMIT 15""")
def target_correlation(spark, d):
    return digits(P.target_correlation(fused(spark, d), _CORR, 15), ["r", "abs_r"])


_LIFT = ["vibration_torque_impact", "total_stress_index", "thermal_strain"]


@query("fusion_lift", f"""WITH ext AS ({union([f"SELECT abs(corr({c}, machine_failure)) AS r FROM fused" for c in C.ENV_FIELDS])}),
  comp AS ({union([f"SELECT corr({c}, machine_failure) AS r FROM fused" for c in _LIFT])})
  SELECT round((SELECT max(r) FROM ext), 6) AS best_external_r, round((SELECT max(r) FROM comp), 6) AS best_composite_r,
  round((SELECT max(r) FROM comp) / (SELECT max(r) FROM ext) - 1, 4) AS lift""")
def fusion_lift(spark, d):
    return digits(digits(P.fusion_lift(fused(spark, d), C.ENV_FIELDS), ["best_external_r", "best_composite_r"]), ["lift"], 4)


@query("class_means", union([f"""SELECT machine_failure, '{c}' AS "column", round(avg({c}), 6) AS mean FROM fused
  GROUP BY machine_failure""" for c in [*C.SENSORS, *C.COMPOSITES]]))
def class_means(spark, d):
    return digits(P.class_means(fused(spark, d), [*C.SENSORS, *C.COMPOSITES]), ["mean"])


def _grid_sql(a: str, b: str, na: int, nb: int, source: str = "fused") -> str:
    """na, nb: bins left after equal edges are merged."""
    edges = lambda c: f"(SELECT list_sort(list_distinct([{', '.join(f'quantile_cont({c}, {i / 5})' for i in range(6))}])) FROM {source})"
    above = lambda c, e: " + ".join(f"CASE WHEN {c} > {e}[{i}] THEN 1 ELSE 0 END" for i in range(2, 6))
    bin_ = lambda c, e: f"CAST({above(c, e)} AS INTEGER)"
    return f"""WITH e AS (SELECT {edges(a)} AS ea, {edges(b)} AS eb),
  cells AS (SELECT {bin_(a, 'ea')} AS bin_a, {bin_(b, 'eb')} AS bin_b, count(*) AS n, avg(machine_failure) * 100 AS r
    FROM {source}, e GROUP BY 1, 2),
  grid AS (SELECT CAST(i AS INTEGER) AS bin_a, CAST(j AS INTEGER) AS bin_b FROM e, generate_series(0, 4) t(i),
    generate_series(0, 4) u(j) WHERE i < len(ea) - 1 AND j < len(eb) - 1)
  SELECT bin_a, bin_b, round(ea[bin_a + 1], 6) AS a_lo, round(ea[bin_a + 2], 6) AS a_hi, round(eb[bin_b + 1], 6) AS b_lo,
  round(eb[bin_b + 2], 6) AS b_hi, coalesce(n, 0) AS n, round(r, 6) AS failure_rate_pct
  FROM grid LEFT JOIN cells USING (bin_a, bin_b), e"""


_EDGES = ["a_lo", "a_hi", "b_lo", "b_hi", "failure_rate_pct"]


@query("interaction_grid", _grid_sql("torque", "ambient_vibration_noise", 5, 5))
def interaction_grid(spark, d):
    return digits(P.interaction_grid(fused(spark, d), "torque", "ambient_vibration_noise"), _EDGES)


@query("interaction_grid_ties", _grid_sql("tool_wear", "operator_skill_proxy", 5, 2))
def interaction_grid_ties(spark, d):
    return digits(P.interaction_grid(fused(spark, d), "tool_wear", "operator_skill_proxy"), _EDGES)


_TWF = C.TWF_DISTANCE_EDGES
_TWF_CASE = "CASE " + " ".join(f"WHEN x > {lo} AND x <= {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(_TWF, _TWF[1:]))) + " END"


@query("twf_distance_buckets", f"""SELECT bucket, n, round(r, 6) AS failure_rate_pct,
  CAST([{', '.join(map(str, _TWF))}][bucket + 1] AS DOUBLE) AS lo, CAST([{', '.join(map(str, _TWF))}][bucket + 2] AS DOUBLE) AS hi,
  CASE WHEN r > 10 THEN 'high' WHEN r > 5 THEN 'medium' ELSE 'low' END AS band
  FROM (SELECT {_TWF_CASE} AS bucket, count(*) AS n, avg(machine_failure) * 100 AS r
  FROM (SELECT 200 - tool_wear AS x, machine_failure FROM telemetry) GROUP BY 1) WHERE bucket IS NOT NULL""")
def twf_distance_buckets(spark, d):
    rows = FE.failure_proximity(S.telemetry(spark, d))
    return digits(P.bucket_rate(rows, "distance_to_twf", _TWF), ["failure_rate_pct"])


@query("osf_distance_buckets", """WITH x AS (SELECT CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 ELSE 13000 END
    - torque * tool_wear AS v, machine_failure FROM telemetry), s AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
  SELECT bucket, n, round(r, 6) AS failure_rate_pct,
  round(CASE WHEN bucket = 0 THEN lo - 0.001e0 * (hi - lo) ELSE lo + bucket * (hi - lo) / 5 END, 4) AS lo,
  round(lo + bucket * ((hi - lo) / 5) + (hi - lo) / 5, 4) AS hi FROM
  (SELECT CAST(greatest(0, least(4, ceil((v - lo) / ((hi - lo) / 5)) - 1)) AS INTEGER) AS bucket, count(*) AS n,
   avg(machine_failure) * 100 AS r FROM x, s GROUP BY 1), s""")
def osf_distance_buckets(spark, d):
    rows = FE.failure_proximity(S.telemetry(spark, d))
    return digits(digits(P.equal_width_rate(rows, "distance_to_osf"), ["failure_rate_pct"]), ["lo", "hi"], 4)


def _hist_sql(source: str, x: str, bins: int, lo: float, hi: float) -> str:
    w = (hi - lo) / bins
    return f"""SELECT CAST(i AS INTEGER) AS bin, round({lo}e0 + i * {w!r}e0, 9) AS lo, round({lo}e0 + (i + 1) * {w!r}e0, 9) AS hi,
  coalesce(n, 0) AS n, round(coalesce(n, 0) * 1e0 / (sum(coalesce(n, 0)) OVER () * {w!r}e0), 6) AS density
  FROM generate_series(0, {bins - 1}) t(i) LEFT JOIN (SELECT CAST(least(floor(({x} - {lo}e0) / {w!r}e0), {bins - 1}) AS BIGINT) AS b,
  count(*) AS n FROM {source} WHERE {x} BETWEEN {lo}e0 AND {hi}e0 GROUP BY 1) ON b = i"""


def _hist(df, col, bins, lo, hi):
    return digits(digits(P.histogram(df, col, bins, lo, hi), ["lo", "hi"], 9), ["density"])


@query("histogram", _hist_sql("scored", "score", 20, 0.0, 1.0))
def histogram(spark, d):
    return _hist(S.scored(spark, d), "score", 20, 0.0, 1.0)


@query("sensor_histogram", _hist_sql("telemetry", "torque", 40, 25.0, 60.0))
def sensor_histogram(spark, d):
    return _hist(S.telemetry(spark, d), "torque", 40, 25.0, 60.0)


@query("risk_score_density", union([f"""SELECT * FROM (SELECT {y} AS machine_failure, * FROM ({_hist_sql(
    f"(SELECT hdf_risk_flag + pwf_risk_flag + osf_risk_flag + twf_risk_flag AS risk_score FROM physics WHERE machine_failure = {y})",
    "risk_score", 5, 0.0, 4.0)}))""" for y in (0, 1)]))
def risk_score_density(spark, d):
    rows = FE.with_risk_score(FE.threshold_flags(S.telemetry(spark, d)))
    out = None
    for y in (0, 1):
        part = _hist(rows.filter(F.col(C.TARGET) == y), "risk_score", 5, 0.0, 4.0).withColumn(C.TARGET, F.lit(y))
        out = part if out is None else out.unionByName(part)
    return out


_CYCLE = """SELECT machine_id, tool_cycle, CAST(sum(machine_failure) AS BIGINT) AS n_failures, count(*) AS n_rows,
  round(avg(machine_failure), 6) AS failure_rate, max(tool_wear) AS lifespan,
  CASE WHEN sum(machine_failure) > 5 THEN 'high' WHEN sum(machine_failure) > 2 THEN 'medium' ELSE 'low' END AS risk_class
  FROM cycles GROUP BY machine_id, tool_cycle"""


def cycles(spark, d):
    return P.cycle_stats(W.tool_cycle(S.telemetry(spark, d)))


@query("cycle_stats", _CYCLE)
def cycle_stats(spark, d):
    return digits(cycles(spark, d), ["failure_rate"])


@query("cycle_summary", f"""SELECT count(*) AS n_cycles, count(DISTINCT tool_cycle) AS n_cycle_numbers,
  round(avg(n_failures), 6) AS failures_per_cycle, round(avg(lifespan), 6) AS mean_lifespan FROM ({_CYCLE})""")
def cycle_summary(spark, d):
    return digits(P.cycle_summary(cycles(spark, d)), ["failures_per_cycle", "mean_lifespan"])


@query("cycle_rate_histogram", _hist_sql(f"(SELECT avg(machine_failure) * 100 AS rate FROM cycles GROUP BY machine_id, tool_cycle)",
                                         "rate", 20, 0.0, 100.0))
def cycle_rate_histogram(spark, d):
    return _hist(cycles(spark, d).withColumn("rate", F.col("failure_rate") * 100), "rate", 20, 0.0, 100.0)


@query("worst_cycles", f"SELECT * FROM ({_CYCLE}) ORDER BY n_failures DESC, machine_id, tool_cycle LIMIT 3")
def worst_cycles(spark, d):
    return digits(P.worst_cycles(cycles(spark, d)), ["failure_rate"])


_RANGES = union([f"""SELECT '{c}' AS sensor, round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.95), 6) AS p95,
  min({c}) AS min, max({c}) AS max FROM telemetry""" for c in C.SENSORS])


@query("normal_ranges", _RANGES)
def normal_ranges(spark, d):
    return digits(P.normal_ranges(S.telemetry(spark, d)), ["p5", "p95"])


@query("outside_normal", f"""WITH r AS ({_RANGES}), latest AS (SELECT * FROM telemetry
    QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) = 1),
  long AS ({union([f"SELECT machine_id, '{c}' AS sensor, {c} AS entered FROM latest" for c in C.SENSORS])})
  SELECT machine_id, sensor, entered, p5, p95, CASE WHEN entered < p5 THEN 'below' WHEN entered > p95 THEN 'above'
  ELSE 'inside' END AS position FROM long JOIN r USING (sensor)""")
def outside_normal(spark, d):
    from gearsight.operators.fleet import latest_per_machine
    rows = S.telemetry(spark, d)
    ranges = digits(P.normal_ranges(rows), ["p5", "p95"]).select("sensor", "p5", "p95")
    return P.outside_normal(latest_per_machine(rows), ranges, ["machine_id"])


@query("env_correlation", f"""SELECT field, round(correlation, 6) AS correlation FROM ({union([
    f"SELECT '{c}' AS field, CASE WHEN stddev_samp({c}) > 1e-9 THEN corr({c}, score) ELSE 0 END AS correlation FROM context"
    for c in C.ENV_FIELDS])})""")
def env_correlation(spark, d):
    return digits(P.env_correlation(fused(spark, d), C.ENV_FIELDS, "score"), ["correlation"])


def _kde_sql(col: str, n: int, factor: float) -> str:
    return f"""WITH s AS (SELECT machine_failure, count(*) AS n, min({col}) AS lo, max({col}) AS hi, stddev_samp({col}) AS sd
    FROM physics GROUP BY 1),
  v AS (SELECT machine_failure, {col} AS v, count(*) AS m FROM physics GROUP BY 1, 2)
  SELECT machine_failure, CAST(i AS INTEGER) AS grid, round(any_value(lo + i * ((hi - lo) / {n - 1})), 6) AS x,
  round(sum(m * exp(-0.5e0 * power((lo + i * ((hi - lo) / {n - 1}) - v) / ({factor}e0 * sd), 2)))
    / any_value(n * ({factor}e0 * sd) * sqrt(2 * pi())), 6) AS density
  FROM v JOIN s USING (machine_failure), generate_series(0, {n - 1}) t(i) GROUP BY machine_failure, i"""


@query("kde_by_class", _kde_sql("torque", 300, 0.3))
def kde_by_class(spark, d):
    return digits(P.kde_by_class(physics(spark, d), "torque"), ["x", "density"])


@query("kde_temp_diff", _kde_sql("temp_diff", 300, 0.35))
def kde_temp_diff(spark, d):
    return digits(P.kde_by_class(physics(spark, d), "temp_diff", factor=0.35), ["x", "density"])


@query("failure_events", """SELECT event_id, machine_id, ts, air_temp, process_temp, rpm, torque, tool_wear FROM telemetry
  WHERE machine_failure = 1""")
def failure_events(spark, d):
    return P.failure_events(S.telemetry(spark, d))


@query("mode_events", union([f"SELECT event_id, machine_id, ts, '{m}' AS mode FROM telemetry WHERE {m} = 1" for m in C.MODES]))
def mode_events(spark, d):
    return P.mode_events(S.telemetry(spark, d))


@query("inspection_summary", f"""SELECT count(*) AS n_rows, 12 AS n_columns, CAST(0 AS BIGINT) AS n_missing,
  round(count(*) FILTER (WHERE machine_failure = 0) * 1e0 / count(*) FILTER (WHERE machine_failure = 1), 1) AS class_ratio,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM telemetry
    GROUP BY type, {', '.join(PROFILED)})) AS n_duplicates FROM telemetry""")
def inspection_summary(spark, d):
    return P.inspection_summary(S.telemetry(spark, d), ["type", *PROFILED])


@query("valid_range", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def valid_range(spark, d):
    return P.valid_range(S.events(spark, d))


@query("label_agreement", """SELECT count(*) AS n_rows, round(avg(CASE WHEN observed = greatest(twf, hdf, pwf, osf, rnf)
  THEN 1e0 ELSE 0e0 END) * 100, 6) AS agreement_pct FROM (SELECT *, CASE WHEN rnf = 1 AND twf + hdf + pwf + osf = 0 THEN 0
  ELSE machine_failure END AS observed FROM telemetry)""")
def label_agreement(spark, d):
    """Random failures are not always reported as machine failures; the audit measures how often."""
    only_random = (F.col("rnf") == 1) & (F.col("twf") + F.col("hdf") + F.col("pwf") + F.col("osf") == 0)
    rows = S.telemetry(spark, d)
    observed = rows.withColumn(C.TARGET, F.when(only_random, 0).otherwise(F.col(C.TARGET)))
    return digits(P.label_agreement(observed), ["agreement_pct"])
