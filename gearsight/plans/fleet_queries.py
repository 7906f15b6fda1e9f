"""Fleet state, lookups, ranges, sessions and what-if scoring."""

from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.operators import fleet as FL
from gearsight.operators import split as SP
from gearsight.operators import windows as W
from gearsight.plans.feature_queries import fused
from gearsight.plans.registry import query
from gearsight.plans.window_queries import STREAM, rounded_causal
from gearsight.sources import telemetry as S


def case(expr: str, table: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def first_flag(texts: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {f} = 1 THEN '{texts[f]}'" for f in C.RISK_FLAGS) + f" ELSE '{otherwise}' END"


REASON = first_flag(C.REASONS, C.NOMINAL_REASON)
ACTION = first_flag(C.ACTIONS, C.NOMINAL_ACTION)
NEWEST = "PARTITION BY machine_id ORDER BY ts DESC, event_id DESC"


@query("risk_tiers", "SELECT event_id, score, risk_tier FROM tiers")
def risk_tiers(spark, d):
    return FL.with_tier(S.scored(spark, d)).select("event_id", "score", "risk_tier")


@query("fleet_status", f"""SELECT machine_id, probability, risk_tier, primary_reason, delta,
  CASE WHEN delta > 0.001e0 THEN 'up' WHEN delta < -0.001e0 THEN 'down' ELSE 'flat' END AS trend, tool_wear, process_temp
  FROM (SELECT machine_id, score AS probability, risk_tier, {REASON} AS primary_reason, tool_wear, process_temp,
    round(coalesce(score - lead(score) OVER ({NEWEST}), 0), 6) AS delta, row_number() OVER ({NEWEST}) AS i FROM tiers)
  WHERE i = 1""")
def fleet_status(spark, d):
    return FL.fleet_status(S.scored(spark, d)).withColumn("delta", F.round("delta", 6))


@query("risk_reason", f"""SELECT event_id, {REASON} AS primary_reason, {ACTION} AS recommended_action,
  coalesce(active, '') AS active_risk_flags FROM (SELECT *, array_to_string([CASE WHEN twf_risk_flag = 1 THEN 'twf_risk_flag' END,
  CASE WHEN hdf_risk_flag = 1 THEN 'hdf_risk_flag' END, CASE WHEN pwf_risk_flag = 1 THEN 'pwf_risk_flag' END,
  CASE WHEN osf_risk_flag = 1 THEN 'osf_risk_flag' END], ',') AS active FROM scored)""")
def risk_reason(spark, d):
    return FL.explain_reason(S.scored(spark, d)).select(
        "event_id", "primary_reason", "recommended_action",
        F.array_join("active_risk_flags", ",").alias("active_risk_flags"))


_KPI = ", ".join(f"count(*) FILTER (WHERE risk_tier = '{t}') AS n_{t.lower()}" for t in C.TIERS)


@query("fleet_kpis", f"""SELECT count(*) AS total_machines, {_KPI}
  FROM (SELECT * FROM tiers QUALIFY row_number() OVER ({NEWEST}) = 1)""")
def fleet_kpis(spark, d):
    return FL.fleet_kpis(S.scored(spark, d))


@query("machine_history", f"""SELECT * FROM (SELECT machine_id, CAST(row_number() OVER ({NEWEST}) AS INTEGER) AS recency, event_id, ts,
  air_temp, process_temp, rpm, torque, tool_wear, score AS probability, risk_tier FROM tiers) WHERE recency <= 60""")
def machine_history(spark, d):
    return FL.machine_history(S.scored(spark, d))


@query("alerts", """SELECT event_id, machine_id, ts, risk_tier, score AS probability FROM tiers
  WHERE risk_tier IN ('High', 'Critical')""")
def alerts(spark, d):
    return FL.alerts(S.scored(spark, d))


@query("latest_alerts", """SELECT event_id, machine_id, ts, risk_tier, score AS probability FROM tiers
  WHERE risk_tier IN ('High', 'Critical') ORDER BY ts DESC, event_id DESC LIMIT 50""")
def latest_alerts(spark, d):
    return FL.alerts(S.scored(spark, d), C.ALERTS_KEPT)




@query("lookup_timestamp", f"""SELECT event_id, machine_id, score AS probability, risk_tier, {REASON} AS primary_reason,
  {ACTION} AS recommended_action, machine_failure AS actual_failure_label, twf, hdf, pwf, osf, rnf FROM tiers
  WHERE ts = (SELECT ts FROM tiers ORDER BY score DESC, event_id LIMIT 1)""")
def lookup_timestamp(spark, d):
    rows = S.scored(spark, d)
    worst = rows.orderBy(F.desc("score"), "event_id").limit(1).select("ts").scalar()
    return FL.lookup_timestamp(rows, worst)


@query("predictions_vs_actual", """SELECT t.event_id, t.machine_id, t.score, t.risk_tier, t.machine_failure, t.twf, t.hdf,
  t.pwf, t.osf, t.rnf, CASE WHEN (score >= 0.5e0) = (machine_failure = 1) THEN 1 ELSE 0 END AS correct FROM tiers t""")
def predictions_vs_actual(spark, d):
    predictions = S.scored(spark, d).select("event_id", "machine_id", "ts", "score")
    return FL.predictions_vs_actual(predictions, S.telemetry(spark, d)).drop("ts")


_COUNTS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS n_{c}" for c in [*C.MODES, *C.RISK_FLAGS])

_RANGE = "ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-22 12:00:00'"


@query("range_summary", f"""WITH r AS (SELECT t.*, CASE WHEN score < 0.05e0 THEN 'Low' WHEN score < 0.2e0 THEN 'Medium'
    WHEN score < 0.5e0 THEN 'High' ELSE 'Critical' END AS risk_tier FROM context t WHERE {_RANGE}),
  a AS (SELECT count(*) AS n_rows, round(avg(score), 6) AS avg_probability, max(score) AS max_probability, {_KPI},
    CAST(coalesce(sum(machine_failure), 0) AS BIGINT) AS n_failures, {_COUNTS},
    {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in C.ENV_FIELDS)} FROM r),
  f AS (SELECT *, CASE WHEN greatest({', '.join('n_' + f for f in C.RISK_FLAGS)}) = 0 THEN NULL
    {' '.join(f"WHEN n_{f} = greatest({', '.join('n_' + g for g in C.RISK_FLAGS)}) THEN '{f}'" for f in C.RISK_FLAGS)} END
    AS dominant_flag FROM a)
  SELECT *, coalesce({case('dominant_flag', {f: C.ACTIONS[f] for f in C.RISK_FLAGS})}, '{C.ROUTINE_RANGE}') AS recommendation FROM f""")
def range_summary(spark, d):
    out = FL.range_summary(fused(spark, d), "2024-01-08 00:00:00", "2024-01-22 12:00:00")
    return out.withColumns({c: F.round(c, 6) for c in ["avg_probability", *[f"avg_{e}" for e in C.ENV_FIELDS]]})


@query("range_trajectory", f"""SELECT event_id, ts, score AS probability, risk_tier, machine_failure AS actual_failure FROM tiers
  WHERE {_RANGE}""")
def range_trajectory(spark, d):
    return FL.range_trajectory(S.scored(spark, d), "2024-01-08 00:00:00", "2024-01-22 12:00:00")


_BLOCKS = f"""SELECT *, CAST(least((row_number() OVER ({STREAM}) - 1) // ((SELECT count(*) FROM events) // 40), 39) AS INTEGER)
  AS session_index FROM tiers"""


@query("list_sessions", f"""SELECT session_index, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows,
  CAST(sum(machine_failure) AS BIGINT) AS n_failures, CASE WHEN sum(machine_failure) > 0 THEN 1 ELSE 0 END AS had_failure
  FROM ({_BLOCKS}) GROUP BY session_index""")
def list_sessions(spark, d):
    return FL.list_sessions(S.scored(spark, d))


@query("session_trajectory", f"""SELECT event_id, ts, score AS probability, risk_tier, machine_failure AS actual_failure
  FROM ({_BLOCKS}) WHERE session_index = 39""")
def session_trajectory(spark, d):
    return FL.session_trajectory(S.scored(spark, d), 39)


def md5_sql(row_id: str, salt: str) -> str:
    return f"md5(concat_ws('|', CAST({row_id} AS VARCHAR), '{salt}', '42'))"


@query("assign_fleet", f"""WITH blocks AS (SELECT event_id, ts, (row_number() OVER ({STREAM}) - 1) // ((SELECT count(*) FROM events) // 40)
    AS session_index FROM events), picked AS (SELECT DISTINCT session_index FROM blocks WHERE session_index < 40
    ORDER BY {md5_sql('session_index', 'sample')}, session_index LIMIT 12),
  named AS (SELECT session_index, 'M-' || lpad(CAST(row_number() OVER (ORDER BY session_index) AS VARCHAR), 3, '0') AS fleet_id FROM picked)
  SELECT event_id, CAST(session_index AS INTEGER) AS session_index, fleet_id FROM blocks JOIN named USING (session_index)""".replace(
    "SELECT DISTINCT session_index FROM blocks WHERE session_index < 40",
    "SELECT session_index FROM (SELECT DISTINCT session_index FROM blocks WHERE session_index < 40)"))
def assign_fleet(spark, d):
    blocks = W.session_blocks(S.events(spark, d).select("event_id", "ts"), remainder="drop")
    return SP.assign_fleet(blocks).select("event_id", "session_index", "fleet_id")


@query("hash_sample", f"""SELECT event_id, score FROM scored ORDER BY {md5_sql('event_id', 'sample')}, event_id LIMIT 300""")
def hash_sample(spark, d):
    return SP.hash_sample(S.scored(spark, d).select("event_id", "score"), 300)


def what_ifs(rows):
    """One what-if per machine: its newest reading pushed harder, on history borrowed from an earlier time.

    The time is the machine's reading about two thirds into its history (null for every fifth machine, a time
    that never occurred for every seventh).
    """
    last = FL.last_n(rows, 1)
    at = FL.last_n(rows, 20).groupBy("machine_id").agg(F.min("ts").alias("_at"))
    m = F.col("machine_id")
    return last.join(at, "machine_id").select(
        m.alias("whatif_id"), "machine_id",
        F.when(m % 5 == 0, None).when(m % 7 == 0, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("_at")).alias("borrow_ts"),
        "air_temp", F.when(m % 11 == 0, F.col("air_temp")).otherwise(F.col("process_temp")).alias("process_temp"),
        (F.col("rpm") - 100).alias("rpm"), (F.col("torque") + 10).alias("torque"),
        F.when(m % 11 == 0, 0.0).otherwise(F.col("tool_wear")).alias("tool_wear"),
        F.when(m % 13 == 0, "X").otherwise(F.col("type")).alias("type"))


_SIX = C.CORE_SIGNALS


def _whatif_sql(session: str) -> str:
    first = "1" if session == "machine" else "n0"
    cond = "true" if session == "machine" else "h.seq_upto + 1 > n0"
    agg = []
    for n in C.WINDOWS:
        for c in _SIX:
            agg.append(f"round(avg({c}) FILTER (WHERE age < {n}), 4) AS {c}_mean_{n}")
            agg.append(f"round(stddev_pop({c}) FILTER (WHERE age < {n}), 4) AS {c}_std_{n}")
    for c in C.LAG_SIGNALS:
        for k in (1, 2):
            agg.append(f"round(coalesce(max({c}) FILTER (WHERE age = {k}), max({c}) FILTER (WHERE age = 0)), 4) AS {c}_lag_{k}")
    for c in ("torque", "rpm", "power", "tool_wear", "temp_diff"):
        mean, sd = f"avg({c}) FILTER (WHERE age < 15)", f"stddev_pop({c}) FILTER (WHERE age < 15)"
        agg.append(f"round(CASE WHEN {sd} > 1e-6 THEN (max({c}) FILTER (WHERE age = 0) - {mean}) / {sd} ELSE 0 END, 9) AS {c}_zscore")
    for c in ("type_code", *C.RISK_FLAGS):
        agg.append(f"max({c}) FILTER (WHERE age = 0) AS {c}")
    return f"""WITH newest AS (SELECT *, row_number() OVER ({NEWEST}) AS i FROM telemetry),
  hist AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS seq FROM cycles),
  opening AS (SELECT machine_id, count(*) AS n0 FROM hist WHERE tool_cycle = 0 GROUP BY 1),
  asked AS (SELECT n.machine_id AS whatif_id, n.machine_id, CASE WHEN n.machine_id % 5 = 0 THEN NULL
      WHEN n.machine_id % 7 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' ELSE a.at END AS borrow_ts, air_temp,
    CASE WHEN n.machine_id % 11 = 0 THEN air_temp ELSE process_temp END AS process_temp, rpm - 100 AS rpm, torque + 10 AS torque,
    CASE WHEN n.machine_id % 11 = 0 THEN 0 ELSE tool_wear END AS tool_wear,
    CASE WHEN n.machine_id % 13 = 0 THEN 'X' ELSE type END AS type
    FROM newest n JOIN (SELECT machine_id, min(ts) AS at FROM newest WHERE i <= 20 GROUP BY 1) a USING (machine_id) WHERE i = 1),
  h AS (SELECT whatif_id, machine_id, (SELECT count(*) FROM hist x WHERE x.machine_id = asked.machine_id AND x.ts < asked.borrow_ts) AS seq_upto,
    EXISTS (SELECT 1 FROM hist x WHERE x.machine_id = asked.machine_id AND x.ts = asked.borrow_ts) AS found FROM asked
    WHERE borrow_ts IS NOT NULL),
  buf AS (SELECT h.whatif_id, h.seq_upto - b.seq + 1 AS age, b.air_temp, b.process_temp, b.rpm, b.torque, b.tool_wear, b.type
    FROM h JOIN opening USING (machine_id) JOIN hist b ON b.machine_id = h.machine_id AND b.seq <= h.seq_upto
      AND b.seq >= greatest(h.seq_upto - 28, {first}) WHERE found AND {cond}
    UNION ALL SELECT whatif_id, 0, air_temp, process_temp, rpm, torque, tool_wear, type FROM asked),
  f AS (SELECT *, torque * rpm AS power, process_temp - air_temp AS temp_diff,
    CASE type WHEN 'L' THEN 0 WHEN 'H' THEN 2 ELSE 1 END AS type_code,
    CASE WHEN tool_wear BETWEEN 200 AND 240 THEN 1 ELSE 0 END AS twf_risk_flag,
    CASE WHEN process_temp - air_temp < 8.6e0 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf_risk_flag,
    CASE WHEN torque * rpm < 3500 OR torque * rpm > 9000 THEN 1 ELSE 0 END AS pwf_risk_flag,
    CASE WHEN torque * tool_wear > CASE type WHEN 'L' THEN 11000 WHEN 'H' THEN 13000 ELSE 12000 END THEN 1 ELSE 0 END AS osf_risk_flag
    FROM buf)
  SELECT f.whatif_id, {', '.join(agg)}, CAST(count(*) AS INTEGER) AS readings_seen, CAST(count(*) - 1 AS INTEGER) AS history_rows,
    CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS cold_start_warning,
    any_value(CASE WHEN borrow_ts IS NOT NULL THEN CASE WHEN found THEN 1 ELSE 0 END END) AS borrow_ts_found
  FROM f JOIN (SELECT whatif_id, borrow_ts FROM asked) a USING (whatif_id)
  LEFT JOIN (SELECT whatif_id, found FROM h) h USING (whatif_id) GROUP BY f.whatif_id"""


def _whatif(spark, d, session):
    rows = S.telemetry(spark, d)
    out = FL.whatif_features(what_ifs(rows), rows, session)
    return out.select("whatif_id", "type_code", *C.RISK_FLAGS, "readings_seen", "history_rows", "cold_start_warning",
                      "borrow_ts_found", *rounded_causal())


@query("whatif_features", _whatif_sql("machine"))
def whatif_features(spark, d):
    return _whatif(spark, d, "machine")


@query("whatif_features_cycle0", _whatif_sql("cycle0"))
def whatif_features_cycle0(spark, d):
    return _whatif(spark, d, "cycle0")
