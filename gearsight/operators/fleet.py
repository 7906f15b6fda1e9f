"""Fleet, lookup and what-if operators over scored telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gearsight.functions import constants as C
from gearsight.functions import expressions as X
from gearsight.operators.features import instant_features
from gearsight.operators.ordering import Series
from gearsight.operators.windows import ORDER, rolling_zscores, session_blocks, tool_cycle



def _newest_first(by: list[str]):
    return Window.partitionBy(*by).orderBy(*[F.desc(c) for c in ORDER])


def last_n(df: DataFrame, n: int, by: list[str] = ("machine_id",)) -> DataFrame:
    """Newest ``n`` rows per series; the limit is applied before the shuffle as well as after it."""
    return (df.withColumn("recency", F.row_number().over(_newest_first(list(by))))
            .filter(F.col("recency") <= n))


def latest_per_machine(df: DataFrame, by: list[str] = ("machine_id",)) -> DataFrame:
    return last_n(df, 1, by).drop("recency")


def risk_delta(df: DataFrame, by: list[str] = ("machine_id",)) -> DataFrame:
    """Latest row per machine with its change against the row before (0 for a single reading)."""
    recent = last_n(df, 2, by)
    before = F.lead("score").over(_newest_first(list(by)))
    return (recent.withColumn("delta", F.coalesce(F.col("score") - before, F.lit(0.0)))
            .filter(F.col("recency") == 1).drop("recency"))


def explain_reason(df: DataFrame, top_driver: str | None = None) -> DataFrame:
    """Reason, action and active flags: first active flag, else the strongest driver, else routine.

    ``top_driver`` names a column with the strongest model driver of the row, when there is one.
    """
    reason, action = F.lit(C.NOMINAL_REASON), F.lit(C.NOMINAL_ACTION)
    if top_driver:
        driver = F.col(top_driver)
        reason = F.when(driver.isNull(), reason).otherwise(F.concat(
            F.lit("No physics threshold breached; model driven mainly by '"), driver, F.lit("'")))
        by_driver = F.when(driver.isNull(), action)
        for key in C.DRIVER_ACTIONS:
            by_driver = by_driver.when(driver.contains(key), C.ACTIONS[key])
        action = by_driver.otherwise(C.NO_ACTION)
    first = lambda texts: F.coalesce(*[F.when(F.col(f) == 1, F.lit(texts[f])) for f in C.RISK_FLAGS])
    return df.withColumns({
        "primary_reason": F.coalesce(first(C.REASONS), reason),
        "recommended_action": F.coalesce(first(C.ACTIONS), action),
        "active_risk_flags": F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in C.RISK_FLAGS])),
    })


def with_tier(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("risk_tier", X.risk_tier(F.col(score)))


def fleet_status(scored: DataFrame) -> DataFrame:
    """Latest state of each machine, riskiest first."""
    latest = explain_reason(with_tier(risk_delta(scored)))
    return latest.withColumn("trend", X.trend_label(F.col("delta"))).select(
        "machine_id", F.col("score").alias("probability"), "risk_tier", "primary_reason", "delta", "trend",
        "tool_wear", "process_temp").orderBy(F.desc("probability"), "machine_id")


def tier_counts(tier: Column) -> dict[str, Column]:
    return {f"n_{t.lower()}": F.count_if(tier == t) for t in C.TIERS}


def fleet_kpis(scored: DataFrame) -> DataFrame:
    status = with_tier(latest_per_machine(scored))
    return status.agg(F.count(F.lit(1)).alias("total_machines"),
                      *[c.alias(n) for n, c in tier_counts(F.col("risk_tier")).items()])


def machine_history(scored: DataFrame, n: int = C.HISTORY_LEN, machine_id=None) -> DataFrame:
    """Newest readings and risks per machine (or of one machine)."""
    rows = scored if machine_id is None else scored.filter(F.col("machine_id") == machine_id)
    return with_tier(last_n(rows, n)).select("machine_id", "recency", "event_id", "ts", *C.SENSORS,
                                             F.col("score").alias("probability"), "risk_tier")


def alerts(scored: DataFrame, keep: int | None = None) -> DataFrame:
    """High and critical readings, newest first."""
    raised = with_tier(scored).filter(F.col("risk_tier").isin("High", "Critical")).select(
        "event_id", "machine_id", "ts", "risk_tier", F.col("score").alias("probability"))
    raised = raised.orderBy(*[F.desc(c) for c in ORDER])
    return raised if keep is None else raised.limit(keep)


def at_timestamp(df: DataFrame, ts) -> DataFrame:
    return df.filter(F.col("ts") == F.lit(ts).cast(df.schema["ts"].dataType))


def between_ts(df: DataFrame, start, end) -> DataFrame:
    kind = df.schema["ts"].dataType
    return df.filter(F.col("ts").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def lookup_timestamp(scored: DataFrame, ts) -> DataFrame:
    """Prediction and actual labels at one timestamp."""
    return explain_reason(with_tier(at_timestamp(scored, ts))).select(
        "event_id", "machine_id", F.col("score").alias("probability"), "risk_tier", "primary_reason",
        "recommended_action", F.col(C.TARGET).alias("actual_failure_label"), *C.MODES)


def predictions_vs_actual(predictions: DataFrame, actuals: DataFrame, on: list[str] = ("event_id",)) -> DataFrame:
    """Equi-join of predictions with observed labels, by reading: two readings may share a machine and a time."""
    joined = predictions.join(actuals.select(*on, C.TARGET, *C.MODES), list(on))
    return with_tier(joined).withColumn("correct", (X.flag(F.col("score") >= 0.5) == F.col(C.TARGET)).cast("int"))


def range_summary(scored: DataFrame, start, end) -> DataFrame:
    """One row about a time range: risk, tiers, failures, flags, recommendation, mean context."""
    rows = with_tier(between_ts(scored, start, end))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0))
    context = [c for c in C.ENV_FIELDS if c in scored.columns]
    out = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("avg_probability"),
        F.max("score").alias("max_probability"),
        *[c.alias(n) for n, c in tier_counts(F.col("risk_tier")).items()],
        total(C.TARGET).alias("n_failures"), *[total(m).alias(f"n_{m}") for m in C.MODES],
        *[total(f).alias(f"n_{f}") for f in C.RISK_FLAGS], *[F.avg(c).alias(f"avg_{c}") for c in context])
    counts = [F.col(f"n_{f}") for f in C.RISK_FLAGS]
    top = F.greatest(*counts)
    dominant = F.when(top > 0, F.coalesce(*[F.when(n == top, F.lit(f)) for f, n in zip(C.RISK_FLAGS, counts)]))
    return out.withColumn("dominant_flag", dominant).withColumn(
        "recommendation", F.coalesce(X.lookup(F.col("dominant_flag"), {f: C.ACTIONS[f] for f in C.RISK_FLAGS}),
                                     F.lit(C.ROUTINE_RANGE)))


def trajectory(scored: DataFrame) -> DataFrame:
    return with_tier(scored).select("event_id", "ts", F.col("score").alias("probability"), "risk_tier",
                                    F.col(C.TARGET).alias("actual_failure"))


def range_trajectory(scored: DataFrame, start, end) -> DataFrame:
    return trajectory(between_ts(scored, start, end))


def list_sessions(df: DataFrame, n: int = C.N_SESSIONS, remainder: str = "last") -> DataFrame:
    failures = F.sum(F.col(C.TARGET).cast("bigint"))
    return session_blocks(df, n, remainder).groupBy("session_index").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_rows"),
        failures.alias("n_failures"), (failures > 0).cast("int").alias("had_failure"))


def session_trajectory(scored: DataFrame, index: int, n: int = C.N_SESSIONS) -> DataFrame:
    if not 0 <= index < n:
        raise ValueError(f"session index must be in 0..{n - 1}")
    return trajectory(session_blocks(scored, n).filter(F.col("session_index") == index))


def borrowed_history(what_if: DataFrame, history: DataFrame, session: str = "machine") -> tuple[DataFrame, DataFrame]:
    """(borrowed rows with their age, what-ifs whose ``borrow_ts`` occurs).

    What-ifs are merged into the machine's ordered rows, so one running count numbers the history and tells
    each what-if how many rows lie strictly before it. The newest 29 are then fetched by number: no what-if
    is ever paired with a whole history.
    """
    if session not in ("machine", "cycle0"):
        raise ValueError("session must be 'machine' or 'cycle0'")
    asked = what_if.filter(F.col("borrow_ts").isNotNull())
    exists = history.select("machine_id", F.col("ts").alias("borrow_ts"))
    found = asked.join(exists, ["machine_id", "borrow_ts"], "left_semi").select("whatif_id", "machine_id", "borrow_ts")
    history = history.join(found.select("machine_id").distinct(), "machine_id", "left_semi")
    rows = history.select("machine_id", "ts", F.lit(1).alias("_real"), F.col("event_id").alias("_id"),
                          "event_id", *C.SENSORS, "type")
    marks = found.select("machine_id", F.col("borrow_ts").alias("ts"), F.lit(0).alias("_real"),
                         F.col("whatif_id").alias("_id"), "whatif_id")
    merged = rows.unionByName(marks, allowMissingColumns=True)
    line = Series(merged, ["machine_id"], ["ts", "_real", "_id"])
    numbered = line.running_sum(merged, "_real", "_seq")
    places = numbered.filter(F.col("_real") == 0).select("whatif_id", "machine_id", F.col("_seq").alias("_upto"))
    first = F.greatest(F.lit(1), F.col("_upto") - (C.BUFFER_LEN - 2))
    if session == "cycle0":
        # cycle 0 is a prefix of the machine's rows; the session starts at its last row
        opening = (tool_cycle(history).filter(F.col("tool_cycle") == 0).groupBy("machine_id")
                   .agg(F.count(F.lit(1)).alias("_n0")))
        places = places.join(opening, "machine_id").filter(F.col("_upto") >= F.col("_n0"))
        first = F.greatest(first, F.col("_n0"))
    wanted = (places.filter(F.col("_upto") > 0).withColumn("_seq", F.explode(F.sequence(first, F.col("_upto"))))
              .select("whatif_id", "machine_id", "_seq", (F.col("_upto") - F.col("_seq") + 1).alias("_age")))
    source = numbered.filter(F.col("_real") == 1).select("machine_id", "_seq", *C.SENSORS, "type")
    return wanted.join(source, ["machine_id", "_seq"]).drop("machine_id", "_seq"), found


def whatif_features(what_if: DataFrame, history: DataFrame, session: str = "machine") -> DataFrame:
    """Causal features of entered readings, each on top of history borrowed from a machine.

    ``what_if``: whatif_id, machine_id, borrow_ts (null: cold start), sensors, type. The borrowed history is
    the newest 29 rows of the machine strictly before ``borrow_ts``. ``session="cycle0"`` starts it at the last
    row in tool cycle 0 at or before that time. A ``borrow_ts`` that does not occur borrows nothing and is
    reported in ``borrow_ts_found``.
    """
    borrowed, found = borrowed_history(what_if, history, session)
    entered = what_if.select("whatif_id", *C.SENSORS, "type", F.lit(0).cast("bigint").alias("_age"))
    buffer = instant_features(borrowed.select("whatif_id", *C.SENSORS, "type", "_age").unionByName(entered))

    # up to 30 rows per what-if, combined into conditional aggregates
    recent = lambda c, n: F.when(F.col("_age") < n, F.col(c))
    aggs = {}
    for n in C.WINDOWS:
        for c in C.CORE_SIGNALS:
            aggs[f"{c}_mean_{n}"] = F.avg(recent(c, n))
            aggs[f"{c}_std_{n}"] = F.stddev_pop(recent(c, n))
    aggs["_wear_mean"], aggs["_wear_std"] = F.avg(recent("tool_wear", 15)), F.stddev_pop(recent("tool_wear", 15))
    own = lambda c, k: F.max(F.when(F.col("_age") == k, F.col(c)))
    for c in C.LAG_SIGNALS:
        for k in (1, 2):
            aggs[f"{c}_lag_{k}"] = F.coalesce(own(c, k), own(c, 0))
    instant = [c for c in buffer.columns if c not in ("whatif_id", "_age")]
    aggs.update({c: own(c, 0) for c in instant})
    aggs["readings_seen"] = F.count(F.lit(1)).cast("int")
    rows = rolling_zscores(buffer.groupBy("whatif_id").agg(*[a.alias(n) for n, a in aggs.items()]))
    out = rows.join(what_if.select("whatif_id", "borrow_ts"), "whatif_id").join(
        found.select("whatif_id", F.lit(1).alias("_found")), "whatif_id", "left")
    return out.withColumns({
        "borrow_ts_found": F.when(F.col("borrow_ts").isNotNull(), F.coalesce("_found", F.lit(0))),
        "history_rows": F.col("readings_seen") - 1,
        "cold_start_warning": (F.col("readings_seen") == 1).cast("int"),
    }).drop("_found")
