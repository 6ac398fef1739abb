"""Alert policies over snapshots, the worst status of components and their likely root cause."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.telemetry import age, seconds_between

RANK = {"ok": 0, "warning": 1, "critical": 2}


@dataclass(frozen=True)
class Threshold:
    """An alert when ``column`` reaches a threshold; without a warning level only critical, ``above`` compares with >."""

    code: str
    column: str
    critical: float
    warning: float | None = None
    above: bool = False


@dataclass(frozen=True)
class Flag:
    """An alert while a boolean column is true; ``observed`` names the number it tells, ``threshold`` what that is held against."""

    code: str
    column: str
    severity: str = "critical"
    observed: str | None = None
    threshold: float | None = None


Policy = tuple["Threshold | Flag", ...]

# Codes and default thresholds of the alerts; fixed values.
OUTBOX = (
    Threshold("outbox_quarantined_events", "quarantined_count", 0, above=True),
    Threshold("outbox_backlog_count_exceeded", "backlog_count", 10_000, 1_000),
    Threshold("outbox_ready_age_exceeded", "oldest_ready_age_seconds", 300, 60),
)
FAILURES = (
    Threshold("consumer_failure_quarantined_events", "quarantined_count", 0, above=True),
    Threshold("consumer_failure_backlog_count_exceeded", "backlog_count", 1_000, 100),
    Threshold("consumer_failure_ready_age_exceeded", "oldest_ready_age_seconds", 1_800, 300),
)
POISON = (
    Threshold("malformed_delivery_recent_records", "recent_count", 10, 1),
    Threshold("malformed_delivery_recent_reobserved_records", "recent_reobserved_count", 5, 1),
)
GAPS = (
    Threshold("projection_gap_age_exceeded", "oldest_pending_age_seconds", 1_800, 300),
    Threshold("projection_pending_events_exceeded", "pending_count", 1_000, 100),
)
PROBE = (Threshold("probe_scheduler_lag", "lag_seconds", 60, 15), Threshold("probe_stuck", "running_seconds", 45))
STREAM = (
    Flag("nats_stream_configuration_invalid", "configuration_invalid"),
    Threshold("nats_stream_lost_messages", "lost_messages", 0, above=True),
    Flag("nats_stream_leader_missing", "leader_missing"),
    Threshold("nats_stream_offline_followers", "offline_followers", 0, above=True),
    Flag("nats_stream_followers_not_current", "followers_not_current", "warning", "not_current_followers", 0.0),
    Threshold("nats_stream_replica_lag", "replica_lag", 10_000, 1_000),
    Threshold("nats_stream_message_capacity", "message_capacity_ratio", 0.95, 0.8),
    Threshold("nats_stream_byte_capacity", "byte_capacity_ratio", 0.95, 0.8),
)
CONSUMER = (
    Flag("nats_consumer_configuration_invalid", "configuration_invalid"),
    Threshold("nats_consumer_pending_backlog", "pending", 1_000, 100),
    Threshold("nats_consumer_redeliveries", "redelivered", 10, 1),
    Threshold("nats_consumer_ack_capacity", "ack_ratio", 1.0, 0.8),
    Threshold("nats_consumer_delivery_stalled", "delivery_stall_seconds", 1_800, 300),
    Threshold("nats_consumer_ack_stalled", "ack_stall_seconds", 1_800, 300),
    Flag("nats_consumer_paused_with_backlog", "paused_with_backlog", "warning", "backlog"),
)


def consumer_snapshot(rows: DataFrame, as_of: Column) -> DataFrame:
    """``rows`` (consumer, pending, ack_pending, redelivered, max_ack_pending, created_at, last_delivery_at, last_ack_at, paused,
    configuration_valid) with what the consumer policy looks at; without a backlog nothing stalls."""
    backlog = F.col("pending") + F.col("ack_pending")
    return rows.withColumns({
        "configuration_invalid": ~F.col("configuration_valid"), "backlog": backlog, "ack_ratio": F.col("ack_pending") / F.col("max_ack_pending"), "paused_with_backlog": F.col("paused") & (backlog > 0),
        "delivery_stall_seconds": F.when(F.col("pending") > 0, age(as_of, F.coalesce("last_delivery_at", "created_at"))),
        "ack_stall_seconds": F.when(F.col("ack_pending") > 0, age(as_of, F.coalesce("last_ack_at", "last_delivery_at", "created_at"))),
    })


def stream_snapshot(rows: DataFrame) -> DataFrame:
    """``rows`` (stream, configuration_valid, lost_messages, clustered, leader_present, offline_followers, not_current_followers, replica_lag,
    messages, max_messages, bytes, max_bytes) with what the stream policy looks at; a limit that is null or not positive is none."""
    def share(used: str, most: str) -> Column:
        return F.when(F.col(most) > 0, F.col(used) / F.col(most))

    return rows.withColumns({
        "configuration_invalid": ~F.col("configuration_valid"), "leader_missing": F.col("clustered") & ~F.col("leader_present"), "followers_not_current": (F.col("offline_followers") == 0) & (F.col("not_current_followers") > 0),
        "message_capacity_ratio": share("messages", "max_messages"), "byte_capacity_ratio": share("bytes", "max_bytes"),
    })


def alerts(policy: Policy) -> Column:
    """Array of (position, code, severity, observed, threshold) that a snapshot row raises; null values raise none."""

    def told(i: int, code: str, severity: str, observed: Column, limit: float | None) -> Column:
        return F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), observed.cast("double").alias("observed"), F.lit(limit).cast("double").alias("threshold"))

    def one(i: int, t: Threshold | Flag) -> Column:
        if isinstance(t, Flag):
            return F.when(F.col(t.column), told(i, t.code, t.severity, F.col(t.observed) if t.observed else F.lit(None), t.threshold))
        value = F.col(t.column).cast("double")
        out = F.when(value > t.critical if t.above else value >= t.critical, told(i, t.code, "critical", value, t.critical))
        return out if t.warning is None else out.when(value >= t.warning, told(i, t.code, "warning", value, t.warning))

    return F.filter(F.array(*[one(i, t) for i, t in enumerate(policy)]), lambda a: a.isNotNull())


def worst(found: Column) -> Column:
    """Status of an array of alerts."""
    return F.when(F.exists(found, lambda a: a["severity"] == "critical"), "critical").when(F.size(found) > 0, "warning").otherwise("ok")


def evaluate(snapshot: DataFrame, policy: Policy, *keys: str) -> DataFrame:
    """keys, status, and one row for each alert (a healthy snapshot has one row without an alert)."""
    judged = snapshot.select(*keys, alerts(policy).alias("alerts")).withColumn("status", worst(F.col("alerts")))
    return judged.select(*keys, "status", F.explode_outer("alerts").alias("alert")).select(*keys, "status", "alert.code", "alert.severity", "alert.observed", "alert.threshold")


def pipeline_health(components: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Worst status of components (component, status, code, alert_position; a component without a reading has a null status and
    counts as critical) and the root-cause candidate: the first alert, in the fixed order of components, of the worst severity."""
    status = F.coalesce("status", F.lit("critical"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), status)
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("component"))
    code = F.coalesce("code", F.when(F.col("status").isNull(), F.concat("component", F.lit("_unreadable"))))
    rows = components.select("component", rank.alias("rank"), F.struct(place.alias("place"), F.coalesce("alert_position", F.lit(0)).alias("position"), "component", code.alias("code")).alias("cause"))
    top = rows.agg(F.max("rank").alias("worst"))
    found = rows.crossJoin(F.broadcast(top)).agg(F.max("worst").alias("worst"), F.min(F.when((F.col("rank") == F.col("worst")) & (F.col("rank") > 0), F.col("cause"))).alias("cause"), F.count_if(F.col("rank") > 0).alias("unhealthy"))
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (v, k)]), F.col("worst"))
    return found.select(F.coalesce(name, F.lit("ok")).alias("status"), F.col("cause.component").alias("root_component"), F.col("cause.code").alias("root_code"), "unhealthy")


def burn_alerts(levels: DataFrame, fast: float = 14.4, slow: float = 3.0) -> DataFrame:
    """Multi-window burn alerts: fast if both 5 min and 1 h burn at ``fast`` or more, slow if both 1 h and 24 h do at ``slow``;
    and the higher rate of each pair."""
    kinds = ("availability", "latency")
    at = {(k, w): F.max(F.when(F.col("window_seconds") == w, F.col(f"{k}_burn_rate"))).alias(f"{k}_{w}") for k in kinds for w in (300, 3600, 86400)}
    row = levels.agg(*at.values())

    def both(k: str, a: int, b: int, limit: float) -> Column:
        x, y = F.col(f"{k}_{a}"), F.col(f"{k}_{b}")
        return F.coalesce(x.isNotNull() & y.isNotNull() & (F.least(x, y) >= limit), F.lit(False))

    pairs = {f"{k}_{name}": (k, a, b, limit) for k in kinds for name, a, b, limit in (("fast", 300, 3600, fast), ("slow", 3600, 86400, slow))}
    rates = [F.greatest(F.col(f"{k}_{a}"), F.col(f"{k}_{b}")).alias(f"{name}_rate") for name, (k, a, b, _) in pairs.items()]
    return row.select(*[both(*p).alias(name) for name, p in pairs.items()], *rates)


#: Seconds before attempt n + 1 of a webhook; fixed values.
WEBHOOK_LADDER = (5, 30, 120, 600, 1800, 3600, 7200, 21600)


def webhook_decision(status: Column, attempt: Column, most: int = 8) -> Column:
    """Struct (outcome, delay): success, retry after the ladder's delay, dead_letter, or invalid for statuses that can't be."""
    retry = status.isNull() | status.isin(408, 425, 429) | status.between(500, 599)
    delay = F.element_at(F.array(*[F.lit(x) for x in WEBHOOK_LADDER]), F.least(F.lit(len(WEBHOOK_LADDER)), attempt).cast("int"))
    outcome = F.when(status.between(200, 299), "success").when(retry & (attempt >= most), "dead_letter").when(retry, "retry").when(status.between(400, 499), "dead_letter").otherwise("invalid")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "retry", delay).alias("delay"))


def missed_slots(started: Column, before: Column, cadence_seconds: int) -> Column:
    """Slots a probe missed between two starts: max(1, floor(difference / cadence)) less the one that ran."""
    return F.greatest(F.lit(1), F.floor((F.unix_micros(started.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(1e6) / cadence_seconds)) - 1


def drift(expected: DataFrame, actual: DataFrame, tolerance: dict[str, float] | None = None) -> DataFrame:
    """Field-wise differences of (resource, field, value) tables; fields named in ``tolerance`` compare as numbers."""
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), ["resource", "field"], "full")
    same = F.col("expected").eqNullSafe(F.col("actual"))
    for field, most in (tolerance or {}).items():
        near = F.abs(F.col("expected").try_cast("double") - F.col("actual").try_cast("double")) <= most
        same = F.when(F.col("field") == field, same | F.coalesce(near, F.lit(False))).otherwise(same)
    return both.where(~same)


def overridden(source: DataFrame, overrides: DataFrame) -> DataFrame:
    """A migration's target: the source's (resource, field, value) with overrides in place."""
    return source.join(overrides.withColumnRenamed("value", "_new"), ["resource", "field"], "left").select("resource", "field", F.coalesce("_new", "value").alias("value"))


def illegal_transitions(history: DataFrame, key: str, order: str, allowed: dict[str | None, tuple[str, ...]]) -> DataFrame:
    """Journal rows whose state may not follow the one before (None: first rows)."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy(key).orderBy(order))
    fine = [(F.col("previous").isNull() if k is None else F.col("previous") == k) & F.col("state").isin(*v) for k, v in allowed.items()]
    return history.withColumn("previous", before).where(~F.coalesce(reduce(lambda a, b: a | b, fine), F.lit(False)))


#: Codes and default thresholds of a probe, and the seconds that clocks may differ; fixed values.
CANARY = (
    Flag("canary_consumer_configuration_invalid", "configuration_invalid"),
    Flag("canary_stream_identity_mismatch", "stream_differs"),
    Flag("canary_durable_identity_mismatch", "durable_differs"),
    Flag("canary_consumer_identity_mismatch", "consumer_differs"),
    Flag("canary_clock_skew_detected", "clocks_differ", observed="least_crossing_seconds", threshold=-1.0),
    Threshold("canary_publish_latency", "publish_seconds", 5, 2),
    Threshold("canary_delivery_latency", "delivery_seconds", 5, 2),
    Threshold("canary_projection_latency", "projection_seconds", 3, 1),
    Threshold("canary_end_to_end_latency", "end_to_end_seconds", 15, 5),
    Flag("canary_publish_timeout", "no_publish", observed="age_seconds"),
    Flag("canary_delivery_timeout", "no_delivery", observed="age_seconds"),
    Flag("canary_projection_timeout", "no_projection", observed="age_seconds"),
    Flag("canary_ack_timeout", "no_ack", observed="age_seconds"),
    Flag("canary_incomplete_timeout", "incomplete", observed="age_seconds"),
    Flag("canary_ack_observer_unavailable", "no_ack_observer"),
)
CLOCK_TOLERANCE = 1.0


def canary_snapshot(probes: DataFrame, stream: str, durable: str, consumer: str, as_of: Column) -> DataFrame:
    """``probes`` with what the canary policy looks at.

    ``probes``: started_at, published_at, broker_at, inbox_at, projected_at, stream_name, durable_name, consumer_name (null: not
    known yet), ack_available, ack_valid, ack_confirmed, complete, timed_out.  Negative latencies raise no latency alert; of the
    timeouts the first stage that is missing counts.
    """
    c = F.col

    def latency(later: str, earlier: str) -> Column:
        seconds = seconds_between(c(later), c(earlier))
        return F.when(seconds >= 0, seconds)

    crossing = F.array_compact(F.array(seconds_between(c("broker_at"), c("started_at")), seconds_between(c("inbox_at"), c("broker_at"))))
    behind = F.array_min(F.filter(crossing, lambda x: x < -CLOCK_TOLERANCE))
    late = c("timed_out") & ~c("complete")
    steps = {"no_publish": c("published_at").isNull(), "no_delivery": c("inbox_at").isNull(), "no_projection": c("projected_at").isNull(), "no_ack": ~c("ack_confirmed")}
    first, done = {}, F.lit(False)
    for name, missing in steps.items():
        first[name] = late & ~done & missing
        done = done | missing
    return probes.withColumns({
        "configuration_invalid": c("ack_available") & ~c("ack_valid"), "stream_differs": c("stream_name") != stream, "durable_differs": c("durable_name") != durable, "consumer_differs": c("consumer_name") != consumer,
        "least_crossing_seconds": behind, "clocks_differ": behind.isNotNull(), "publish_seconds": latency("published_at", "started_at"), "delivery_seconds": latency("inbox_at", "broker_at"),
        "projection_seconds": latency("projected_at", "inbox_at"), "end_to_end_seconds": latency("projected_at", "started_at"), **first, "incomplete": late & ~done, "age_seconds": age(as_of, c("started_at")),
        "no_ack_observer": ~c("ack_available") & c("timed_out"),
    })


#: Alerts over service levels: staleness, failures in a row, and burn rates of two windows; fixed values.
SLI = (
    Flag("canary_sli_no_observations", "never_run", threshold=180.0),
    Threshold("canary_sli_stale", "last_run_age_seconds", 180),
    Threshold("canary_sli_consecutive_failures", "consecutive_failures", 3, 2),
    Flag("canary_sli_availability_fast_burn", "availability_fast", "critical", "availability_fast_rate", 14.4),
    Flag("canary_sli_availability_slow_burn", "availability_slow", "warning", "availability_slow_rate", 3.0),
    Flag("canary_sli_latency_fast_burn", "latency_fast", "critical", "latency_fast_rate", 14.4),
    Flag("canary_sli_latency_slow_burn", "latency_slow", "warning", "latency_slow_rate", 3.0),
)


def sli_snapshot(levels: DataFrame, as_of: Column) -> DataFrame:
    """One row with what the service-level policy looks at, from the levels of the windows of 5 minutes, 1 hour and 24 hours."""
    history = levels.where("window_seconds = 300").select(F.col("last_run_at").isNull().alias("never_run"), age(as_of, F.col("last_run_at")).alias("last_run_age_seconds"), "consecutive_failures")
    return history.crossJoin(burn_alerts(levels))


#: Signals of readiness in the order in which a cause is sought, and the one that turns all others off; fixed values.
READINESS = ("configuration", "pipeline_health", "watchdog", "canary_sli")
DISABLED = "deployment_disabled"


def readiness(signals: DataFrame, order: tuple[str, ...] = READINESS) -> DataFrame:
    """pipeline_id, status (ready, degraded, not_ready), root_signal, root_code, n_signals.

    ``signals``: pipeline_id, signal, status (null: unavailable, hence critical), code.  Of a pipeline that is disabled only the
    configuration counts.  The cause is the first signal, in order, of the worst status.
    """
    off = signals.groupBy("pipeline_id").agg(F.bool_or((F.col("signal") == order[0]) & F.col("code").eqNullSafe(DISABLED)).alias("off"))
    counted = signals.join(off, "pipeline_id").where(~F.col("off") | (F.col("signal") == order[0]))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.coalesce("status", F.lit("critical")))
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("signal"))
    worst_first = F.min(F.struct((-rank).alias("r"), place.alias("p"), "signal", "code"))
    found = counted.groupBy("pipeline_id").agg(worst_first.alias("w"), F.count("*").alias("n_signals"))
    status = F.when(F.col("w.r") == -2, "not_ready").when(F.col("w.r") == -1, "degraded").otherwise("ready")
    cause = F.col("w.r") < 0
    return found.select("pipeline_id", status.alias("status"), F.when(cause, F.col("w.signal")).alias("root_signal"), F.when(cause, F.col("w.code")).alias("root_code"), "n_signals")


#: Components in the order in which a root cause is sought; fixed values.
COMPONENT_ORDER = ("outbox", "nats_stream", "nats_consumer", "malformed_delivery", "consumer_failure", "projection_gap")


def alert_counts(snapshots: DataFrame, policy: Policy) -> DataFrame:
    """How many snapshots raise each alert at each severity."""
    raised = snapshots.select(F.explode(alerts(policy)).alias("a"))
    return raised.groupBy(F.col("a.code").alias("code"), F.col("a.severity").alias("severity")).agg(F.count("*").alias("n"), F.max("a.observed").alias("worst"))
