"""Control-plane decisions over journals, routes, probes and containers, as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import ledger
from tallyhouse.operators.pipeline import updated
from tallyhouse.operators.telemetry import seconds_between

#: The stages of a probe: name -> (later, earlier) timestamp columns; fixed values.
LATENCIES = {
    "outbox_publish_confirm_seconds": ("published_at", "started_at"),
    "start_to_broker_seconds": ("broker_at", "started_at"),
    "broker_to_inbox_seconds": ("inbox_at", "broker_at"),
    "inbox_to_projection_seconds": ("projected_at", "inbox_at"),
    "end_to_end_projection_seconds": ("projected_at", "started_at"),
}
#: Codes that end a probe, the first one present counts; fixed values.
TERMINAL_PRIORITY = (
    "canary_publish_timeout",
    "canary_delivery_timeout",
    "canary_projection_timeout",
    "canary_ack_timeout",
    "canary_incomplete_timeout",
    "canary_consumer_configuration_invalid",
    "canary_stream_identity_mismatch",
    "canary_durable_identity_mismatch",
    "canary_consumer_identity_mismatch",
    "canary_ack_observer_unavailable",
)
#: State -> states that may follow in the provisioning journal; fixed values.
JOURNAL_STEPS: dict[str | None, tuple[str, ...]] = {
    None: ("prepared",),
    "prepared": ("applying", "target_verified", "rollback_started", "failed", "manual_intervention"),
    "applying": ("applied", "target_verified", "rollback_started", "failed", "manual_intervention"),
    "applied": ("target_verified", "rollback_started", "failed", "manual_intervention"),
    "target_verified": ("canary_verified", "rollback_started", "failed", "manual_intervention"),
    "canary_verified": ("readiness_verified", "rollback_started", "failed", "manual_intervention"),
    "readiness_verified": ("completed", "rollback_started", "failed", "manual_intervention"),
    "rollback_started": ("source_verified", "failed", "manual_intervention"),
    "source_verified": ("rolled_back", "failed", "manual_intervention"),
}


def with_latencies(probes: DataFrame) -> DataFrame:
    """``probes`` with the stages' seconds; a stage without both times is null."""
    return probes.withColumns({name: seconds_between(F.col(later), F.col(earlier)) for name, (later, earlier) in LATENCIES.items()})


def terminal_code(complete: Column, codes: Column) -> Column:
    """Why a probe ended: null if complete, else the code with the highest priority, else canary_incomplete."""
    ranked = F.array(*[F.lit(c) for c in TERMINAL_PRIORITY])
    return F.when(~complete, F.coalesce(F.get(F.filter(ranked, lambda c: F.array_contains(codes, c)), F.lit(0)), F.lit("canary_incomplete")))


#: Code of a topology change -> (status, decision); fixed values.
PREFLIGHT = {
    "topology_target_already_deployed": ("ok", "no_changes"),
    "topology_migration_required": ("critical", "blocked"),
    "topology_migration_cleanup_required": ("warning", "no_changes"),
    "topology_migration_expired": ("critical", "blocked"),
    "topology_migration_target_reached": ("ok", "no_changes"),
    "topology_live_state_unexpected": ("critical", "blocked"),
    "topology_migration_requires_single_resource": ("critical", "blocked"),
    "topology_migration_ready": ("ok", "safe_to_apply"),
}


def preflight(has_migration: Column, phase: Column, matched: Column, resources: Column) -> Column:
    """Struct (status, decision, code) of a topology change: what matches the live state, and how many resources differ."""
    live = F.coalesce(matched, F.lit("neither"))
    over = F.coalesce(phase == "expired", F.lit(False))
    without = F.when(live == "target", "topology_target_already_deployed").otherwise("topology_migration_required")
    after = F.when(live == "target", "topology_migration_cleanup_required").when(live == "source", "topology_migration_expired").otherwise("topology_live_state_unexpected")
    during = F.when(live == "target", "topology_migration_target_reached").when(live != "source", "topology_live_state_unexpected")
    during = during.when(resources != 1, "topology_migration_requires_single_resource").otherwise("topology_migration_ready")
    code = F.when(~has_migration, without).when(over, after).otherwise(during)
    table = F.create_map(*[x for c, (status, decision) in PREFLIGHT.items() for x in (F.lit(c), F.struct(F.lit(status).alias("status"), F.lit(decision).alias("decision")))])
    judged = F.element_at(table, code)
    return F.struct(judged["status"].alias("status"), judged["decision"].alias("decision"), code.alias("code"))


def canonical_fingerprint(fields: Column) -> Column:
    """SHA-256 of a string map as compact JSON with sorted keys (texts of ASCII characters)."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))), 256)


def retry_after(value: Column, now: Column, most_seconds: int = 86_400) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date from ``now`` on; at most ``most_seconds``, null if unreadable."""
    raw = F.trim(value)
    number = F.when(raw.rlike("^[0-9]+$"), F.least(F.coalesce(raw.try_cast("decimal(38,0)"), F.lit(most_seconds)), F.lit(most_seconds)))
    # the weekday says nothing that the date doesn't
    moment = F.try_to_timestamp(F.regexp_extract(raw, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.ceil(seconds_between(moment, now))
    return F.coalesce(number, F.when(moment.isNotNull(), F.least(F.greatest(wait, F.lit(0)), F.lit(most_seconds)))).cast("long")


def transaction_index(events: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index rows, rejected events with their reason) of posted transactions.

    Version 2 takes the tenant of its envelope, version 1 that of the ledger (``transactions``), with which it must agree.
    """
    told = transactions.select("transaction_id", F.col("tenant_id").alias("_tenant"), F.col("transaction_type").alias("_type"))
    joined = events.join(told, "transaction_id", "left")
    v2 = F.col("schema_version") == 2
    reason = (
        F.when(F.col("aggregate_version") != 1, "version_not_one")
        .when(~F.col("schema_version").isin(1, 2), "unsupported_schema")
        .when(v2 & F.col("tenant_id").isNull(), "tenant_missing")
        .when(~v2 & F.col("tenant_id").isNotNull(), "tenant_not_allowed")
        .when(~v2 & F.col("_tenant").isNull(), "no_source_ledger")
        .when(~v2 & (F.col("_type") != F.col("transaction_type")), "differs_from_ledger")
    )
    judged = joined.withColumn("reason", reason).withColumn("tenant_id", F.when(v2, F.col("tenant_id")).otherwise(F.col("_tenant"))).drop("_tenant", "_type")
    fine = judged.where("reason is null").groupBy("tenant_id", "transaction_id").agg(F.min(F.struct("event_id", "transaction_type", "schema_version")).alias("e"))
    return fine.select("tenant_id", "transaction_id", "e.event_id", "e.transaction_type", F.when(F.col("e.schema_version") == 2, "v2").otherwise("v1_legacy").alias("mode")), judged.where("reason is not null")


def rollout_batches(requests: DataFrame, outbox: DataFrame) -> DataFrame:
    """Each requested batch (batch_id, tenant_id, event_id rows) with its eligible events: a batch moves as a whole or not at all."""
    untouched = F.col("published_at").isNull() & F.col("quarantined_at").isNull() & F.col("claimed_until").isNull() & (F.col("attempt_count") == 0) & (F.col("delivery_route") == "shared")
    fit = outbox.where(untouched).select("event_id", "tenant_id").distinct().withColumn("eligible", F.lit(True))
    found = requests.join(fit, ["event_id", "tenant_id"], "left")
    counts = found.groupBy("batch_id").agg(F.count("*").alias("requested"), F.countDistinct("event_id").alias("distinct"), F.count("eligible").alias("eligible"))
    return counts.withColumn("accepted", F.col("requested").between(1, 100) & (F.col("requested") == F.col("distinct")) & (F.col("eligible") == F.col("requested")))


def provisioning_health(runs: DataFrame, as_of: Column, warning_seconds: float = 60, critical_seconds: float = 180) -> DataFrame:
    """Current and history status: the latest active run by lease and state age, the latest ended one by how it ended."""
    ended = F.col("state").isin("completed", "rolled_back", "failed", "manual_intervention")
    row = F.struct("started_at", "run_id", "state", "lease_until", "state_changed_at")
    last = runs.agg(F.max(F.when(~ended, row)).alias("a"), F.max(F.when(ended, row)).alias("t"))
    age = seconds_between(as_of, F.col("a.state_changed_at"))
    current = F.when(F.col("a.lease_until") <= as_of, "topology_provisioning_lease_expired").when(age >= critical_seconds, "topology_provisioning_execution_stuck").when(age >= warning_seconds, "topology_provisioning_execution_slow")
    names = {"rolled_back": "topology_provisioning_latest_rolled_back", "failed": "topology_provisioning_latest_failed", "manual_intervention": "topology_provisioning_manual_intervention"}
    history = reduce(lambda c, kv: c.when(F.col("t.state") == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    graded = last.select("a.run_id", current.alias("current_code"), history.alias("history_code"))
    warn = ("topology_provisioning_execution_slow", "topology_provisioning_latest_rolled_back")
    critical = reduce(lambda x, y: x | y, [F.col(c).isNotNull() & ~F.col(c).isin(*warn) for c in ("current_code", "history_code")])
    return graded.withColumn("status", F.when(critical, "critical").when(F.coalesce("current_code", "history_code").isNotNull(), "warning").otherwise("ok"))


def watchdog(receipts: DataFrame, expected_at: Column, as_of: Column, cadence_seconds: float, grace_seconds: float = 30) -> DataFrame:
    """Probe scheduling: status and code from the latest receipt (started_at, due_at) before ``as_of``."""
    last = receipts.where(F.col("started_at") <= as_of).agg(F.max(F.struct("due_at", "started_at")).alias("r"))
    due, lag = F.col("r.due_at"), seconds_between(F.col("r.started_at"), F.col("r.due_at"))
    missing = due.isNull() | (due < expected_at)
    late = seconds_between(as_of, expected_at) >= grace_seconds
    missed = F.greatest(F.lit(1), F.floor(seconds_between(expected_at, due) / cadence_seconds))
    code = F.when(missing & late & due.isNull(), "probe_execution_never_observed").when(missing & late, "probe_execution_missing").when(~missing & (lag >= 15), "probe_scheduler_lag")
    status = F.when(code == "probe_execution_never_observed", "critical").when(code == "probe_execution_missing", F.when(missed >= 2, "critical").otherwise("warning")).when(code == "probe_scheduler_lag", F.when(lag >= 60, "critical").otherwise("warning")).otherwise("ok")
    return last.select(status.alias("status"), code.alias("code"), F.when(missing & due.isNotNull(), missed).alias("missed"), lag.alias("lag_seconds"))


def relocatable(units: DataFrame, contents: DataFrame) -> DataFrame:
    """Top-level units and whether everything inside may move; ``contents``: unit_id, eligible (for movement)."""
    roots = units.where("parent_id is null")
    inside = ledger.descendants(units, roots)
    blocked = inside.join(contents.where(~F.col("eligible")).select("unit_id"), "unit_id").groupBy("root_id").agg(F.count("*").alias("blocked"))
    sizes = inside.groupBy("root_id").agg(F.count("*").alias("units"))
    return sizes.join(blocked, "root_id", "left").select("root_id", "units", F.coalesce("blocked", F.lit(0)).alias("blocked"), F.col("blocked").isNull().alias("relocatable"))


def next_generation(journal: DataFrame, key: str) -> DataFrame:
    """The generation that a replay of each key gets."""
    return journal.groupBy(key).agg((F.coalesce(F.max("generation"), F.lit(-1)) + 1).alias("next_generation"))


def claim_delivery(deliveries: DataFrame, subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """The delivery that is next (none or one row), of an active subscription: pending and due, or in flight with a lease that ran out
    (recovered: its open attempt ends as lease_expired)."""
    active = subscriptions.where("state = 'active'").select("subscription_id")
    due = (F.col("state") == "pending") & (F.col("next_attempt_at") <= as_of)
    lost = (F.col("state") == "in_flight") & (F.col("lease_expires_at") <= as_of)
    found = deliveries.join(active, "subscription_id").where(due | lost).withColumn("recovered", F.col("state") == "in_flight")
    return found.orderBy("next_attempt_at", "created_at", "delivery_id").limit(1)


def replay_deliveries(requests: DataFrame, deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """request_id, reason (null: accepted) and generation of requests to send an ended delivery again (request_id, delivery_id)."""
    last = deliveries.groupBy("subscription_id", "event_id").agg((F.coalesce(F.max("generation"), F.lit(-1)) + 1).alias("_next"))
    found = requests.join(deliveries.select("delivery_id", "subscription_id", "event_id", "state"), "delivery_id", "left").join(last, ["subscription_id", "event_id"], "left")
    found = found.join(subscriptions.select("subscription_id", F.col("state").alias("_subscription")), "subscription_id", "left")
    reason = F.when(F.col("state").isNull(), "delivery_not_found").when(~F.col("state").isin("succeeded", "dead_letter"), "delivery_not_ended").when(~F.col("_subscription").eqNullSafe("active"), "subscription_not_active")
    return found.select("request_id", reason.alias("reason"), F.when(reason.isNull(), F.col("_next")).alias("generation"))


def begin_rollouts(requests: DataFrame, activations: DataFrame, journal: DataFrame) -> DataFrame:
    """``requests`` (deployment_id, tenant_id, receipt_id) with accepted: the activation in force has this receipt, and the journal has
    it for the same tenant."""
    told = journal.select("receipt_id", "tenant_id").distinct()
    current = activations.join(told, ["receipt_id", "tenant_id"]).select("deployment_id", "tenant_id", F.col("receipt_id").alias("_receipt"))
    return requests.join(current, ["deployment_id", "tenant_id"], "left").select(*requests.columns, F.coalesce(F.col("_receipt") == F.col("receipt_id"), F.lit(False)).alias("accepted"))


def stage_events(requests: DataFrame, outbox: DataFrame, route: str = "tenant") -> DataFrame:
    """``outbox`` with the events of accepted batches (see ``rollout_batches``) moved to the tenant's route."""
    fine = rollout_batches(requests, outbox).where("accepted").select("batch_id")
    moved = requests.join(fine, "batch_id").select("event_id", "tenant_id").distinct().withColumn("delivery_route", F.lit(route))
    return updated(outbox, moved, "event_id", "tenant_id")


def pause_rollouts(requests: DataFrame, states: DataFrame) -> DataFrame:
    """``requests`` (deployment_id, tenant_id) with paused: true where the rollout (deployment_id, tenant_id, phase) was active."""
    key = ["deployment_id", "tenant_id"]
    found = requests.join(states.select(*key, "phase"), key, "left")
    return found.select(*requests.columns, F.coalesce(F.col("phase") == "active", F.lit(False)).alias("paused"))


def rollback_batches(requests: DataFrame, outbox: DataFrame, states: DataFrame, journal: DataFrame) -> DataFrame:
    """batch_id, reason (null: the whole batch goes back to the shared route) of requests (batch_id, deployment_id, tenant_id, event_id).

    The rollout must be paused; every event must be the tenant's, on its route, never attempted, staged in the rollout's own generation
    and not reverted before.  ``states``: deployment_id, tenant_id, phase, generation_id; ``journal``: deployment_id, generation_id,
    event_id, action.
    """
    key = ["deployment_id", "tenant_id"]
    untouched = F.col("published_at").isNull() & F.col("quarantined_at").isNull() & F.col("claimed_until").isNull() & (F.col("attempt_count") == 0) & (F.col("delivery_route") == "tenant")
    fit = outbox.where(untouched).select("event_id", "tenant_id").distinct().withColumn("_fit", F.lit(True))
    steps = journal.groupBy("deployment_id", "generation_id", "event_id").agg(F.bool_or(F.col("action") == "staged").alias("_staged"))
    gone = journal.where("action = 'reverted'").select("deployment_id", "event_id").distinct().withColumn("_reverted", F.lit(True))
    found = requests.join(states, key, "left").join(fit, ["event_id", "tenant_id"], "left").join(steps, ["deployment_id", "generation_id", "event_id"], "left").join(gone, ["deployment_id", "event_id"], "left")
    one = F.coalesce(F.col("_fit") & F.col("_staged") & F.col("_reverted").isNull(), F.lit(False))
    batches = found.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d"), F.count_if(one).alias("eligible"), F.bool_and(F.coalesce(F.col("phase") == "paused", F.lit(False))).alias("paused"))
    reason = F.when((F.col("n") > 100) | (F.col("n") != F.col("d")), "invalid_batch").when(~F.col("paused"), "not_paused").when(F.col("eligible") != F.col("n"), "not_entirely_eligible")
    return batches.select("batch_id", reason.alias("reason"))


#: What an outcome of a probe is evidence of; fixed values.
EVIDENCE = ("outcome", "health_status", "terminal_code")


def record_outcomes(probes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """canary_id, at and result of each outcome told (canary_id, outcome, health_status, terminal_code, at) for tracked probes (canary_id):
    recorded (the first), duplicate (the same evidence again), conflict (other evidence) or unknown_probe."""
    first = outcomes.groupBy("canary_id").agg(F.min(F.struct("at", *EVIDENCE)).alias("f"))
    found = outcomes.join(first, "canary_id").join(probes.select("canary_id").distinct().withColumn("_tracked", F.lit(True)), "canary_id", "left")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"f.{c}")) for c in EVIDENCE))
    result = F.when(F.col("_tracked").isNull(), "unknown_probe").when(F.col("at") == F.col("f.at"), "recorded").when(same, "duplicate").otherwise("conflict")
    return found.select("canary_id", "at", result.alias("result"))


def start_probes(requests: DataFrame, timeout_seconds: int) -> DataFrame:
    """Tracked probes: a pending outcome with its deadline for each request (canary_id, started_at), the first of an id."""
    first = requests.groupBy("canary_id").agg(F.min("started_at").alias("started_at"))
    return first.select("canary_id", "started_at", (F.col("started_at") + F.make_dt_interval(secs=F.lit(timeout_seconds))).alias("deadline_at"), F.lit("pending").alias("outcome"))


def read_probes(probes: DataFrame, publications: DataFrame, receipts: DataFrame, projections: DataFrame) -> DataFrame:
    """The five times of each probe (canary_id, started_at): published and at the broker, in the inbox, projected; null while unknown."""
    own = [
        publications.groupBy("canary_id").agg(F.min("published_at").alias("published_at"), F.min("broker_at").alias("broker_at")),
        receipts.groupBy("canary_id").agg(F.min("inbox_at").alias("inbox_at")), projections.groupBy("canary_id").agg(F.min("projected_at").alias("projected_at")),
    ]
    return reduce(lambda a, b: a.join(b, "canary_id", "left"), own, probes)


def transactions_of(index: DataFrame, tenant: str, caller_tenants: tuple[str, ...], limit: int) -> DataFrame:
    """Newest transactions of a tenant; who may not read it is refused before anything is read."""
    if tenant not in caller_tenants:
        raise PermissionError("tenant is outside the caller's scope")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return index.where(F.col("tenant_id") == tenant).orderBy(F.desc("occurred_at"), F.desc("transaction_id")).limit(limit)
