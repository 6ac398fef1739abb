"""Events: building envelopes, claiming, retry delays, deduplication and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claimable(outbox: DataFrame, as_of: Column, route: str = "shared") -> DataFrame:
    """Events that a worker may claim: unpublished, not quarantined, of the route, due and not leased."""
    free = F.col("claimed_until").isNull() | (F.col("claimed_until") <= as_of)
    return outbox.where("published_at is null and quarantined_at is null").where((F.col("delivery_route") == route) & (F.col("available_at") <= as_of) & free)


def claim(outbox: DataFrame, as_of: Column, limit: int, lease_seconds: int, route: str = "shared") -> DataFrame:
    """The batch that a claim takes (oldest first), with its lease and attempt."""
    batch = claimable(outbox, as_of, route).orderBy("recorded_at", "event_id").limit(limit)
    return batch.withColumn("claimed_until", as_of + F.make_dt_interval(secs=F.lit(lease_seconds))).withColumn("attempt_count", F.col("attempt_count") + 1)


def envelope(columns: dict[str, Column], schema_version: Column, tenant_id: Column) -> Column:
    """JSON text of an event; nulls are left out, tenant_id is there from schema version 2 on."""
    tenant = F.when(schema_version >= 2, tenant_id)
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()], schema_version.alias("schema_version"), tenant.alias("tenant_id")))


#: Transaction type -> its own event type, beside the posted event that each transaction has; fixed values.
TYPED_EVENTS = {
    "reservation": "inventory.reservation.created",
    "reservation_release": "inventory.reservation.released",
    "allocation": "inventory.allocation.created",
    "allocation_release": "inventory.allocation.released",
    "movement": "inventory.movement.confirmed",
    "count_reconciliation": "inventory.reconciliation.posted",
}


def transaction_events(transactions: DataFrame) -> DataFrame:
    """transaction_id and event_type: one posted event, and a typed one where its type has one.

    ``transactions``: transaction_id, transaction_type, fingerprint.  An allocation has its own event only
    if its fingerprint is of an allocation commitment.
    """
    typed = F.when((F.col("transaction_type") != "allocation") | F.col("fingerprint").startswith("allocation-commitment:"), F.element_at(F.create_map(*[F.lit(x) for kv in TYPED_EVENTS.items() for x in kv]), F.col("transaction_type")))
    return transactions.select("transaction_id", F.explode(F.filter(F.array(F.lit("inventory.transaction.posted"), typed), lambda e: e.isNotNull())).alias("event_type"))


def leg_events(legs: DataFrame, *keys: str, order: tuple[str, ...]) -> DataFrame:
    """``legs`` with the running version of their position."""
    return legs.withColumn("aggregate_version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def state_changes(history: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows whose state differs from the one before, with previous_state and a version without gaps."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = history.withColumn("previous_state", F.lag("state").over(w)).where("previous_state is null or previous_state <> state")
    return changed.withColumn("domain_event_version", F.row_number().over(w).cast("long"))


def state_since(history: DataFrame, key: str, at: str) -> DataFrame:
    """Current state of each key and when it took it (later rows with the same state don't move that)."""
    w = Window.partitionBy(key).orderBy(at)
    marked = history.withColumn("_before", F.lag("state").over(w))
    return marked.groupBy(key).agg(F.max_by("state", at).alias("state"), F.max(F.when(~F.col("_before").eqNullSafe(F.col("state")), F.col(at))).alias("state_changed_at"))


def unit_interval(text: Column) -> Column:
    """First eight bytes of the text's SHA-256 as a share of 2^64 - 1 (double)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def retry_delay(event_id: Column, attempt: Column, base_seconds: int = 5, max_seconds: int = 3600, jitter: float = 0.2, max_attempts: int = 8, prefix: str = "") -> Column:
    """Seconds until the next attempt, null once the attempts are spent (then the event is quarantined).

    Doubles with each attempt up to the maximum; a jitter from a hash of event and attempt is reproducible.
    Halves round to even.
    """
    exponential = F.least(F.lit(float(max_seconds)), F.lit(float(base_seconds)) * F.pow(F.lit(2.0), attempt - 1))
    u = unit_interval(F.concat(F.lit(prefix), event_id.cast("string"), F.lit(":"), attempt.cast("string")))
    delay = F.rint(exponential * (1 + F.lit(jitter) * (2 * u - 1))).cast("long")
    return F.when(attempt < max_attempts, F.least(F.lit(max_seconds).cast("long"), F.greatest(F.lit(1).cast("long"), delay)))


#: SQLSTATE -> (code, retryable); fixed values.
SQLSTATES = {
    "40001": ("database_serialization_failure", True),
    "40P01": ("database_deadlock", True),
    "55P03": ("database_lock_unavailable", True),
    "57014": ("database_statement_cancelled", True),
    "23514": ("handler_constraint_violation", False),
}


def classify_failure(sqlstate: Column, message: Column, kind: Column) -> Column:
    """Struct (code, retryable) of a handler's failure; ``kind``: value, data, operational or other."""
    text = F.lower(F.coalesce(message, F.lit("")))

    def result(code: str, retryable: bool) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(retryable).alias("retryable"))

    out = F.when((sqlstate == "55000") & text.contains("projection rebuild fence is active"), result("projection_rebuild_fence_active", True))
    for state, (code, retryable) in SQLSTATES.items():
        out = out.when(sqlstate == state, result(code, retryable))
    out = out.when(sqlstate.startswith("08"), result("database_connection_failure", True))
    out = out.when((sqlstate == "23505") & (text.contains("projection") | text.contains("version")), result("projection_version_conflict", False))
    out = out.when(sqlstate == "23505", result("handler_identity_conflict", False))
    out = out.when(kind == "value", result("invalid_event_contract", False)).when(kind == "data", result("handler_data_violation", False))
    return out.when(kind == "operational", result("database_unavailable", True)).otherwise(result("handler_failure", True))


def first_receipts(deliveries: DataFrame) -> DataFrame:
    """The inbox: the first receipt of each consumer and event, and how often it came."""
    return deliveries.groupBy("consumer_name", "event_id").agg(F.min("received_at").alias("first_seen_at"), F.count("*").alias("deliveries"))


def poison_identities(observations: DataFrame) -> DataFrame:
    """Undecodable deliveries by stream identity; different payloads under one identity are a conflict."""
    return observations.groupBy("stream", "stream_sequence").agg(F.count("*").alias("observation_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), (F.countDistinct("payload_sha256") > 1).alias("conflict"))


def archive(live: DataFrame, ended_at: str, before: Column, limit: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows that move to the archive: the oldest ``limit`` ended before the cutoff; rows that stay)."""
    moved = live.where(F.col(ended_at) < before).orderBy(ended_at, *order).limit(limit)
    return moved, live.join(moved.select(*order), list(order), "left_anti")


def _checked(limit: int, most: int = 1000) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def archive_with_records(live: DataFrame, records: DataFrame, ended_at: str, before: Column, limit: int, *key: str) -> dict[str, DataFrame]:
    """As ``archive``, with what was recorded about the rows (``records``, by the same key): moved, kept, moved_records, kept_records."""
    moved, kept = archive(live, ended_at, before, _checked(limit), *key)
    keys = moved.select(*key)
    return {"moved": moved, "kept": kept, "moved_records": records.join(keys, list(key), "left_semi"), "kept_records": records.join(keys, list(key), "left_anti")}


def archive_failures(failures: DataFrame, receipts: DataFrame, actions: DataFrame, consumer: str, before: Column, limit: int) -> dict[str, DataFrame]:
    """Archive of a consumer's resolved failures that the inbox has a receipt of, with the operators' actions on them."""
    key = ["consumer_name", "event_id"]
    done = failures.where((F.col("consumer_name") == consumer) & (F.col("status") == "resolved")).join(receipts.select(*key), key, "left_semi")
    found = archive_with_records(done, actions.where(F.col("consumer_name") == consumer), "resolved_at", before, limit, *key)
    keys = found["moved"].select(*key)
    return found | {"kept": failures.join(keys, key, "left_anti"), "kept_records": actions.join(keys, key, "left_anti")}


def retention_cutoff(as_of: Column, days: int = 30) -> Column:
    """What ended before this may be archived."""
    if days < 1:
        raise ValueError("days must be positive")
    return as_of - F.make_dt_interval(days=F.lit(days))


def claim_failures(failures: DataFrame, consumer: str, as_of: Column, limit: int, lease_seconds: int) -> DataFrame:
    """The batch of a consumer's deferred failures that are due and not leased, longest due first, with its lease."""
    free = F.col("claimed_until").isNull() | (F.col("claimed_until") <= as_of)
    due = failures.where((F.col("consumer_name") == consumer) & (F.col("status") == "deferred") & (F.col("available_at") <= as_of) & free)
    return due.orderBy("available_at", "first_failed_at", "event_id").limit(_checked(limit)).withColumn("claimed_until", as_of + F.make_dt_interval(secs=F.lit(lease_seconds)))


def fail_again(claimed: DataFrame, results: DataFrame, as_of: Column, max_attempts: int) -> DataFrame:
    """Leased failures after another failed attempt (``results``: consumer_name, event_id, failure_code, can_retry, retry_after).

    One attempt more; deferred while it may be retried and attempts are left, else quarantined with the reason.
    """
    own = claimed.where((F.col("status") == "deferred") & (F.col("claimed_until") > as_of)).drop("failure_code").join(results, ["consumer_name", "event_id"])
    attempt = F.col("attempt_count") + 1
    status = F.when(F.col("can_retry") & (attempt < max_attempts), "deferred").otherwise("quarantined")
    reason = F.concat(F.when(F.col("can_retry"), "attempt_limit_exhausted:").otherwise("terminal:"), F.col("failure_code"))
    return own.select(
        "consumer_name", "event_id", status.alias("status"), attempt.alias("attempt_count"), "failure_code", F.col("can_retry").alias("retryable"), (as_of + F.make_dt_interval(secs=F.col("retry_after"))).alias("available_at"),
        F.when(status == "quarantined", reason).alias("quarantine_reason"), F.when(status == "quarantined", as_of).alias("quarantined_at"),
    )


def replay_failures(requests: DataFrame, failures: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    """replay_id and outcome of requests to replay quarantined failures (replay_id, consumer_name, event_id, operator_id, reason).

    A replay's identity is looked up among live and archived actions together: the same request again is a duplicate, another one
    under the same id conflicts, and one that is in both tables is corrupt.
    """
    identity = ["consumer_name", "event_id", "operator_id", "reason"]
    both = live.select("replay_id", *identity).unionByName(archived.select("replay_id", *identity))
    known = both.groupBy("replay_id").agg(F.count("*").alias("copies"), *[F.min(c).alias(f"_{c}") for c in identity])
    held = failures.where("status = 'quarantined'").select("consumer_name", "event_id").distinct().withColumn("_held", F.lit(True))
    found = requests.join(known, "replay_id", "left").join(held, ["consumer_name", "event_id"], "left")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col("copies") > 1, "identity_in_live_and_archive").when(F.col("copies").isNotNull() & ~same, "identity_of_another_request").when(F.col("copies").isNotNull(), "duplicate").when(F.col("_held").isNull(), "not_quarantined").otherwise("replayed")
    return found.select("replay_id", outcome.alias("outcome"))


def consume(deliveries: DataFrame, receipts: DataFrame, failures: DataFrame) -> DataFrame:
    """``deliveries`` (consumer_name, event_id, malformed (code or null), error (code or null)) with the route each takes:
    malformed, known_failure, duplicate, captured or applied.  All are acknowledged, once what the route asks for is stored."""
    key = ["consumer_name", "event_id"]
    seen = receipts.select(*key).distinct().withColumn("_seen", F.lit(True))
    failed = failures.select(*key).distinct().withColumn("_failed", F.lit(True))
    found = deliveries.join(failed, key, "left").join(seen, key, "left")
    route = F.when(F.col("malformed").isNotNull(), "malformed").when(F.col("_failed"), "known_failure").when(F.col("_seen"), "duplicate").when(F.col("error").isNotNull(), "captured").otherwise("applied")
    return found.select(*deliveries.columns, route.alias("route"))


def retry_cycle(claimed: DataFrame, receipts: DataFrame, errors: DataFrame) -> DataFrame:
    """Outcome of each claimed failure on its way through the inbox: duplicate (a receipt is there), failed (``errors``) or applied; the
    first two of these resolve it."""
    key = ["consumer_name", "event_id"]
    found = claimed.select(*key).join(receipts.select(*key).distinct().withColumn("_seen", F.lit(True)), key, "left").join(errors.select(*key).distinct().withColumn("_error", F.lit(True)), key, "left")
    outcome = F.when(F.col("_seen"), "duplicate").when(F.col("_error"), "failed").otherwise("applied")
    return found.select(*key, outcome.alias("outcome"), (outcome != "failed").alias("resolved"))


def enqueue(requests: DataFrame, known: DataFrame) -> DataFrame:
    """event_id and outcome of requests to enqueue (tenant_id, dedup_key, event_id, payload, requested_at): a key is bound to its payload
    for good, be it queued, published or archived (``known``: tenant_id, dedup_key, event_id, payload).

    enqueued: the first of its key; duplicate: the same payload again (with the event that has it); conflict: another payload.
    """
    payload = F.sha2("payload", 256)
    first = requests.groupBy("tenant_id", "dedup_key").agg(F.min(F.struct("requested_at", "event_id", payload.alias("payload"))).alias("f"))
    bound = known.select("tenant_id", "dedup_key", F.col("event_id").alias("k_event"), payload.alias("k_payload"))
    found = requests.join(first, ["tenant_id", "dedup_key"]).join(bound, ["tenant_id", "dedup_key"], "left")
    owner, wanted = F.coalesce("k_event", "f.event_id"), F.coalesce("k_payload", "f.payload")
    outcome = F.when(payload != wanted, "conflict").when(F.col("event_id") == owner, F.when(F.col("k_event").isNull(), "enqueued").otherwise("duplicate")).otherwise("duplicate")
    return found.select("event_id", outcome.alias("outcome"), F.when(outcome != "conflict", owner).alias("bound_to"))


def route_error(subject: Column, header_tenant: Column, envelope_tenant: Column, envelope_type: Column, schema_version: Column, prefix: str, tenant: Column, event_type: Column) -> Column:
    """Why a delivery isn't of a tenant's route (null: it is): its subject, its header and its envelope must all be exactly the route's."""
    expected = F.concat_ws(".", F.lit(prefix), F.lit("tenants"), tenant, event_type)
    return (
        F.when(~subject.eqNullSafe(expected), "subject_differs")
        .when(~header_tenant.eqNullSafe(tenant), "header_differs")
        .when(~schema_version.eqNullSafe(F.lit(2)), "schema_not_routed")
        .when(~envelope_type.eqNullSafe(event_type), "type_not_authorized")
        .when(~envelope_tenant.eqNullSafe(tenant), "tenant_outside_route")
    )


def updated(target: DataFrame, changes: DataFrame, *key: str) -> DataFrame:
    """``target`` with the columns of ``changes`` (one row for each key) in place: what UPDATE ... FROM does, as a new table."""
    new = [c for c in changes.columns if c not in key]
    joined = target.join(changes.select(*key, F.struct(*new).alias("_new")), list(key), "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


def without(target: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """``target`` without the rows that ``gone`` names: what DELETE ... USING does, as a new table."""
    return target.join(gone.select(*key), list(key), "left_anti")


def ordered_ids(rows: DataFrame, at: str, event_id: str, *keys: str) -> DataFrame:
    """Ids of each group in order of time and id."""
    pairs = F.array_sort(F.collect_list(F.struct(at, event_id)))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p[event_id]).alias("ids"), F.count("*").alias("n"))


def live_or_archived(wanted: DataFrame, live: DataFrame, archived: DataFrame, key: str, value: str) -> DataFrame:
    """``wanted`` with the value found in the live or the archive table (null where in neither)."""
    both = live.select(key, value).unionByName(archived.select(key, value)).groupBy(key).agg(F.max(value).alias(value), F.count("*").alias("copies"))
    return wanted.join(both, key, "left")


def claim_for_tenant(outbox: DataFrame, tenant_id: Column, event_type: str, as_of: Column, limit: int, lease_seconds: int) -> DataFrame:
    """As ``claim`` for the events of one tenant that were moved to its own route; shared claims never see those."""
    own = outbox.where((F.col("tenant_id") == tenant_id) & (F.col("event_type") == event_type))
    return claim(own, as_of, limit, lease_seconds, route="tenant")


def delivery_outcomes(actions: DataFrame) -> DataFrame:
    """State of each event from its log of actions (event_id, action, at): an acknowledgement is final, else the last
    of nack, quarantine and replay decides; attempts count since the last replay."""
    acked = F.max(F.when(F.col("action") == "ack", F.col("at")))
    rest = F.max(F.when(F.col("action").isin("nack", "quarantine", "replay"), F.struct("at", "action")))
    summary = actions.groupBy("event_id").agg(acked.alias("published_at"), rest.alias("last"), F.max(F.when(F.col("action") == "replay", F.col("at"))).alias("_replayed"))
    tries = actions.where("action in ('nack', 'ack')").join(summary.select("event_id", "_replayed"), "event_id").where("_replayed is null or at > _replayed").groupBy("event_id").agg(F.count("*").alias("attempts"))
    state = F.when(F.col("published_at").isNotNull(), "published").when(F.col("last.action") == "quarantine", "quarantined").otherwise("waiting")
    return summary.join(tries, "event_id", "left").select("event_id", state.alias("state"), "published_at", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def failure_states(failures: DataFrame, receipts: DataFrame, budget: int = 5) -> DataFrame:
    """Status of each failed delivery (consumer_name, event_id, retryable, at): resolved once the inbox has a receipt,
    quarantined when it can't be retried or its attempts are spent, else deferred."""
    counted = failures.groupBy("consumer_name", "event_id").agg(F.count("*").alias("attempts"), F.max_by("retryable", "at").alias("retryable"), F.min("at").alias("first_failed_at"))
    found = counted.join(receipts.select("consumer_name", "event_id").distinct().withColumn("_done", F.lit(True)), ["consumer_name", "event_id"], "left")
    reason = F.when(~F.col("retryable"), "terminal").when(F.col("attempts") >= budget, "attempts_spent")
    status = F.when(F.col("_done"), "resolved").when(reason.isNotNull(), "quarantined").otherwise("deferred")
    return found.select("consumer_name", "event_id", "attempts", "first_failed_at", status.alias("status"), F.when(status == "quarantined", reason).alias("reason"))


def publisher_cycle(attempts: DataFrame, *keys: str) -> DataFrame:
    """Counters of publishing cycles from their attempts (outcome: published, failed, quarantined, stale)."""
    kinds = ("published", "failed", "quarantined", "stale")
    return attempts.groupBy(*keys).agg(F.count("*").alias("claimed"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
