"""Registered queries of the library on the supplied tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import availability, control, health, knowledge, ledger, pipeline, projection, quality, replay, telemetry, work
from tallyhouse.operators.availability import SCOPE, qty
from tallyhouse.plans.mapping import AS_OF, HOLD_AS_OF, Source
from tallyhouse.registry import ORACLE_SQL, QUERIES, as_of, query
from tallyhouse.sources import exposition, seed

SCOPE_SQL = ", ".join(SCOPE)
SAME_SCOPE = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in SCOPE)
ACTIVE = f"h.starts_at <= TS'{HOLD_AS_OF}' AND h.released_at IS NULL AND (h.expires_at IS NULL OR h.expires_at > TS'{HOLD_AS_OF}')"


def _eligible_sql(action: str) -> str:
    return f"""NOT EXISTS (SELECT 1 FROM holds h JOIN hold_policies q ON q.policy_id = h.policy_id WHERE q.blocks_{action} AND {ACTIVE}
        AND (h.position_id IS NULL OR h.position_id = p.position_id) AND {" AND ".join(f"h.{k} IS NOT DISTINCT FROM p.{k}" for k in SCOPE)})"""


# ---- availability -----------------------------------------------------------------------------


@query(("positions", "reservations", "hold_policies", "holds"), f"""
, marked AS (SELECT p.*, {_eligible_sql("allocation")} AS eligible FROM positions p),
stock AS (SELECT {SCOPE_SQL}, SUM(physical_qty) AS physical_qty, SUM(reserved_qty) AS exact_reserved_qty, SUM(allocated_qty) AS allocated_qty,
  SUM(CASE WHEN eligible THEN physical_qty - allocated_qty - reserved_qty ELSE 0 END) AS free FROM marked GROUP BY ALL),
claims AS (SELECT {SCOPE_SQL}, SUM(quantity - allocated_qty - consumed_qty - released_qty) AS claimed FROM reservations GROUP BY ALL)
SELECT {", ".join("a." + k for k in SCOPE)}, CAST(physical_qty AS DOUBLE) AS physical_qty, CAST(exact_reserved_qty AS DOUBLE) AS exact_reserved_qty, CAST(allocated_qty AS DOUBLE) AS allocated_qty,
  CAST(COALESCE(claimed, 0) AS DOUBLE) AS coarse_reserved_qty, CAST(GREATEST(free - COALESCE(claimed, 0), 0) AS DOUBLE) AS available_qty
FROM stock a LEFT JOIN claims b ON {SAME_SCOPE}""")
def a2_scope_availability(s: Source) -> DataFrame:
    s.share("positions")
    return availability.scope_availability(s.relation("positions"), s.relation("reservations"), s.relation("holds"), s.relation("hold_policies"), as_of(HOLD_AS_OF))


@query(("positions", "hold_policies", "holds"), f"SELECT position_id, {_eligible_sql('allocation')} AS allocation, {_eligible_sql('movement')} AS movement, {_eligible_sql('picking')} AS picking, {_eligible_sql('shipping')} AS shipping FROM positions p")
def h1_action_eligibility(s: Source) -> DataFrame:
    s.share("positions")
    found = availability.action_eligibility(s.relation("positions"), s.relation("holds"), s.relation("hold_policies"), as_of(HOLD_AS_OF))
    return found.select("position_id", *availability.ACTIONS)


@query(("positions", "hold_policies", "holds"), f"SELECT h.hold_id, h.policy_id, h.starts_at, h.expires_at FROM holds h WHERE {ACTIVE}")
def f11_active_holds(s: Source) -> DataFrame:
    return s.relation("holds").where(availability.active_at(as_of(HOLD_AS_OF))).select("hold_id", "policy_id", "starts_at", "expires_at")


@query(("positions",), """
SELECT position_id, location_id, CAST(physical_qty AS DOUBLE) AS physical_qty, CAST(allocated_qty AS DOUBLE) AS allocated_qty FROM positions WHERE warehouse_id = 5 AND condition_id = 'N' AND lot_id IS NULL AND positions.physical_qty > positions.allocated_qty
ORDER BY location_id NULLS LAST, position_id LIMIT 20""")
def t1_candidate_positions(s: Source) -> DataFrame:
    found = availability.candidates(s.relation("positions"), {"warehouse_id": 5, "condition_id": "N", "lot_id": None})
    return found.select("position_id", "location_id", "physical_qty", "allocated_qty")


# ---- ledger -----------------------------------------------------------------------------------


@query(("legs",), "SELECT location_id, item_id, CAST(SUM(physical_delta) AS DOUBLE) AS physical_qty, COUNT(*) AS legs FROM legs GROUP BY location_id, item_id")
def l2_ledger_balances(s: Source) -> DataFrame:
    return ledger.balances(s.relation("legs"), "location_id", "item_id")


@query(("legs",), "SELECT transaction_id, CAST(SUM(physical_delta) AS DOUBLE) AS difference, COUNT(*) AS legs FROM legs GROUP BY transaction_id HAVING SUM(physical_delta) <> 0")
def l5_conservation(s: Source) -> DataFrame:
    return ledger.unbalanced(s.relation("legs"))


@query(("legs",), """
, daily AS (SELECT location_id, item_id, posted_on, CAST(SUM(physical_delta) AS DECIMAL(24,6)) AS delta FROM legs GROUP BY ALL)
SELECT location_id, item_id, posted_on, CAST(delta AS DOUBLE) AS delta, CAST(SUM(delta) OVER (PARTITION BY location_id, item_id ORDER BY posted_on) AS DOUBLE) AS balance FROM daily""")
def l4_running_balance(s: Source) -> DataFrame:
    return ledger.running_balance(s.relation("legs"))


COUNTS = "SELECT DISTINCT l_suppkey AS location_id, l_partkey AS item_id, CAST('2000-06-30 00:00:00' AS TIMESTAMP) AS observed_on, CAST(l_partkey % 7 AS DECIMAL(24,6)) AS counted FROM lineitem"


@query(("legs",), f"""
, counts AS ({COUNTS}), known AS (
SELECT c.location_id, c.item_id, c.observed_on, c.counted, CAST(COALESCE(SUM(l.physical_delta), 0) AS DECIMAL(24,6)) AS system_qty
FROM counts c LEFT JOIN legs l ON l.location_id = c.location_id AND l.item_id = c.item_id AND l.posted_on <= c.observed_on GROUP BY ALL)
SELECT * REPLACE (CAST(counted AS DOUBLE) AS counted, CAST(system_qty AS DOUBLE) AS system_qty), CAST(counted - system_qty AS DOUBLE) AS variance_qty FROM known""")
def l12_count_variance(s: Source) -> DataFrame:
    counts = s.spark.sql(COUNTS.replace("FROM lineitem", "FROM {t}").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), t=s.table("lineitem"))
    return ledger.balance_at(s.relation("legs"), counts)


COMMANDS = "SELECT o_custkey % 50 AS tenant_id, concat('k', CAST(o_custkey % 400 AS VARCHAR(20))) AS idempotency_key, o_orderkey AS id, o_orderdate AS recorded_at, CAST(o_custkey % 3 AS VARCHAR(20)) AS kind, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS detail FROM orders"


def commands(s: Source) -> DataFrame:
    rows = s.spark.sql(COMMANDS.replace("VARCHAR(20)", "STRING").replace("FROM orders", "FROM {t}"), t=s.table("orders"))
    return rows.withColumn("fingerprint", ledger.fingerprint("command", "kind", "detail"))


@query((), f"""
WITH c AS (SELECT *, sha256('command:' || kind || ':' || COALESCE(detail, '-')) AS fingerprint FROM ({COMMANDS}))
SELECT tenant_id, idempotency_key, id, fingerprint FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY recorded_at, id) AS n FROM c) WHERE n = 1""")
def i1_first_commands(s: Source) -> DataFrame:
    return ledger.idempotent(commands(s), "tenant_id", "idempotency_key")[0].select("tenant_id", "idempotency_key", "id", "fingerprint")


@query((), f"SELECT tenant_id, idempotency_key, COUNT(DISTINCT concat(kind, ':', COALESCE(detail, '-'))) AS fingerprints FROM ({COMMANDS}) GROUP BY ALL HAVING COUNT(DISTINCT concat(kind, ':', COALESCE(detail, '-'))) > 1")
def i1_idempotency_conflicts(s: Source) -> DataFrame:
    return ledger.idempotent(commands(s), "tenant_id", "idempotency_key")[1]


@query(("handling_units",), """
, inside AS (SELECT unit_id AS root_id, unit_id, 0 AS level FROM handling_units WHERE parent_id IS NULL UNION ALL SELECT i.root_id, u.unit_id, i.level + 1 FROM inside i JOIN handling_units u ON u.parent_id = i.unit_id)
SELECT root_id, level, COUNT(*) AS units, CAST(SUM(size) AS BIGINT) AS size FROM inside JOIN handling_units USING (unit_id) GROUP BY root_id, level""", recursive=True)
def j9_unit_tree(s: Source) -> DataFrame:
    units = s.relation("handling_units")
    inside = ledger.descendants(units, units.where("parent_id is null"))
    return inside.join(units, "unit_id").groupBy("root_id", "level").agg(F.count("*").alias("units"), F.sum("size").alias("size"))


# ---- work -------------------------------------------------------------------------------------


@query(("works", "assignments"), """
SELECT work_id, tenant_id, warehouse_id, priority, due_at, ROW_NUMBER() OVER (PARTITION BY tenant_id, warehouse_id ORDER BY priority DESC, due_at ASC NULLS LAST, created_at, work_id) AS queue_rank
FROM works w WHERE state = 'released' AND NOT EXISTS (SELECT 1 FROM assignments a WHERE a.work_id = w.work_id AND a.state = 'active')""")
def w1_work_queue(s: Source) -> DataFrame:
    return work.queue(s.relation("works"), s.relation("assignments")).select("work_id", "tenant_id", "warehouse_id", "priority", "due_at", "queue_rank")


@query(("tasks",), """
SELECT work_id, (min({'s': sequence, 'id': task_id})).id AS first_task, (min({'s': sequence, 'id': task_id}) FILTER (WHERE state NOT IN ('completed', 'cancelled'))).id AS next_task,
  (min({'s': sequence, 'id': task_id}) FILTER (WHERE state NOT IN ('completed', 'cancelled'))).s AS next_sequence, COUNT(*) AS tasks, COUNT(*) FILTER (WHERE state = 'completed') AS completed FROM tasks GROUP BY work_id""")
def t3_next_task(s: Source) -> DataFrame:
    return work.next_task(s.relation("tasks"))


@query(("assignments",), "SELECT work_id, COUNT(*) AS active FROM assignments WHERE state = 'active' GROUP BY work_id HAVING COUNT(*) > 1")
def dq_double_assignments(s: Source) -> DataFrame:
    return work.doubly_assigned(s.relation("assignments"))


# ---- telemetry --------------------------------------------------------------------------------

def _age_sql(expression: str, name: str) -> str:
    return f"CASE WHEN {expression} IS NOT NULL THEN GREATEST((epoch_us(TS'{AS_OF}') - epoch_us({expression})) / 1e6, 0.0) END AS {name}"


def _state_sql(quarantined: str) -> str:
    return f"CASE WHEN {quarantined} THEN 'quarantined' WHEN claimed_until > TS'{AS_OF}' THEN 'leased' WHEN available_at > TS'{AS_OF}' THEN 'delayed' ELSE 'ready' END AS st"


COUNTS_SQL = "COUNT(*) AS backlog_count, " + ", ".join(f"COUNT(*) FILTER (WHERE st = '{x}') AS {x}_count" for x in ("ready", "delayed", "leased", "quarantined")) + """,
  COUNT(*) FILTER (WHERE attempt_count = 0) AS attempts_0_count, COUNT(*) FILTER (WHERE attempt_count = 1) AS attempts_1_count, COUNT(*) FILTER (WHERE attempt_count BETWEEN 2 AND 4) AS attempts_2_to_4_count,
  COUNT(*) FILTER (WHERE attempt_count >= 5) AS attempts_5_plus_count, MAX(attempt_count) AS max_attempt_count"""


@query(("outbox",), f"""
, c AS (SELECT *, {_state_sql("quarantined_at IS NOT NULL")} FROM outbox WHERE published_at IS NULL)
SELECT {COUNTS_SQL}, {_age_sql("MIN(recorded_at)", "oldest_backlog_age_seconds")}, {_age_sql("MIN(recorded_at) FILTER (WHERE st = 'ready')", "oldest_ready_age_seconds")},
  {_age_sql("MIN(quarantined_at) FILTER (WHERE st = 'quarantined')", "oldest_quarantined_age_seconds")} FROM c""")
def a3_outbox_telemetry(s: Source) -> DataFrame:
    return telemetry.outbox(s.relation("outbox"), as_of())


@query(("failures",), f"""
, c AS (SELECT *, {_state_sql("status = 'quarantined'")} FROM failures WHERE status IN ('deferred', 'quarantined'))
SELECT consumer_name, {COUNTS_SQL}, COUNT(*) FILTER (WHERE st = 'quarantined' AND NOT retryable) AS terminal_quarantined_count, COUNT(*) FILTER (WHERE st = 'quarantined' AND retryable) AS exhausted_quarantined_count,
  {_age_sql("MIN(first_failed_at)", "oldest_backlog_age_seconds")}, {_age_sql("MIN(first_failed_at) FILTER (WHERE st = 'ready')", "oldest_ready_age_seconds")},
  {_age_sql("MIN(quarantined_at) FILTER (WHERE st = 'quarantined')", "oldest_quarantined_age_seconds")} FROM c GROUP BY consumer_name""")
def a4_failure_telemetry(s: Source) -> DataFrame:
    return telemetry.failures(s.relation("failures"), as_of(), ("consumer_name",))


LOOKBACK = 7 * 86400


@query(("poison",), f"""
SELECT consumer_name, COUNT(*) AS retained_count, COUNT(*) FILTER (WHERE first_seen_at >= TS'{AS_OF}' - INTERVAL '7' DAY AND first_seen_at <= TS'{AS_OF}') AS recent_count,
  COUNT(*) FILTER (WHERE observation_count > 1 AND last_seen_at >= TS'{AS_OF}' - INTERVAL '7' DAY AND last_seen_at <= TS'{AS_OF}') AS recent_reobserved_count, CAST(COALESCE(SUM(observation_count), 0) AS BIGINT) AS total_observation_count,
  COUNT(*) FILTER (WHERE failure_code = 'invalid_message_encoding') AS invalid_encoding_count, COUNT(*) FILTER (WHERE failure_code = 'invalid_message_json') AS invalid_json_count,
  COUNT(*) FILTER (WHERE failure_code = 'invalid_event_envelope') AS invalid_envelope_count, COUNT(*) FILTER (WHERE failure_code = 'invalid_transport_headers') AS invalid_headers_count,
  COUNT(*) FILTER (WHERE failure_code = 'payload_too_large') AS other_failure_count, MAX(observation_count) AS max_observation_count,
  {_age_sql("MIN(first_seen_at)", "oldest_first_seen_age_seconds")}, {_age_sql("MAX(first_seen_at)", "newest_first_seen_age_seconds")}, {_age_sql("MAX(last_seen_at)", "latest_observation_age_seconds")}
FROM poison GROUP BY consumer_name""")
def a5_poison_telemetry(s: Source) -> DataFrame:
    return telemetry.poison(s.relation("poison"), as_of(), LOOKBACK, ("consumer_name",))


CURSOR_SQL = """
, own AS (SELECT position_id, version, MIN(event_id) AS event_id, MIN(recorded_at) AS recorded_at, MIN(delta) AS delta FROM versioned GROUP BY ALL),
placed AS (SELECT *, version = ROW_NUMBER() OVER (PARTITION BY position_id ORDER BY version) AS applied FROM own),
cursors AS (SELECT position_id, COALESCE(MAX(version) FILTER (WHERE applied), 0) AS version, CAST(COALESCE(SUM(delta) FILTER (WHERE applied), 0) AS DECIMAL(24,6)) AS quantity, COUNT(*) FILTER (WHERE applied) AS applied, COUNT(*) FILTER (WHERE NOT applied) AS pending,
  MIN(version) FILTER (WHERE NOT applied) AS first_pending_version, MAX(version) FILTER (WHERE NOT applied) AS last_pending_version, MIN(recorded_at) FILTER (WHERE NOT applied) AS oldest_pending_at FROM placed GROUP BY position_id)"""


@query(("versioned",), CURSOR_SQL + " SELECT * REPLACE (CAST(quantity AS DOUBLE) AS quantity) FROM cursors")
def p2_position_projection(s: Source) -> DataFrame:
    return projection.apply_deltas(s.relation("versioned"))


@query(("versioned",), CURSOR_SQL + " SELECT position_id, version + 1 AS expected_version, first_pending_version, last_pending_version, pending, oldest_pending_at FROM cursors WHERE pending > 0")
def a6_projection_gaps(s: Source) -> DataFrame:
    return projection.gaps(projection.apply_deltas(s.relation("versioned")))


@query(("versioned",), CURSOR_SQL + f"""
SELECT COUNT(*) AS gap_count, CAST(COALESCE(SUM(pending), 0) AS BIGINT) AS pending_count, COALESCE(MAX(pending), 0) AS max_pending_count, {_age_sql("MIN(oldest_pending_at)", "oldest_pending_age_seconds")} FROM cursors WHERE pending > 0""")
def a7_gap_telemetry(s: Source) -> DataFrame:
    gaps = projection.gaps(projection.apply_deltas(s.relation("versioned")))
    counts = gaps.agg(F.count("*").alias("gap_count"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_count"), F.coalesce(F.max("pending"), F.lit(0)).alias("max_pending_count"), F.min("oldest_pending_at").alias("o"))
    return counts.select("gap_count", "pending_count", "max_pending_count", telemetry.age(as_of(), F.col("o")).alias("oldest_pending_age_seconds"))


SNAPSHOT = "SELECT position_id, MAX(version) AS version, CAST(SUM(delta) AS DECIMAL(24,6)) AS quantity FROM versioned WHERE version <= 40 GROUP BY position_id"


@query(("versioned",), f"""
, snap AS ({SNAPSHOT}), own AS (SELECT position_id, version, MIN(delta) AS delta FROM versioned GROUP BY ALL),
placed AS (SELECT o.*, o.version - s.version = ROW_NUMBER() OVER (PARTITION BY o.position_id ORDER BY o.version) AS fits FROM own o JOIN snap s USING (position_id) WHERE o.version > s.version)
SELECT s.position_id, COALESCE((SELECT MAX(version) FROM placed p WHERE p.position_id = s.position_id AND fits), s.version) AS version,
  CAST(s.quantity + COALESCE((SELECT SUM(delta) FROM placed p WHERE p.position_id = s.position_id AND fits), 0) AS DOUBLE) AS quantity,
  (SELECT COUNT(*) FROM own o WHERE o.position_id = s.position_id AND o.version <= s.version) AS superseded,
  (SELECT COUNT(*) FROM placed p WHERE p.position_id = s.position_id AND fits) AS drained, (SELECT COUNT(*) FROM placed p WHERE p.position_id = s.position_id AND NOT fits) AS remaining FROM snap s""")
def p5_projection_rebuild(s: Source) -> DataFrame:
    events = s.relation("versioned")
    snapshot = events.where("version <= 40").groupBy("position_id").agg(F.max("version").alias("version"), qty(F.sum("delta")).alias("quantity"))
    return projection.rebuild(events, snapshot)


WORK_EVENTS = """SELECT user_id AS work_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) + CASE WHEN event_id % 211 = 7 THEN 1 ELSE 0 END AS version,
  LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state, event_type AS state FROM events"""


@query((), f"""
WITH e AS ({WORK_EVENTS}), c AS (SELECT *, ROW_NUMBER() OVER w AS n, LAG(state) OVER w AS was FROM e WINDOW w AS (PARTITION BY work_id ORDER BY version, state)),
g AS (SELECT *, version = n AND (was IS NULL OR was IS NOT DISTINCT FROM previous_state) AS good FROM c),
b AS (SELECT *, MIN(version) FILTER (WHERE NOT good) OVER (PARTITION BY work_id) AS broken_version FROM g)
SELECT work_id, (MAX({{'v': version, 's': state}}) FILTER (WHERE broken_version IS NULL OR version < broken_version)).v AS version,
  (MAX({{'v': version, 's': state}}) FILTER (WHERE broken_version IS NULL OR version < broken_version)).s AS state, MAX(broken_version) AS broken_version FROM b GROUP BY work_id""")
def p7_work_states(s: Source) -> DataFrame:
    rows = s.spark.sql(WORK_EVENTS.replace("FROM events", "FROM {t}"), t=s.table("events"))
    return projection.work_states(rows)


SLI = dict(windows=(300, 3600, 86400, 30 * 86400), availability_target=0.99, latency_ratio=0.95, latency_seconds=5.0)
SLI_AT = "2024-01-29 12:00:00"


@query(("outcomes",), f"""
, e AS (SELECT *, CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_AT}' THEN 'failed' ELSE outcome END AS eo, CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_AT}' THEN deadline_at ELSE finalized_at END AS ea,
  CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_AT}' THEN 'canary_probe_abandoned' ELSE terminal_code END AS ec FROM outcomes),
w AS (SELECT UNNEST([300, 3600, 86400, 2592000]) AS window_seconds),
i AS (SELECT w.window_seconds, e.* FROM w JOIN e ON eo <> 'pending' AND ea >= TS'{SLI_AT}' - w.window_seconds * INTERVAL '1' SECOND AND ea <= TS'{SLI_AT}'),
c AS (SELECT window_seconds, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE eo = 'succeeded') AS good, COUNT(*) FILTER (WHERE eo = 'failed') AS bad, COUNT(*) FILTER (WHERE eo = 'succeeded' AND end_to_end_seconds <= 5) AS fast,
  {", ".join(f"quantile_cont({c}, {q}) FILTER (WHERE eo = 'succeeded' AND {r or 'true'}) AS {n}_{p}" for n, (c, r) in telemetry.STAGES.items() for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))} FROM i GROUP BY window_seconds),
f AS (SELECT window_seconds, string_agg('"' || ec || '":' || n, ',' ORDER BY ec) AS codes FROM (SELECT window_seconds, ec, COUNT(*) AS n FROM i WHERE eo = 'failed' GROUP BY ALL) GROUP BY window_seconds),
l AS (SELECT MAX(started_at) AS last_run_at, MAX(ea) FILTER (WHERE eo = 'succeeded') AS last_success_at FROM e),
o AS (SELECT eo, ROW_NUMBER() OVER (ORDER BY ea DESC, canary_id DESC) AS n FROM e WHERE eo <> 'pending'),
k AS (SELECT COUNT(*) AS consecutive_failures FROM o WHERE eo = 'failed' AND n < COALESCE((SELECT MIN(n) FROM o WHERE eo = 'succeeded'), 9223372036854775807))
SELECT w.window_seconds, COALESCE(total_runs, 0) AS total_runs, COALESCE(good, 0) AS successful_runs, COALESCE(bad, 0) AS failed_runs, good / NULLIF(total_runs, 0) AS success_ratio, bad / NULLIF(total_runs, 0) / (1.0::DOUBLE - 0.99::DOUBLE) AS availability_burn_rate,
  COALESCE(fast, 0) AS latency_good_runs, fast / NULLIF(good, 0) AS latency_good_ratio, (good - fast) / NULLIF(good, 0) / (1.0::DOUBLE - 0.95::DOUBLE) AS latency_burn_rate, last_run_at, last_success_at, consecutive_failures,
  '{{' || COALESCE(codes, '') || '}}' AS failure_codes, {", ".join(f"round({n}_{p}, 9) AS {n}_{p}" for n in telemetry.STAGES for p in ("p50", "p95", "p99"))}
FROM w LEFT JOIN c USING (window_seconds) LEFT JOIN f USING (window_seconds), l, k""")
def a9_service_levels(s: Source) -> DataFrame:
    found = telemetry.service_levels(s.relation("outcomes"), as_of(SLI_AT), **SLI)
    return found.withColumns({f"{n}_{p}": F.round(f"{n}_{p}", 9) for n in telemetry.STAGES for p in ("p50", "p95", "p99")})


@query((), """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, MAX(value) AS slowest, round(AVG(value), 6) AS mean, COUNT(*) AS samples FROM events GROUP BY event_type""")
def a23_nearest_rank(s: Source) -> DataFrame:
    return telemetry.latency_summary(s.table("events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


# ---- events -----------------------------------------------------------------------------------


@query(("outbox",), f"""
SELECT event_id, recorded_at, attempt_count + 1 AS attempt_count, TS'{AS_OF}' + INTERVAL '60' SECOND AS claimed_until FROM outbox
WHERE published_at IS NULL AND quarantined_at IS NULL AND delivery_route = 'shared' AND available_at <= TS'{AS_OF}' AND (claimed_until IS NULL OR claimed_until <= TS'{AS_OF}') ORDER BY recorded_at, event_id LIMIT 100""")
def e5_claim_batch(s: Source) -> DataFrame:
    return pipeline.claim(s.relation("outbox"), as_of(), 100, 60).select("event_id", "recorded_at", "attempt_count", "claimed_until")


@query(("outbox",), """
SELECT event_id, '{"event_id":' || event_id || ',"type":"' || event_type || '","aggregate_id":' || aggregate_id || CASE WHEN published_at IS NOT NULL THEN ',"published":true' ELSE '' END || ',"schema_version":' || (1 + event_id % 2)
  || CASE WHEN event_id % 2 = 1 THEN ',"tenant_id":"t' || (aggregate_id % 3) || '"' ELSE '' END || '}' AS envelope FROM outbox""")
def e7_envelopes(s: Source) -> DataFrame:
    columns = {"event_id": F.col("event_id"), "type": F.col("event_type"), "aggregate_id": F.col("aggregate_id"), "published": F.when(F.col("published_at").isNotNull(), True)}
    tenant = F.concat(F.lit("t"), (F.col("aggregate_id") % 3).cast("string"))
    return s.relation("outbox").select("event_id", pipeline.envelope(columns, 1 + F.col("event_id") % 2, tenant).alias("envelope"))


TRANSACTIONS = "SELECT o_orderkey AS transaction_id, CASE o_custkey % 7 WHEN 0 THEN 'receipt' WHEN 1 THEN 'movement' WHEN 2 THEN 'allocation' WHEN 3 THEN 'reservation_release' WHEN 4 THEN 'reservation' WHEN 5 THEN 'count_reconciliation' ELSE 'allocation_release' END AS transaction_type, CASE WHEN o_orderkey % 2 = 0 THEN 'allocation-commitment:x' ELSE 'allocation:x' END AS fingerprint FROM orders"


@query((), f"""
WITH t AS ({TRANSACTIONS}) SELECT transaction_id, 'inventory.transaction.posted' AS event_type FROM t
UNION ALL SELECT transaction_id, CASE transaction_type WHEN 'movement' THEN 'inventory.movement.confirmed' WHEN 'reservation' THEN 'inventory.reservation.created' WHEN 'reservation_release' THEN 'inventory.reservation.released' WHEN 'allocation_release' THEN 'inventory.allocation.released' WHEN 'count_reconciliation' THEN 'inventory.reconciliation.posted' ELSE 'inventory.allocation.created' END FROM t
WHERE transaction_type NOT IN ('receipt', 'allocation') OR (transaction_type = 'allocation' AND fingerprint LIKE 'allocation-commitment:%')""")
def e2_transaction_events(s: Source) -> DataFrame:
    return pipeline.transaction_events(s.spark.sql(TRANSACTIONS.replace("FROM orders", "FROM {t}"), t=s.table("orders")))


@query(("legs",), """
SELECT transaction_id, line, location_id, item_id, CAST(physical_delta AS DOUBLE) AS physical_delta, ROW_NUMBER() OVER (PARTITION BY location_id, item_id ORDER BY posted_on, transaction_id, line, legs.physical_delta) AS aggregate_version FROM legs""")
def e3_leg_events(s: Source) -> DataFrame:
    found = pipeline.leg_events(s.relation("legs"), "location_id", "item_id", order=("posted_on", "transaction_id", "line", "physical_delta"))
    return found.select("transaction_id", "line", "location_id", "item_id", "physical_delta", "aggregate_version")


@query((), """
WITH h AS (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events), c AS (SELECT * FROM h WHERE previous_state IS NULL OR previous_state <> event_type)
SELECT user_id AS work_id, event_id, previous_state, event_type AS state, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS domain_event_version FROM c""")
def e4_state_changes(s: Source) -> DataFrame:
    history = s.table("events").select(F.col("user_id").alias("work_id"), "event_id", "ts", F.col("event_type").alias("state"))
    return pipeline.state_changes(history, "work_id", ("ts", "event_id")).select("work_id", "event_id", "previous_state", "state", "domain_event_version")


@query((), """
WITH h AS (SELECT user_id, ts, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events)
SELECT user_id AS journal_id, arg_max(event_type, ts) AS state, MAX(ts) FILTER (WHERE was IS DISTINCT FROM event_type) AS state_changed_at FROM h GROUP BY user_id""")
def cp10_state_age(s: Source) -> DataFrame:
    return pipeline.state_since(s.table("events").select(F.col("user_id").alias("journal_id"), "ts", F.col("event_type").alias("state")), "journal_id", "ts")


@query(("outbox",), """
, d AS (SELECT event_id, attempt_count + 1 AS attempt, LEAST(3600.0, 5.0 * power(2.0, attempt_count)) AS e, CAST(('0x' || substr(sha256(event_id || ':' || (attempt_count + 1)), 1, 16))::UHUGEINT AS DOUBLE) / 18446744073709551615.0 AS u FROM outbox)
SELECT event_id, attempt, CASE WHEN attempt < 6 THEN LEAST(3600, GREATEST(1, CAST(round_even(e * (1 + 0.2::DOUBLE * (2 * u - 1)), 0) AS BIGINT))) END AS delay_seconds FROM d""")
def e10_retry_delays(s: Source) -> DataFrame:
    attempt = F.col("attempt_count") + 1
    return s.relation("outbox").select("event_id", attempt.alias("attempt"), pipeline.retry_delay(F.col("event_id"), attempt, max_attempts=6).alias("delay_seconds"))


SQLSTATE = """SELECT event_id, CASE event_id % 10 WHEN 0 THEN '40001' WHEN 1 THEN '40P01' WHEN 2 THEN '55P03' WHEN 3 THEN '57014' WHEN 4 THEN '08006' WHEN 5 THEN '23505' WHEN 6 THEN '23514' WHEN 7 THEN '55000' END AS sqlstate,
  CASE event_id % 3 WHEN 0 THEN 'Projection rebuild fence is active' WHEN 1 THEN 'duplicate key' END AS message, CASE event_id % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'data' WHEN 2 THEN 'operational' ELSE 'other' END AS kind FROM events"""


@query((), f"""
WITH f AS ({SQLSTATE}), c AS (SELECT event_id, CASE WHEN sqlstate = '55000' AND message LIKE 'Projection%' THEN 'projection_rebuild_fence_active' WHEN sqlstate = '40001' THEN 'database_serialization_failure' WHEN sqlstate = '40P01' THEN 'database_deadlock'
  WHEN sqlstate = '55P03' THEN 'database_lock_unavailable' WHEN sqlstate = '57014' THEN 'database_statement_cancelled' WHEN sqlstate LIKE '08%' THEN 'database_connection_failure' WHEN sqlstate = '23505' AND message LIKE 'Projection%' THEN 'projection_version_conflict'
  WHEN sqlstate = '23505' THEN 'handler_identity_conflict' WHEN sqlstate = '23514' THEN 'handler_constraint_violation' WHEN kind = 'value' THEN 'invalid_event_contract' WHEN kind = 'data' THEN 'handler_data_violation' WHEN kind = 'operational' THEN 'database_unavailable' ELSE 'handler_failure' END AS code FROM f)
SELECT event_id, code, code LIKE 'database%' OR code IN ('projection_rebuild_fence_active', 'handler_failure') AS retryable FROM c""")
def e13_failure_classes(s: Source) -> DataFrame:
    rows = s.spark.sql(SQLSTATE.replace("FROM events", "FROM {t}"), t=s.table("events"))
    return rows.select("event_id", pipeline.classify_failure(F.col("sqlstate"), F.col("message"), F.col("kind")).alias("c")).select("event_id", "c.code", "c.retryable")


@query((), "SELECT CASE user_id % 4 WHEN 0 THEN 'a' ELSE 'b' END AS consumer_name, user_id AS event_id, MIN(ts) AS first_seen_at, COUNT(*) AS deliveries FROM events GROUP BY ALL")
def e11_inbox(s: Source) -> DataFrame:
    rows = s.table("events").select(F.when(F.col("user_id") % 4 == 0, "a").otherwise("b").alias("consumer_name"), F.col("user_id").alias("event_id"), F.col("ts").alias("received_at"))
    return pipeline.first_receipts(rows)


@query((), "SELECT 's' || (user_id % 3) AS stream, user_id AS stream_sequence, COUNT(*) AS observation_count, MIN(ts) AS first_seen_at, MAX(ts) AS last_seen_at, COUNT(DISTINCT props) > 1 AS conflict FROM events GROUP BY ALL")
def e19_poison_identities(s: Source) -> DataFrame:
    rows = s.table("events").select(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("stream"), F.col("user_id").alias("stream_sequence"), F.col("ts").alias("seen_at"), F.sha2("props", 256).alias("payload_sha256"))
    return pipeline.poison_identities(rows)


@query(("outbox",), "SELECT event_id, published_at FROM outbox WHERE published_at < TS'2024-01-15 00:00:00' ORDER BY published_at, event_id LIMIT 500")
def r1_archive_batch(s: Source) -> DataFrame:
    return pipeline.archive(s.relation("outbox"), "published_at", as_of(HOLD_AS_OF), 500, "event_id")[0].select("event_id", "published_at")


@query(("outbox",), """
, pairs AS (SELECT event_type, event_id, published_at FROM outbox WHERE published_at < TS'2024-01-15 00:00:00' ORDER BY published_at, event_id LIMIT 500)
SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY published_at, event_id) AS ids, COUNT(*) AS n FROM pairs GROUP BY event_type""")
def a11_ordered_ids(s: Source) -> DataFrame:
    batch = pipeline.archive(s.relation("outbox"), "published_at", as_of(HOLD_AS_OF), 500, "event_id")[0]
    found = pipeline.ordered_ids(batch, "published_at", "event_id", "event_type")
    return found.select("event_type", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@query(("outbox",), """
, w AS (SELECT event_id FROM events), both_ AS (SELECT event_id, published_at FROM outbox WHERE event_id % 2 = 0 UNION ALL SELECT event_id, published_at FROM outbox WHERE event_id % 2 = 1)
SELECT w.event_id, MAX(b.published_at) AS published_at, CASE WHEN COUNT(b.event_id) > 0 THEN COUNT(b.event_id) END AS copies FROM w LEFT JOIN both_ b USING (event_id) GROUP BY w.event_id""")
def j6_live_or_archived(s: Source) -> DataFrame:
    rows = s.relation("outbox")
    return pipeline.live_or_archived(s.table("events").select("event_id"), rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "event_id", "published_at")


# ---- health -----------------------------------------------------------------------------------


@query(("failures",), f"""
, c AS (SELECT *, {_state_sql("status = 'quarantined'")} FROM failures WHERE status IN ('deferred', 'quarantined')),
t AS (SELECT consumer_name, COUNT(*) AS b, COUNT(*) FILTER (WHERE st = 'quarantined') AS q, {_age_sql("MIN(first_failed_at) FILTER (WHERE st = 'ready')", "r")} FROM c GROUP BY consumer_name),
a AS (SELECT consumer_name, 'consumer_failure_quarantined_events' AS code, 'critical' AS severity, q::DOUBLE AS observed, 0.0::DOUBLE AS threshold FROM t WHERE q > 0
  UNION ALL SELECT consumer_name, 'consumer_failure_backlog_count_exceeded', CASE WHEN b >= 1000 THEN 'critical' ELSE 'warning' END, b, CASE WHEN b >= 1000 THEN 1000 ELSE 100 END FROM t WHERE b >= 100
  UNION ALL SELECT consumer_name, 'consumer_failure_ready_age_exceeded', CASE WHEN r >= 1800 THEN 'critical' ELSE 'warning' END, r, CASE WHEN r >= 1800 THEN 1800 ELSE 300 END FROM t WHERE r >= 300),
s AS (SELECT consumer_name, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS status FROM a GROUP BY consumer_name)
SELECT t.consumer_name, COALESCE(s.status, 'ok') AS status, a.code, a.severity, a.observed, a.threshold FROM t LEFT JOIN s USING (consumer_name) LEFT JOIN a USING (consumer_name)""")
def hp2_failure_alerts(s: Source) -> DataFrame:
    return health.evaluate(telemetry.failures(s.relation("failures"), as_of(), ("consumer_name",)), health.FAILURES, "consumer_name")


@query(("outbox",), f"""
, c AS (SELECT *, {_state_sql("quarantined_at IS NOT NULL")} FROM outbox WHERE published_at IS NULL),
t AS (SELECT COUNT(*) AS b, COUNT(*) FILTER (WHERE st = 'quarantined') AS q, {_age_sql("MIN(recorded_at) FILTER (WHERE st = 'ready')", "r")} FROM c),
a AS (SELECT 'outbox_quarantined_events' AS code, 'critical' AS severity, q::DOUBLE AS observed, 0.0::DOUBLE AS threshold FROM t WHERE q > 0
  UNION ALL SELECT 'outbox_backlog_count_exceeded', CASE WHEN b >= 10000 THEN 'critical' ELSE 'warning' END, b, CASE WHEN b >= 10000 THEN 10000 ELSE 1000 END FROM t WHERE b >= 1000
  UNION ALL SELECT 'outbox_ready_age_exceeded', CASE WHEN r >= 300 THEN 'critical' ELSE 'warning' END, r, CASE WHEN r >= 300 THEN 300 ELSE 60 END FROM t WHERE r >= 60)
SELECT COALESCE((SELECT CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END FROM a), 'ok') AS status, code, severity, observed, threshold FROM (SELECT 1) LEFT JOIN a ON true""")
def hp1_outbox_alerts(s: Source) -> DataFrame:
    return health.evaluate(telemetry.outbox(s.relation("outbox"), as_of()), health.OUTBOX)


COMPONENTS = """SELECT DISTINCT CASE user_id % 6 WHEN 0 THEN 'outbox' WHEN 1 THEN 'consumer_failure' WHEN 2 THEN 'malformed_delivery' WHEN 3 THEN 'projection_gap' WHEN 4 THEN 'nats_consumer' ELSE 'nats_stream' END AS component, CASE WHEN user_id % 6 = 4 THEN NULL WHEN user_id % 6 = 3 THEN 'critical' WHEN user_id % 6 = 0 THEN 'ok' ELSE 'warning' END AS status,
  CASE WHEN user_id % 6 = 3 THEN concat('gap_', event_type) END AS code, CASE WHEN user_id % 6 = 3 THEN length(event_type) END AS alert_position FROM events"""
@query((), f"""
WITH c AS ({COMPONENTS}), r AS (SELECT *, CASE COALESCE(status, 'critical') WHEN 'ok' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank, COALESCE(code, CASE WHEN status IS NULL THEN component || '_unreadable' END) AS why, list_position(['outbox', 'nats_stream', 'nats_consumer', 'malformed_delivery', 'consumer_failure', 'projection_gap'], component) AS place FROM c),
b AS (SELECT component, why FROM r WHERE rank = (SELECT MAX(rank) FROM r) AND rank > 0 ORDER BY place, COALESCE(alert_position, 0), component, why LIMIT 1)
SELECT CASE (SELECT MAX(rank) FROM r) WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'critical' END AS status, component AS root_component, why AS root_code, (SELECT COUNT(*) FROM r WHERE rank > 0) AS unhealthy FROM (SELECT 1) LEFT JOIN b ON true""")
def hp7_pipeline_health(s: Source) -> DataFrame:
    return health.pipeline_health(s.spark.sql(COMPONENTS.replace("FROM events", "FROM {t}"), t=s.table("events")), health.COMPONENT_ORDER)


@query(("outcomes",), f"""
, e AS (SELECT *, CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_AT}' THEN 'failed' ELSE outcome END AS eo, CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_AT}' THEN deadline_at ELSE finalized_at END AS ea FROM outcomes),
w AS (SELECT UNNEST([300, 3600, 86400]) AS s), c AS (SELECT s, COUNT(*) FILTER (WHERE eo = 'failed') / COUNT(*) / 0.01 AS a, COUNT(*) FILTER (WHERE eo = 'succeeded' AND end_to_end_seconds > 5) / NULLIF(COUNT(*) FILTER (WHERE eo = 'succeeded'), 0) / 0.05 AS l
  FROM w JOIN e ON eo <> 'pending' AND ea >= TS'{SLI_AT}' - s * INTERVAL '1' SECOND AND ea <= TS'{SLI_AT}' GROUP BY s),
p AS (SELECT MAX(a) FILTER (WHERE s = 300) AS a1, MAX(a) FILTER (WHERE s = 3600) AS a2, MAX(a) FILTER (WHERE s = 86400) AS a3, MAX(l) FILTER (WHERE s = 300) AS l1, MAX(l) FILTER (WHERE s = 3600) AS l2, MAX(l) FILTER (WHERE s = 86400) AS l3 FROM c)
SELECT COALESCE(a1 >= 14.4 AND a2 >= 14.4, false) AS availability_fast, COALESCE(l1 >= 14.4 AND l2 >= 14.4, false) AS latency_fast, COALESCE(a2 >= 3 AND a3 >= 3, false) AS availability_slow, COALESCE(l2 >= 3 AND l3 >= 3, false) AS latency_slow FROM p""")
def hp9_burn_alerts(s: Source) -> DataFrame:
    found = health.burn_alerts(telemetry.service_levels(s.relation("outcomes"), as_of(SLI_AT), **SLI))
    return found.select("availability_fast", "latency_fast", "availability_slow", "latency_slow")


@query((), """
WITH x AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 302 ELSE 204 END AS status, 1 + event_id % 10 AS n FROM events),
y AS (SELECT *, status IS NULL OR status IN (408, 425, 429) OR status BETWEEN 500 AND 599 AS again FROM x)
SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'success' WHEN again AND n >= 8 THEN 'dead_letter' WHEN again THEN 'retry' WHEN status BETWEEN 400 AND 499 THEN 'dead_letter' ELSE 'invalid' END AS outcome,
  CASE WHEN again AND n < 8 THEN [5, 30, 120, 600, 1800, 3600, 7200, 21600][n] END AS delay FROM y""")
def cp8_webhook_decisions(s: Source) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x).cast("int") for x in (None, 200, 429, 503, 404, 302, 204)]), (F.col("event_id") % 7 + 1).cast("int"))
    return s.table("events").select("event_id", health.webhook_decision(status, 1 + F.col("event_id") % 10).alias("d")).select("event_id", "d.outcome", "d.delay")


def _fields(s: Source, changed: bool) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_suppkey").alias("resource"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    if changed:
        rows = rows.where("resource % 17 <> 3").withColumn("nation", F.when(F.col("resource") % 5 == 0, "moved").otherwise(F.col("nation")))
    return rows.unpivot("resource", ["name", "nation"], "field", "value")


@query((), """
WITH e AS (SELECT s_suppkey AS resource, 'name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier),
a AS (SELECT resource, field, CASE WHEN field = 'nation' AND resource % 5 = 0 THEN 'moved' ELSE value END AS value FROM e WHERE resource % 17 <> 3)
SELECT resource, field, e.value AS expected, a.value AS actual FROM e FULL JOIN a USING (resource, field) WHERE e.value IS DISTINCT FROM a.value""")
def cp1_drift(s: Source) -> DataFrame:
    return health.drift(_fields(s, False), _fields(s, True))


@query(("failures",), f"""
, c AS (SELECT *, {_state_sql("status = 'quarantined'")} FROM failures WHERE status IN ('deferred', 'quarantined')), t AS (SELECT consumer_name, COUNT(*) AS b, COUNT(*) FILTER (WHERE st = 'ready') AS r FROM c GROUP BY consumer_name)
SELECT 'failures_backlog_count{{consumer_name="' || consumer_name || '"}} ' || b::DOUBLE AS line FROM t UNION ALL SELECT 'failures_ready_count{{consumer_name="' || consumer_name || '"}} ' || r::DOUBLE FROM t""")
def s14_prometheus(s: Source) -> DataFrame:
    snapshot = telemetry.failures(s.relation("failures"), as_of(), ("consumer_name",)).select("consumer_name", "backlog_count", "ready_count")
    return exposition.prometheus(snapshot, "failures", "consumer_name")


# ---- records ----------------------------------------------------------------------------------


def _companies(s: Source) -> DataFrame:
    own = s.relation("companies")
    offers = s.relation("offers")
    lists = offers.groupBy("company_id").agg(F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_set("layer")).alias("layers"))
    return own.join(lists, "company_id", "left").select(
        F.col("company_id").alias("id"), "name", "status", "market", F.col("country").alias("hq_country"), F.array("country").alias("served_countries"), F.array().cast("array<string>").alias("presence_countries"),
        text.strings(F.col("categories")).alias("categories"), text.strings(F.col("layers")).alias("layers"),
    )


@query(("companies", "offers"), """
SELECT company_id AS id, name, country AS hq_country FROM companies c WHERE lower(name) LIKE '%supplier#%' AND EXISTS (SELECT 1 FROM offers o WHERE o.company_id = c.company_id AND category = 'Brand#7') AND EXISTS (SELECT 1 FROM offers o WHERE o.company_id = c.company_id AND category = 'Brand#2')
  AND country IN (SELECT n_name FROM nation WHERE n_nationkey = 7)""")
def k1_vendors(s: Source) -> DataFrame:
    country = s.table("nation").where("n_nationkey = 7").select("n_name").first()
    return knowledge.vendors(_companies(s), name="Supplier#", country=country[0] if country else None, categories=["Brand#7", "Brand#2"]).select("id", "name", "hq_country")


@query((), "SELECT p_partkey AS id, p_name FROM part WHERE (p_name LIKE '%widget%' OR lower(p_brand) LIKE '%widget%') AND p_type = 'ECONOMY'")
def k2_record_search(s: Source) -> DataFrame:
    parts = s.table("part").withColumnRenamed("p_partkey", "id")
    return knowledge.records(parts, "  WIDGET ", ("p_name", "p_brand"), p_type="ECONOMY").select("id", "p_name")


@query((), "SELECT doc_id, regexp_matches(lower(text), 'th') AS one, length(trim(regexp_replace(lower(lang || ' _ ' || source), '[^a-z0-9]+', ' ', 'g'))) AS key_chars FROM documents")
def f5_search_keys(s: Source) -> DataFrame:
    docs = s.table("documents")
    key = text.search_key(F.concat("lang", F.lit(" _ "), "source"))
    return docs.select("doc_id", F.contains(F.lower("text"), F.lit("th")).alias("one"), F.length(key).alias("key_chars"))


@query(("offers",), "SELECT layer, string_agg(CAST(company_id AS VARCHAR), ',' ORDER BY company_id) AS members, COUNT(*) AS n FROM (SELECT DISTINCT layer, company_id FROM offers) GROUP BY layer")
def a16_layer_members(s: Source) -> DataFrame:
    found = knowledge.group_to_list(s.relation("offers"), "layer", "company_id")
    return found.select("layer", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "n")


@query(("companies",), "SELECT place, status, COUNT(company_id) AS n FROM (VALUES (0, 'verified'), (1, 'partial'), (2, 'unverified'), (3, 'retired')) d(place, status) LEFT JOIN companies USING (status) GROUP BY place, status")
def a17_status_counts(s: Source) -> DataFrame:
    return knowledge.counts_with_zeros(s.relation("companies"), "status", ["verified", "partial", "unverified", "retired"])


@query(("companies", "offers"), """
SELECT 'companies' AS metric, COUNT(*) AS value FROM companies UNION ALL SELECT 'categories', COUNT(*) FROM (SELECT DISTINCT company_id, category FROM offers) UNION ALL SELECT 'layers', COUNT(*) FROM (SELECT DISTINCT company_id, layer FROM offers)
UNION ALL SELECT 'products', COUNT(*) FROM part UNION ALL SELECT 'sizes', CAST(SUM(p_size) AS BIGINT) FROM part""")
def a15_statistics(s: Source) -> DataFrame:
    companies = (_companies(s), {"categories": F.size("categories"), "layers": F.size("layers")})
    return knowledge.statistics({"companies": companies, "products": (s.table("part"), {"sizes": F.col("p_size")})})


@query(("companies",), """
SELECT 'company' AS kind, CAST(company_id AS VARCHAR) AS subject, 'status:' || status AS gap FROM companies WHERE status <> 'verified'
UNION ALL SELECT 'product', CAST(p_partkey AS VARCHAR), 'size:large' FROM part WHERE p_size > 45 UNION ALL SELECT 'product', CAST(p_partkey AS VARCHAR), 'price:low' FROM part WHERE p_retailprice < 950
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'balance:negative' FROM customer WHERE c_acctbal < 0""")
def u3_research_gaps(s: Source) -> DataFrame:
    def when(*cases: tuple[Column, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(c, v) for c, v in cases]))

    return knowledge.gaps({
        "company": (s.relation("companies"), "company_id", when((F.col("status") != "verified", F.concat(F.lit("status:"), "status")))),
        "product": (s.table("part"), "p_partkey", when((F.col("p_size") > 45, F.lit("size:large")), (F.col("p_retailprice") < 950, F.lit("price:low")))),
        "customer": (s.table("customer"), "c_custkey", when((F.col("c_acctbal") < 0, F.lit("balance:negative")))),
    })


@query(("companies",), """
, scores AS (SELECT n_name AS subject, c.c AS criterion, CAST(AVG(CASE c.c WHEN 'a' THEN s_suppkey % 10 WHEN 'b' THEN s_suppkey % 7 ELSE 5 END) AS DECIMAL(10,2)) AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey, (VALUES ('a'), ('b'), ('c')) c(c) GROUP BY ALL),
t AS (SELECT subject, SUM(CASE criterion WHEN 'a' THEN 50 WHEN 'b' THEN 30 ELSE 20 END * score)::DOUBLE / 100 AS total FROM scores GROUP BY subject)
SELECT subject, round(total, 6) AS total, ROW_NUMBER() OVER (ORDER BY total DESC, subject) AS rank, round(total - LEAD(total) OVER (ORDER BY total DESC, subject), 6) AS margin FROM t""")
def a19_weighted_scores(s: Source) -> DataFrame:
    rows = s.table("supplier").join(F.broadcast(s.table("nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    each = F.create_map(F.lit("a"), F.col("s_suppkey") % 10, F.lit("b"), F.col("s_suppkey") % 7, F.lit("c"), F.lit(5).cast("long"))
    scores = rows.select(F.col("n_name").alias("subject"), F.explode(each).alias("criterion", "score")).groupBy("subject", "criterion").agg(F.avg("score").cast("decimal(10,2)").alias("score"))
    weights = s.spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "criterion string, weight int")
    found = knowledge.weighted_scores(scores.withColumn("score", F.col("score").cast("double")), weights, "subject")
    return found.select("subject", F.round("total", 6).alias("total"), "rank", F.round("margin", 6).alias("margin"))


@query(("offers", "companies"), """
, c AS (SELECT product_id, string_agg(DISTINCT CAST(company_id AS VARCHAR), ',' ORDER BY CAST(company_id AS VARCHAR)) AS x FROM offers GROUP BY product_id)
SELECT p_partkey AS id, COALESCE(x, '') AS suppliers FROM part LEFT JOIN c ON product_id = p_partkey""")
def j12_product_links(s: Source) -> DataFrame:
    products = s.table("part").select(F.col("p_partkey").alias("id"))
    suppliers = s.relation("offers").select("product_id", F.col("company_id").cast("string").alias("company"))
    return knowledge.linked(products, ("suppliers", suppliers, "company")).select("id", F.array_join("suppliers", ",").alias("suppliers"))


@query((), """
SELECT o_orderkey, o_orderpriority, n FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 50""")
def t8_enum_ranking(s: Source) -> DataFrame:
    top = knowledge.ranked_by(s.table("orders"), "o_orderpriority", ["2-HIGH", "1-URGENT"], F.desc("o_totalprice"), "o_orderkey").limit(50)
    place = F.when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(3)
    return top.select("o_orderkey", "o_orderpriority", F.row_number().over(Window.orderBy(place, F.desc("o_totalprice"), "o_orderkey")).alias("n"))


@query((), "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def u5_first_of_each(s: Source) -> DataFrame:
    return knowledge.first_of_each(s.table("orders"), "o_orderkey", "o_custkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(("positions", "reservations", "outbox"), """
SELECT position_id AS key, 'reserved_in_physical' AS rule FROM positions WHERE NOT (reserved_qty >= 0 AND reserved_qty <= physical_qty) UNION ALL SELECT position_id, 'allocated_in_physical' FROM positions WHERE NOT (allocated_qty >= 0 AND allocated_qty <= physical_qty)
UNION ALL SELECT position_id, 'commitments_in_physical' FROM positions WHERE NOT (reserved_qty + allocated_qty <= physical_qty) UNION ALL SELECT CAST(demand_id AS VARCHAR), 'reservation_bounds' FROM reservations WHERE NOT (allocated_qty + consumed_qty + released_qty <= quantity)
UNION ALL SELECT CAST(demand_id AS VARCHAR), 'positive_quantity' FROM reservations WHERE NOT quantity > 0 UNION ALL SELECT CAST(event_id AS VARCHAR), 'published_is_unclaimed' FROM outbox WHERE published_at IS NOT NULL AND claimed_until IS NOT NULL
UNION ALL SELECT CAST(event_id AS VARCHAR), 'published_is_not_quarantined' FROM outbox WHERE published_at IS NOT NULL AND quarantined_at IS NOT NULL
UNION ALL SELECT concat(l_orderkey, '/', l_linenumber), 'unique_line' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
UNION ALL SELECT DISTINCT CAST(c_custkey AS VARCHAR), 'customer_without_order' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def dq1_findings(s: Source) -> DataFrame:
    return quality.findings(
        quality.violations(s.relation("positions"), "position_id", quality.position_rules()),
        quality.violations(s.relation("reservations"), "demand_id", quality.reservation_rules()),
        quality.violations(s.relation("outbox"), "event_id", quality.outbox_rules()),
        quality.repeated(s.table("lineitem"), "unique_line", "l_orderkey", "l_linenumber"),
        quality.missing_references(s.table("customer"), "c_custkey", s.table("orders"), "o_custkey", "customer_without_order"),
    )


@query((), "SELECT event_id, event_type || '.' || user_id || '.x' AS subject FROM events WHERE event_type = 'click'")
def f15_subject_filter(s: Source) -> DataFrame:
    rows = s.table("events").select("event_id", F.concat_ws(".", "event_type", F.col("user_id").cast("string"), F.lit("x")).alias("subject"))
    return rows.where(text.subject_matches(F.lit("click.*.>"), F.col("subject")))


# ---- replay (sequential by nature: rows-only check here, golden vectors in the tests) -----------


@query()
def l6_commitment_replay(s: Source) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("receipt", "reserve", "allocate", "issue", "receipt")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")])
    rows = s.table("lineitem").select(
        line.alias("command_id"), F.col("l_partkey").cast("string").alias("scope"), kinds.alias("kind"), qty(F.col("l_quantity")).alias("quantity"), F.lit(None).cast("string").alias("reference"),
        F.lit(None).cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("fingerprint"), F.col("l_shipdate").alias("recorded_at"),
    )
    return replay.replay_scopes(rows)


@query()
def wk_work_replay(s: Source) -> DataFrame:
    steps = F.element_at(F.array(*[F.lit(k) for k in ("release", "claim", "start", "confirm", "start", "confirm", "raise", "resume", "cancel")]), (F.col("event_id") % 9 + 1).cast("int"))
    task = (F.col("event_id") % 2 + 1).cast("int")
    return replay.replay_works(s.table("events").select(F.col("user_id").alias("work_id"), F.col("event_id").alias("command_id"), steps.alias("command"), task.alias("task"), F.lit(2).alias("tasks"), F.lit("r").alias("resource_id"), F.col("ts").alias("recorded_at")))


# ---- control plane ----------------------------------------------------------------------------

CASES = "SELECT event_id, event_id % 3 <> 0 AS has_migration, CASE event_id % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'active' END AS phase, CASE user_id % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'source' END AS matched, CAST(event_id % 5 AS INT) AS resources FROM events"


@query((), f"""
WITH c AS ({CASES}), d AS (SELECT event_id, CASE WHEN NOT has_migration THEN CASE WHEN matched = 'target' THEN 'target_already_deployed' ELSE 'migration_required' END
  WHEN phase = 'expired' THEN CASE WHEN matched = 'target' THEN 'migration_cleanup_required' WHEN matched = 'source' THEN 'migration_expired' ELSE 'live_state_unexpected' END
  WHEN matched = 'target' THEN 'migration_target_reached' WHEN matched IS DISTINCT FROM 'source' THEN 'live_state_unexpected' WHEN resources <> 1 THEN 'migration_requires_single_resource' ELSE 'migration_ready' END AS code FROM c)
SELECT event_id, 'topology_' || code AS code, CASE WHEN code IN ('target_already_deployed', 'migration_cleanup_required', 'migration_target_reached') THEN 'no_changes' WHEN code = 'migration_ready' THEN 'safe_to_apply' ELSE 'blocked' END AS decision,
  CASE WHEN code = 'migration_cleanup_required' THEN 'warning' WHEN code IN ('target_already_deployed', 'migration_target_reached', 'migration_ready') THEN 'ok' ELSE 'critical' END AS status FROM d""")
def cp3_preflight(s: Source) -> DataFrame:
    rows = s.spark.sql(CASES.replace("FROM events", "FROM {t}"), t=s.table("events"))
    return rows.select("event_id", control.preflight(F.col("has_migration"), F.col("phase"), F.col("matched"), F.col("resources")).alias("d")).select("event_id", "d.code", "d.decision", "d.status")


POSTED = "SELECT o_orderkey AS event_id, o_custkey AS transaction_id, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS INT) AS aggregate_version, CAST(1 + o_orderkey % 2 AS INT) AS schema_version, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0 THEN concat('t', CAST(o_custkey % 3 AS VARCHAR(9))) END AS tenant_id, CASE WHEN o_orderkey % 11 = 0 THEN 'issue' ELSE 'receipt' END AS transaction_type FROM orders"
LEDGER = "SELECT c_custkey AS transaction_id, concat('t', CAST(c_custkey % 3 AS VARCHAR(9))) AS tenant_id, 'receipt' AS transaction_type FROM customer WHERE c_custkey % 17 <> 0"


@query((), f"""
WITH e AS ({POSTED}), l AS ({LEDGER}), j AS (SELECT e.*, l.tenant_id AS lt, l.transaction_type AS ly FROM e LEFT JOIN l USING (transaction_id)),
f AS (SELECT *, CASE WHEN schema_version = 2 THEN tenant_id ELSE lt END AS t FROM j WHERE aggregate_version = 1 AND ((schema_version = 2 AND tenant_id IS NOT NULL) OR (schema_version = 1 AND tenant_id IS NULL AND lt IS NOT NULL AND ly = transaction_type))),
m AS (SELECT t, transaction_id, MIN({{'e': event_id, 'y': transaction_type, 'v': schema_version}}) AS x FROM f GROUP BY ALL)
SELECT t AS tenant_id, transaction_id, x.e AS event_id, x.y AS transaction_type, CASE WHEN x.v = 2 THEN 'v2' ELSE 'v1_legacy' END AS mode FROM m""")
def p8_transaction_index(s: Source) -> DataFrame:
    sql = {k: v.replace("VARCHAR(9)", "STRING") for k, v in (("e", POSTED), ("l", LEDGER))}
    events = s.spark.sql(sql["e"].replace("FROM orders", "FROM {t}"), t=s.table("orders"))
    return control.transaction_index(events, s.spark.sql(sql["l"].replace("FROM customer", "FROM {t}"), t=s.table("customer")))[0]


@query(("outbox",), """
, o AS (SELECT event_id, aggregate_id % 3 AS tenant_id, published_at IS NULL AND quarantined_at IS NULL AND claimed_until IS NULL AND attempt_count = 0 AS fit FROM outbox),
r AS (SELECT event_id // 2 AS batch_id, event_id, user_id % 3 AS tenant_id FROM events)
SELECT batch_id, COUNT(*) AS requested, COUNT(DISTINCT r.event_id) AS distinct, COUNT(*) FILTER (WHERE o.fit) AS eligible, COUNT(*) BETWEEN 1 AND 100 AND COUNT(*) = COUNT(DISTINCT r.event_id) AND COUNT(*) FILTER (WHERE o.fit) = COUNT(*) AS accepted
FROM r LEFT JOIN o ON o.event_id = r.event_id AND o.tenant_id = r.tenant_id GROUP BY batch_id""")
def cp7_rollout_batches(s: Source) -> DataFrame:
    outbox = s.relation("outbox").withColumn("tenant_id", F.col("aggregate_id") % 3)
    requests = s.table("events").select(F.expr("event_id div 2").alias("batch_id"), "event_id", (F.col("user_id") % 3).alias("tenant_id"))
    return control.rollout_batches(requests, outbox)


@query((), """
WITH p AS (SELECT event_id, ts AS a, ts + INTERVAL '1' SECOND * (event_id % 3) AS o, ts + INTERVAL '1' SECOND * (event_id % 4) AS b, CASE WHEN event_id % 6 <> 0 THEN ts + INTERVAL '1' SECOND * (event_id % 9) END AS i, CASE WHEN event_id % 8 <> 0 THEN ts + INTERVAL '1' SECOND * (event_id % 11) END AS c FROM events)
SELECT event_id, (epoch_us(o) - epoch_us(a)) / 1e6 AS outbox_publish_confirm_seconds, (epoch_us(b) - epoch_us(a)) / 1e6 AS start_to_broker_seconds, (epoch_us(i) - epoch_us(b)) / 1e6 AS broker_to_inbox_seconds,
  (epoch_us(c) - epoch_us(i)) / 1e6 AS inbox_to_projection_seconds, (epoch_us(c) - epoch_us(a)) / 1e6 AS end_to_end_projection_seconds FROM p""")
def c3_stage_latencies(s: Source) -> DataFrame:
    second, n = F.make_dt_interval(secs=F.lit(1)), F.col("event_id")
    at = {"published_at": n % 3, "broker_at": n % 4, "inbox_at": F.when(n % 6 != 0, n % 9), "projected_at": F.when(n % 8 != 0, n % 11)}
    probes = s.table("events").select("event_id", F.col("ts").alias("started_at"), *[(F.col("ts") + second * seconds).alias(name) for name, seconds in at.items()])
    return control.with_latencies(probes).select("event_id", *control.LATENCIES)


@query(("handling_units",), """
, inside AS (SELECT unit_id AS root_id, unit_id FROM handling_units WHERE parent_id IS NULL OR unit_id <= 12 UNION ALL SELECT i.root_id, u.unit_id FROM inside i JOIN handling_units u ON u.parent_id = i.unit_id WHERE u.unit_id > 12)
SELECT root_id, COUNT(*) AS units, COUNT(*) FILTER (WHERE unit_id % 173 = 20) AS blocked, COUNT(*) FILTER (WHERE unit_id % 173 = 20) = 0 AS relocatable FROM inside GROUP BY root_id""", recursive=True)
def l15_relocation(s: Source) -> DataFrame:
    units = s.relation("handling_units").withColumn("parent_id", F.when(F.col("unit_id") > 12, F.col("parent_id")))  # the first units stand by themselves
    contents = units.select("unit_id", (F.col("unit_id") % 173 != 20).alias("eligible"))
    return control.relocatable(units, contents)


# ---- more of the event pipeline and of health ---------------------------------------------------


@query((), """
WITH p AS (SELECT range AS n, 200 AS items FROM range(40000)) SELECT '00000000-0000-7000-8000-' || lpad(to_hex(n), 12, '0') AS position_id, n % items AS item_id, n // items AS location_id, 100.0::DOUBLE AS physical_qty FROM p""".replace("to_hex(n)", "lower(to_hex(n))"))
def s16_seed(s: Source) -> DataFrame:
    return seed.seed_positions(s.spark, 40_000)


ACTIONS = "SELECT user_id AS event_id, CASE event_id % 11 WHEN 0 THEN 'ack' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'replay' ELSE 'nack' END AS action, ts AS at_ FROM events WHERE user_id % 4 <> 0 OR event_id % 11 <> 0"


@query((), f"""
WITH a AS ({ACTIONS}), g AS (SELECT event_id, MAX(at_) FILTER (WHERE action = 'ack') AS published_at, arg_max(action, at_) FILTER (WHERE action <> 'ack') AS last, MAX(at_) FILTER (WHERE action = 'replay') AS r FROM a GROUP BY event_id)
SELECT event_id, CASE WHEN published_at IS NOT NULL THEN 'published' WHEN last = 'quarantine' THEN 'quarantined' ELSE 'waiting' END AS state, published_at,
  (SELECT COUNT(*) FROM a WHERE a.event_id = g.event_id AND action IN ('ack', 'nack') AND (g.r IS NULL OR at_ > g.r)) AS attempts FROM g""")
def e8_delivery_outcomes(s: Source) -> DataFrame:
    return pipeline.delivery_outcomes(s.spark.sql(ACTIONS.replace("FROM events", "FROM {t}"), t=s.table("events")).withColumnRenamed("at_", "at"))


@query((), """
WITH f AS (SELECT CASE user_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS consumer_name, user_id AS event_id, event_id % 4 <> 0 AS retryable, ts AS t FROM events WHERE event_type = 'error'),
r AS (SELECT DISTINCT user_id AS event_id FROM events WHERE event_type = 'purchase' AND event_id % 97 = 0),
g AS (SELECT consumer_name, event_id, COUNT(*) AS attempts, arg_max(retryable, t) AS retryable, MIN(t) AS first_failed_at FROM f GROUP BY ALL),
s AS (SELECT *, CASE WHEN event_id IN (SELECT event_id FROM r) THEN 'resolved' WHEN NOT retryable OR attempts >= 14 THEN 'quarantined' ELSE 'deferred' END AS status FROM g)
SELECT consumer_name, event_id, attempts, first_failed_at, status, CASE WHEN status = 'quarantined' THEN CASE WHEN NOT retryable THEN 'terminal' ELSE 'attempts_spent' END END AS reason FROM s""")
def e14_failure_states(s: Source) -> DataFrame:
    events = s.table("events").withColumn("consumer_name", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    failures = events.where("event_type = 'error'").select("consumer_name", F.col("user_id").alias("event_id"), (F.col("event_id") % 4 != 0).alias("retryable"), F.col("ts").alias("at"))
    receipts = events.where("event_type = 'purchase' and event_id % 97 = 0").select("consumer_name", F.col("user_id").alias("event_id"))
    return pipeline.failure_states(failures, receipts, budget=14)


@query((), """
SELECT user_id % 10 AS cycle, COUNT(*) AS claimed, COUNT(*) FILTER (WHERE event_id % 5 < 2) AS published, COUNT(*) FILTER (WHERE event_id % 5 = 2) AS failed, COUNT(*) FILTER (WHERE event_id % 5 = 3) AS quarantined, COUNT(*) FILTER (WHERE event_id % 5 = 4) AS stale FROM events GROUP BY ALL""")
def e9_publisher_cycles(s: Source) -> DataFrame:
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("published", "published", "failed", "quarantined", "stale")]), (F.col("event_id") % 5 + 1).cast("int"))
    return pipeline.publisher_cycle(s.table("events").select((F.col("user_id") % 10).alias("cycle"), outcome.alias("outcome")), "cycle")


@query(("versioned",), CURSOR_SQL + """
, q AS (SELECT position_id, version + CASE WHEN position_id % 5 = 0 THEN 1 ELSE 0 END AS ev, pending AS ep, version + position_id % 3 - 1 AS sv, CASE position_id % 4 WHEN 0 THEN 'require-empty' WHEN 1 THEN 'other' ELSE 'supersede-covered-retain-future' END AS disposition FROM cursors),
j AS (SELECT q.*, CASE WHEN c.version <> ev THEN 'version_changed' WHEN c.pending <> ep THEN 'pending_changed' WHEN sv < c.version THEN 'moves_backward' WHEN disposition = 'require-empty' AND c.pending > 0 THEN 'pending_not_empty' WHEN disposition = 'other' THEN 'unknown_disposition' END AS reason FROM q JOIN cursors c USING (position_id))
SELECT position_id, sv AS snapshot_version, disposition, reason IS NULL AS accepted, reason FROM j""")
def p4_rebuild_plans(s: Source) -> DataFrame:
    cursors = projection.apply_deltas(s.relation("versioned"))
    p = F.col("position_id")
    disposition = F.when(p % 4 == 0, "require-empty").when(p % 4 == 1, "other").otherwise("supersede-covered-retain-future")
    requests = cursors.select(p, (F.col("version") + F.when(p % 5 == 0, 1).otherwise(0)).alias("expected_version"), F.col("pending").alias("expected_pending"), (F.col("version") + p % 3 - 1).alias("snapshot_version"), disposition.alias("disposition"))
    return projection.plan_rebuilds(cursors, requests)


@query(("poison",), f"""
, t AS (SELECT consumer_name, COUNT(*) FILTER (WHERE first_seen_at >= TS'{AS_OF}' - INTERVAL '7' DAY AND first_seen_at <= TS'{AS_OF}') AS a, COUNT(*) FILTER (WHERE observation_count > 1 AND last_seen_at >= TS'{AS_OF}' - INTERVAL '7' DAY AND last_seen_at <= TS'{AS_OF}') AS b FROM poison GROUP BY consumer_name),
x AS (SELECT consumer_name, 'malformed_delivery_recent_records' AS code, CASE WHEN a >= 10 THEN 'critical' ELSE 'warning' END AS severity, a::DOUBLE AS observed, CASE WHEN a >= 10 THEN 10 ELSE 1 END::DOUBLE AS threshold FROM t WHERE a >= 1
  UNION ALL SELECT consumer_name, 'malformed_delivery_recent_reobserved_records', CASE WHEN b >= 5 THEN 'critical' ELSE 'warning' END, b, CASE WHEN b >= 5 THEN 5 ELSE 1 END FROM t WHERE b >= 1),
s AS (SELECT consumer_name, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS status FROM x GROUP BY consumer_name)
SELECT t.consumer_name, COALESCE(s.status, 'ok') AS status, code, severity, observed, threshold FROM t LEFT JOIN s USING (consumer_name) LEFT JOIN x USING (consumer_name)""")
def hp3_malformed_alerts(s: Source) -> DataFrame:
    return health.evaluate(telemetry.poison(s.relation("poison"), as_of(), LOOKBACK, ("consumer_name",)), health.POISON, "consumer_name")


@query(("positions",), "SELECT DISTINCT warehouse_id, item_id, condition_id, lot_id FROM positions")
def u7_distinct_scopes(s: Source) -> DataFrame:
    return s.relation("positions").select("warehouse_id", "item_id", "condition_id", "lot_id").distinct().orderBy("warehouse_id", "item_id", "condition_id", "lot_id")


@query((), "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, side FROM (SELECT DISTINCT o_custkey, 'missing' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) UNION ALL SELECT c_custkey, 'unknown' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))")
def u4_id_difference(s: Source) -> DataFrame:
    registered = s.table("customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return quality.symmetric_difference(s.table("orders"), registered, "o_custkey")


@query(("positions",), """
, m AS (SELECT position_id, COUNT(*) AS serials FROM (SELECT concat(CAST(l_suppkey AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-', l_returnflag, '-', CAST(l_linenumber % 3 AS VARCHAR)) AS position_id FROM lineitem, range(20)) GROUP BY position_id)
SELECT position_id, serials, CAST(physical_qty AS DOUBLE) AS physical_qty FROM m JOIN positions USING (position_id) WHERE serials > positions.physical_qty""")
def a25_serial_excess(s: Source) -> DataFrame:
    key = F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag", (F.col("l_linenumber") % 3).cast("string"))
    members = s.table("lineitem").select(key.alias("position_id"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("serial"))
    return ledger.serial_excess(members, s.relation("positions"))


@query((), """
WITH c AS (SELECT c_mktsegment AS id, c_custkey % 4 AS lens, MIN(CASE WHEN c_acctbal < -990 THEN 0 ELSE 1 END) AS ok, MAX(CASE WHEN c_acctbal > 9990 THEN 1 ELSE 0 END) AS hot FROM customer GROUP BY ALL), s AS (SELECT id, CASE WHEN ok = 1 THEN 'covered' WHEN hot = 1 THEN 'missing' ELSE 'partial' END AS st FROM c)
SELECT id, CASE WHEN bool_and(st = 'covered') THEN 'covered' WHEN bool_and(st = 'missing') THEN 'missing' ELSE 'partial' END AS overall FROM s GROUP BY id""")
def a20_lens_rollup(s: Source) -> DataFrame:
    per = s.table("customer").groupBy(F.col("c_mktsegment").alias("id"), (F.col("c_custkey") % 4).cast("string").alias("lens")).agg(F.min(F.when(F.col("c_acctbal") < -990, 0).otherwise(1)).alias("ok"), F.max(F.when(F.col("c_acctbal") > 9990, 1).otherwise(0)).alias("hot"))
    state = F.when(F.col("ok") == 1, "covered").when(F.col("hot") == 1, "missing").otherwise("partial")
    lenses = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lens", state.alias("state")))).alias("lenses"))
    return lenses.select("id", knowledge.rollup(F.col("lenses")).alias("overall"))


@query((), "SELECT n_name AS record_id, s_name AS metric, s_acctbal AS value FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_name LIKE '%7%'")
def k6_nested_items(s: Source) -> DataFrame:
    rows = s.table("supplier").join(F.broadcast(s.table("nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    registry = rows.groupBy(F.col("n_name").alias("id")).agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))).alias("metrics"))
    return knowledge.nested(registry, "metrics", "7", "name").select("record_id", F.col("item.name").alias("metric"), F.col("item.value").alias("value"))


from tallyhouse import queries_events, queries_records  # noqa: E402, F401  (they register their queries)
