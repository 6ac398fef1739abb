"""Registered queries over events, commands and control, and DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import availability, commitments, control, health, ledger, pipeline, projection, telemetry, work
from tallyhouse.operators.availability import SCOPE
from tallyhouse.plans.mapping import AS_OF, HOLD_AS_OF, Source, dialect
from tallyhouse.queries import COMMANDS, CURSOR_SQL, SLI, commands
from tallyhouse.registry import as_of, made, query
from tallyhouse.sources import exposition, records
from tallyhouse.storage import shared_folder, stored
from tallyhouse.streaming import positions

# ---- envelopes, names and routes ----------------------------------------------------------------

_UUID = "concat('0190a0b0-0000-7000-8000-', lpad(CAST(event_id AS VARCHAR(20)), 12, '0'))"
MESSAGES = f"""SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{{nope' WHEN 1 THEN '[1]' ELSE concat('{{"event_id":"', CASE WHEN event_id % 10 = 2 THEN 'x' ELSE {_UUID} END, '","type":"', CASE WHEN event_id % 10 = 3 THEN 'Bad' ELSE concat('inventory.', event_type) END,
  '","occurred_at":"2024-01-01T00:00:00Z","recorded_at":"2024-01-01T00:00:00Z","aggregate_type":"position","aggregate_id":"p","aggregate_version":', CAST(CASE WHEN event_id % 10 = 4 THEN 0 ELSE 1 + event_id % 5 END AS VARCHAR(20)),
  ',"schema_version":', CAST(1 + event_id % 2 AS VARCHAR(20)), CASE WHEN (event_id % 2 = 1) <> (event_id % 10 = 5) THEN ',"tenant_id":"0190a0b0-0000-7000-8000-00000000000a"' ELSE '' END, ',"data":{{"k":1}}}}') END AS payload,
  CASE event_id % 10 WHEN 6 THEN 'other' ELSE {_UUID} END AS header_id, concat('inventory.', event_type) AS header_type FROM events"""


@query((), """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'invalid_message_json' WHEN 1 THEN 'invalid_message_json' WHEN 2 THEN 'invalid_event_envelope' WHEN 3 THEN 'invalid_event_envelope' WHEN 4 THEN 'invalid_event_envelope' WHEN 5 THEN 'invalid_event_envelope' WHEN 6 THEN 'invalid_transport_headers' END AS failure_code,
  CASE WHEN event_id % 10 IN (7, 8, 9) THEN 'inventory.' || event_type END AS type FROM events""")
def s7_envelopes(s: Source) -> DataFrame:
    rows = made(s, MESSAGES).withColumn("headers", F.create_map(F.lit("event-id"), "header_id", F.lit("event-type"), "header_type"))
    found = records.decode_envelopes(rows)
    return found.select("event_id", "failure_code", F.when(F.col("failure_code").isNull(), F.col("event.type")).alias("type"))


NAMES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(event_type, '_failed') WHEN 1 THEN concat('9', event_type) WHEN 2 THEN upper(event_type) WHEN 3 THEN concat('inventory.', event_type) ELSE '' END AS name FROM events"


@query((), f"WITH n AS ({NAMES}) SELECT event_id, regexp_matches(name, '^[a-z][a-z0-9_]{{0,99}}$') AS failure_code, regexp_matches(name, '^[a-z][a-z0-9_]*([.][a-z0-9_]+)+$') AS event_type FROM n")
def f14_names(s: Source) -> DataFrame:
    return made(s, NAMES).select("event_id", F.col("name").rlike(records.FAILURE_CODE).alias("failure_code"), F.col("name").rlike(records.EVENT_TYPE).alias("event_type"))


ROUTED = "SELECT event_id, concat('t', CAST(user_id % 3 AS VARCHAR(20))) AS tenant, CASE WHEN event_id % 7 = 0 THEN 'kernel.other' ELSE concat('kernel.tenants.t', CAST(user_id % 3 AS VARCHAR(20)), '.inventory.changed') END AS subject, CASE WHEN event_id % 7 = 1 THEN NULL ELSE concat('t', CAST(user_id % 3 AS VARCHAR(20))) END AS header, CAST(CASE WHEN event_id % 7 = 2 THEN 1 ELSE 2 END AS INT) AS version, CASE WHEN event_id % 7 = 3 THEN 'inventory.other' ELSE 'inventory.changed' END AS type, CASE WHEN event_id % 7 = 4 THEN 't9' ELSE concat('t', CAST(user_id % 3 AS VARCHAR(20))) END AS told FROM events"


@query((), "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'subject_differs' WHEN 1 THEN 'header_differs' WHEN 2 THEN 'schema_not_routed' WHEN 3 THEN 'type_not_authorized' WHEN 4 THEN 'tenant_outside_route' END AS reason FROM events")
def f16_tenant_routes(s: Source) -> DataFrame:
    c = F.col
    return made(s, ROUTED).select("event_id", pipeline.route_error(c("subject"), c("header"), c("told"), c("type"), c("version"), "kernel", c("tenant"), F.lit("inventory.changed")).alias("reason"))


# ---- queueing and consuming -----------------------------------------------------------------------

REQUESTS = "SELECT event_id, user_id % 5 AS tenant_id, concat('k', CAST(user_id AS VARCHAR(20))) AS dedup_key, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'same' END AS payload, ts AS requested_at FROM events WHERE event_type <> 'error'"
BOUND = "SELECT o_custkey % 5 AS tenant_id, concat('k', CAST(o_custkey AS VARCHAR(20))) AS dedup_key, MIN(o_orderkey) + 1000000000 AS event_id, CASE WHEN o_custkey % 2 = 0 THEN 'same' ELSE 'other' END AS payload FROM orders GROUP BY o_custkey"


@query((), f"""
WITH r AS ({REQUESTS}), b AS ({BOUND}), f AS (SELECT tenant_id, dedup_key, min({{'t': requested_at, 'e': event_id, 'p': payload}}) AS f FROM (SELECT tenant_id, dedup_key, event_id, requested_at, payload FROM r) GROUP BY ALL),
j AS (SELECT r.*, f.f, b.event_id AS be, COALESCE(b.payload, f.f.p) AS want, COALESCE(b.event_id, f.f.e) AS owner FROM r JOIN f USING (tenant_id, dedup_key) LEFT JOIN b USING (tenant_id, dedup_key))
SELECT event_id, CASE WHEN payload <> want THEN 'conflict' WHEN event_id = owner AND be IS NULL THEN 'enqueued' ELSE 'duplicate' END AS outcome, CASE WHEN payload = want THEN owner END AS bound_to FROM j""")
def e1_enqueue(s: Source) -> DataFrame:
    return pipeline.enqueue(made(s, REQUESTS), made(s, BOUND))


@query(("outbox",), f"""
, t AS (SELECT *, aggregate_id % 3 AS tenant_id, CASE WHEN event_id % 2 = 0 THEN 'tenant' ELSE 'shared' END AS route FROM outbox)
SELECT event_id, recorded_at, attempt_count + 1 AS attempt_count FROM t WHERE tenant_id = 1 AND event_type = 'click' AND route = 'tenant' AND published_at IS NULL AND quarantined_at IS NULL AND available_at <= TS'{AS_OF}'
  AND (claimed_until IS NULL OR claimed_until <= TS'{AS_OF}') ORDER BY recorded_at, event_id LIMIT 50""")
def e6_tenant_claims(s: Source) -> DataFrame:
    rows = s.relation("outbox").withColumn("tenant_id", F.col("aggregate_id") % 3).withColumn("delivery_route", F.when(F.col("event_id") % 2 == 0, "tenant").otherwise("shared"))
    return pipeline.claim_for_tenant(rows, F.lit(1), "click", as_of(), 50, 60).select("event_id", "recorded_at", "attempt_count")


DELIVERED = "SELECT 'c' AS consumer_name, event_id, CASE WHEN event_id % 8 = 0 THEN 'invalid_message_json' END AS malformed, CASE WHEN event_id % 5 = 0 THEN 'handler_failure' END AS error FROM events"


@query((), f"""
WITH d AS ({DELIVERED})
SELECT event_id, CASE WHEN malformed IS NOT NULL THEN 'malformed' WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) THEN 'known_failure' WHEN event_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) THEN 'duplicate' WHEN error IS NOT NULL THEN 'captured' ELSE 'applied' END AS route FROM d""")
def e12_consumer_routes(s: Source) -> DataFrame:
    seen = made(s, "SELECT 'c' AS consumer_name, o_orderkey AS event_id FROM orders WHERE o_orderkey % 7 = 0")
    failed = made(s, "SELECT 'c' AS consumer_name, o_orderkey AS event_id FROM orders WHERE o_orderkey % 3 = 0")
    return pipeline.consume(made(s, DELIVERED), seen, failed).select("event_id", "route")


CLAIMED_FAILURES = f"""SELECT * FROM failures WHERE consumer_name = 'audit' AND status = 'deferred' AND available_at <= TS'{AS_OF}' AND (claimed_until IS NULL OR claimed_until <= TS'{AS_OF}') ORDER BY available_at, first_failed_at, event_id LIMIT 200"""


def _claimed(s: Source) -> DataFrame:
    return pipeline.claim_failures(s.relation("failures"), "audit", as_of(), 200, 60)


@query(("failures",), f"SELECT event_id, attempt_count, available_at, TS'{AS_OF}' + INTERVAL '60' SECOND AS claimed_until FROM ({CLAIMED_FAILURES})")
def e15_failure_claims(s: Source) -> DataFrame:
    return _claimed(s).select("event_id", "attempt_count", "available_at", "claimed_until")


@query(("failures",), f"""
, c AS ({CLAIMED_FAILURES}), r AS (SELECT *, event_id % 3 <> 0 AS can_retry, 'code_' || (event_id % 4) AS code, attempt_count + 1 AS n FROM c WHERE event_id % 2 = 0), j AS (SELECT *, CASE WHEN can_retry AND n < 4 THEN 'deferred' ELSE 'quarantined' END AS st FROM r)
SELECT event_id, st AS status, n AS attempt_count, CASE WHEN st = 'quarantined' THEN CASE WHEN can_retry THEN 'attempt_limit_exhausted:' ELSE 'terminal:' END || code END AS quarantine_reason, TS'{AS_OF}' + (event_id % 9) * INTERVAL '1' SECOND AS available_at FROM j""")
def e16_failed_again(s: Source) -> DataFrame:
    claimed, n = _claimed(s), F.col("event_id")
    results = claimed.where("event_id % 2 = 0").select("consumer_name", "event_id", (n % 3 != 0).alias("can_retry"), F.concat(F.lit("code_"), (n % 4).cast("string")).alias("failure_code"), (n % 9).alias("retry_after"))
    return pipeline.fail_again(claimed, results, as_of(), 4).select("event_id", "status", "attempt_count", "quarantine_reason", "available_at")


REPLAYS = "SELECT concat('r', CAST(event_id AS VARCHAR(20))) AS replay_id, CASE user_id % 4 WHEN 0 THEN 'audit' WHEN 1 THEN 'billing' WHEN 2 THEN 'position-projector' ELSE 'work-projector' END AS consumer_name, event_id, 'op' AS operator_id, 'why' AS reason FROM events"


@query(("failures",), f"""
, q AS ({REPLAYS}), l AS (SELECT * REPLACE (CASE WHEN event_id % 4 = 0 THEN 'other' ELSE reason END AS reason) FROM q WHERE event_id % 6 = 0), a AS (SELECT * FROM q WHERE event_id % 10 = 0),
k AS (SELECT replay_id, COUNT(*) AS n, MIN(reason) AS reason FROM (SELECT * FROM l UNION ALL SELECT * FROM a) GROUP BY replay_id)
SELECT q.replay_id, CASE WHEN k.n > 1 THEN 'identity_in_live_and_archive' WHEN k.n = 1 AND k.reason <> q.reason THEN 'identity_of_another_request' WHEN k.n = 1 THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM failures f WHERE f.status = 'quarantined' AND f.consumer_name = q.consumer_name AND f.event_id = q.event_id) THEN 'replayed' ELSE 'not_quarantined' END AS outcome FROM q LEFT JOIN k USING (replay_id)""")
def e17_failure_replays(s: Source) -> DataFrame:
    requests = made(s, REPLAYS)
    live = requests.where("event_id % 6 = 0").withColumn("reason", F.when(F.col("event_id") % 4 == 0, "other").otherwise(F.col("reason")))
    return pipeline.replay_failures(requests, s.relation("failures"), live, requests.where("event_id % 10 = 0"))


@query(("failures",), f"""
, c AS ({CLAIMED_FAILURES}) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'duplicate' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'applied' END AS outcome, event_id % 3 = 0 OR event_id % 5 <> 0 AS resolved FROM c""")
def e18_retry_cycle(s: Source) -> DataFrame:
    claimed = _claimed(s)
    return pipeline.retry_cycle(claimed, claimed.where("event_id % 3 = 0"), claimed.where("event_id % 5 = 0")).select("event_id", "outcome", "resolved")


# ---- retention ------------------------------------------------------------------------------------


@query(("outbox",), """
, m AS (SELECT event_id FROM outbox WHERE published_at < TS'2024-01-15 00:00:00' ORDER BY published_at, event_id LIMIT 400),
r AS (SELECT event_id, user_id % 3 AS kind FROM events UNION ALL SELECT event_id, 9 FROM events WHERE event_id % 5 = 0)
SELECT 'moved' AS part, COUNT(*) AS n FROM m UNION ALL SELECT 'kept', COUNT(*) FROM outbox WHERE event_id NOT IN (SELECT event_id FROM m) UNION ALL SELECT 'moved_records', COUNT(*) FROM r WHERE event_id IN (SELECT event_id FROM m) UNION ALL SELECT 'kept_records', COUNT(*) FROM r WHERE event_id NOT IN (SELECT event_id FROM m)""")
def r1_archive_with_audits(s: Source) -> DataFrame:
    events = s.table("events")
    audits = events.select("event_id", (F.col("user_id") % 3).alias("kind")).unionByName(events.where("event_id % 5 = 0").select("event_id", F.lit(9).cast("long").alias("kind")))
    return _parts(pipeline.archive_with_records(s.relation("outbox"), audits, "published_at", as_of(HOLD_AS_OF), 400, "event_id"))


def _parts(found: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ACTED = "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'audit' WHEN 1 THEN 'billing' WHEN 2 THEN 'position-projector' ELSE 'work-projector' END AS consumer_name, event_type AS action FROM events"


@query(("failures",), f"""
, a AS ({ACTED}), r AS (SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 4 <> 1),
m AS (SELECT event_id FROM failures WHERE consumer_name = 'billing' AND status = 'resolved' AND resolved_at < TS'{AS_OF}' - INTERVAL '10' DAY AND event_id IN (SELECT event_id FROM r) ORDER BY resolved_at, event_id LIMIT 300)
SELECT 'moved' AS part, COUNT(*) AS n FROM m UNION ALL SELECT 'kept', COUNT(*) FROM failures WHERE event_id NOT IN (SELECT event_id FROM m) UNION ALL SELECT 'moved_records', COUNT(*) FROM a WHERE consumer_name = 'billing' AND event_id IN (SELECT event_id FROM m)
UNION ALL SELECT 'kept_records', COUNT(*) FROM a WHERE NOT (consumer_name = 'billing' AND event_id IN (SELECT event_id FROM m))""")
def r2_failure_archive(s: Source) -> DataFrame:
    receipts = made(s, "SELECT 'billing' AS consumer_name, o_orderkey AS event_id FROM orders WHERE o_orderkey % 4 <> 1")
    return _parts(pipeline.archive_failures(s.relation("failures"), receipts, made(s, ACTED), "billing", pipeline.retention_cutoff(as_of(), 10), 300))


@query(("poison",), f"SELECT stream_sequence, last_seen_at FROM poison WHERE last_seen_at < TS'{AS_OF}' - INTERVAL '12' DAY ORDER BY last_seen_at, stream_sequence LIMIT 250")
def r3_poison_archive(s: Source) -> DataFrame:
    return pipeline.archive(s.relation("poison"), "last_seen_at", pipeline.retention_cutoff(as_of(), 12), 250, "stream_sequence")[0].select("stream_sequence", "last_seen_at")


@query(("outbox",), f"""
, c AS (SELECT event_id, attempt_count + 1 AS n FROM outbox WHERE published_at IS NULL AND quarantined_at IS NULL AND available_at <= TS'{AS_OF}' AND (claimed_until IS NULL OR claimed_until <= TS'{AS_OF}') ORDER BY recorded_at, event_id LIMIT 100),
g AS (SELECT event_id FROM outbox WHERE published_at < TS'2024-01-15 00:00:00' ORDER BY published_at, event_id LIMIT 500)
SELECT o.event_id, COALESCE(c.n, o.attempt_count) AS attempt_count, CASE WHEN c.n IS NOT NULL THEN TS'{AS_OF}' + INTERVAL '60' SECOND ELSE o.claimed_until END AS claimed_until FROM outbox o LEFT JOIN c USING (event_id) WHERE o.event_id NOT IN (SELECT event_id FROM g)""")
def j11_rewritten_outbox(s: Source) -> DataFrame:
    outbox = s.relation("outbox")
    claimed = pipeline.claim(outbox, as_of(), 100, 60).select("event_id", "claimed_until", "attempt_count")
    gone = pipeline.archive(outbox, "published_at", as_of(HOLD_AS_OF), 500, "event_id")[0]
    return pipeline.without(pipeline.updated(outbox, claimed, "event_id"), gone, "event_id").select("event_id", "attempt_count", "claimed_until")


# ---- projections ----------------------------------------------------------------------------------


@query(("versioned",), CURSOR_SQL + " SELECT position_id, version, CAST(quantity AS DOUBLE) AS quantity, pending FROM cursors")
def p1_streaming_projection(s: Source) -> DataFrame:
    """The keyed streaming projection, run over all events; its last state of each position."""
    folder = f"{shared_folder(s.spark)}/projection-{uuid.uuid4().hex}"
    rows = s.relation("versioned").select("position_id", "version", "event_id", "delta")
    rows.write.parquet(f"{folder}/in")
    stream = s.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    running = positions.project(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    last = s.spark.read.parquet(f"{folder}/out").groupBy("position_id").agg(F.max(F.struct("version", (-F.col("pending")).alias("least"), "quantity")).alias("l"), F.sum(F.when(F.col("outcome") == "buffered", 1).otherwise(0)).alias("b"))
    behind = rows.join(last.select("position_id", F.col("l.version").alias("at")), "position_id").where("version > at").groupBy("position_id").agg(F.count_distinct("version").alias("pending"))
    return last.join(behind, "position_id", "left").select("position_id", "l.version", "l.quantity", F.coalesce("pending", F.lit(0)).alias("pending"))


BOOTSTRAPS = "SELECT event_id AS bootstrap_id, user_id AS position_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 10 + user_id % 3 END AS version, CAST(user_id % 7 AS DECIMAL(24,6)) AS quantity, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'y' END AS checksum, ts AS requested_at FROM events"
BOOTSTRAPPED = "SELECT user_id AS position_id, MAX(event_id) AS bootstrap_id, 10 + user_id % 3 AS version, CAST(user_id % 7 AS DECIMAL(24,6)) AS quantity, 'x' AS checksum FROM events WHERE user_id % 4 = 1 GROUP BY user_id"


@query((), f"""
WITH r AS ({BOOTSTRAPS}), k AS ({BOOTSTRAPPED}), f AS (SELECT position_id, min({{'t': requested_at, 'b': bootstrap_id}}) AS f FROM r GROUP BY position_id)
SELECT r.bootstrap_id, r.position_id, CASE WHEN r.version < 1 THEN 'invalid_snapshot' WHEN r.position_id % 9 = 2 THEN 'fence_active' WHEN k.position_id IS NULL AND r.requested_at = f.f.t THEN 'bootstrapped'
  WHEN k.position_id IS NOT NULL AND k.bootstrap_id = r.bootstrap_id AND k.checksum = r.checksum AND k.version = r.version THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM r JOIN f USING (position_id) LEFT JOIN k ON k.position_id = r.position_id""")
def p3_bootstraps(s: Source) -> DataFrame:
    return projection.bootstrap(made(s, BOOTSTRAPS), made(s, BOOTSTRAPPED), made(s, "SELECT DISTINCT user_id AS position_id FROM events WHERE user_id % 9 = 2"))


REBUILDS = "SELECT o_orderkey AS rebuild_id, CASE o_orderkey % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'cancelled' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'op' END AS cancelled_by, CASE WHEN o_orderkey % 3 = 1 THEN 'why' END AS reason FROM orders"
CANCELS = "SELECT event_id AS rebuild_id, CASE WHEN user_id % 2 = 0 THEN 'op' ELSE 'else' END AS cancelled_by, 'why' AS reason FROM events"


@query((), f"""
WITH r AS ({REBUILDS}), q AS ({CANCELS})
SELECT rebuild_id, CASE WHEN r.status IS NULL THEN 'unknown_rebuild' WHEN r.status = 'prepared' THEN 'cancelled' WHEN r.status <> 'cancelled' THEN 'not_prepared' WHEN r.cancelled_by = q.cancelled_by THEN 'duplicate' ELSE 'conflict' END AS outcome FROM q LEFT JOIN r USING (rebuild_id)""")
def p6_rebuild_cancels(s: Source) -> DataFrame:
    return projection.cancel_rebuilds(made(s, REBUILDS), made(s, CANCELS))


# ---- ledger commands --------------------------------------------------------------------------------

CANDIDATES = "SELECT concat('c', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS candidate_id, CAST(s_nationkey % 3 AS INT) AS tenant_id, s_nationkey AS warehouse_id, l_suppkey AS location_id, l_partkey AS item_id, CAST(l_partkey % 5 AS INT) AS owner_id, 'Q' AS condition_id, NULLIF(l_linenumber % 3, 0) AS lot_id, NULLIF(CAST(l_partkey % 4 AS INT), 0) AS stock_scope_id, NULLIF(CAST(l_partkey % 2 AS INT), 0) AS attribute_set_id, CAST(NULL AS INT) AS stock_segment_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"


@query(("positions",), f"""
, c AS ({CANDIDATES} UNION ALL SELECT 'known-' || position_id, tenant_id, warehouse_id, location_id, item_id, owner_id, condition_id, lot_id, stock_scope_id, attribute_set_id, stock_segment_id FROM positions),
f AS (SELECT *, MIN(candidate_id) OVER (PARTITION BY {", ".join(("location_id", *SCOPE))}) AS first FROM c)
SELECT candidate_id, CASE WHEN location_id % 10 = 7 THEN NULL WHEN candidate_id LIKE 'known-%' THEN substr(candidate_id, 7) ELSE first END AS position_id,
  CASE WHEN location_id % 10 = 7 THEN 'unknown_anchor' WHEN candidate_id LIKE 'known-%' OR candidate_id <> first THEN 'existing' ELSE 'created' END AS outcome FROM f""")
def l1_positions(s: Source) -> DataFrame:
    known = stored(s.relation("positions").select("position_id", "location_id", *SCOPE), "position-keys", compression="zstd")
    more = known.select(F.concat(F.lit("known-"), "position_id").alias("candidate_id"), "location_id", *SCOPE)
    anchors = made(s, "SELECT s_suppkey AS location_id, CAST(s_nationkey % 3 AS INT) AS tenant_id, s_nationkey AS warehouse_id FROM supplier WHERE s_suppkey % 10 <> 7")
    return ledger.ensure_positions(made(s, CANDIDATES).unionByName(more), known, anchors)


_JUDGED = """CASE WHEN quantity > p.physical_qty THEN 'exceeds_physical' WHEN p.physical_qty - quantity < GREATEST(p.reserved_qty, p.allocated_qty) THEN 'strands_commitments' END"""


@query(("positions",), f"""
, r AS (SELECT 'i-' || position_id AS issue_id, position_id, CAST(item_id % 40 + 1 AS DECIMAL(24,6)) AS quantity FROM positions UNION ALL SELECT 'lost', 'nowhere', 1),
j AS (SELECT r.*, CASE WHEN p.position_id IS NULL THEN 'unknown_position' WHEN p.item_id % 6 = 0 THEN 'not_eligible' ELSE {_JUDGED} END AS reason FROM r LEFT JOIN positions p USING (position_id))
SELECT issue_id, position_id, reason, CASE WHEN reason IS NULL THEN CAST(-quantity AS DOUBLE) END AS physical_delta FROM j""")
def l3_issues(s: Source) -> DataFrame:
    s.share("positions")
    known = s.relation("positions").withColumn("shipping", F.col("item_id") % 6 != 0)
    quantity = (F.col("item_id") % 40 + 1).cast("decimal(24,6)").alias("quantity")
    lost = s.spark.sql("SELECT 'lost' AS issue_id, 'nowhere' AS position_id, CAST(1 AS DECIMAL(24,6)) AS quantity")
    return ledger.judge_issues(known.select(F.concat(F.lit("i-"), "position_id").alias("issue_id"), "position_id", quantity).unionByName(lost), known)


@query(("positions",), f"""
, n AS (SELECT *, LEAD(position_id) OVER (PARTITION BY item_id, condition_id ORDER BY position_id) AS target_id FROM positions), m AS (SELECT 'm-' || position_id AS movement_id, position_id AS source_id, target_id, CAST(item_id % 9 + 1 AS DECIMAL(24,6)) AS quantity FROM n WHERE target_id IS NOT NULL),
j AS (SELECT m.*, CASE WHEN p.item_id % 10 = 3 THEN 'source_not_eligible' WHEN {" OR ".join(f"p.{k} IS DISTINCT FROM t.{k}" for k in SCOPE)} THEN 'other_stock_identity' ELSE {_JUDGED} END AS reason FROM m JOIN positions p ON p.position_id = source_id JOIN positions t ON t.position_id = target_id)
SELECT movement_id, source_id AS position_id, CAST(-quantity AS DOUBLE) AS physical_delta, reason FROM j WHERE reason IS NULL UNION ALL SELECT movement_id, target_id, CAST(quantity AS DOUBLE), reason FROM j WHERE reason IS NULL
UNION ALL SELECT movement_id, NULL, NULL, reason FROM j WHERE reason IS NOT NULL""")
def l4_movements(s: Source) -> DataFrame:
    from pyspark.sql import Window

    s.share("positions")
    known = s.relation("positions").withColumn("movement", F.col("item_id") % 10 != 3)
    after = F.lead("position_id").over(Window.partitionBy("item_id", "condition_id").orderBy("position_id"))
    requests = known.withColumn("target_id", after).where("target_id is not null").select(F.concat(F.lit("m-"), "position_id").alias("movement_id"), F.col("position_id").alias("source_id"), "target_id", (F.col("item_id") % 9 + 1).cast("decimal(24,6)").alias("quantity"))
    return ledger.movement_outcomes(ledger.judge_movements(requests, known)).select("movement_id", "position_id", "physical_delta", "reason")


COUNTED = (
    "concat('n-', position_id) AS count_id", "position_id", "CASE WHEN item_id % 7 = 0 THEN 'reconciled' ELSE 'observed' END AS state",
    "CAST(CASE WHEN item_id % 5 = 0 THEN physical_qty + 1 ELSE physical_qty END AS DECIMAL(24,6)) AS system_qty", "CAST(item_id % 60 AS DECIMAL(24,6)) AS counted_qty",
)


@query(("positions",), f"""
, c AS (SELECT {", ".join(COUNTED)} FROM positions), j AS (SELECT c.*, CASE WHEN state <> 'observed' THEN 'already_reconciled' WHEN counted_qty = system_qty THEN 'zero_variance' WHEN p.physical_qty <> system_qty THEN 'stale_snapshot' WHEN p.physical_qty + counted_qty - system_qty < 0 THEN 'negative_result'
  WHEN p.physical_qty + counted_qty - system_qty < GREATEST(p.reserved_qty, p.allocated_qty) THEN 'strands_commitments' END AS reason FROM c JOIN positions p USING (position_id))
SELECT count_id, reason, CASE WHEN reason IS NULL THEN CAST(counted_qty - system_qty AS DOUBLE) END AS physical_delta FROM j""")
def l13_reconciliations(s: Source) -> DataFrame:
    s.share("positions")
    return ledger.judge_reconciliations(s.relation("positions").selectExpr(*COUNTED), s.relation("positions"))


@query((), """
WITH m AS (SELECT l_orderkey % 50 * 1000 + l_partkey % 1000 AS serial_id, l_suppkey AS position_id, CASE WHEN l_linenumber = 5 THEN l_suppkey + 1 ELSE l_suppkey END AS item_id FROM lineitem), n AS (SELECT serial_id, COUNT(DISTINCT position_id) AS n FROM m GROUP BY serial_id),
j AS (SELECT serial_id, position_id, CASE WHEN m.item_id % 4 = 0 OR m.item_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'item_not_tracked' WHEN m.item_id <> position_id THEN 'item_differs' WHEN n > 1 THEN 'in_two_positions' END AS reason FROM m JOIN n USING (serial_id))
SELECT serial_id, position_id, reason, COUNT(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL""")
def l14_serial_errors(s: Source) -> DataFrame:
    members = made(s, "SELECT l_orderkey % 50 * 1000 + l_partkey % 1000 AS serial_id, l_suppkey AS position_id, CASE WHEN l_linenumber = 5 THEN l_suppkey + 1 ELSE l_suppkey END AS item_id FROM lineitem")
    found = ledger.serial_errors(members, made(s, "SELECT s_suppkey AS position_id, s_suppkey AS item_id FROM supplier"), made(s, "SELECT s_suppkey AS item_id, s_suppkey % 4 <> 0 AS exact FROM supplier"))
    return found.groupBy("serial_id", "position_id", "reason").agg(F.count("*").alias("n"))


@query(("positions",), f"""
, r AS (SELECT 'h-' || position_id AS hold_id, CAST(item_id % 5 AS INT) AS policy_id, position_id FROM positions WHERE location_id % 3 = 1)
SELECT r.hold_id, r.policy_id, {", ".join("p." + k for k in SCOPE)}, CASE WHEN p.item_id % 2 = 0 THEN TS'2024-01-08 00:00:00' + (p.item_id % 3) * INTERVAL '1' DAY END AS released_at FROM r JOIN positions p USING (position_id)""")
def h3_position_holds(s: Source) -> DataFrame:
    s.share("positions")
    start = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    requests = s.relation("positions").where("location_id % 3 = 1").select(F.concat(F.lit("h-"), "position_id").alias("hold_id"), (F.col("item_id") % 5).cast("int").alias("policy_id"), "position_id", start.alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    holds = ledger.position_holds(requests, s.relation("positions"))
    first = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("item_id") % 3).cast("int"))
    releases = holds.where("item_id % 2 = 0").select("hold_id", first.alias("at"))
    later = releases.withColumn("at", F.col("at") + F.make_dt_interval(days=F.lit(5)))
    return ledger.release_holds(holds, releases.unionByName(later)).select("hold_id", "policy_id", *SCOPE, "released_at")


@query(("positions", "holds"), f"""
, h AS (SELECT * REPLACE (CASE WHEN item_id % 8 = 5 THEN owner_id + 1 ELSE owner_id END AS owner_id, CASE WHEN item_id % 26 = 0 THEN tenant_id + 1 ELSE tenant_id END AS tenant_id) FROM holds), o AS (SELECT policy_id, t AS tenant_id FROM (SELECT DISTINCT policy_id FROM h) x, (VALUES (0), (1), (2)) v(t)),
j AS (SELECT h.hold_id, CASE WHEN h.tenant_id > 2 THEN 'policy_of_another_tenant' WHEN h.position_id IS NOT NULL AND p.tenant_id IS DISTINCT FROM h.tenant_id THEN 'position_of_another_tenant'
  WHEN h.position_id IS NOT NULL AND ({" OR ".join(f"h.{k} IS DISTINCT FROM p.{k}" for k in SCOPE[1:])}) THEN 'scope_differs_from_position' END AS reason FROM h LEFT JOIN positions p ON p.position_id = h.position_id)
SELECT hold_id, reason, COUNT(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL""")
def h5_hold_errors(s: Source) -> DataFrame:
    s.share("positions")
    holds = s.relation("holds").withColumns({
        "owner_id": F.when(F.col("item_id") % 8 == 5, F.col("owner_id") + 1).otherwise(F.col("owner_id")), "tenant_id": F.when(F.col("item_id") % 26 == 0, F.col("tenant_id") + 1).otherwise(F.col("tenant_id")),
    }).withColumn("policy_id", F.col("policy_id") * 10 + F.least("tenant_id", F.lit(2)))
    policies = s.spark.range(5).selectExpr("explode(array(0, 1, 2)) AS tenant_id", "CAST(id AS INT) AS p").selectExpr("p * 10 + tenant_id AS policy_id", "tenant_id")
    return ledger.hold_errors(holds, policies, s.relation("positions")).groupBy("hold_id", "reason").agg(F.count("*").alias("n"))


@query(("positions", "hold_policies", "holds"), f"""
, e AS (SELECT p.position_id, NOT EXISTS (SELECT 1 FROM holds h JOIN hold_policies q ON q.policy_id = h.policy_id WHERE q.blocks_allocation AND h.starts_at <= TS'{HOLD_AS_OF}' AND h.released_at IS NULL AND (h.expires_at IS NULL OR h.expires_at > TS'{HOLD_AS_OF}')
  AND (h.position_id IS NULL OR h.position_id = p.position_id) AND {" AND ".join(f"h.{k} IS NOT DISTINCT FROM p.{k}" for k in SCOPE)}) AS ok, p.allocated_qty AS b, p.item_id % 12 AS a FROM positions p)
SELECT position_id, CAST(b AS DOUBLE) AS before, a AS after FROM e WHERE NOT ok AND a > b""")
def h6_ineligible_allocations(s: Source) -> DataFrame:
    s.share("positions")
    known = availability.action_eligibility(s.relation("positions"), s.relation("holds"), s.relation("hold_policies"), as_of(HOLD_AS_OF))
    changes = s.relation("positions").select("position_id", F.col("allocated_qty").alias("before"), (F.col("item_id") % 12).alias("after"))
    return ledger.ineligible_allocations(changes, known)


# ---- commitments --------------------------------------------------------------------------------------

SCOPE_LIST = ", ".join(SCOPE)
SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in SCOPE)
#: Made of positions, in both engines: what a scope has available, reservations and allocations.
AVAILABLE = f"SELECT {SCOPE_LIST}, CAST(SUM(physical_qty - allocated_qty - reserved_qty) AS DECIMAL(24,6)) AS available_qty FROM positions WHERE item_id % 8 <> 7 GROUP BY {SCOPE_LIST}"
#: The same, not yet summed.
FREE = f"SELECT {SCOPE_LIST}, CAST(physical_qty - allocated_qty - reserved_qty AS DECIMAL(24,6)) AS available_qty FROM positions WHERE item_id % 8 <> 7"
RESERVED = f"SELECT concat('r-', position_id) AS reservation_id, {', '.join(k for k in SCOPE if k != 'owner_id')}, CASE WHEN item_id % 7 = 0 THEN owner_id + 1 ELSE owner_id END AS owner_id, CASE WHEN item_id % 11 = 0 THEN 0 ELSE item_id END AS demand_id, CAST(30 + item_id % 9 AS DECIMAL(24,6)) AS quantity, CAST(item_id % 6 AS DECIMAL(24,6)) AS allocated_qty, CAST(item_id % 4 AS DECIMAL(24,6)) AS consumed_qty, CAST(item_id % 3 AS DECIMAL(24,6)) AS released_qty, CASE WHEN item_id % 10 = 1 THEN TS'2024-01-05 00:00:00' END AS released_at FROM positions"
ALLOCATED = "SELECT concat('a-', position_id) AS allocation_id, position_id, CASE WHEN item_id % 3 = 1 THEN concat('r-', position_id) END AS reservation_id, allocated_qty AS quantity, CAST(FLOOR(allocated_qty / 4) AS DECIMAL(24,6)) AS consumed_qty, CAST(CASE WHEN item_id % 13 = 2 THEN allocated_qty - FLOOR(allocated_qty / 4) ELSE 0 END AS DECIMAL(24,6)) AS released_qty, CASE WHEN item_id % 9 = 0 THEN TS'2024-01-06 00:00:00' END AS released_at FROM positions WHERE allocated_qty > 0"


def _of_positions(s: Source, sql: str) -> DataFrame:
    return s.spark.sql(dialect(sql.replace("FROM positions", "FROM {positions}"), True), positions=s.share("positions").relation("positions"))


@query(("positions",), f"""
, b AS ({AVAILABLE}), a AS (SELECT DISTINCT {SCOPE_LIST}, CAST(item_id % 60 AS DECIMAL(24,6)) AS quantity FROM positions)
SELECT concat({", '/', ".join(f"COALESCE(CAST(a.{k} AS VARCHAR), '-')" for k in SCOPE)}) AS reservation_id, CASE WHEN COALESCE(b.available_qty, 0) < a.quantity THEN 'exceeds_scope_availability' END AS reason FROM a LEFT JOIN b ON {SAME}""")
def l6_reservations(s: Source) -> DataFrame:
    available = _of_positions(s, AVAILABLE)
    requests = s.relation("positions").select(*SCOPE, (F.col("item_id") % 60).cast("decimal(24,6)").alias("quantity")).distinct()
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in SCOPE])
    return commitments.judge_reservations(requests.withColumn("reservation_id", name), available)


@query(("positions",), f"""
, r AS ({RESERVED}), q AS (SELECT 'r-' || position_id AS reservation_id FROM positions WHERE location_id % 2 = 0 UNION ALL SELECT 'nowhere')
SELECT q.reservation_id, CASE WHEN r.quantity IS NULL THEN 'unknown_reservation' WHEN released_at IS NOT NULL THEN 'already_released' END AS reason, CASE WHEN r.quantity IS NOT NULL AND released_at IS NULL THEN CAST(quantity - allocated_qty - consumed_qty AS DOUBLE) END AS released_qty FROM q LEFT JOIN r USING (reservation_id)""")
def l7_reservation_releases(s: Source) -> DataFrame:
    reservations = _of_positions(s, RESERVED)
    requests = s.relation("positions").where("location_id % 2 = 0").select(F.concat(F.lit("r-"), "position_id").alias("reservation_id")).unionByName(s.spark.sql("SELECT 'nowhere' AS reservation_id"))
    return commitments.release_reservations(requests, reservations)


@query(("positions",), f"""
, v AS ({AVAILABLE}), r AS ({RESERVED}), q AS (SELECT 'n-' || position_id AS allocation_id, position_id, CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'r-' || position_id ELSE CASE WHEN location_id % 5 = 0 THEN 'r-none' ELSE 'r-' || position_id END END AS reservation_id, item_id AS demand_id, CAST(item_id % 35 AS DECIMAL(24,6)) AS quantity FROM positions UNION ALL SELECT 'lost', 'nowhere', NULL, 1, 1),
j AS (SELECT q.*, p.position_id IS NULL AS no_p, r.reservation_id IS NULL AS no_r, r.released_at AS ended, r.demand_id IS DISTINCT FROM q.demand_id OR {" OR ".join(f"r.{k} IS DISTINCT FROM p.{k}" for k in SCOPE)} AS differs, r.quantity - r.allocated_qty - r.consumed_qty - r.released_qty AS held, p.physical_qty - p.allocated_qty - p.reserved_qty AS free, COALESCE(v.available_qty, 0) AS available
  FROM q LEFT JOIN positions p USING (position_id) LEFT JOIN r USING (reservation_id) LEFT JOIN v ON {" AND ".join(f"v.{k} IS NOT DISTINCT FROM p.{k}" for k in SCOPE)}),
k AS (SELECT *, CASE WHEN no_p THEN 'unknown_position' WHEN reservation_id IS NOT NULL AND no_r THEN 'unknown_reservation' WHEN reservation_id IS NOT NULL AND ended IS NOT NULL THEN 'reservation_released' WHEN reservation_id IS NOT NULL AND differs THEN 'reservation_does_not_match'
  WHEN reservation_id IS NOT NULL AND held < quantity THEN 'exceeds_reservation' WHEN free < quantity THEN 'exceeds_free_quantity' WHEN reservation_id IS NULL AND available < quantity THEN 'consumes_reserved_capacity' END AS reason FROM j)
SELECT allocation_id, reason, CASE WHEN reason IS NULL THEN CAST(quantity AS DOUBLE) END AS allocated_delta FROM k""")
def l8_allocations(s: Source) -> DataFrame:
    reservations, available = _of_positions(s, RESERVED), _of_positions(s, FREE)
    n = F.col("item_id") % 4
    own = F.concat(F.lit("r-"), "position_id")
    given = F.when(n == 2, own).when(n == 3, F.when(F.col("location_id") % 5 == 0, "r-none").otherwise(own))
    requests = s.relation("positions").select(F.concat(F.lit("n-"), "position_id").alias("allocation_id"), "position_id", given.alias("reservation_id"), F.col("item_id").alias("demand_id"), (F.col("item_id") % 35).cast("decimal(24,6)").alias("quantity"))
    lost = s.spark.sql("SELECT 'lost' AS allocation_id, 'nowhere' AS position_id, CAST(NULL AS STRING) AS reservation_id, 1L AS demand_id, CAST(1 AS DECIMAL(24,6)) AS quantity")
    return commitments.judge_allocations(requests.unionByName(lost), s.relation("positions"), reservations, available)


@query(("positions",), f"""
, r AS ({RESERVED}), a AS ({ALLOCATED}), q AS (SELECT 'a-' || position_id AS allocation_id FROM positions), j AS (SELECT q.allocation_id, a.position_id, a.reservation_id, r.released_at IS NOT NULL AS over, a.quantity - a.consumed_qty - a.released_qty AS l, CASE WHEN a.quantity IS NULL THEN 'unknown_allocation' WHEN a.released_at IS NOT NULL THEN 'already_released' WHEN a.quantity - a.consumed_qty - a.released_qty <= 0 THEN 'nothing_remains' END AS reason
  FROM q LEFT JOIN a USING (allocation_id) LEFT JOIN r ON r.reservation_id = a.reservation_id)
SELECT allocation_id, reason, position_id, CASE WHEN reason IS NULL THEN CAST(-l AS DOUBLE) END AS allocated_delta, CASE WHEN reason IS NULL THEN CASE WHEN reservation_id IS NOT NULL THEN CAST(-l AS DOUBLE) ELSE 0 END END AS reservation_allocated_delta, CASE WHEN reason IS NULL THEN CASE WHEN reservation_id IS NOT NULL AND over THEN CAST(l AS DOUBLE) ELSE 0 END END AS reservation_released_delta FROM j""")
def l9_allocation_releases(s: Source) -> DataFrame:
    reservations, allocations = _of_positions(s, RESERVED), _of_positions(s, ALLOCATED)
    return commitments.release_allocations(s.relation("positions").select(F.concat(F.lit("a-"), "position_id").alias("allocation_id")), allocations, reservations)


@query(("positions",), f"""
, a AS ({ALLOCATED}), n AS (SELECT position_id, LEAD(position_id) OVER (PARTITION BY {SCOPE_LIST} ORDER BY position_id) AS target_id FROM positions), q AS (SELECT 'p-' || a.allocation_id AS pick_id, a.allocation_id, COALESCE(n.target_id, CASE WHEN p.item_id % 2 = 0 THEN 'nowhere' ELSE p.position_id END) AS target_id, CAST(1 + p.item_id % 12 AS DECIMAL(24,6)) AS quantity FROM a JOIN positions p USING (position_id) JOIN n USING (position_id)),
j AS (SELECT q.*, a.position_id AS source_id, CASE WHEN a.released_at IS NOT NULL THEN 'allocation_released' WHEN a.quantity - a.consumed_qty - a.released_qty < q.quantity THEN 'exceeds_allocation' WHEN t.position_id IS NULL THEN 'unknown_position' WHEN {" OR ".join(f"p.{k} IS DISTINCT FROM t.{k}" for k in SCOPE)} THEN 'other_stock_identity'
  WHEN p.item_id % 14 = 5 OR p.item_id % 6 = 4 OR t.item_id % 6 = 4 THEN 'not_eligible' WHEN p.allocated_qty < q.quantity OR p.physical_qty < q.quantity THEN 'source_cannot_satisfy' WHEN p.physical_qty - q.quantity < GREATEST(p.reserved_qty, p.allocated_qty - q.quantity) THEN 'strands_commitments' END AS reason
  FROM q JOIN a USING (allocation_id) JOIN positions p ON p.position_id = a.position_id LEFT JOIN positions t ON t.position_id = q.target_id)
SELECT pick_id, reason, source_id AS position_id, CASE WHEN reason IS NULL THEN CAST(-quantity AS DOUBLE) END AS physical_delta, CASE WHEN reason IS NULL THEN CAST(-quantity AS DOUBLE) END AS allocated_delta FROM j UNION ALL SELECT pick_id, reason, target_id, CAST(quantity AS DOUBLE), 0 FROM j WHERE reason IS NULL""")
def l11_picks(s: Source) -> DataFrame:
    from pyspark.sql import Window

    allocations = _of_positions(s, ALLOCATED)
    n = F.col("item_id")
    known = s.relation("positions").withColumn("picking", n % 14 != 5).withColumn("movement", n % 6 != 4)
    positions = s.relation("positions").select("position_id", "item_id", "allocated_qty", availability.key_text(known, *SCOPE).alias("scope"))
    after = F.lead("position_id").over(Window.partitionBy("scope").orderBy("position_id"))
    own = F.concat(F.lit("a-"), "position_id")
    requests = positions.withColumn("after", after).where("allocated_qty > 0").select(
        F.concat(F.lit("p-"), own).alias("pick_id"), own.alias("allocation_id"), F.coalesce("after", F.when(n % 2 == 0, "nowhere").otherwise(F.col("position_id"))).alias("target_id"), (1 + n % 12).cast("decimal(24,6)").alias("quantity"),
    )
    return commitments.pick_outcomes(commitments.judge_picks(requests, allocations, known)).select("pick_id", "position_id", "physical_delta", "allocated_delta", "reason")


# ---- work commands --------------------------------------------------------------------------------------

WORKS = "SELECT o_orderkey AS work_id, CASE o_orderkey % 7 WHEN 0 THEN 'planned' WHEN 1 THEN 'released' WHEN 2 THEN 'assigned' WHEN 3 THEN 'in_progress' WHEN 4 THEN 'exception' WHEN 5 THEN 'completed' ELSE 'planned' END AS state FROM orders"
TASKS = """SELECT l_orderkey AS work_id, l_linenumber AS sequence, l_orderkey * 10 + l_linenumber AS task_id, l_linenumber % 2 = 0 AS needs_ref,
  CASE WHEN l_orderkey % 7 IN (0, 1) THEN 'pending' WHEN l_orderkey % 7 = 6 THEN CASE WHEN l_linenumber = 2 THEN 'ready' ELSE 'pending' END ELSE CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'ready' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'exception' ELSE 'pending' END END AS state
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
ASSIGNED = "SELECT o_orderkey AS work_id, o_custkey % 4 AS resource_id, CASE WHEN o_orderkey % 11 = 0 THEN 'released' ELSE 'active' END AS state FROM orders WHERE o_orderkey % 7 IN (2, 3, 4)"
EXECUTED = "SELECT l_orderkey * 10 + l_linenumber AS task_id, o_custkey % 4 AS resource_id, CASE WHEN (l_orderkey + l_linenumber) % 5 = 2 THEN 'in_progress' ELSE 'blocked' END AS state FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE (l_orderkey + l_linenumber) % 5 IN (2, 3) AND l_orderkey % 13 <> 0 GROUP BY l_orderkey, l_linenumber, o_custkey"
ORDERED = "SELECT o_orderkey * 100 + n AS command_id, CASE n % 8 WHEN 0 THEN 'release' WHEN 1 THEN 'claim' WHEN 2 THEN 'start' WHEN 3 THEN 'confirm' WHEN 4 THEN 'raise' WHEN 5 THEN 'resume' WHEN 6 THEN 'cancel' ELSE 'start' END AS command, o_orderkey AS work_id, o_orderkey * 10 + CASE WHEN n > 2 THEN n - 2 ELSE 1 END AS task_id, CASE WHEN n % 8 = 7 THEN 9 ELSE o_custkey % 4 END AS resource_id, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'ref' END AS domain_ref FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(n)"
JUDGED_WORK = f"""
c AS ({ORDERED}), w AS ({WORKS}), t AS ({TASKS}), s AS (SELECT work_id, MIN(resource_id) AS who FROM ({ASSIGNED}) WHERE state = 'active' GROUP BY work_id), x AS (SELECT task_id, min({{'s': state, 'r': resource_id}}) AS run FROM ({EXECUTED}) GROUP BY task_id),
g AS (SELECT work_id, bool_and(state = 'pending') AS fresh, bool_or(state IN ('in_progress', 'exception', 'completed')) AS began, min({{'q': sequence, 'i': task_id}}).i AS first, MIN(sequence) FILTER (WHERE state NOT IN ('completed', 'cancelled')) AS open FROM t GROUP BY work_id),
n AS (SELECT a.task_id, min({{'q': b.sequence, 'i': b.task_id, 's': b.state}}) AS nx FROM t a JOIN t b ON b.work_id = a.work_id AND b.sequence > a.sequence AND b.state NOT IN ('completed', 'cancelled') GROUP BY a.task_id),
k AS (SELECT c.*, w.state AS ws, t.state AS ts, t.sequence, t.needs_ref, g.fresh, g.began, g.first, g.open, s.who, x.run, n.nx, COALESCE(x.run.s = 'in_progress' AND x.run.r = c.resource_id AND s.who = c.resource_id, false) AS mine
  FROM c LEFT JOIN w USING (work_id) LEFT JOIN t ON t.task_id = c.task_id LEFT JOIN g ON g.work_id = c.work_id LEFT JOIN s ON s.work_id = c.work_id LEFT JOIN x ON x.task_id = c.task_id LEFT JOIN n ON n.task_id = c.task_id),
r AS (SELECT *, CASE command
  WHEN 'release' THEN CASE WHEN ws <> 'planned' THEN 'not_planned' WHEN NOT COALESCE(fresh, true) THEN 'tasks_not_pending' WHEN first IS NULL THEN 'no_task' END WHEN 'claim' THEN CASE WHEN ws <> 'released' THEN 'not_released' END
  WHEN 'start' THEN CASE WHEN ts IS NULL THEN 'unknown_task' WHEN ws NOT IN ('assigned', 'in_progress') THEN 'not_executable' WHEN ts <> 'ready' THEN 'task_not_ready' WHEN open < sequence THEN 'sequence_skipped' WHEN who IS NULL THEN 'no_assignment' WHEN who <> resource_id THEN 'not_the_assigned_resource' END
  WHEN 'confirm' THEN CASE WHEN ts IS NULL THEN 'unknown_task' WHEN ts <> 'in_progress' THEN 'task_not_in_progress' WHEN needs_ref AND trim(domain_ref) = '' THEN 'domain_reference_required' WHEN NOT mine THEN 'no_live_execution' WHEN nx.s <> 'pending' THEN 'next_task_not_pending' END
  WHEN 'raise' THEN CASE WHEN ts IS NULL THEN 'unknown_task' WHEN ts <> 'in_progress' THEN 'task_not_in_progress' WHEN NOT mine THEN 'no_live_execution' END
  WHEN 'resume' THEN CASE WHEN ts IS NULL THEN 'unknown_task' WHEN ts <> 'exception' THEN 'no_open_exception' WHEN COALESCE(run.s, '') <> 'blocked' THEN 'no_blocked_execution' WHEN who IS NULL THEN 'no_assignment' END
  ELSE CASE WHEN ws NOT IN ('planned', 'released', 'assigned') OR COALESCE(began, false) THEN 'execution_began' END END AS reason FROM k)"""


def _judged_work(s: Source, commands: DataFrame) -> DataFrame:
    return work.judge_commands(commands, made(s, WORKS), made(s, TASKS, lineitem="l_orderkey"), made(s, ASSIGNED), made(s, EXECUTED))


@query((), f"""WITH {JUDGED_WORK}
SELECT command_id, reason, CASE WHEN reason IS NULL THEN CASE command WHEN 'release' THEN 'released' WHEN 'claim' THEN 'assigned' WHEN 'start' THEN 'in_progress' WHEN 'raise' THEN 'exception' WHEN 'resume' THEN 'assigned' WHEN 'cancel' THEN 'cancelled' ELSE CASE WHEN nx IS NULL THEN 'completed' ELSE ws END END END AS work_state,
  CASE WHEN reason IS NULL THEN CASE command WHEN 'start' THEN 'in_progress' WHEN 'confirm' THEN 'completed' WHEN 'raise' THEN 'exception' WHEN 'resume' THEN 'ready' END END AS task_state, CASE WHEN reason IS NULL THEN CASE command WHEN 'release' THEN first WHEN 'confirm' THEN nx.i END END AS ready_task FROM r""")
def wk1_work_commands(s: Source) -> DataFrame:
    return _judged_work(s, made(s, ORDERED, orders="o_orderkey"))


@query((), f"""
WITH c AS (SELECT *, sha256('command:' || kind || ':' || COALESCE(detail, '-')) AS fingerprint FROM ({COMMANDS})), f AS (SELECT tenant_id, idempotency_key, min({{'t': recorded_at, 'i': id, 'p': fingerprint}}) AS f FROM c GROUP BY ALL)
SELECT id, CASE WHEN id = f.i THEN 'applied' WHEN fingerprint = f.p THEN 'replayed' ELSE 'conflict' END AS outcome, CASE WHEN id = f.i OR fingerprint = f.p THEN f.i END AS belongs_to FROM c JOIN f USING (tenant_id, idempotency_key)""")
def wk8_command_replays(s: Source) -> DataFrame:
    return ledger.replays(commands(s), "tenant_id", "idempotency_key").select("id", "outcome", "belongs_to")


@query((), f"""WITH {JUDGED_WORK}
SELECT command_id, COALESCE(reason, CASE WHEN command_id % 700 < 100 THEN 'domain_result_missing' WHEN command_id % 5 = 0 THEN 'strands_commitments' END) AS reason FROM r WHERE command = 'confirm'""")
def wk9_composite_confirmations(s: Source) -> DataFrame:
    confirms = made(s, ORDERED).where("command = 'confirm'").select("command_id")
    judged = _judged_work(s, made(s, ORDERED, orders="o_orderkey").where("command = 'confirm'"))
    n = F.col("command_id")
    domain = confirms.where("command_id % 700 >= 100").select("command_id", F.when(n % 5 == 0, "strands_commitments").alias("reason"))
    return work.judge_confirmations(judged, domain)


# ---- alerts -----------------------------------------------------------------------------------------


def _alert_sql(snapshot: str, alerts: tuple[tuple[str, str, str], ...]) -> str:
    """(code, severity, n, worst) of alerts (code, SQL of the severity or null, SQL of the number)."""
    parts = " UNION ALL ".join(f"SELECT '{code}' AS code, {severity} AS severity, CAST({value} AS DOUBLE) AS v FROM x" for code, severity, value in alerts)
    return f"WITH x AS ({snapshot}), u AS ({parts}) SELECT code, severity, COUNT(*) AS n, round(MAX(v), 6) AS worst FROM u WHERE severity IS NOT NULL GROUP BY code, severity"


def _levels(value: str, warning: float, critical: float) -> str:
    return f"CASE WHEN {value} >= {critical} THEN 'critical' WHEN {value} >= {warning} THEN 'warning' END"


CONSUMERS = "SELECT user_id AS consumer, COUNT(*) FILTER (WHERE event_type <> 'view') * 3 * (user_id % 4) AS pending, COUNT(*) FILTER (WHERE event_type = 'click') * (user_id % 3) AS ack_pending, COUNT(*) FILTER (WHERE event_type = 'error') AS redelivered, CASE WHEN user_id % 5 <> 0 THEN 20 + user_id % 30 END AS max_ack_pending, MIN(ts) AS created_at, MAX(ts) FILTER (WHERE event_type = 'purchase') AS last_delivery_at, MAX(ts) FILTER (WHERE event_type = 'signup') AS last_ack_at, user_id % 7 = 0 AS paused, user_id % 11 <> 0 AS configuration_valid FROM events GROUP BY user_id"
_STALL = f"(epoch_us(TS'{AS_OF}') - epoch_us({{}})) / 1e6"


@query((), _alert_sql(
    f"SELECT *, pending + ack_pending AS backlog, ack_pending / max_ack_pending AS ratio, CASE WHEN pending > 0 THEN {_STALL.format('COALESCE(last_delivery_at, created_at)')} END AS ds, CASE WHEN ack_pending > 0 THEN {_STALL.format('COALESCE(last_ack_at, last_delivery_at, created_at)')} END AS ks FROM ({CONSUMERS})".replace("TS'", "TIMESTAMP '"),
    (
        ("nats_consumer_configuration_invalid", "CASE WHEN NOT configuration_valid THEN 'critical' END", "NULL"), ("nats_consumer_pending_backlog", _levels("pending", 100, 1000), "pending"), ("nats_consumer_redeliveries", _levels("redelivered", 1, 10), "redelivered"),
        ("nats_consumer_ack_capacity", _levels("ratio", 0.8, 1.0), "ratio"), ("nats_consumer_delivery_stalled", _levels("ds", 300, 1800), "ds"), ("nats_consumer_ack_stalled", _levels("ks", 300, 1800), "ks"),
        ("nats_consumer_paused_with_backlog", "CASE WHEN paused AND backlog > 0 THEN 'warning' END", "backlog"),
    ),
))
def hp5_consumer_alerts(s: Source) -> DataFrame:
    return health.alert_counts(health.consumer_snapshot(made(s, CONSUMERS), as_of()), health.CONSUMER).withColumn("worst", F.round("worst", 6))


STREAMS = "SELECT user_id AS stream, user_id % 13 <> 0 AS configuration_valid, CASE WHEN user_id % 17 = 0 THEN 2 ELSE 0 END AS lost_messages, user_id % 2 = 0 AS clustered, user_id % 6 <> 0 AS leader_present, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS offline_followers, user_id % 3 AS not_current_followers, COUNT(*) * (user_id % 90) * 50 AS replica_lag, COUNT(*) AS messages, CASE WHEN user_id % 4 <> 0 THEN COUNT(*) + user_id % 9 ELSE 0 END AS max_messages, SUM(value) AS bytes, CASE WHEN user_id % 5 <> 0 THEN SUM(value) + user_id * 100 END AS max_bytes FROM events GROUP BY user_id"


@query((), _alert_sql(
    f"SELECT *, messages / NULLIF(max_messages, 0) AS mr, bytes / max_bytes AS br FROM ({STREAMS})",
    (
        ("nats_stream_configuration_invalid", "CASE WHEN NOT configuration_valid THEN 'critical' END", "NULL"), ("nats_stream_lost_messages", "CASE WHEN lost_messages > 0 THEN 'critical' END", "lost_messages"), ("nats_stream_leader_missing", "CASE WHEN clustered AND NOT leader_present THEN 'critical' END", "NULL"),
        ("nats_stream_offline_followers", "CASE WHEN offline_followers > 0 THEN 'critical' END", "offline_followers"), ("nats_stream_followers_not_current", "CASE WHEN offline_followers = 0 AND not_current_followers > 0 THEN 'warning' END", "not_current_followers"),
        ("nats_stream_replica_lag", _levels("replica_lag", 1000, 10000), "replica_lag"), ("nats_stream_message_capacity", _levels("mr", 0.8, 0.95), "mr"), ("nats_stream_byte_capacity", _levels("br", 0.8, 0.95), "br"),
    ),
))
def hp6_stream_alerts(s: Source) -> DataFrame:
    return health.alert_counts(health.stream_snapshot(made(s, STREAMS)), health.STREAM).withColumn("worst", F.round("worst", 6))


_AT = "ts + INTERVAL '1' SECOND * {}"
PROBES = f"SELECT event_id AS canary_id, ts AS started_at, CASE WHEN event_id % 11 <> 0 THEN {_AT.format('(event_id % 7)')} END AS published_at, CASE WHEN event_id % 11 <> 0 THEN {_AT.format('(event_id % 9 - 2)')} END AS broker_at, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN {_AT.format('(event_id % 10)')} END AS inbox_at, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 THEN {_AT.format('(event_id % 19)')} END AS projected_at, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 31 = 0 THEN 'x' ELSE 's' END END AS stream_name, CASE WHEN event_id % 37 = 0 THEN 'x' ELSE 'd' END AS durable_name, CASE WHEN event_id % 41 = 0 THEN 'x' ELSE 'c' END AS consumer_name, event_id % 23 <> 0 AS ack_available, event_id % 29 <> 0 AS ack_valid, event_id % 6 <> 0 AS ack_confirmed, event_id % 4 = 0 AS complete, event_id % 3 = 0 AS timed_out FROM events"


def _seconds(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 1e6"


@query((), _alert_sql(
    f"SELECT *, timed_out AND NOT complete AS late, LEAST(CASE WHEN {_seconds('broker_at', 'started_at')} < -1 THEN {_seconds('broker_at', 'started_at')} END, CASE WHEN {_seconds('inbox_at', 'broker_at')} < -1 THEN {_seconds('inbox_at', 'broker_at')} END) AS skew, {_seconds('published_at', 'started_at')} AS pub, {_seconds('inbox_at', 'broker_at')} AS del, {_seconds('projected_at', 'inbox_at')} AS pro, {_seconds('projected_at', 'started_at')} AS e2e, GREATEST({_STALL.format('started_at')}, 0) AS age FROM ({PROBES})".replace("TS'", "TIMESTAMP '"),
    (
        ("canary_consumer_configuration_invalid", "CASE WHEN ack_available AND NOT ack_valid THEN 'critical' END", "NULL"), ("canary_stream_identity_mismatch", "CASE WHEN stream_name <> 's' THEN 'critical' END", "NULL"), ("canary_durable_identity_mismatch", "CASE WHEN durable_name <> 'd' THEN 'critical' END", "NULL"),
        ("canary_consumer_identity_mismatch", "CASE WHEN consumer_name <> 'c' THEN 'critical' END", "NULL"), ("canary_clock_skew_detected", "CASE WHEN skew IS NOT NULL THEN 'critical' END", "skew"), ("canary_publish_latency", _levels("pub", 2, 5), "pub"), ("canary_delivery_latency", _levels("del", 2, 5), "del"),
        ("canary_projection_latency", _levels("pro", 1, 3), "pro"), ("canary_end_to_end_latency", _levels("e2e", 5, 15), "e2e"), ("canary_publish_timeout", "CASE WHEN late AND published_at IS NULL THEN 'critical' END", "age"),
        ("canary_delivery_timeout", "CASE WHEN late AND published_at IS NOT NULL AND inbox_at IS NULL THEN 'critical' END", "age"), ("canary_projection_timeout", "CASE WHEN late AND published_at IS NOT NULL AND inbox_at IS NOT NULL AND projected_at IS NULL THEN 'critical' END", "age"),
        ("canary_ack_timeout", "CASE WHEN late AND projected_at IS NOT NULL AND NOT ack_confirmed THEN 'critical' END", "age"), ("canary_incomplete_timeout", "CASE WHEN late AND projected_at IS NOT NULL AND ack_confirmed THEN 'critical' END", "age"),
        ("canary_ack_observer_unavailable", "CASE WHEN NOT ack_available AND timed_out THEN 'critical' END", "NULL"),
    ),
))
def hp8_canary_alerts(s: Source) -> DataFrame:
    return health.alert_counts(health.canary_snapshot(made(s, PROBES), "s", "d", "c", as_of()), health.CANARY).withColumn("worst", F.round("worst", 6))


SLI_LATE = "2024-02-01 12:00:00"


@query(("outcomes",), f"""
, e AS (SELECT *, CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_LATE}' THEN 'failed' ELSE outcome END AS eo, CASE WHEN outcome = 'pending' AND deadline_at <= TS'{SLI_LATE}' THEN deadline_at ELSE finalized_at END AS ea FROM outcomes),
w AS (SELECT UNNEST([300, 3600, 86400]) AS s), c AS (SELECT s, COUNT(*) FILTER (WHERE eo = 'failed') / COUNT(*) / (1.0::DOUBLE - 0.99::DOUBLE) AS a, COUNT(*) FILTER (WHERE eo = 'succeeded' AND end_to_end_seconds > 5) / NULLIF(COUNT(*) FILTER (WHERE eo = 'succeeded'), 0) / (1.0::DOUBLE - 0.95::DOUBLE) AS l
  FROM w JOIN e ON eo <> 'pending' AND ea >= TS'{SLI_LATE}' - s * INTERVAL '1' SECOND AND ea <= TS'{SLI_LATE}' GROUP BY s),
p AS (SELECT MAX(a) FILTER (WHERE s = 300) AS a1, MAX(a) FILTER (WHERE s = 3600) AS a2, MAX(a) FILTER (WHERE s = 86400) AS a3, MAX(l) FILTER (WHERE s = 300) AS l1, MAX(l) FILTER (WHERE s = 3600) AS l2, MAX(l) FILTER (WHERE s = 86400) AS l3 FROM c),
h AS (SELECT GREATEST((epoch_us(TS'{SLI_LATE}') - epoch_us(MAX(started_at))) / 1e6, 0) AS age FROM e), o AS (SELECT eo, ROW_NUMBER() OVER (ORDER BY ea DESC, canary_id DESC) AS n FROM e WHERE eo <> 'pending'),
k AS (SELECT COUNT(*) AS streak FROM o WHERE eo = 'failed' AND n < COALESCE((SELECT MIN(n) FROM o WHERE eo = 'succeeded'), 9223372036854775807)),
u AS (SELECT 'canary_sli_no_observations' AS code, CASE WHEN age IS NULL THEN 'critical' END AS severity, NULL::DOUBLE AS observed FROM h UNION ALL SELECT 'canary_sli_stale', CASE WHEN age >= 180 THEN 'critical' END, age FROM h
  UNION ALL SELECT 'canary_sli_consecutive_failures', CASE WHEN streak >= 3 THEN 'critical' WHEN streak >= 2 THEN 'warning' END, streak FROM k
  UNION ALL SELECT 'canary_sli_availability_fast_burn', CASE WHEN a1 >= 14.4 AND a2 >= 14.4 THEN 'critical' END, GREATEST(a1, a2) FROM p UNION ALL SELECT 'canary_sli_availability_slow_burn', CASE WHEN a2 >= 3 AND a3 >= 3 THEN 'warning' END, GREATEST(a2, a3) FROM p
  UNION ALL SELECT 'canary_sli_latency_fast_burn', CASE WHEN l1 >= 14.4 AND l2 >= 14.4 THEN 'critical' END, GREATEST(l1, l2) FROM p UNION ALL SELECT 'canary_sli_latency_slow_burn', CASE WHEN l2 >= 3 AND l3 >= 3 THEN 'warning' END, GREATEST(l2, l3) FROM p),
f AS (SELECT * FROM u WHERE severity IS NOT NULL)
SELECT COALESCE((SELECT CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN COUNT(*) > 0 THEN 'warning' END FROM f), 'ok') AS status, code, severity, round(observed, 6) AS observed FROM (SELECT 1) LEFT JOIN f ON true""")
def hp9_sli_alerts(s: Source) -> DataFrame:
    levels = stored(telemetry.service_levels(s.relation("outcomes"), as_of(SLI_LATE), **SLI), "service-levels")
    return health.evaluate(health.sli_snapshot(levels, as_of(SLI_LATE)), health.SLI).select("status", "code", "severity", F.round("observed", 6).alias("observed"))


@query(("versioned",), CURSOR_SQL + f"""
, t AS (SELECT CAST(COALESCE(SUM(pending), 0) AS DOUBLE) AS p, (epoch_us(TS'{AS_OF}') - epoch_us(MIN(oldest_pending_at))) / 1e6 AS a FROM cursors WHERE pending > 0),
u AS (SELECT 'projection_gap_age_exceeded' AS code, CASE WHEN a >= 1800 THEN 'critical' WHEN a >= 300 THEN 'warning' END AS severity, a AS observed FROM t UNION ALL SELECT 'projection_pending_events_exceeded', CASE WHEN p >= 1000 THEN 'critical' WHEN p >= 100 THEN 'warning' END, p FROM t)
SELECT code, severity, observed FROM u WHERE severity IS NOT NULL""")
def hp4_gap_alerts(s: Source) -> DataFrame:
    gaps = projection.gaps(projection.apply_deltas(s.relation("versioned")))
    row = gaps.agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_count"), F.min("oldest_pending_at").alias("o")).withColumn("oldest_pending_age_seconds", telemetry.age(as_of(), F.col("o")))
    return health.evaluate(row, health.GAPS).where("code is not null").select("code", "severity", "observed")


@query((), f"""
WITH r AS (SELECT ts AS started_at, ts - (event_id % 40) * INTERVAL '1' SECOND AS due_at FROM events WHERE ts <= TIMESTAMP '{HOLD_AS_OF}'), l AS (SELECT max({{'d': due_at, 's': started_at}}) AS r FROM r),
x AS (SELECT r.d AS due, (epoch_us(r.s) - epoch_us(r.d)) / 1e6 AS lag, TIMESTAMP '{HOLD_AS_OF}' - INTERVAL '90' SECOND AS expected FROM l),
c AS (SELECT *, due IS NULL OR due < expected AS missing, GREATEST(1, floor((epoch_us(expected) - epoch_us(due)) / 1e6 / 60)) AS missed FROM x)
SELECT CASE WHEN missing THEN CASE WHEN missed >= 2 THEN 'critical' ELSE 'warning' END WHEN lag >= 60 THEN 'critical' WHEN lag >= 15 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN missing THEN 'probe_execution_missing' WHEN lag >= 15 THEN 'probe_scheduler_lag' END AS code, CASE WHEN missing THEN CAST(missed AS BIGINT) END AS missed, lag AS lag_seconds FROM c""")
def hp10_watchdog(s: Source) -> DataFrame:
    receipts = s.table("events").select(F.col("ts").alias("started_at"), (F.col("ts") - F.make_dt_interval(secs=F.col("event_id") % 40)).alias("due_at"))
    return control.watchdog(receipts, as_of(HOLD_AS_OF) - F.make_dt_interval(secs=F.lit(90)), as_of(HOLD_AS_OF), 60)


SIGNALS = "SELECT user_id AS pipeline_id, 'configuration' AS signal, CASE WHEN user_id % 9 = 0 THEN 'critical' ELSE 'ok' END AS status, CASE WHEN user_id % 9 = 0 THEN 'deployment_disabled' END AS code FROM events GROUP BY user_id UNION ALL SELECT user_id, 'pipeline_health', CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 'warning' ELSE 'ok' END, CASE WHEN user_id % 5 = 0 THEN 'pipeline_runtime_endpoint_missing' WHEN user_id % 5 = 1 THEN 'pipeline_health_degraded' END FROM events GROUP BY user_id UNION ALL SELECT user_id, 'canary_sli', CASE WHEN user_id % 7 < 2 THEN 'critical' ELSE 'ok' END, CASE WHEN user_id % 7 < 2 THEN 'canary_sli_critical' END FROM events GROUP BY user_id UNION ALL SELECT user_id, 'watchdog', CASE WHEN user_id % 3 = 0 THEN 'warning' ELSE 'ok' END, CASE WHEN user_id % 3 = 0 THEN 'watchdog_degraded' END FROM events GROUP BY user_id"


@query((), f"""
WITH g AS ({SIGNALS}), c AS (SELECT *, CASE COALESCE(status, 'critical') WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS r, list_position(['configuration', 'pipeline_health', 'watchdog', 'canary_sli'], signal) AS p FROM g WHERE pipeline_id % 9 <> 0 OR signal = 'configuration'),
w AS (SELECT pipeline_id, MAX(r) AS r, COUNT(*) AS n FROM c GROUP BY pipeline_id), f AS (SELECT c.pipeline_id, arg_min(signal, p) AS signal, arg_min(code, p) AS code FROM c JOIN w ON w.pipeline_id = c.pipeline_id AND w.r = c.r AND c.r > 0 GROUP BY c.pipeline_id)
SELECT w.pipeline_id, CASE w.r WHEN 2 THEN 'not_ready' WHEN 1 THEN 'degraded' ELSE 'ready' END AS status, f.signal AS root_signal, f.code AS root_code, n AS n_signals FROM w LEFT JOIN f USING (pipeline_id)""")
def hp11_readiness(s: Source) -> DataFrame:
    return health.readiness(made(s, SIGNALS))


RUNS = "SELECT event_id AS run_id, CASE WHEN event_id % 5 < 2 THEN 'applying' WHEN event_id % 5 = 2 THEN 'completed' WHEN event_id % 5 = 3 THEN 'rolled_back' ELSE 'failed' END AS state, ts AS started_at, TS'2024-02-01 00:00:00' AS lease_until, ts + INTERVAL '10' SECOND AS state_changed_at FROM events"


@query((), f"""
WITH r AS ({RUNS}), a AS (SELECT max({{'s': started_at, 'i': run_id}}) AS x FROM r WHERE state = 'applying'), t AS (SELECT max({{'s': started_at, 'i': run_id, 'z': state}}) AS x FROM r WHERE state <> 'applying'),
j AS (SELECT a.x.i AS run_id, CASE WHEN (epoch_us(TS'{AS_OF}') - epoch_us(a.x.s)) / 1e6 - 10 >= 180 THEN 'topology_provisioning_execution_stuck' WHEN (epoch_us(TS'{AS_OF}') - epoch_us(a.x.s)) / 1e6 - 10 >= 60 THEN 'topology_provisioning_execution_slow' END AS c,
  CASE t.x.z WHEN 'rolled_back' THEN 'topology_provisioning_latest_rolled_back' WHEN 'failed' THEN 'topology_provisioning_latest_failed' END AS h FROM a, t)
SELECT run_id, c AS current_code, h AS history_code, CASE WHEN c = 'topology_provisioning_execution_stuck' OR h = 'topology_provisioning_latest_failed' THEN 'critical' WHEN c IS NOT NULL OR h IS NOT NULL THEN 'warning' ELSE 'ok' END AS status FROM j""".replace("TS'", "TIMESTAMP '"))
def hp12_provisioning_health(s: Source) -> DataFrame:
    return control.provisioning_health(made(s, RUNS), as_of())


# ---- control ----------------------------------------------------------------------------------------


@query((), """
WITH s AS (SELECT s_suppkey AS resource, 'name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT resource, field, CASE WHEN field = 'nation' AND resource % 4 = 1 THEN 'moved' ELSE value END AS value FROM s""")
def cp2_migration_target(s: Source) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_suppkey").alias("resource"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation")).unpivot("resource", ["name", "nation"], "field", "value")
    overrides = rows.where("field = 'nation' and resource % 4 = 1").withColumn("value", F.lit("moved"))
    return health.overridden(rows, overrides)


JOURNAL = "SELECT user_id AS journal_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'prepared' WHEN 'click' THEN 'applying' WHEN 'view' THEN 'applied' WHEN 'purchase' THEN 'target_verified' ELSE 'failed' END AS state FROM events"


@query((), f"""
WITH j AS ({JOURNAL}), l AS (SELECT *, LAG(state) OVER (PARTITION BY journal_id ORDER BY ts) AS p FROM j)
SELECT event_id, p AS previous, state FROM l WHERE NOT (COALESCE((p IS NULL AND state = 'prepared') OR (p = 'prepared' AND state IN ('applying', 'target_verified', 'failed')) OR (p = 'applying' AND state IN ('applied', 'target_verified', 'failed')) OR (p = 'applied' AND state IN ('target_verified', 'failed')) OR (p = 'target_verified' AND state = 'failed'), false))""")
def cp4_illegal_transitions(s: Source) -> DataFrame:
    return health.illegal_transitions(made(s, JOURNAL), "journal_id", "ts", control.JOURNAL_STEPS).select("event_id", "previous", "state")


@query((), """SELECT s_suppkey, sha256('{"balance":"' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || '","name":"' || s_name || '"}') AS fingerprint FROM supplier""")
def cp5_fingerprints(s: Source) -> DataFrame:
    fields = F.create_map(F.lit("name"), F.col("s_name"), F.lit("balance"), F.floor("s_acctbal").cast("string"))
    return s.table("supplier").select("s_suppkey", control.canonical_fingerprint(fields).alias("fingerprint"))


@query(("outbox",), """
, o AS (SELECT *, aggregate_id % 3 AS tenant_id FROM outbox), q AS (SELECT event_id // 2 AS batch_id, event_id, user_id % 3 AS tenant_id FROM events),
b AS (SELECT batch_id FROM q LEFT JOIN o ON o.event_id = q.event_id AND o.tenant_id = q.tenant_id AND o.published_at IS NULL AND o.quarantined_at IS NULL AND o.claimed_until IS NULL AND o.attempt_count = 0 GROUP BY batch_id HAVING COUNT(*) = COUNT(o.event_id))
SELECT o.event_id, CASE WHEN EXISTS (SELECT 1 FROM q JOIN b USING (batch_id) WHERE q.event_id = o.event_id AND q.tenant_id = o.tenant_id) THEN 'tenant' ELSE 'shared' END AS delivery_route FROM o""")
def cp7_staged_events(s: Source) -> DataFrame:
    outbox = s.relation("outbox").withColumn("tenant_id", F.col("aggregate_id") % 3)
    requests = s.table("events").select(F.expr("event_id div 2").alias("batch_id"), "event_id", (F.col("user_id") % 3).alias("tenant_id"))
    return control.stage_events(requests, outbox).select("event_id", "delivery_route")


WEBHOOKS = "SELECT event_id AS delivery_id, user_id AS subscription_id, event_id % 10 AS event_id, event_id % 3 AS generation, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_flight' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'dead_letter' ELSE 'pending' END AS state, ts AS created_at, ts + INTERVAL '1' HOUR AS next_attempt_at, ts + INTERVAL '2' HOUR AS lease_expires_at FROM events"
SUBSCRIPTIONS = "SELECT user_id AS subscription_id, CASE WHEN user_id % 4 = 0 THEN 'paused' ELSE 'active' END AS state FROM events GROUP BY user_id"


@query((), f"""
WITH d AS ({WEBHOOKS}), s AS ({SUBSCRIPTIONS})
SELECT d.delivery_id, d.state = 'in_flight' AS recovered FROM d JOIN s USING (subscription_id) WHERE s.state = 'active' AND ((d.state = 'pending' AND next_attempt_at <= TIMESTAMP '{AS_OF}') OR (d.state = 'in_flight' AND lease_expires_at <= TIMESTAMP '{AS_OF}')) ORDER BY next_attempt_at, created_at, d.delivery_id LIMIT 1""")
def j15_next_delivery(s: Source) -> DataFrame:
    return control.claim_delivery(made(s, WEBHOOKS), made(s, SUBSCRIPTIONS), as_of()).select("delivery_id", "recovered")


@query((), f"""
WITH d AS ({WEBHOOKS}), s AS ({SUBSCRIPTIONS}), g AS (SELECT subscription_id, event_id, COALESCE(MAX(generation), -1) + 1 AS n FROM d GROUP BY ALL), q AS (SELECT o_orderkey AS delivery_id FROM orders)
, j AS (SELECT q.delivery_id, g.n, CASE WHEN d.state IS NULL THEN 'delivery_not_found' WHEN d.state NOT IN ('succeeded', 'dead_letter') THEN 'delivery_not_ended' WHEN s.state <> 'active' THEN 'subscription_not_active' END AS reason FROM q LEFT JOIN d USING (delivery_id) LEFT JOIN g ON g.subscription_id = d.subscription_id AND g.event_id = d.event_id LEFT JOIN s ON s.subscription_id = d.subscription_id)
SELECT delivery_id AS request_id, reason, CASE WHEN reason IS NULL THEN n END AS generation FROM j""")
def a14_replay_generations(s: Source) -> DataFrame:
    requests = made(s, "SELECT o_orderkey AS request_id, o_orderkey AS delivery_id FROM orders")
    return control.replay_deliveries(requests, made(s, WEBHOOKS), made(s, SUBSCRIPTIONS))


RETRY_AFTER = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id * 37 AS VARCHAR(20)) WHEN 1 THEN ' 5 ' WHEN 2 THEN 'Wed, 31 Jan 2024 00:10:00 GMT' WHEN 3 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' WHEN 4 THEN 'soon' ELSE '' END AS v FROM events"


@query((), "SELECT event_id, CASE event_id % 6 WHEN 0 THEN LEAST(event_id * 37, 86400) WHEN 1 THEN 5 WHEN 2 THEN 600 WHEN 3 THEN 0 END AS seconds FROM events")
def cp9_retry_after(s: Source) -> DataFrame:
    return made(s, RETRY_AFTER).select("event_id", control.retry_after(F.col("v"), as_of()).alias("seconds"))


@query((), "SELECT CAST(o_orderkey AS BIGINT) AS transaction_id, o_orderdate AS occurred_at FROM orders WHERE o_custkey % 5 = 2 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def t6_newest_transactions(s: Source) -> DataFrame:
    index = s.table("orders").select(F.col("o_orderkey").alias("transaction_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tenant_id"), F.col("o_orderdate").alias("occurred_at"))
    return control.transactions_of(index, "t2", ("t1", "t2"), 25).select("transaction_id", "occurred_at")


ACTIVATIONS = "SELECT c_custkey AS deployment_id, c_custkey % 3 AS tenant_id, c_custkey * 10 AS receipt_id FROM customer"
RECEIPTS = "SELECT c_custkey * 10 AS receipt_id, CASE WHEN c_custkey % 5 = 0 THEN 9 ELSE c_custkey % 3 END AS tenant_id FROM customer"


@query((), "SELECT c_custkey AS deployment_id, c_custkey % 3 AS tenant_id, CASE WHEN c_custkey % 4 = 0 THEN 7 ELSE c_custkey * 10 END AS receipt_id, c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS accepted FROM customer WHERE c_custkey > 0")
def j16_rollouts(s: Source) -> DataFrame:
    requests = made(s, "SELECT c_custkey AS deployment_id, c_custkey % 3 AS tenant_id, CASE WHEN c_custkey % 4 = 0 THEN 7 ELSE c_custkey * 10 END AS receipt_id FROM customer WHERE c_custkey > 0")
    return control.begin_rollouts(requests, made(s, ACTIVATIONS), made(s, RECEIPTS))


# ---- probes -----------------------------------------------------------------------------------------


@query((), """
WITH p AS (SELECT user_id AS canary_id, MIN(ts) AS started_at FROM events WHERE event_type = 'signup' GROUP BY user_id), b AS (SELECT user_id AS canary_id, MIN(ts) AS published_at, MIN(ts) + INTERVAL '2' SECOND AS broker_at FROM events WHERE event_type = 'click' GROUP BY user_id),
i AS (SELECT user_id AS canary_id, MIN(ts) AS inbox_at FROM events WHERE event_type = 'view' GROUP BY user_id), j AS (SELECT user_id AS canary_id, MIN(ts) AS projected_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT canary_id, started_at, started_at + INTERVAL '30' SECOND AS deadline_at, published_at, broker_at, inbox_at, projected_at FROM p LEFT JOIN b USING (canary_id) LEFT JOIN i USING (canary_id) LEFT JOIN j USING (canary_id)""")
def c1_probe_times(s: Source) -> DataFrame:
    def of(kind: str, *names: str) -> DataFrame:
        return s.table("events").where(F.col("event_type") == kind).select(F.col("user_id").alias("canary_id"), *[F.col("ts").alias(n) for n in names])

    probes = control.start_probes(of("signup", "started_at"), 30).drop("outcome")
    broker = of("click", "published_at", "broker_at").withColumn("broker_at", F.col("broker_at") + F.make_dt_interval(secs=F.lit(2)))
    return control.read_probes(probes, broker, of("view", "inbox_at"), of("purchase", "projected_at")).select("canary_id", "started_at", "deadline_at", "published_at", "broker_at", "inbox_at", "projected_at")


TOLD = "SELECT user_id AS canary_id, ts AS at_, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome, 'ok' AS health_status, CASE WHEN event_id % 3 = 0 THEN 'canary_ack_timeout' END AS terminal_code FROM events"


@query((), f"""
WITH o AS ({TOLD}), f AS (SELECT canary_id, MIN(at_) AS t, arg_min(outcome, at_) AS outcome FROM o GROUP BY canary_id)
SELECT o.canary_id, o.at_ AS "at", CASE WHEN o.canary_id % 6 = 5 THEN 'unknown_probe' WHEN o.at_ = f.t THEN 'recorded' WHEN o.outcome = f.outcome THEN 'duplicate' ELSE 'conflict' END AS result FROM o JOIN f USING (canary_id)""")
def c2_recorded_outcomes(s: Source) -> DataFrame:
    probes = made(s, "SELECT DISTINCT user_id AS canary_id FROM events WHERE user_id % 6 <> 5")
    return control.record_outcomes(probes, made(s, TOLD).withColumnRenamed("at_", "at"))


@query((), """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'canary_publish_timeout' WHEN event_id % 5 = 0 THEN 'canary_ack_timeout' WHEN event_id % 3 = 0 THEN 'canary_durable_identity_mismatch' ELSE 'canary_incomplete' END AS code FROM events""")
def c4_terminal_codes(s: Source) -> DataFrame:
    n = F.col("event_id")
    codes = F.array_compact(F.array(F.when(n % 3 == 0, "canary_durable_identity_mismatch"), F.when(n % 5 == 0, "canary_ack_timeout"), F.when(n % 7 == 0, "canary_publish_timeout"), F.lit("else")))
    return s.table("events").select("event_id", control.terminal_code(n % 4 == 0, codes).alias("code"))


# ---- sources ----------------------------------------------------------------------------------------


@query((), """
WITH v AS (SELECT p_partkey, p_brand || ' | ' || CASE WHEN p_size % 3 = 0 THEN 'UnKnown' ELSE p_type END || '||' || p_name AS v FROM part)
SELECT p_partkey, CASE WHEN split_part(v, ' | ', 2) LIKE 'UnKnown%' THEN p_b || ';' || p_n ELSE p_b || ';' || p_t || ';' || p_n END AS kept FROM (SELECT v.p_partkey, v, p_brand AS p_b, p_type AS p_t, p_name AS p_n FROM v JOIN part USING (p_partkey))""")
def s3_multivalues(s: Source) -> DataFrame:
    value = F.concat("p_brand", F.lit(" | "), F.when(F.col("p_size") % 3 == 0, "UnKnown").otherwise(F.col("p_type")), F.lit("||"), "p_name")
    return s.table("part").select("p_partkey", F.array_join(text.split_pipe(value, keep_unknown=False), ";").alias("kept"))


@query((), """
WITH w AS (SELECT GREATEST(8, MAX(length(CAST(r_regionkey AS VARCHAR)))) AS a, GREATEST(6, MAX(length(r_name))) AS b FROM region)
SELECT 0 AS place, rpad('R_REGIONKEY', GREATEST(a, 11)::INT, ' ') || '  ' || rpad('R_NAME', b::INT, ' ') AS line FROM w UNION ALL SELECT 1, repeat('-', GREATEST(a, 11)) || '  ' || repeat('-', b) FROM w
UNION ALL SELECT 2, rpad(CAST(r_regionkey AS VARCHAR), GREATEST(a, 11)::INT, ' ') || '  ' || rpad(r_name, b::INT, ' ') FROM region, w""")
def s13_aligned_table(s: Source) -> DataFrame:
    return exposition.aligned(s.table("region").select("r_regionkey", "r_name"))


@query((), """
SELECT '{"balance":' || CAST(floor(s_acctbal) AS BIGINT) || ',"name":"' || s_name || '"}' AS line FROM supplier UNION ALL SELECT s_name || chr(9) || CAST(floor(s_acctbal) AS BIGINT) FROM supplier UNION ALL SELECT '| ' || s_name || ' | ' || CAST(floor(s_acctbal) AS BIGINT) || ' |' FROM supplier""")
def s13_rendered_lines(s: Source) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_name").alias("name"), F.floor("s_acctbal").alias("balance"))
    return exposition.json_lines(rows.select("balance", "name")).unionByName(exposition.tsv(rows)).unionByName(exposition.markdown(rows))


@query((), """
SELECT n_name AS name, n_regionkey AS region, 'missing' AS change FROM nation WHERE n_nationkey % 6 = 1 UNION ALL SELECT n_name || '!', n_regionkey, 'unexpected' FROM nation WHERE n_nationkey % 9 = 4 UNION ALL SELECT n_name, n_regionkey, 'missing' FROM nation WHERE n_nationkey % 9 = 4 AND n_nationkey % 6 <> 1""")
def s15_stale_view(s: Source) -> DataFrame:
    now = s.table("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), "n_nationkey")
    renamed = now.withColumn("name", F.when(F.col("n_nationkey") % 9 == 4, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return exposition.stale(now.drop("n_nationkey"), renamed.where("n_nationkey % 6 <> 1 or n_nationkey % 9 = 4").drop("n_nationkey"))


@query((), """SELECT 'r' || r_regionkey AS id, r_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS tags, '2024-01-0' || (r_regionkey + 1) AS since FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def s1_yaml_records(s: Source) -> DataFrame:
    """Records written as YAML files, one each, and read again."""
    folder = f"{shared_folder(s.spark)}/yaml-{uuid.uuid4().hex}"
    tags = F.array_join(F.sort_array(F.collect_list("n_name")), ", ")
    rows = s.table("region").join(s.table("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(tags.alias("tags"))
    lines = F.concat(F.lit("id: r"), F.col("r_regionkey").cast("string"), F.lit("\nname: "), "r_name", F.lit("\nsince: 2024-01-0"), (F.col("r_regionkey") + 1).cast("string"), F.lit("\ntags: ["), "tags", F.lit("]"))
    rows.select(lines.alias("value"), F.col("r_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(folder)
    found = records.read_yaml(s.spark, f"{folder}/part=*/*.txt", "id string, name string, since string, tags array<string>")
    return found.select("id", "name", F.array_join("tags", ",").alias("tags"), "since")


@query((), "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE 'a;b c' END AS tags FROM supplier")
def s2_delimited_records(s: Source) -> DataFrame:
    folder = f"{shared_folder(s.spark)}/csv-{uuid.uuid4().hex}"
    tags = F.when(F.col("s_suppkey") % 3 == 0, " a | unknown").otherwise("a|b c||")
    s.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), tags.alias("tags")).write.csv(folder, header=True)
    found = records.read_delimited(s.spark, folder, "id long, name string, tags string", ("tags",), keep_unknown=False)
    return found.select("id", "name", F.array_join("tags", ";").alias("tags"))


@query((), """
WITH t AS (SELECT n_nationkey AS k, '{"position_id":"p' || n_nationkey || '"' || CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE ',"version":' || n_regionkey END || CASE WHEN n_nationkey % 5 = 2 THEN ',"more":1' ELSE '' END || '}' AS text FROM nation)
SELECT sha256(text || chr(10)) AS sha256, 'p' || k AS position_id, CASE WHEN k % 4 = 1 OR k % 5 = 2 THEN 'unexpected_keys' END AS rejected FROM t""")
def s5_snapshot_artifacts(s: Source) -> DataFrame:
    folder, n = f"{shared_folder(s.spark)}/snapshots-{uuid.uuid4().hex}", F.col("n_nationkey")
    told = F.concat(F.lit('{"position_id":"p'), n.cast("string"), F.lit('"'), F.when(n % 4 == 1, "").otherwise(F.concat(F.lit(',"version":'), F.col("n_regionkey").cast("string"))), F.when(n % 5 == 2, ',"more":1').otherwise(""), F.lit("}"))
    s.table("nation").select(told.alias("value"), n.alias("part")).repartition("part").write.partitionBy("part").text(folder)
    return records.read_snapshots(s.spark, f"{folder}/part=*/*.txt", ("position_id", "version")).select("sha256", "position_id", "rejected")


_SECRET = b"a secret of the subscription"
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in _SECRET.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query((), f"SELECT event_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(event_id || '.1700000000.' || props)))) AS signature FROM events")
def s11_webhook_signatures(s: Source) -> DataFrame:
    return s.table("events").select("event_id", records.signature(_SECRET, F.col("event_id").cast("string"), F.lit("1700000000"), F.col("props")).alias("signature"))


@query(("failures",), """
, c AS (SELECT consumer_name FROM failures WHERE status IN ('deferred', 'quarantined') GROUP BY consumer_name), w AS (SELECT consumer_name FROM c WHERE consumer_name <> 'audit')
SELECT consumer_name, 'states_differ_from_backlog' AS rule FROM w UNION ALL SELECT consumer_name, 'attempts_differ_from_backlog' FROM w UNION ALL SELECT consumer_name, 'quarantined_age_differs_from_count' FROM w""")
def hp13_snapshot_errors(s: Source) -> DataFrame:
    """Snapshots as they are have no errors; those of all consumers but one are spoilt first."""
    found = telemetry.failures(s.relation("failures"), as_of(), ("consumer_name",))
    spoilt = found.where("consumer_name <> 'audit'").withColumn("backlog_count", F.col("backlog_count") + 1).withColumn("oldest_quarantined_age_seconds", F.when(F.col("quarantined_count") == 0, 1.0))
    return telemetry.snapshot_errors(found, "consumer_name").unionByName(telemetry.snapshot_errors(spoilt, "consumer_name"))


ROLLOUTS = "SELECT user_id % 3 AS tenant_id, user_id % 3 AS deployment_id, CASE user_id % 3 WHEN 0 THEN 'active' ELSE 'paused' END AS phase, 7 AS generation_id FROM events GROUP BY user_id % 3"


@query((), f"WITH r AS ({ROLLOUTS}), q AS (SELECT DISTINCT user_id % 4 AS tenant_id FROM events) SELECT q.tenant_id AS deployment_id, q.tenant_id, COALESCE(phase = 'active', false) AS paused FROM q LEFT JOIN r ON r.tenant_id = q.tenant_id")
def cp7_pauses(s: Source) -> DataFrame:
    return control.pause_rollouts(made(s, "SELECT DISTINCT user_id % 4 AS deployment_id, user_id % 4 AS tenant_id FROM events"), made(s, ROLLOUTS))


STEPS = "SELECT user_id % 3 AS deployment_id, CASE WHEN event_id % 12 = 5 THEN 6 ELSE 7 END AS generation_id, event_id, 'staged' AS action FROM events UNION ALL SELECT user_id % 3, 7, event_id, 'reverted' FROM events WHERE event_id % 10 = 3"


@query(("outbox",), f"""
, r AS ({ROLLOUTS}), q AS (SELECT event_id // 2 AS batch_id, event_id, user_id % 3 AS t FROM events), o AS (SELECT event_id, aggregate_id % 3 AS t FROM outbox WHERE event_id % 9 <> 4 AND published_at IS NULL AND quarantined_at IS NULL AND claimed_until IS NULL AND attempt_count = 0)
SELECT batch_id, CASE WHEN bool_or(q.t = 0) THEN 'not_paused' WHEN COUNT(*) FILTER (WHERE o.event_id IS NOT NULL AND q.event_id % 12 <> 5 AND q.event_id % 10 <> 3) <> COUNT(*) THEN 'not_entirely_eligible' END AS reason FROM q LEFT JOIN o ON o.event_id = q.event_id AND o.t = q.t GROUP BY batch_id""")
def cp7_rollbacks(s: Source) -> DataFrame:
    outbox = s.relation("outbox").withColumn("tenant_id", F.col("aggregate_id") % 3).withColumn("delivery_route", F.when(F.col("event_id") % 9 != 4, "tenant").otherwise("shared"))
    requests = s.table("events").select(F.expr("event_id div 2").alias("batch_id"), (F.col("user_id") % 3).alias("deployment_id"), (F.col("user_id") % 3).alias("tenant_id"), "event_id")
    return control.rollback_batches(requests, outbox, made(s, ROLLOUTS), made(s, STEPS))
