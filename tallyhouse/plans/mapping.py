"""Domain relations out of the supplied star schema, as SQL that Spark and the oracle both read.

``TS'...'`` stands for a time-zone-free timestamp literal.  The operators get these
relations as DataFrames; their oracle SQL gets the same text as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.storage import stored

AS_OF = "2024-01-31 00:00:00"
HOLD_AS_OF = "2024-01-15 00:00:00"

#: name -> (what it is built from, SQL)
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "positions": (("lineitem", "supplier"), """
        SELECT CAST(s_nationkey % 3 AS INT) AS tenant_id, s_nationkey AS warehouse_id, l_suppkey AS location_id, l_partkey AS item_id, CAST(l_partkey % 5 AS INT) AS owner_id,
               l_returnflag AS condition_id, NULLIF(l_linenumber % 3, 0) AS lot_id, NULLIF(CAST(l_partkey % 4 AS INT), 0) AS stock_scope_id, NULLIF(CAST(l_partkey % 2 AS INT), 0) AS attribute_set_id, CAST(NULL AS INT) AS stock_segment_id,
               concat(CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', l_returnflag, '-', CAST(l_linenumber % 3 AS VARCHAR(20))) AS position_id,
               CAST(SUM(l_quantity) AS DECIMAL(24,6)) AS physical_qty,
               CAST(SUM(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN FLOOR(l_quantity / 4) ELSE 0 END) AS DECIMAL(24,6)) AS reserved_qty,
               CAST(SUM(CASE WHEN l_linestatus = 'F' THEN FLOOR(l_quantity / 2) ELSE 0 END) AS DECIMAL(24,6)) AS allocated_qty
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        GROUP BY s_nationkey, l_suppkey, l_partkey, l_returnflag, l_linenumber % 3"""),
    "reservations": (("lineitem", "supplier", "orders"), """
        SELECT CAST(s_nationkey % 3 AS INT) AS tenant_id, s_nationkey AS warehouse_id, l_partkey AS item_id, CAST(l_partkey % 5 AS INT) AS owner_id, l_returnflag AS condition_id,
               NULLIF(l_linenumber % 3, 0) AS lot_id, NULLIF(CAST(l_partkey % 4 AS INT), 0) AS stock_scope_id, NULLIF(CAST(l_partkey % 2 AS INT), 0) AS attribute_set_id, CAST(NULL AS INT) AS stock_segment_id,
               o_orderkey AS demand_id, CAST(l_quantity AS DECIMAL(24,6)) AS quantity, CAST(FLOOR(l_quantity / 8) AS DECIMAL(24,6)) AS allocated_qty, CAST(FLOOR(l_quantity / 5) AS DECIMAL(24,6)) AS consumed_qty, CAST(FLOOR(l_quantity / 10) AS DECIMAL(24,6)) AS released_qty
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"""),
    "hold_policies": (("region",), """
        SELECT r_regionkey AS policy_id, r_regionkey % 2 = 0 AS blocks_allocation, r_regionkey % 3 = 0 AS blocks_movement, r_regionkey >= 3 AS blocks_picking, r_regionkey <> 1 AS blocks_shipping FROM region"""),
    "holds": (("lineitem", "supplier"), """
        SELECT DISTINCT concat('scope-', CAST(item_id AS VARCHAR(20)), '-', CAST(warehouse_id AS VARCHAR(20)), '-', condition_id, '-', CAST(COALESCE(lot_id, 0) AS VARCHAR(20))) AS hold_id, CAST(item_id % 5 AS INT) AS policy_id, CAST(NULL AS VARCHAR(60)) AS position_id,
               tenant_id, warehouse_id, item_id, owner_id, condition_id, lot_id, stock_scope_id, attribute_set_id, stock_segment_id,
               TS'2024-01-01 00:00:00' + (item_id % 20) * INTERVAL '1' DAY AS starts_at,
               CASE WHEN item_id % 4 <> 0 THEN TS'2024-01-01 00:00:00' + (item_id % 20 + 12) * INTERVAL '1' DAY END AS expires_at,
               CASE WHEN item_id % 22 = 0 THEN TS'2024-01-10 00:00:00' END AS released_at
        FROM positions WHERE item_id % 11 = 0
        UNION ALL
        SELECT concat('position-', position_id), CAST(location_id % 5 AS INT), position_id, tenant_id, warehouse_id, item_id, owner_id, condition_id, lot_id, stock_scope_id, attribute_set_id, stock_segment_id,
               TS'2024-01-02 00:00:00', CASE WHEN item_id % 2 = 0 THEN TS'2024-01-15 00:00:00' END, CAST(NULL AS TIMESTAMP)
        FROM positions WHERE location_id % 13 = 0"""),
    "legs": (("lineitem",), """
        SELECT l_orderkey AS transaction_id, l_linenumber AS line, l_shipdate AS posted_on, l_suppkey AS location_id, l_partkey AS item_id, CAST(-l_quantity AS DECIMAL(24,6)) AS physical_delta FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_shipdate, (l_suppkey * 7) % 100, l_partkey, CAST(CASE WHEN l_partkey % 97 = 0 THEN l_quantity - 1 ELSE l_quantity END AS DECIMAL(24,6)) FROM lineitem"""),
    "works": (("orders",), """
        SELECT o_orderkey AS work_id, o_orderstatus AS tenant_id, CAST(o_custkey % 10 AS INT) AS warehouse_id, CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, NULLIF(o_custkey % 7, 0) AS due_at, o_orderdate AS created_at,
               CASE o_orderkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'assigned' ELSE 'released' END AS state FROM orders"""),
    "assignments": (("lineitem",), """
        SELECT l_orderkey AS work_id, l_suppkey AS resource_id, CASE WHEN l_partkey % 3 = 0 THEN 'active' ELSE 'released' END AS state FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'"""),
    "tasks": (("lineitem",), """
        SELECT l_orderkey AS work_id, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS task_id, l_linenumber AS sequence,
               CASE l_partkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'ready' WHEN 2 THEN 'pending' ELSE 'cancelled' END AS state FROM lineitem"""),
    "handling_units": (("part",), """
        SELECT p_partkey AS unit_id, CASE WHEN p_partkey > 0 THEN CAST(FLOOR((p_partkey - 1) / 3) AS BIGINT) END AS parent_id, p_size AS size FROM part"""),
    "outbox": (("events",), """
        SELECT event_id, user_id AS aggregate_id, event_type, ts AS recorded_at, CAST(event_id % 7 AS INT) AS attempt_count, 'shared' AS delivery_route,
               CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN ts + INTERVAL '1' HOUR END AS quarantined_at,
               CASE WHEN event_id % 5 = 1 THEN TS'2024-01-30 23:00:00' + (event_id % 3) * INTERVAL '1' HOUR END AS claimed_until,
               CASE WHEN event_id % 5 = 2 THEN TS'2024-01-31 00:30:00' ELSE ts END AS available_at,
               CASE WHEN event_id % 4 = 0 AND NOT (event_type = 'error' AND event_id % 10 = 0) THEN ts + INTERVAL '5' MINUTE END AS published_at
        FROM events WHERE event_type <> 'purchase'"""),
    "versioned": (("events",), """
        SELECT event_id, position_id, version, ts AS recorded_at, delta FROM (
          SELECT event_id, user_id AS position_id, ts, CAST(value AS DECIMAL(24,6)) AS delta, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM events) v
        WHERE event_id % 37 <> 5"""),
    "outcomes": (("events",), """
        SELECT event_id AS canary_id, ts AS started_at, ts + INTERVAL '30' SECOND AS deadline_at,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 6 = 0 THEN 'pending' ELSE 'succeeded' END AS outcome,
               CASE WHEN NOT (event_type = 'signup' AND event_id % 6 = 0) THEN ts + INTERVAL '20' SECOND END AS finalized_at,
               CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'outbox_publish_timeout' WHEN 1 THEN 'inbox_delivery_timeout' ELSE 'projection_timeout' END END AS terminal_code,
               event_id % 50 = 0 AS clock_skew_detected, value / 200 AS publish_seconds, (value - 2) / 100 AS delivery_seconds, CASE WHEN event_id % 9 <> 0 THEN value / 300 END AS projection_seconds, value / 60 AS end_to_end_seconds
        FROM events"""),
    "failures": (("events",), """
        SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'audit' WHEN 1 THEN 'billing' WHEN 2 THEN 'position-projector' ELSE 'work-projector' END AS consumer_name, CASE WHEN event_id % 9 < 3 THEN 'resolved' WHEN event_id % 9 < 7 THEN 'deferred' ELSE 'quarantined' END AS status,
               event_id % 2 = 0 AS retryable, CAST(event_id % 6 AS INT) AS attempt_count, ts AS first_failed_at, ts + INTERVAL '1' HOUR AS last_failed_at, CASE WHEN event_id % 9 >= 7 THEN ts + INTERVAL '2' HOUR END AS quarantined_at,
               CASE WHEN event_id % 9 < 3 THEN ts + INTERVAL '3' HOUR END AS resolved_at,
               CASE WHEN event_id % 5 = 1 THEN TS'2024-01-30 23:00:00' + (event_id % 3) * INTERVAL '1' HOUR END AS claimed_until, CASE WHEN event_id % 5 = 2 THEN TS'2024-01-31 00:30:00' ELSE ts END AS available_at
        FROM events WHERE event_type IN ('error', 'click')"""),
    "poison": (("events",), """
        SELECT event_id AS stream_sequence, CASE user_id % 4 WHEN 0 THEN 'audit' WHEN 1 THEN 'billing' WHEN 2 THEN 'position-projector' ELSE 'work-projector' END AS consumer_name, CAST(1 + event_id % 4 AS BIGINT) AS observation_count, ts AS first_seen_at, ts + (event_id % 4) * INTERVAL '1' HOUR AS last_seen_at,
               CASE event_id % 5 WHEN 0 THEN 'invalid_message_encoding' WHEN 1 THEN 'invalid_message_json' WHEN 2 THEN 'invalid_event_envelope' WHEN 3 THEN 'invalid_transport_headers' ELSE 'payload_too_large' END AS failure_code
        FROM events WHERE event_id % 8 = 3"""),
    "companies": (("supplier", "nation", "region"), """
        SELECT s_suppkey AS company_id, s_name AS name, n_name AS country, r_name AS market, CASE WHEN s_acctbal < 0 THEN 'unverified' WHEN s_acctbal < 5000 THEN 'partial' ELSE 'verified' END AS status
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""),
    "offers": (("lineitem", "part"), """
        SELECT DISTINCT l_suppkey AS company_id, p_partkey AS product_id, p_brand AS category, p_type AS layer FROM lineitem JOIN part ON p_partkey = l_partkey"""),
}
BASED_ON = {"holds": ("positions",)}
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents")


def dialect(sql: str, spark: bool) -> str:
    sql = re.sub(r"\bTS'", "TIMESTAMP_NTZ'" if spark else "TIMESTAMP '", sql)
    if spark:
        sql = re.sub(r"VARCHAR\(\d+\)", "STRING", sql).replace("CAST(NULL AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP_NTZ)")
    return sql


class Source:
    """The supplied tables of one folder, and the domain relations made of them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._shared: dict[str, DataFrame] = {}

    def share(self, *names: str) -> Source:
        """Make relations once, for all that reads them or is built on them."""
        for name in (n for n in names if n not in self._shared):
            self._shared[name] = stored(self.relation(name), f"relation-{name}", compression="zstd")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def relation(self, name: str) -> DataFrame:
        if name in self._shared:
            return self._shared[name]
        bases, sql = RELATIONS[name]
        needs = {b: self.table(b) for b in bases if re.search(rf"\b(?:FROM|JOIN) {b}\b", sql)} | {b: self.relation(b) for b in BASED_ON.get(name, ())}
        for b in needs:
            sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
        return self.spark.sql(dialect(sql, True), **needs)


def with_relations(names: tuple[str, ...], body: str, recursive: bool = False) -> str:
    """Oracle SQL: ``body`` after common table expressions for the relations; ``body`` may go on with ``, name AS (...)``."""
    order: list[str] = []
    for n in names:
        order += [b for b in BASED_ON.get(n, ()) if b not in order]
        if n not in order:
            order.append(n)
    ctes = ",\n".join(f"{n} AS ({dialect(RELATIONS[n][1], False)})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{dialect(body, False)}"
