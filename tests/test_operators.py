from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import availability, health, knowledge, ledger, pipeline, projection, quality, replay, telemetry
from tallyhouse.operators.availability import SCOPE

T0 = datetime(2024, 1, 1)
SCOPE_TYPES = "tenant_id int, warehouse_id int, item_id int, owner_id int, condition_id string, lot_id int, stock_scope_id int, attribute_set_id int, stock_segment_id int"
KEY = (1, 1, 1, 1, "A", None, None, None, None)
HELD = (1, 1, 2, 1, "A", None, 5, None, None)


def at(moment: datetime):
    return F.lit(moment).cast("timestamp_ntz")


def q(x) -> Decimal:
    return Decimal(x).quantize(Decimal("0.000001"))


def stock(spark):
    kinds = f"position_id string, location_id int, {SCOPE_TYPES}, physical_qty decimal(24,6), reserved_qty decimal(24,6), allocated_qty decimal(24,6)"
    rows = [("p1", 1, *KEY, q(10), q(0), q(4)), ("p2", 2, *KEY, q(5), q(1), q(0)), ("p3", None, *HELD, q(7), q(0), q(0)), ("p4", 4, *HELD, q(2), q(0), q(0))]
    return spark.createDataFrame(rows, kinds)


def claims(spark, rows=((*KEY, q(6), q(4), q(0), q(0)),)):
    return spark.createDataFrame(list(rows), f"{SCOPE_TYPES}, quantity decimal(24,6), allocated_qty decimal(24,6), consumed_qty decimal(24,6), released_qty decimal(24,6)")


def holds(spark, rows):
    return spark.createDataFrame(rows, f"hold_id string, policy_id int, position_id string, {SCOPE_TYPES}, starts_at timestamp_ntz, expires_at timestamp_ntz, released_at timestamp_ntz")


def policies(spark):
    return spark.createDataFrame([(1, True, False, False, True)], "policy_id int, blocks_allocation boolean, blocks_movement boolean, blocks_picking boolean, blocks_shipping boolean")


def available(spark, hold_rows, moment=T0, reservations=None):
    found = availability.scope_availability(stock(spark), reservations if reservations is not None else claims(spark), holds(spark, hold_rows), policies(spark), at(moment))
    return {r["item_id"]: r for r in found.collect()}


def test_availability_with_null_scope_keys(spark):
    found = available(spark, [])
    assert found[1]["available_qty"] == q(8)  # (10 - 4) + (5 - 1) - 2
    assert found[1]["coarse_reserved_qty"] == q(2)
    assert found[2]["available_qty"] == q(9)


def test_position_hold_keeps_totals_but_not_availability(spark):
    found = available(spark, [("h", 1, "p3", *HELD, T0, None, None)])
    assert (found[2]["physical_qty"], found[2]["available_qty"]) == (q(9), q(2))


def test_scope_hold_matches_nulls_and_is_half_open(spark):
    until = T0 + timedelta(days=1)
    rows = [("h", 1, None, *HELD, T0, until, None)]
    assert available(spark, rows)[2]["available_qty"] == q(0)
    assert available(spark, rows, until)[2]["available_qty"] == q(9)
    assert available(spark, rows, T0 - timedelta(seconds=1))[2]["available_qty"] == q(9)
    assert available(spark, [("h", 1, None, *HELD, T0, None, T0)])[2]["available_qty"] == q(9)


def test_availability_is_clamped_for_the_scope(spark):
    assert available(spark, [], reservations=claims(spark, [(*KEY, q(50), q(0), q(0), q(0))]))[1]["available_qty"] == q(0)


def test_unknown_action_is_an_error(spark):
    with pytest.raises(ValueError):
        availability.with_eligibility(stock(spark), holds(spark, []), policies(spark), "counting", at(T0))


def test_candidates_put_null_locations_last(spark):
    found = availability.candidates(stock(spark), {"item_id": 2, "lot_id": None})
    assert [r["position_id"] for r in found.collect()] == ["p4", "p3"]


def test_golden_reservation_vector(spark):
    commands = [("r", "receipt", 10, None), ("v", "reserve", 6, None), ("a", "allocate", 4, "v"), ("x", "reserve", 5, None), ("d", "deallocate", None, "a"), ("b", "allocate", 7, "v")]
    rows = [(c, "s", k, None if n is None else q(n), ref, None, None, T0 + timedelta(seconds=i)) for i, (c, k, n, ref) in enumerate(commands)]
    kinds = "command_id string, scope string, kind string, quantity decimal(24,6), reference string, idempotency_key string, fingerprint string, recorded_at timestamp_ntz"
    found = {r["command_id"]: r for r in replay.replay_scopes(spark.createDataFrame(rows, kinds)).collect()}
    assert found["v"]["available"] == q(4) and found["a"]["available"] == q(4)
    assert found["x"]["reason"] == "insufficient_availability"
    assert found["d"]["accepted"] and found["b"]["reason"] == "exceeds_reservation"


def test_rejected_commands_do_not_use_up_their_key(spark):
    rows = [("1", "s", "reserve", q(5), None, "k", "f", T0), ("2", "s", "receipt", q(9), None, None, None, T0 + timedelta(1)), ("3", "s", "reserve", q(5), None, "k", "f", T0 + timedelta(2)), ("4", "s", "reserve", q(5), None, "k", "f", T0 + timedelta(3)), ("5", "s", "reserve", q(1), None, "k", "g", T0 + timedelta(4))]
    kinds = "command_id string, scope string, kind string, quantity decimal(24,6), reference string, idempotency_key string, fingerprint string, recorded_at timestamp_ntz"
    found = {r["command_id"]: r["reason"] for r in replay.replay_scopes(spark.createDataFrame(rows, kinds)).collect()}
    assert found == {"1": "insufficient_availability", "2": None, "3": None, "4": "replayed", "5": "idempotency_conflict"}


def test_work_replay_follows_the_state_machine(spark):
    steps = [
        ("release", None, "r", None), ("start", 1, "r", "not_executable"), ("claim", None, "r", None), ("start", 2, "r", "task_not_ready"), ("start", 1, "x", "not_the_assigned_resource"), ("start", 1, "r", None),
        ("cancel", None, "r", "execution_began"), ("raise", 1, "r", None), ("confirm", 1, "r", "no_live_execution"), ("resume", 1, "r", None), ("start", 1, "r", None), ("confirm", 1, "r", None), ("start", 2, "r", None), ("confirm", 2, "r", None), ("claim", None, "r", "not_released"),
    ]
    rows = [(1, i, c, task, 2, who, T0 + timedelta(seconds=i)) for i, (c, task, who, _) in enumerate(steps)] + [(2, 0, "cancel", None, 1, None, T0)]
    kinds = "work_id int, command_id int, command string, task int, tasks int, resource_id string, recorded_at timestamp_ntz"
    found = sorted(replay.replay_works(spark.createDataFrame(rows, kinds)).collect(), key=lambda r: (r["work_id"], r["command_id"]))
    assert [r["reason"] for r in found[:-1]] == [why for *_, why in steps]
    assert found[-2]["state"] == "completed" and found[-1]["state"] == "cancelled"


EVENT = "position_id long, version long, event_id long, recorded_at timestamp_ntz, delta decimal(24,6)"


def test_projection_applies_the_contiguous_prefix_in_any_order(spark):
    rows = [(1, v, 100 + v, T0, q(v)) for v in (1, 2, 4)] + [(2, 2, 7, T0, q(3)), (1, 2, 102, T0, q(2))]
    for own in (rows, rows[::-1]):
        found = {r["position_id"]: r for r in projection.apply_deltas(spark.createDataFrame(own, EVENT)).collect()}
        assert (found[1]["version"], found[1]["quantity"], found[1]["pending"], found[1]["first_pending_version"]) == (2, q(3), 1, 4)
        assert (found[2]["version"], found[2]["quantity"], found[2]["pending"]) == (0, q(0), 1)
    assert projection.conflicts(spark.createDataFrame([(1, 1, 5, T0, q(1)), (1, 1, 6, T0, q(1))], EVENT)).count() == 1


def test_rebuild_from_snapshot(spark):
    events = spark.createDataFrame([(1, 3, 3, T0, q(5)), (1, 4, 4, T0, q(0))], EVENT)
    base = spark.createDataFrame([(1, 3, q(10)), (9, 2, q(1))], "position_id long, version long, quantity decimal(24,6)")
    found = {r["position_id"]: r for r in projection.rebuild(events, base).collect()}
    assert (found[1]["version"], found[1]["quantity"], found[1]["superseded"], found[1]["drained"], found[1]["remaining"]) == (4, q(10), 1, 1, 0)
    assert (found[9]["version"], found[9]["quantity"], found[9]["drained"]) == (2, q(1), 0)


def test_service_levels_golden_numbers(spark):
    rows = [(i, T0, T0 + timedelta(seconds=60), "succeeded", T0 + timedelta(seconds=i), None, False, float(i), float(i), float(i), float(i)) for i in range(1, 9)]
    rows += [(9, T0, T0, "failed", T0 + timedelta(seconds=20), "x", False, None, None, None, None), (10, T0, T0 + timedelta(seconds=30), "pending", None, None, False, None, None, None, None)]
    kinds = "canary_id long, started_at timestamp_ntz, deadline_at timestamp_ntz, outcome string, finalized_at timestamp_ntz, terminal_code string, clock_skew_detected boolean, publish_seconds double, delivery_seconds double, projection_seconds double, end_to_end_seconds double"
    r = telemetry.service_levels(spark.createDataFrame(rows, kinds), at(T0 + timedelta(seconds=60)), (3600,), 0.999, 0.99, 5.0).first()
    assert (r["total_runs"], r["failed_runs"], r["latency_good_runs"], r["consecutive_failures"]) == (10, 2, 5, 2)
    assert r["availability_burn_rate"] == pytest.approx(200) and r["latency_burn_rate"] == pytest.approx(37.5)
    assert (r["end_to_end_p50"], r["end_to_end_p95"], r["end_to_end_p99"]) == pytest.approx((4.5, 7.65, 7.93))
    assert r["failure_codes"] == '{"canary_probe_abandoned":1,"x":1}'


def test_outbox_telemetry_partitions_and_empty(spark):
    t = T0
    kinds = "event_id int, recorded_at timestamp_ntz, attempt_count int, quarantined_at timestamp_ntz, claimed_until timestamp_ntz, available_at timestamp_ntz, published_at timestamp_ntz"
    ago = lambda s: t - timedelta(seconds=s)
    rows = [(1, ago(120), 0, None, None, ago(120), None), (2, ago(90), 1, None, None, ago(-30), None), (3, ago(60), 2, None, ago(-30), ago(60), None), (4, ago(300), 5, ago(40), None, ago(300), None), (5, ago(900), 0, None, None, ago(900), ago(1))]
    r = telemetry.outbox(spark.createDataFrame(rows, kinds), at(t)).first()
    assert [r[f"{x}_count"] for x in ("backlog", "ready", "delayed", "leased", "quarantined")] == [4, 1, 1, 1, 1]
    assert (r["oldest_backlog_age_seconds"], r["oldest_ready_age_seconds"], r["oldest_quarantined_age_seconds"]) == (300, 120, 40)
    later = telemetry.outbox(spark.createDataFrame(rows, kinds), at(t + timedelta(seconds=31))).first()
    assert [later[f"{x}_count"] for x in ("ready", "delayed", "leased", "quarantined")] == [3, 0, 0, 1]
    empty = telemetry.outbox(spark.createDataFrame([], kinds), at(t)).first()
    assert empty["backlog_count"] == 0 and empty["oldest_ready_age_seconds"] is None
    assert health.evaluate(telemetry.outbox(spark.createDataFrame([], kinds), at(t)), health.OUTBOX).collect()[0]["status"] == "ok"


def test_retry_delay_matches_plain_python(spark):
    from hashlib import sha256

    def expected(event, n, base=5, most=3600, jitter=0.2, attempts=8):
        if n >= attempts:
            return None
        u = int.from_bytes(sha256(f"{event}:{n}".encode()).digest()[:8], "big") / ((1 << 64) - 1)
        return min(most, max(1, round(min(most, base * 2 ** (n - 1)) * (1 + jitter * (2 * u - 1)))))

    rows = [(f"e{i}", n) for i in range(40) for n in range(1, 10)]
    found = spark.createDataFrame(rows, "e string, n int").select("e", "n", pipeline.retry_delay(F.col("e"), F.col("n")).alias("d")).collect()
    assert all(r["d"] == expected(r["e"], r["n"]) for r in found)


def test_webhook_signature_is_hmac(spark):
    import hashlib
    import hmac

    from tallyhouse.sources.records import signature

    for secret in (b"key", b"k" * 100):
        found = spark.range(1).select(signature(secret, F.lit("id"), F.lit("17"), F.lit("{}")).alias("s")).first()["s"]
        assert found == hmac.new(secret, b"id.17.{}", hashlib.sha256).hexdigest()


def test_subject_filters(spark):
    cases = [("a.*.c", "a.b.c", True), ("a.*.c", "a.b.d.c", False), ("a.>", "a.b.c", True), ("a.>", "a", False), ("a.b", "axb", False)]
    df = spark.createDataFrame(cases, "p string, s string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", text.subject_matches(F.col("p"), F.col("s")).alias("got")).collect())


def test_text_filters(spark):
    df = spark.createDataFrame([(["a", "b"], " Foo_Bar  baz", "x | Unknown||y ")], "v array<string>, t string, p string")
    r = df.select(
        text.contains_all(F.col("v"), ["a"]).alias("a"), text.contains_all(F.lit(None).cast("array<string>"), []).alias("b"), text.contains_all(F.col("v"), ["c"]).alias("c"),
        text.normalized(F.col("t")).alias("n"), text.split_pipe(F.col("p"), keep_unknown=False).alias("s"), text.matches_terms(F.col("v"), ["A"]).alias("m"),
    ).first()
    assert r == (True, True, False, "foo-bar baz", ["x", "y"], True)


def test_knowledge_operators(spark):
    rows = [("b", "B", 2), ("a", "A", 1), ("b", "C", 0)]
    df = spark.createDataFrame(rows, "k string, v string, o int")
    assert knowledge.first_of_each(df, "o", "k").count() == 2
    assert [r["n"] for r in knowledge.counts_with_zeros(df, "k", ["b", "z"]).collect()] == [2, 0]
    entities = spark.createDataFrame([("r1", "Stock", [("e1", "bin", "a place", ["shelf"])]), ("r2", "Orders", [("e2", "wave", "a batch", [])])], "id string, title string, entities array<struct<id:string,term:string,definition:string,aliases:array<string>>>")
    assert [(r["id"], len(r["entities"])) for r in knowledge.ontology(entities, "SHELF").collect()] == [("r1", 1)]
    assert [(r["id"], len(r["entities"])) for r in knowledge.ontology(entities, "stock").collect()] == [("r1", 0)]
    lenses = spark.createDataFrame([({"x": "covered", "y": "not-applicable"},), ({"x": "missing"},), ({"x": "covered", "y": "missing"},)], "l map<string,string>")
    assert [r[0] for r in lenses.select(knowledge.rollup(F.col("l"))).collect()] == ["covered", "missing", "partial"]


def test_drift_and_transitions(spark):
    kinds = "resource string, field string, value string"
    expected = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2.0000001"), ("r", "c", None)], kinds)
    actual = spark.createDataFrame([("r", "a", "x"), ("r", "b", "2"), ("r", "c", None), ("r", "d", "9")], kinds)
    assert sorted(r["field"] for r in health.drift(expected, actual, {"b": 1e-6}).collect()) == ["a", "d"]
    journal = spark.createDataFrame([(1, 1, "new"), (1, 2, "done"), (1, 3, "new")], "id int, n int, state string")
    assert [r["n"] for r in health.illegal_transitions(journal, "id", "n", {None: ("new",), "new": ("done",)}).collect()] == [3]


def test_quality_findings(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (2, -1)], "id int, n int")
    found = quality.findings(quality.violations(rows, "id", {"positive": F.col("n") > 0}), quality.repeated(rows, "unique", "id"))
    assert sorted((r["key"], r["rule"]) for r in found.collect()) == [("2", "positive"), ("2", "positive"), ("2", "unique")]


def test_tree_and_counts(spark):
    units = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0)], "unit_id int, parent_id int")
    assert sorted((r["unit_id"], r["level"]) for r in ledger.descendants(units, units.where("unit_id = 0")).collect()) == [(0, 0), (1, 1), (2, 2), (3, 1)]


def test_scope_has_nine_columns():
    assert len(SCOPE) == 9
