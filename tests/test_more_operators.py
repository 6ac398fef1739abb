from __future__ import annotations

import re
import time
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import ranking, text
from tallyhouse.operators import commitments, ledger, quality, replay, technology, work
from tallyhouse.operators.availability import key_text
from tallyhouse.plans.mapping import Source
from tallyhouse.queries import QUERIES
from tallyhouse.queries_records import _technology
from tallyhouse.streaming import publish
from tests.oracle import FOLDER

T0 = datetime(2024, 1, 1)


def test_numbers_and_quantiles_of_groups_in_many_ranges(spark):
    rows = [(None if i % 3 == 0 else i % 3, i * 7 % 101, i) for i in range(101)] + [(7, None, 500)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(5)
    found = {(r["g"], r["id"]): r["n"] for r in ranking.numbered(df, ("g",), [F.desc("v"), F.col("id")], "n").collect()}
    for g in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [found[(g, r[2])] for r in own] == list(range(1, len(own) + 1))
    picked = {r["g"]: r for r in ranking.quantiles(df, ("g",), "v", {"a": 0.5, "b": 0.95}, nearest=True).collect()}
    assert set(picked) == {None, 1, 2}
    for g, r in picked.items():
        own = sorted(x[1] for x in rows if x[0] == g)
        assert (r["a"], r["b"]) == (own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1])
    between = ranking.quantiles(spark.createDataFrame([(1, float(x)) for x in (1, 1, 2, 10)], "g int, v double"), ("g",), "v", {"m": 0.5, "t": 0.9}).first()
    assert between["m"] == 1.5 and between["t"] == pytest.approx(7.6)


def test_endless_containers_are_an_error(spark):
    units = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "unit_id int, parent_id int")
    assert ledger.descendants(units, units.where("parent_id is null"), 3).count() == 4
    with pytest.raises(ValueError):
        ledger.descendants(units, units.where("parent_id is null"), 2)


def test_ontology_errors(spark):
    kinds = "registry string, kind string, entities array<struct<id:string,attributes:array<string>,examples:array<string>,parents:array<string>>>, relationships array<string>, evidence_refs array<string>"
    key = ("inventory-key", ["warehouse", "anchor", "item", "owner", "serial"], None, None)
    rows = [
        ("inventory-transaction", "x", [key, ("inventory-anchor", None, ["location"], None), ("serial-membership", None, None, ["inventory-key"])], [], []),
        ("process", "p", [("task-execution", None, None, None), ("other", None, None, None)], [], []),
    ]
    found = {(r["key"], r["rule"]) for r in quality.ontology_errors(spark.createDataFrame(rows, kinds)).collect()}
    assert found == {
        ("work", "ontology_missing"), ("inventory-transaction/condition", "key_attribute_missing"), ("inventory-transaction/serial", "key_attribute_forbidden"), ("inventory-transaction/inventory-anchor", "anchor_incomplete"),
        ("inventory-transaction/serial-membership", "serial_is_a_key"), ("process/task-execution", "execution_entity_in_process"),
    }
    work = [("work", "task", [(e, None, None, None) for e in quality.REQUIRED_WORK_ENTITIES[1:]], list(quality.REQUIRED_WORK_RELATIONSHIPS[:4]), ["a"]), ("inventory-transaction", "x", [], [], [])]
    found = {(r["key"], r["rule"]) for r in quality.ontology_errors(spark.createDataFrame(work, kinds)).collect()}
    assert {("work", "work_kind_differs"), ("work", "work_evidence_thin"), ("work/warehouse-work", "work_entity_missing"), ("work/task-execution may-produce task-exception", "work_relationship_missing")} <= found


def test_published_once(spark, tmp_path):
    kinds = "event_id string, b int, a string"
    for i, part in enumerate(([("e1", 1, "x"), ("e2", 2, None)], [("e2", 2, None), ("e3", 3, "z"), ("e3", 3, "z")])):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        publish.publish(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 + i
    lines = sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert lines == ['{"a":"x","b":1,"event_id":"e1"}', '{"a":"z","b":3,"event_id":"e3"}', '{"b":2,"event_id":"e2"}']


def test_searches_refuse_unknown_filters(spark):
    empty = spark.createDataFrame([], "kind string, id string, " + ", ".join(f"{f} array<string>" for f in technology.FILTERS) + ", dispositions array<string>, verification string, confidence string, n_gaps int")
    with pytest.raises(ValueError):
        technology.search(empty, vendor=("x",))
    with pytest.raises(ValueError):
        technology.page(empty, 0)
    assert technology.page(technology.search(empty, api=("x",), decision=("adopt",), research_gaps=True)).count() == 0


def test_flat_texts_of_nested_values(spark):
    df = spark.createDataFrame([(1, [("a", None), ("b", {"k": "v"})])], "n int, items array<struct<x:string,m:map<string,string>>>")
    found = df.select(text.flat(F.struct("n", "items"), df.select(F.struct("n", "items").alias("s")).schema["s"].dataType).alias("t")).first()["t"]
    assert found.split() == ["1", "a", "b", "v"]


def _work_tables(spark):
    works = spark.createDataFrame([(1, "in_progress"), (2, "assigned")], "work_id int, state string")
    tasks = [(1, 10, 1, "in_progress"), (1, 11, 2, "completed"), (1, 12, 3, "pending"), (1, 13, 4, "ready"), (2, 20, 1, "ready"), (2, 21, 1, "pending"), (2, 22, 2, "in_progress")]
    assignments = spark.createDataFrame([(1, 7, "active"), (2, 7, "active")], "work_id int, resource_id int, state string")
    executions = spark.createDataFrame([(10, 7, "in_progress"), (22, 7, "in_progress")], "task_id int, resource_id int, state string")
    return works, spark.createDataFrame([(*t, False) for t in tasks], "work_id int, task_id int, sequence int, state string, needs_ref boolean"), assignments, executions


def test_next_task_of_a_confirmation_is_the_task_s_own(spark):
    rows = [(1, "confirm", 1, 10, 7, "r"), (2, "confirm", 2, 22, 7, "r"), (3, "confirm", 1, 99, 7, "r"), (4, None, 1, 10, 7, "r"), (5, "start", 2, 20, 7, "r"), (6, "cancel", 9, None, 7, "r"), (6, "confirm", 1, 10, 7, "r")]
    commands = spark.createDataFrame(rows, "command_id int, command string, work_id int, task_id int, resource_id int, domain_ref string")
    judged = work.judge_commands(commands, *_work_tables(spark))
    found = sorted((tuple(r) for r in judged.collect()), key=str)
    assert found == sorted([
        (1, None, "in_progress", "completed", 12), (2, None, "completed", "completed", None), (3, "unknown_task", None, None, None), (4, None, "in_progress", None, None), (5, None, "in_progress", "in_progress", None),
        (6, "unknown_work", None, None, None), (6, None, "in_progress", "completed", 12),
    ], key=str)


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_work_commands_move_once(spark, shuffled_joins):
    """Commands lie by their work before they are expanded; only those on tasks go to their task."""
    plan = QUERIES["wk1_work_commands"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(command_id" not in plan
    assert plan.count("hashpartitioning(cast(task_id") + plan.count("hashpartitioning(task_id") <= 3


def test_composite_confirmations_judge_only_confirmations(spark, shuffled_joins):
    assert "LeftSemi" not in QUERIES["wk9_composite_confirmations"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_many_logs_are_read_as_one_stream(spark):
    """One task reads all its scopes; a scope's open reservations aren't summed anew at each command."""
    kinds = "command_id string, scope string, kind string, quantity decimal(24,6), reference string, idempotency_key string, fingerprint string, recorded_at timestamp_ntz"
    logs = [(None, 1), ("a", 2), ("b", 3), ("c", 0)]
    steps = [("receipt", 10, None), ("reserve", 4, None), ("reserve", 3, None), ("allocate", 2, "1"), ("release", None, "2"), ("deallocate", None, "3"), ("issue", 7, None), ("reserve", 1, None)]
    rows = [(str(i), scope, kind, None if n is None else Decimal(n), ref and str(ref), None, None, T0 + timedelta(seconds=i)) for scope, _ in logs for i, (kind, n, ref) in enumerate(steps)]
    found = replay.replay_scopes(spark.createDataFrame(rows, kinds).orderBy(F.rand(1)))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    told = {(r["scope"], int(r["command_id"])): (r["reason"], r["available"]) for r in found.collect()}
    expected = [(None, 10), (None, 6), (None, 3), (None, 3), (None, 6), (None, 6), ("strands_commitments", 6), (None, 5)]
    assert told == {(scope, i): e for scope, _ in logs for i, e in enumerate(expected)}
    works = spark.createDataFrame([(w, i, c, 1, n, None, T0) for w, n in ((None, 1), (1, 2)) for i, c in enumerate(("release", "claim", "start", "confirm"))], "work_id int, command_id int, command string, task int, tasks int, resource_id string, recorded_at timestamp_ntz")
    assert {(r["work_id"], r["state"]) for r in replay.replay_works(works).where("command = 'confirm'").collect()} == {(None, "completed"), (1, "in_progress")}
    state, n = replay.ScopeState(), 20_000
    state.apply("receipt", Decimal(n), "r", None)
    began = time.process_time()
    for i in range(n):
        assert state.apply("reserve", Decimal(1), str(i), None) is None
    assert state.available == 0 and time.process_time() - began < 5


def test_key_texts_are_equal_for_equal_keys_only(spark):
    values = [None, "", "/", "\\", "\\N", "a", "a/", "/a", "\\/", "\\\\N", "N"]
    df = spark.createDataFrame([(a, b) for a in values for b in values] * 2, "a string, b string")
    assert df.select(key_text(df, "a", "b").alias("k")).distinct().count() == len(values) ** 2


def test_positions_are_ensured_with_one_move_of_candidates(spark, shuffled_joins):
    kinds = "candidate_id string, tenant_id int, warehouse_id int, location_id int, item_id int, owner_id int, condition_id string, lot_id int, stock_scope_id int, attribute_set_id int, stock_segment_id int"
    key = (1, 1, 5, 2, 3, "g", None, None, 4, None)
    rows = [("b", *key), ("a", *key), ("k", *key[:5], "h", *key[6:]), ("x", 2, *key[1:]), ("n", None, *key[1:]), ("y", *key[:5], None, *key[6:]), ("z", *key[:5], None, *key[6:])]
    candidates, anchors = spark.createDataFrame(rows, kinds), spark.createDataFrame([(5, 1, 1), (5, 1, 1)], "location_id int, tenant_id int, warehouse_id int")
    positions = spark.createDataFrame([("p1", *key[:5], "h", *key[6:]), ("p2", *key[:5], "h", *key[6:])], kinds.replace("candidate_id", "position_id"))
    made = ledger.ensure_positions(candidates, positions, anchors)
    assert {r["candidate_id"]: (r["position_id"], r["outcome"]) for r in made.collect()} == {
        "a": ("a", "created"), "b": ("a", "existing"), "k": ("p1", "existing"), "x": (None, "unknown_anchor"), "n": (None, "unknown_anchor"), "y": ("y", "created"), "z": ("y", "existing"),
    }
    made = QUERIES["l1_positions"](spark, FOLDER)
    made.collect()
    moved = [line for line in made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if re.search(r"\bExchange hashpartitioning\(_key", line) and "ReusedExchange" not in line]
    assert len(moved) == 2


SCOPE_KINDS = "tenant_id int, warehouse_id int, item_id int, owner_id int, condition_id string, lot_id int, stock_scope_id int, attribute_set_id int, stock_segment_id int"
SCOPE_1, SCOPE_2 = (1, 1, 2, 3, "g", None, None, 4, None), (1, 1, 2, 3, "g", 1, None, 4, None)


def _stock(spark):
    rows = [("p1", *SCOPE_1, Decimal(10), Decimal(1), Decimal(2), True, True), ("p2", *SCOPE_1, Decimal(4), Decimal(0), Decimal(4), True, True), ("p3", *SCOPE_2, Decimal(9), Decimal(0), Decimal(0), True, True), ("p4", *SCOPE_1, Decimal(9), Decimal(0), Decimal(0), False, True)]
    return spark.createDataFrame(rows, f"position_id string, {SCOPE_KINDS}, physical_qty decimal(24,6), reserved_qty decimal(24,6), allocated_qty decimal(24,6), movement boolean, picking boolean")


def test_allocations_meet_only_what_they_need(spark, shuffled_joins):
    reservations = [("r1", *SCOPE_1, 7, Decimal(5), Decimal(0), Decimal(0), Decimal(0), None), ("r2", *SCOPE_2, 7, Decimal(5), Decimal(0), Decimal(0), Decimal(0), None), ("r3", *SCOPE_1, 7, Decimal(5), Decimal(0), Decimal(0), Decimal(0), T0), ("r4", *SCOPE_1, None, Decimal(50), Decimal(0), Decimal(0), Decimal(0), None)]
    reservations = spark.createDataFrame(reservations, f"reservation_id string, {SCOPE_KINDS}, demand_id int, quantity decimal(24,6), allocated_qty decimal(24,6), consumed_qty decimal(24,6), released_qty decimal(24,6), released_at timestamp_ntz")
    available = spark.createDataFrame([(*SCOPE_1, Decimal(2)), (*SCOPE_1, Decimal(3))], f"{SCOPE_KINDS}, available_qty decimal(24,6)")
    asked = {
        ("a", "p1", None, 7, 5): None, ("b", "p1", None, 7, 6): "consumes_reserved_capacity", ("c", "p2", None, 7, 1): "exceeds_free_quantity", ("d", "p3", None, 7, 1): "consumes_reserved_capacity", ("e", "p9", None, 7, 1): "unknown_position",
        ("f", "p1", "r1", 7, 5): None, ("g", "p1", "r2", 7, 5): "reservation_does_not_match", ("h", "p1", "r3", 7, 5): "reservation_released", ("i", "p1", "r9", 7, 5): "unknown_reservation", ("j", "p1", "r1", 8, 5): "reservation_does_not_match",
        ("k", "p1", "r1", 7, 6): "exceeds_reservation", ("l", "p2", "r1", 7, 1): "exceeds_free_quantity", ("m", "p1", "r4", None, 7): None, ("n", "p9", "r1", 7, 1): "unknown_position", ("o", "p1", "r4", 1, 7): "reservation_does_not_match",
    }
    requests = spark.createDataFrame([(*r[:4], Decimal(r[4])) for r in asked], "allocation_id string, position_id string, reservation_id string, demand_id int, quantity decimal(24,6)")
    judged = commitments.judge_allocations(requests, _stock(spark), reservations, available)
    assert {r["allocation_id"]: r["reason"] for r in judged.collect()} == {k[0]: why for k, why in asked.items()}
    assert {r["allocation_id"]: r["allocated_delta"] for r in judged.where("reason is null").collect()} == {k[0]: k[4] for k, why in asked.items() if why is None}


@pytest.mark.parametrize("filters", [
    {"decision": ("adopt",), "technology": ("Widget",), "source": ("nation 1",)}, {"api": ("economy",), "confidence": ("high", "medium")}, {"kinds": ("open-source",), "decision": ("adopt", "reject")}, {"company": ("supplier",), "decision": ("trial",)},
    {"verification": ("partial",), "research_gaps": True, "deployment": ("nation", "2")}, {"kinds": ("decision", "product"), "confidence": ("low",), "database": ("brand",)}, {},
])
def test_filters_come_before_links_and_find_the_same(spark, filters):
    tables = _technology(Source(spark, FOLDER))
    found = technology.find(**tables, **filters)
    assert sorted(map(tuple, found.select("kind", "id").collect())) == sorted(map(tuple, technology.search(technology.records(**tables), **filters).select("kind", "id").collect()))


def test_picks_and_movements_are_told_in_one_pass(spark, shuffled_joins):
    none = Decimal(0)
    allocations = spark.createDataFrame([("a1", "p1", Decimal(5), none, none, None), ("a2", "p2", Decimal(4), none, none, None), ("a3", "p1", Decimal(4), none, none, T0), ("a4", "p9", Decimal(4), none, none, None)], "allocation_id string, position_id string, quantity decimal(24,6), consumed_qty decimal(24,6), released_qty decimal(24,6), released_at timestamp_ntz")
    asked = {("1", "a1", "p2", 2): None, ("2", "a9", "p2", 2): "unknown_allocation", ("3", "a3", "p2", 2): "allocation_released", ("4", "a1", "p2", 6): "exceeds_allocation", ("5", "a4", "p2", 2): "unknown_position", ("6", "a1", "p8", 2): "unknown_position", ("7", "a1", "p3", 2): "other_stock_identity", ("8", "a1", "p4", 2): "not_eligible", ("9", "a1", "p2", 3): "source_cannot_satisfy", ("10", "a2", "p1", 4): None}
    requests = spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in asked], "pick_id string, allocation_id string, target_id string, quantity decimal(24,6)")
    judged = commitments.judge_picks(requests, allocations, _stock(spark))
    assert {r["pick_id"]: r["reason"] for r in judged.collect()} == {k[0]: why for k, why in asked.items()}
    told = {(r["pick_id"], r["position_id"], r["physical_delta"], r["allocated_delta"], r["reason"]) for r in commitments.pick_outcomes(judged).where("pick_id in ('1', '2', '3')").collect()}
    assert told == {("1", "p1", -2, -2, None), ("1", "p2", 2, 0, None), ("2", None, None, None, "unknown_allocation"), ("3", "p1", None, None, "allocation_released")}
    assert {tuple(r) for r in commitments.pick_legs(judged).where("pick_id = '10'").collect()} == {("10", "p2", -4, -4), ("10", "p1", 4, 0)}
    asked = {("1", "p1", "p2", 2): None, ("2", "p1", "p9", 2): "unknown_position", ("3", "p4", "p1", 2): "source_not_eligible", ("4", "p1", "p4", 2): "target_not_eligible", ("5", "p1", "p3", 99): "other_stock_identity", ("6", "p1", "p2", 11): "exceeds_physical", ("7", "p1", "p2", 9): "strands_commitments"}
    requests = spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in asked], "movement_id string, source_id string, target_id string, quantity decimal(24,6)")
    judged = ledger.judge_movements(requests, _stock(spark))
    assert {r["movement_id"]: r["reason"] for r in judged.collect()} == {k[0]: why for k, why in asked.items()}
    assert {tuple(r) for r in ledger.movement_legs(judged).collect()} == {("1", "p1", -2), ("1", "p2", 2)}
    assert ledger.movement_outcomes(judged).count() == 8


def test_serials_in_two_positions_are_seen_by_their_bounds(spark, shuffled_joins):
    members = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("t", 1, 5), ("t", 1, 5), ("u", None, 5), ("u", 1, 5)], "serial_id string, position_id int, item_id int")
    found = ledger.serial_errors(members, spark.createDataFrame([(1, 5), (2, 5)], "position_id int, item_id int"), spark.createDataFrame([(5, True)], "item_id int, exact boolean"))
    assert "hashpartitioning(serial_id#" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\(serial_id#\d+, position_id", plan)
    assert {tuple(r) for r in found.collect()} == {("s", 1, "in_two_positions"), ("s", 2, "in_two_positions"), ("u", None, "item_differs")}


def test_availability_meets_in_one_grouping(spark, shuffled_joins):
    plan = QUERIES["a2_scope_availability"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isnull(lot_id" not in plan and "Union" in plan


def test_join_errors_make_only_leftovers_distinct(spark, shuffled_joins):
    """No side of an anti join is made distinct before it."""
    tables = _technology(Source(spark, FOLDER))
    found = technology.join_errors(tables["products"], tables["sources"], tables["decisions"].limit(9), tables["projects"], tables["sources"])
    joins = found._jdf.queryExecution().analyzed().toString().split("Join LeftAnti")[1:]
    assert len(joins) == 5 and not any(re.match(r"[^\n]*\n[ :]*[:+]- (Deduplicate|Distinct)", below) for below in joins)
