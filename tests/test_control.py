from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import control, health

T0 = datetime(2024, 1, 1)


def at(moment):
    return F.lit(moment).cast("timestamp_ntz")


def test_retry_after_forms(spark):
    cases = [("120", 120), (" 7 ", 7), ("999999999999999999999999", 86400), ("Mon, 01 Jan 2024 00:00:30 GMT", 30), ("Sun, 31 Dec 2023 23:00:00 GMT", 0), ("soon", None), ("", None), (None, None), ("-5", None)]
    df = spark.createDataFrame(cases, "v string, want long")
    assert all(r["got"] == r["want"] for r in df.select("want", control.retry_after(F.col("v"), at(T0)).alias("got")).collect())


def test_terminal_code_priority(spark):
    df = spark.createDataFrame([(False, ["canary_ack_timeout", "canary_delivery_timeout"]), (False, ["x"]), (True, ["canary_ack_timeout"])], "done boolean, codes array<string>")
    assert [r[0] for r in df.select(control.terminal_code(F.col("done"), F.col("codes"))).collect()] == ["canary_delivery_timeout", "canary_incomplete", None]


def test_canonical_fingerprint(spark):
    import hashlib

    found = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>").select(control.canonical_fingerprint(F.col("m")).alias("f")).first()["f"]
    assert found == hashlib.sha256(b'{"a":"1","b":"2"}').hexdigest()


def test_provisioning_health(spark):
    kinds = "run_id int, state string, started_at timestamp_ntz, lease_until timestamp_ntz, state_changed_at timestamp_ntz"
    now = T0 + timedelta(seconds=100)
    active, old = (2, "applying", T0, now + timedelta(seconds=9), T0), (1, "rolled_back", T0 - timedelta(1), T0, T0)

    def judged(*rows):
        r = control.provisioning_health(spark.createDataFrame(list(rows), kinds), at(now)).first()
        return r["status"], r["current_code"], r["history_code"]

    assert judged(active, old) == ("warning", "topology_provisioning_execution_slow", "topology_provisioning_latest_rolled_back")
    assert judged((2, "applying", T0, now, T0)) == ("critical", "topology_provisioning_lease_expired", None)
    assert judged((1, "failed", T0, now, T0))[0] == "critical" and judged((1, "completed", T0, now, T0)) == ("ok", None, None) and judged() == ("ok", None, None)


def test_watchdog(spark):
    kinds = "started_at timestamp_ntz, due_at timestamp_ntz"
    due, now = T0 + timedelta(seconds=300), T0 + timedelta(seconds=340)

    def judged(*rows):
        r = control.watchdog(spark.createDataFrame(list(rows), kinds), at(due), at(now), 60).first()
        return r["status"], r["code"]

    assert judged() == ("critical", "probe_execution_never_observed")
    assert judged((due + timedelta(seconds=5), due)) == ("ok", None)
    assert judged((due + timedelta(seconds=20), due)) == ("warning", "probe_scheduler_lag")
    assert judged((due - timedelta(seconds=60), due - timedelta(seconds=60))) == ("warning", "probe_execution_missing")
    assert judged((T0, T0)) == ("critical", "probe_execution_missing")


def test_journal_steps(spark):
    rows = [(1, i, s) for i, s in enumerate(("prepared", "applying", "applied", "completed"))]
    assert [r["n"] for r in health.illegal_transitions(spark.createDataFrame(rows, "id int, n int, state string"), "id", "n", control.JOURNAL_STEPS).collect()] == [3]


def test_transactions_are_guarded(spark):
    index = spark.createDataFrame([("a", 1, T0), ("a", 2, T0), ("b", 3, T0)], "tenant_id string, transaction_id int, occurred_at timestamp_ntz")
    assert [r["transaction_id"] for r in control.transactions_of(index, "a", ("a",), 1).collect()] == [2]
    with pytest.raises(PermissionError):
        control.transactions_of(index, "b", ("a",), 1)


def test_next_generation_and_webhooks(spark):
    journal = spark.createDataFrame([("d", 0), ("d", 1), ("e", None)], "id string, generation int")
    assert {r["id"]: r["next_generation"] for r in control.next_generation(journal, "id").collect()} == {"d": 2, "e": 0}
    cases = [(200, 1, "success", None), (503, 3, "retry", 120), (None, 8, "dead_letter", None), (404, 1, "dead_letter", None), (302, 1, "invalid", None)]
    df = spark.createDataFrame(cases, "s int, n int, outcome string, delay int")
    assert all(r["d"] == (r["outcome"], r["delay"]) for r in df.select("outcome", "delay", health.webhook_decision(F.col("s"), F.col("n")).alias("d")).collect())
