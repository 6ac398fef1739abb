from __future__ import annotations

import json
import random
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tallyhouse.operators import projection
from tallyhouse.sources import exposition, records
from tallyhouse.streaming import positions

ID = "0190a0b0-0000-7000-8000-00000000000a"


def envelope(**changes):
    return {"event_id": ID, "type": "inventory.position.changed", "occurred_at": "2024-01-01T00:00:00Z", "recorded_at": "2024-01-01T00:00:00Z", "aggregate_type": "position", "aggregate_id": "p", "aggregate_version": 1, "schema_version": 1, "data": {"k": 1}} | changes


def test_envelopes_are_classified(spark):
    good, tenant = envelope(), envelope(schema_version=2, tenant_id=ID)
    cases = [
        (json.dumps(good).encode(), None), (json.dumps(tenant).encode(), None), (b"\xff\xfe", "invalid_message_encoding"), (b"{nope", "invalid_message_json"), (b"[1]", "invalid_message_json"),
        (json.dumps(envelope(tenant_id=ID)).encode(), "invalid_event_envelope"), (json.dumps(envelope(schema_version=2)).encode(), "invalid_event_envelope"), (json.dumps(envelope(aggregate_version=0)).encode(), "invalid_event_envelope"),
        (json.dumps(envelope(event_id="x")).encode(), "invalid_event_envelope"),
    ]
    rows = [(i, bytearray(c), {"event-id": ID, "event-type": "inventory.position.changed"}) for i, (c, _) in enumerate(cases)] + [(99, bytearray(cases[0][0]), {"event-id": "other", "event-type": "x"})]
    found = {r["n"]: r["failure_code"] for r in records.decode_envelopes(spark.createDataFrame(rows, "n int, payload binary, headers map<string,string>")).collect()}
    assert found == {i: code for i, (_, code) in enumerate(cases)} | {99: "invalid_transport_headers"}


def test_yaml_csv_and_snapshots(spark, tmp_path):
    (tmp_path / "b.yml").write_text("id: b\nsince: 2024-01-02\ntags: [x, y]\n")
    (tmp_path / "a.yml").write_text("id: a\ntags: []\n")
    found = records.read_yaml(spark, f"{tmp_path}/*.yml", "id string, since string, tags array<string>").collect()
    assert [(r["id"], r["since"], r["tags"]) for r in found] == [("a", None, []), ("b", "2024-01-02", ["x", "y"])]
    (tmp_path / "m.csv").write_text("id,layers\n1,a | b\n2,unknown\n")
    found = records.read_delimited(spark, f"{tmp_path}/m.csv", "id int, layers string", ("layers",), keep_unknown=False).collect()
    assert [r["layers"] for r in found] == [["a", "b"], []]
    (tmp_path / "s1.json").write_text('{"position_id": "p", "version": 3}')
    (tmp_path / "s2.json").write_text('{"position_id": "p"}')
    found = {r["path"][-7:]: r for r in records.read_snapshots(spark, f"{tmp_path}/s*.json", ("position_id", "version")).collect()}
    assert found["s1.json"]["rejected"] is None and found["s1.json"]["version"] == "3" and found["s2.json"]["rejected"] == "unexpected_keys"


def test_renderings(spark):
    df = spark.createDataFrame([("a", 1, None), ('b"', 2, 3.5)], "c string, n int, x double")
    lines = sorted(r["line"] for r in exposition.prometheus(df, "m", "c").collect())
    assert lines == ['m_n{c="a"} 1.0', 'm_n{c="b\\""} 2.0', 'm_x{c="b\\""} 3.5']
    assert exposition.json_lines(df).first()["line"] == '{"c":"a","n":1}'
    assert exposition.markdown(df).first()["line"] == "| a | 1 |  |"
    assert exposition.stale(df, df).count() == 0


def test_streaming_projection_converges_to_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(p, v, p * 100 + v, Decimal(v)) for p in (1, 2) for v in range(1, 9) if (p, v) != (2, 5)]
    sent = rows + rng.sample(rows, 6)
    rng.shuffle(sent)
    kinds = "position_id long, version long, event_id long, delta decimal(24,6)"
    folder = str(tmp_path / "in")
    for part in (sent[:7], sent[7:13], sent[13:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder)
    running = positions.project(stream).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination()
    out = spark.table("outcomes").collect()
    last = {p: max((r for r in out if r["position_id"] == p), key=lambda r: (r["version"], -r["pending"])) for p in (1, 2)}
    batch = projection.apply_deltas(spark.createDataFrame(rows, kinds).withColumn("recorded_at", F.lit(datetime(2024, 1, 1)))).collect()
    assert {p: (r["version"], r["quantity"]) for p, r in last.items()} == {r["position_id"]: (r["version"], r["quantity"]) for r in batch}
    assert {r["outcome"] for r in out} <= {"applied", "buffered", "duplicate", "stale"} and len(out) == len(sent)
