"""Readers of record collections: YAML trees, CSV with multivalues, JSON artifacts and event envelopes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyhouse.functions.text import split_pipe

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EVENT_TYPE = "^[a-z][a-z0-9_]*([.][a-z0-9_]+)+$"
FAILURE_CODE = "^[a-z][a-z0-9_]{0,99}$"


@F.pandas_udf(StringType())
def yaml_to_json(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A YAML document as JSON text; dates become ISO strings."""
    import yaml

    def plain(value: object) -> str:
        if isinstance(value, (date, datetime)):
            return value.isoformat()
        raise TypeError(f"unsupported YAML value: {type(value).__name__}")

    for batch in documents:
        yield batch.map(lambda text: None if text is None else json.dumps(yaml.safe_load(text), default=plain, ensure_ascii=False))


def read_yaml(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """Records of YAML files (one each), ordered by path."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return files.select("path", F.from_json(yaml_to_json("value"), schema, {"mode": "FAILFAST"}).alias("r")).select("path", "r.*").orderBy("path")


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, multivalued: tuple[str, ...] = (), keep_unknown: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a header; columns named in ``multivalued`` are split at ``|``."""
    df = spark.read.csv(path, header=True, schema=schema, sep=sep, mode="FAILFAST")
    return df.withColumns({c: split_pipe(F.col(c), keep_unknown) for c in multivalued})


def read_snapshots(spark: SparkSession, glob: str, keys: tuple[str, ...]) -> DataFrame:
    """JSON snapshot artifacts: sha256 of the exact bytes, the fields as strings, and why a file is rejected (missing or extra keys)."""
    files = spark.read.format("binaryFile").load(glob)
    text = F.decode("content", "UTF-8")
    found = files.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(text, "map<string,string>").alias("fields"), F.json_object_keys(text).alias("names"))
    exact = F.coalesce(F.array_sort("names") == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))
    reason = F.when(F.col("names").isNull(), "invalid_json").when(~exact, "unexpected_keys")
    return found.select("path", "sha256", *[F.col("fields")[k].alias(k) for k in keys], reason.alias("rejected"))


ENVELOPE = "event_id string, tenant_id string, type string, occurred_at string, recorded_at string, aggregate_type string, aggregate_id string, aggregate_version long, schema_version int, data string"


def decode_envelopes(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """``messages`` with the envelope's fields and failure_code: bytes that are no UTF-8, text that is no JSON object,
    fields that break the contract (V2 has a tenant, V1 has none), headers that differ from the envelope (column headers: a map)."""
    text = F.try_validate_utf8(F.col(payload).cast("string"))
    parsed = messages.withColumn("_text", text).withColumn("_keys", F.json_object_keys("_text")).withColumn("event", F.from_json("_text", ENVELOPE))
    e = F.col("event")
    version_fits = F.when(e["schema_version"] >= 2, e["tenant_id"].rlike(UUID)).when(e["schema_version"] == 1, e["tenant_id"].isNull()).otherwise(False)
    times = F.try_to_timestamp(e["occurred_at"]).isNotNull() & F.try_to_timestamp(e["recorded_at"]).isNotNull()
    typed = e["event_id"].rlike(UUID) & e["aggregate_id"].isNotNull() & (e["aggregate_version"] > 0) & e["type"].rlike(EVENT_TYPE) & times & version_fits
    code = F.when(F.col("_text").isNull(), "invalid_message_encoding").when(F.col("_keys").isNull(), "invalid_message_json").when(~F.coalesce(typed, F.lit(False)), "invalid_event_envelope")
    if "headers" in messages.columns:
        same = F.col("headers")["event-id"].eqNullSafe(e["event_id"]) & F.col("headers")["event-type"].eqNullSafe(e["type"])
        code = code.when(~same, "invalid_transport_headers")
    return parsed.withColumn("failure_code", code).drop("_text", "_keys")


def signature(secret: bytes, event_id: Column, timestamp: Column, body: Column) -> Column:
    """HMAC-SHA256 (hex) over ``id.timestamp.body``, from two SHA-256 rounds over padded keys."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ x for b in key) for x in (0x36, 0x5C))
    message = F.concat_ws(".", event_id, timestamp, body).cast("binary")
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)
