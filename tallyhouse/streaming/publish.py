"""Streaming sink: events as canonical JSON lines, each event once however often it is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def canonical(columns: list[str]) -> Column:
    """Compact JSON with the fields in the order of their names; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def publish(events: DataFrame, folder: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Start writing ``events`` to ``folder`` (parquet: key, batch_id, line) for all data available now.

    A batch that is run again replaces what it wrote before; events of earlier batches are dropped by their key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select(F.col(key).alias("key"), canonical(batch.columns).alias("line")).groupBy("key").agg(F.min("line").alias("line"))
        if batch_id > 0:
            before = spark.read.schema("key string, line string, batch_id long").parquet(folder).where(F.col("batch_id") < batch_id)
            own = own.join(before.select("key").distinct(), own["key"].cast("string") == before["key"], "left_anti")
        own.select(F.col("key").cast("string").alias("key"), "line").write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
