"""A synthetic stock of any size from row numbers alone (no randomness, no driver loop)."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_positions(spark: SparkSession, positions: int) -> DataFrame:
    """position_id, item_id, location_id, physical_qty: 100 of each; items by the square root of the size, 10 to 1,000."""
    items = max(10, min(1000, isqrt(positions)))
    n = F.col("id")
    identity = F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(F.lower(F.hex(n)), 12, "0"))
    return spark.range(positions).select(identity.alias("position_id"), (n % items).alias("item_id"), F.floor(n / items).alias("location_id"), F.lit(100).cast("decimal(24,6)").alias("physical_qty"))
