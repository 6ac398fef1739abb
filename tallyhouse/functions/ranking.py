"""Row numbers and exact quantiles of groups of any size.

Rows are dealt by ranges of their group and order, so one group may lie in many tasks; each
range is numbered by itself, and running sums over the small table of (group, range) counts
number them through.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.storage import small, stored


def _ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with the number of their range, stored: another run might draw other borders."""
    return stored(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranked")


def _offsets(placed: DataFrame, keys: Sequence[str], n: Column) -> DataFrame:
    """_before and _total for each group and range."""
    counts = placed.groupBy(*keys, "_range").agg(n.alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    told = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total"))
    return small(stored(told, "ranked-offsets"))


def _joined(placed: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both together; null keys are equal to each other."""
    renamed = offsets.withColumnsRenamed({k: f"_{k}" for k in [*keys, "_range"]})
    same = reduce(lambda a, b: a & b, (placed[k].eqNullSafe(renamed[f"_{k}"]) for k in [*keys, "_range"]))
    return placed.join(renamed, same).drop(*[f"_{k}" for k in [*keys, "_range"]])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their place in the order of their group (from 1); the order must leave no ties."""
    placed = _ranged(rows, keys, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = _joined(placed.withColumn(name, F.row_number().over(inside)), _offsets(placed, keys, F.count("*")), keys)
    return ranked.select(*rows.columns, (F.col(name) + F.col("_before")).cast("long").alias(name))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """keys and one column for each share, over the values that aren't null.

    ``nearest``: the value at rank ceil(n * share); else interpolated between the two next to (n - 1) * share.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_count"))
    placed = _ranged(counts, keys, [F.col(value)])
    upto = F.sum("_count").over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = _joined(placed.withColumn("_upto", upto), _offsets(placed, keys, F.sum("_count")), keys).withColumn("_upto", F.col("_upto") + F.col("_before"))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col(value)))

    def one(share: float) -> Column:
        if nearest:
            return at(F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(share))))
        place = (F.col("_total") - 1) * F.lit(share)
        low, high = at(F.floor(place) + 1), at(F.ceil(place) + 1)
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return found.groupBy(*keys).agg(*[one(s).alias(name) for name, s in shares.items()])
