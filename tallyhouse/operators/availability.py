"""Stock availability by scope under holds and reservations.

A scope is nine columns, four of them nullable: nulls are equal to each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCOPE = ("tenant_id", "warehouse_id", "item_id", "owner_id", "condition_id", "lot_id", "stock_scope_id", "attribute_set_id", "stock_segment_id")
NULLABLE = frozenset(SCOPE[5:])
#: Action -> the flag of a hold's policy that blocks it.
ACTIONS = {"allocation": "blocks_allocation", "movement": "blocks_movement", "picking": "blocks_picking", "shipping": "blocks_shipping"}


def qty(c: Column) -> Column:
    """Quantities are decimal(24,6) at every public boundary."""
    return c.cast("decimal(24,6)")


def same_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = SCOPE, nullable: frozenset[str] = NULLABLE) -> Column:
    """Equality of ``keys``; nulls match in nullable ones, and the join stays an equi-join."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) if k in nullable else left[k] == right[k] for k in keys))


def key_text(df: DataFrame, *keys: str) -> Column:
    """The keys as one text: equal for equal keys only, nulls included.  It travels in fewer bytes than the columns, and joins by it are plain.

    Parts are joined by ``/``; in texts ``\\`` and ``/`` are escaped by ``\\``, and a null is ``\\N``, which no escaped text is.
    """

    def part(name: str) -> Column:
        value = F.col(name).cast("string")
        if isinstance(df.schema[name].dataType, StringType):
            value = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))
        return F.coalesce(value, F.lit("\\N"))

    return F.concat_ws("/", *[part(k) for k in keys])


def active_at(as_of: Column) -> Column:
    """Half-open: a hold applies from starts_at until before expires_at, unless it was released."""
    return (F.col("starts_at") <= as_of) & F.col("released_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def blocking_holds(holds: DataFrame, policies: DataFrame, action: str, as_of: Column) -> DataFrame:
    if action not in ACTIONS:
        raise ValueError(f"unsupported action: {action}")
    return holds.where(active_at(as_of)).join(policies.where(F.col(ACTIONS[action])).select("policy_id"), "policy_id", "left_semi")


def with_eligibility(positions: DataFrame, holds: DataFrame, policies: DataFrame, action: str, as_of: Column) -> DataFrame:
    """``positions`` with the boolean ``eligible``: no active hold of its scope or of itself blocks the action."""
    blocking = blocking_holds(holds, policies, action, as_of)
    on_scope = blocking.where("position_id is null").select(*SCOPE).distinct().withColumn("scope_held", F.lit(True))
    on_position = blocking.where("position_id is not null").select("position_id").distinct().withColumn("position_held", F.lit(True))
    found = positions.join(on_position, "position_id", "left")
    found = found.join(on_scope, same_keys(found, on_scope), "left").select(*[found[c] for c in positions.columns], found["position_held"], on_scope["scope_held"])
    return found.select(*positions.columns, (F.col("position_held").isNull() & F.col("scope_held").isNull()).alias("eligible"))


def action_eligibility(positions: DataFrame, holds: DataFrame, policies: DataFrame, as_of: Column) -> DataFrame:
    """``positions`` with a boolean for each action (as ``with_eligibility``), all of them by one join with the scopes and one with the positions held."""
    active = holds.where(active_at(as_of)).join(policies.select("policy_id", *ACTIONS.values()), "policy_id")

    def blocked(kind: str) -> list[Column]:
        return [F.coalesce(F.bool_or(flag), F.lit(False)).alias(f"{kind}_{action}") for action, flag in ACTIONS.items()]

    on_scope = active.where("position_id is null").groupBy(*SCOPE).agg(*blocked("scope"))
    on_position = active.where("position_id is not null").groupBy("position_id").agg(*blocked("own"))
    found = positions.join(on_position, "position_id", "left")
    found = found.join(on_scope, same_keys(found, on_scope), "left").select(*[found[c] for c in positions.columns], *[f"{kind}_{a}" for kind in ("own", "scope") for a in ACTIONS])
    free = [(~F.coalesce(F.col(f"own_{a}") | F.col(f"scope_{a}"), F.col(f"own_{a}"), F.col(f"scope_{a}"), F.lit(False))).alias(a) for a in ACTIONS]
    return found.select(*positions.columns, *free)


def remaining(reservations: DataFrame) -> DataFrame:
    """What each reservation still claims: quantity less allocated, consumed and released."""
    return reservations.withColumn("remaining_qty", qty(F.col("quantity") - F.col("allocated_qty") - F.col("consumed_qty") - F.col("released_qty")))


def scope_availability(positions: DataFrame, reservations: DataFrame, holds: DataFrame, policies: DataFrame, as_of: Column, action: str = "allocation") -> DataFrame:
    """Totals of all positions of a scope, and what is available: the eligible ones' free
    quantity less the reservations, clamped at zero for the scope (not for each position).

    Positions, holds of a scope and reservations meet in one grouping by scope, where nulls are equal; a scope counts where it has positions.
    """
    free = F.col("physical_qty") - F.col("allocated_qty") - F.col("reserved_qty")
    blocking = blocking_holds(holds, policies, action, as_of)
    on_position = blocking.where("position_id is not null").select("position_id").distinct().withColumn("held", F.lit(True))
    on_scope = blocking.where("position_id is null").select(*SCOPE, F.lit(True).alias("scope_held")).distinct()
    own = positions.join(on_position, "position_id", "left").select(*SCOPE, "physical_qty", "reserved_qty", "allocated_qty", F.when(F.col("held").isNull(), free).otherwise(0).alias("free"), F.lit(True).alias("stocked"))
    claims = remaining(reservations).select(*SCOPE, F.col("remaining_qty").alias("claimed"))
    met = own.unionByName(on_scope, allowMissingColumns=True).unionByName(claims, allowMissingColumns=True).groupBy(*SCOPE).agg(
        *[qty(F.sum(c)).alias(name) for c, name in (("physical_qty", "physical_qty"), ("reserved_qty", "exact_reserved_qty"), ("allocated_qty", "allocated_qty"), ("free", "free"), ("claimed", "claimed"))],
        F.bool_or("scope_held").alias("scope_held"), F.bool_or("stocked").alias("stocked"),
    )
    zero = F.lit(0).cast("decimal(24,6)")
    claimed = F.coalesce("claimed", zero)
    eligible_free = F.when(F.col("scope_held"), zero).otherwise(F.col("free"))
    return met.where("stocked").select(*SCOPE, "physical_qty", "exact_reserved_qty", "allocated_qty", qty(claimed).alias("coarse_reserved_qty"), qty(F.greatest(qty(eligible_free - claimed), zero)).alias("available_qty"))


def candidates(positions: DataFrame, scope: dict[str, object], limit: int = 20) -> DataFrame:
    """Positions of one scope with unallocated stock, by location (nulls last) and id: a top-n, not a full sort."""
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in scope.items()))
    return positions.where(match & (F.col("physical_qty") > F.col("allocated_qty"))).orderBy(F.col("location_id").asc_nulls_last(), "position_id").limit(limit)
