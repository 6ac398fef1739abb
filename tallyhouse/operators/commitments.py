"""Reservations and allocations: requests judged against the tables as they are, and the changes that accepted ones make.

Each function is a join of a batch of requests with the state; a batch is applied before the next one is judged
(``pipeline.updated`` puts changes in place).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.availability import SCOPE, key_text, qty, same_keys


def _first(reasons: list[tuple[Column, str]]) -> Column:
    """The first reason that holds, null if none does."""
    return F.coalesce(*[F.when(broken, name) for broken, name in reasons])


def _remaining() -> Column:
    return F.col("quantity") - F.col("consumed_qty") - F.col("released_qty")


def judge_reservations(requests: DataFrame, available: DataFrame) -> DataFrame:
    """reservation_id and reason (null: accepted) of requests (reservation_id, the scope, quantity) against ``available`` (the scope,
    available_qty: see ``availability.scope_availability``); a scope without stock has none."""
    known = available.select(*SCOPE, "available_qty")
    found = requests.join(known, same_keys(requests, known), "left")
    short = F.coalesce("available_qty", F.lit(0)) < F.col("quantity")
    return found.select("reservation_id", F.when(short, "exceeds_scope_availability").alias("reason"))


def release_reservations(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """reservation_id, reason and the released_qty that accepted requests leave: all that remains goes, once.

    ``reservations``: reservation_id, quantity, allocated_qty, consumed_qty, released_qty, released_at.
    """
    found = requests.select("reservation_id").distinct().join(reservations, "reservation_id", "left")
    reason = _first([(F.col("quantity").isNull(), "unknown_reservation"), (F.col("released_at").isNotNull(), "already_released")])
    return found.select("reservation_id", reason.alias("reason"), F.when(reason.isNull(), qty(F.col("released_qty") + _remaining() - F.col("allocated_qty"))).alias("released_qty"))


def judge_allocations(requests: DataFrame, positions: DataFrame, reservations: DataFrame, available: DataFrame) -> DataFrame:
    """allocation_id, reason (null: accepted) and allocated_delta of requests (allocation_id, position_id, reservation_id or null, demand_id,
    quantity).

    ``available``: the scope, available_qty; rows of one scope are summed.

    Against a reservation demand and scope must be its own and what remains of it suffice; without one the scope must have that much
    available.  In both cases the position itself must have it free.  Only requests with a reservation meet the reservations, and only
    those that nothing else refuses meet the scopes.
    """
    c = F.col
    at = positions.select("position_id", key_text(positions, *SCOPE).alias("scope"), (c("physical_qty") - c("allocated_qty") - c("reserved_qty")).alias("free"))
    held = reservations.select("reservation_id", key_text(reservations, *SCOPE).alias("held_scope"), c("demand_id").alias("held_demand"), (_remaining() - c("allocated_qty")).alias("held"), c("released_at").isNotNull().alias("ended"))
    found = requests.join(at, "position_id", "left").withColumn("short", c("free") < c("quantity")).drop("free")
    given = found.where("reservation_id is not null").select("allocation_id", "reservation_id", "demand_id", "quantity", "scope", "short").join(held, "reservation_id", "left")
    differs = ~c("scope").eqNullSafe(c("held_scope")) | ~c("held_demand").eqNullSafe(c("demand_id"))
    reason = _first([
        (c("scope").isNull(), "unknown_position"), (c("held_scope").isNull(), "unknown_reservation"), (c("ended"), "reservation_released"), (differs, "reservation_does_not_match"),
        (c("held") < c("quantity"), "exceeds_reservation"), (c("short"), "exceeds_free_quantity"),
    ])
    plain = found.where("reservation_id is null").select("allocation_id", "quantity", "scope", _first([(c("scope").isNull(), "unknown_position"), (c("short"), "exceeds_free_quantity")]).alias("reason"))
    known = available.select(key_text(available, *SCOPE).alias("scope"), "available_qty").groupBy("scope").agg(qty(F.sum("available_qty")).alias("available_qty"))
    scoped = plain.where("reason is null").join(known, "scope", "left")
    consumes = F.coalesce("available_qty", F.lit(0)) < c("quantity")
    judged = [
        given.select("allocation_id", "quantity", reason.alias("reason")), plain.where("reason is not null").select("allocation_id", "quantity", "reason"),
        scoped.select("allocation_id", "quantity", F.when(consumes, "consumes_reserved_capacity").alias("reason")),
    ]
    return reduce(DataFrame.unionByName, judged).select("allocation_id", "reason", F.when(c("reason").isNull(), qty(c("quantity"))).alias("allocated_delta"))


def release_allocations(requests: DataFrame, allocations: DataFrame, reservations: DataFrame) -> DataFrame:
    """allocation_id, reason, position_id and the deltas of accepted requests: the position's allocated_delta, and the reservation's
    allocated and released ones (what comes back to a reservation that is over is released with it).

    ``allocations``: allocation_id, position_id, reservation_id, quantity, consumed_qty, released_qty, released_at.
    """
    ended = reservations.select("reservation_id", F.col("released_at").isNotNull().alias("over"))
    found = requests.select("allocation_id").distinct().join(allocations, "allocation_id", "left").join(ended, "reservation_id", "left")
    left = _remaining()
    reason = _first([(F.col("quantity").isNull(), "unknown_allocation"), (F.col("released_at").isNotNull(), "already_released"), (left <= 0, "nothing_remains")])
    fine, none = reason.isNull(), F.lit(0)
    reserved = F.col("reservation_id").isNotNull()
    return found.select(
        "allocation_id", reason.alias("reason"), "position_id", F.when(fine, qty(-left)).alias("allocated_delta"),
        F.when(fine, qty(F.when(reserved, -left).otherwise(none))).alias("reservation_allocated_delta"), F.when(fine, qty(F.when(reserved & F.col("over"), left).otherwise(none))).alias("reservation_released_delta"),
    )


def judge_picks(requests: DataFrame, allocations: DataFrame, positions: DataFrame) -> DataFrame:
    """``requests`` (pick_id, allocation_id, target_id, quantity) with source_id and reason (null: accepted): a pick consumes an allocation
    by moving stock.  ``positions``: as for ``ledger.judge_movements``, with picking.  What the
    allocation alone refuses doesn't meet the positions."""
    c, q = F.col, F.col("quantity")
    own = allocations.select("allocation_id", c("position_id").alias("source_id"), _remaining().alias("left"), c("released_at").alias("ended"))
    source = positions.select(
        c("position_id").alias("source_id"), key_text(positions, *SCOPE).alias("source_scope"), (c("picking") & c("movement")).alias("source_moves"),
        F.least("physical_qty", "allocated_qty").alias("most"), (c("physical_qty") - c("reserved_qty")).alias("unreserved"), (c("physical_qty") < c("allocated_qty")).alias("overdrawn"),
    )
    target = positions.select(c("position_id").alias("target_id"), key_text(positions, *SCOPE).alias("target_scope"), c("movement").alias("target_moves"))
    refused = _first([(c("source_id").isNull(), "unknown_allocation"), (c("ended").isNotNull(), "allocation_released"), (c("left") < q, "exceeds_allocation")])
    taken = requests.join(own, "allocation_id", "left").select(*requests.columns, "source_id", refused.alias("reason"))
    found = taken.where("reason is null").drop("reason").join(source, "source_id", "left")
    short = _first([(c("most") < q, "source_cannot_satisfy"), ((c("unreserved") < q) | c("overdrawn"), "strands_commitments")])
    found = found.select(*requests.columns, "source_id", "source_scope", "source_moves", short.alias("short")).join(target, "target_id", "left")
    stopped = _first([
        (c("source_scope").isNull() | c("target_scope").isNull(), "unknown_position"), (c("source_scope") != c("target_scope"), "other_stock_identity"), (~(c("source_moves") & c("target_moves")), "not_eligible"),
    ])
    return found.select(*requests.columns, "source_id", F.coalesce(stopped, "short").alias("reason")).unionByName(taken.where("reason is not null"))


def pick_legs(judged: DataFrame) -> DataFrame:
    """pick_id, position_id, physical_delta, allocated_delta: two legs of each accepted pick; the physical ones sum to zero."""
    return pick_outcomes(judged).where("reason is null").drop("reason")


def pick_outcomes(judged: DataFrame) -> DataFrame:
    """pick_id, reason, position_id, physical_delta, allocated_delta: the legs of accepted picks, and one row with the source for each refused one."""
    q = F.col("quantity")
    ends = [F.struct(F.col(end).alias("position_id"), qty(moved).alias("physical_delta"), qty(taken).alias("allocated_delta")) for end, moved, taken in (("source_id", -q, -q), ("target_id", q, F.lit(0)))]
    refused = F.struct(F.col("source_id").alias("position_id"), qty(F.lit(None)).alias("physical_delta"), qty(F.lit(None)).alias("allocated_delta"))
    legs = F.when(F.col("reason").isNull(), F.array(*ends)).otherwise(F.array(refused))
    return judged.select("pick_id", "reason", F.explode(legs).alias("leg")).select("pick_id", "reason", "leg.*")
