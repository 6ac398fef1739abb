"""The inventory ledger: balances, conservation, idempotency, counts and container trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.availability import SCOPE, key_text, qty
from tallyhouse.storage import small, stored


def balances(legs: DataFrame, *keys: str) -> DataFrame:
    return legs.groupBy(*keys).agg(qty(F.sum("physical_delta")).alias("physical_qty"), F.count("*").alias("legs"))


def unbalanced(legs: DataFrame) -> DataFrame:
    """Movements that don't conserve quantity: their legs don't sum to zero."""
    return balances(legs, "transaction_id").where("physical_qty <> 0").withColumnRenamed("physical_qty", "difference")


def running_balance(legs: DataFrame) -> DataFrame:
    """Balance of each location and item after each day; days are summed first, so a window gets one row a day."""
    daily = legs.groupBy("location_id", "item_id", "posted_on").agg(qty(F.sum("physical_delta")).alias("delta"))
    w = Window.partitionBy("location_id", "item_id").orderBy("posted_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("balance", qty(F.sum("delta").over(w)))


def balance_at(legs: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts (location_id, item_id, observed_on, counted) with the ledger's quantity as of then and the variance."""
    known = counts.join(legs.select("location_id", "item_id", "posted_on", "physical_delta"), ["location_id", "item_id"], "left")
    before = F.when(F.col("posted_on") <= F.col("observed_on"), F.col("physical_delta")).otherwise(0)
    system = known.groupBy("location_id", "item_id", "observed_on", "counted").agg(qty(F.coalesce(F.sum(before), F.lit(0))).alias("system_qty"))
    return system.withColumn("variance_qty", qty(F.col("counted") - F.col("system_qty")))


def idempotent(commands: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(first command of each key, keys used with different fingerprints); ``commands`` has fingerprint, recorded_at and id."""
    w = Window.partitionBy(*key).orderBy("recorded_at", "id")
    first = commands.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    conflicts = commands.groupBy(*key).agg(F.countDistinct("fingerprint").alias("fingerprints")).where("fingerprints > 1")
    return first, conflicts


def replays(commands: DataFrame, *key: str) -> DataFrame:
    """``commands`` with outcome (applied for the first of a key, replayed for the same request again, conflict for another one) and the id
    that the key belongs to."""
    first = commands.groupBy(*key).agg(F.min(F.struct("recorded_at", "id", "fingerprint")).alias("_f"))
    found = commands.join(first, list(key))
    outcome = F.when(F.col("id") == F.col("_f.id"), "applied").when(F.col("fingerprint") == F.col("_f.fingerprint"), "replayed").otherwise("conflict")
    return found.select(*commands.columns, outcome.alias("outcome"), F.when(outcome != "conflict", F.col("_f.id")).alias("belongs_to"))


def fingerprint(kind: str, *columns: str) -> Column:
    """SHA-256 of a request's parts; a null part is ``-``."""
    return F.sha2(F.concat_ws(":", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)


def descendants(units: DataFrame, roots: DataFrame, most_levels: int = 64) -> DataFrame:
    """root_id, unit_id, level of everything inside the roots, themselves included.

    One join a level, each written before the next; a chain deeper than ``most_levels`` (or endless) is an error.
    """
    children = units.where("parent_id is not null").select("unit_id", "parent_id")
    level = stored(roots.select(F.col("unit_id").alias("root_id"), "unit_id", F.lit(0).alias("level")), "tree-level")
    levels = [level]
    while not level.isEmpty():
        if len(levels) > most_levels + 1:
            raise ValueError(f"units are nested deeper than {most_levels} levels")
        inside = level.select("root_id", F.col("unit_id").alias("parent_id"), (F.col("level") + 1).alias("level"))
        level = stored(inside.join(children, "parent_id").select("root_id", "unit_id", "level"), "tree-level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


ANCHORED = ("location_id", *SCOPE)


def ensure_positions(candidates: DataFrame, positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """candidate_id, position_id and outcome of requests for a position: existing where its whole key is taken, else created (the first
    candidate of a key gives its id), or unknown_anchor where the anchor is not of the tenant and warehouse.

    ``candidates``: candidate_id and the key (an anchor and a scope, nulls equal); ``anchors``: location_id, tenant_id, warehouse_id.
    Candidates move once, with their key as one text.
    """
    place = ["location_id", "tenant_id", "warehouse_id"]
    here = small(stored(anchors.select(*place).distinct().withColumn("_anchored", F.lit(True)), "anchors"), row_bytes=32)
    placed = candidates.withColumn("_key", key_text(candidates, *ANCHORED)).join(here, place, "left").select("candidate_id", "_key", "_anchored")
    asked = placed.where("_anchored").select("candidate_id", "_key").repartition("_key")
    first = asked.groupBy("_key").agg(F.min("candidate_id").alias("_first"))
    known = positions.select("position_id", key_text(positions, *ANCHORED).alias("_key")).groupBy("_key").agg(F.min("position_id").alias("_known"))
    found = asked.join(first, "_key").join(known, "_key", "left")
    outcome = F.when(F.col("_known").isNotNull() | (F.col("candidate_id") != F.col("_first")), "existing").otherwise("created")
    told = found.select("candidate_id", F.coalesce("_known", F.col("_first").cast("string")).alias("position_id"), outcome.alias("outcome"))
    return told.unionByName(placed.where("_anchored is null").select("candidate_id", F.lit(None).cast("string").alias("position_id"), F.lit("unknown_anchor").alias("outcome")))


def _short(quantity: Column, physical: Column, reserved: Column, allocated: Column) -> list[tuple[Column, str]]:
    """What stands in the way of taking ``quantity`` from a position, in the order in which it is looked at."""
    return [(quantity > physical, "exceeds_physical"), (physical - quantity < F.greatest(reserved, allocated), "strands_commitments")]


def _first_reason(reasons: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(broken, name) for broken, name in reasons])


def judge_issues(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """issue_id, position_id, reason (null: accepted) and physical_delta, each against the positions as they are.

    ``requests``: issue_id, position_id, quantity; ``positions``: position_id, physical_qty, reserved_qty, allocated_qty, shipping
    (whether the action is allowed).
    """
    found = requests.join(positions.select("position_id", "physical_qty", "reserved_qty", "allocated_qty", "shipping"), "position_id", "left")
    c = F.col
    reason = _first_reason([(c("physical_qty").isNull(), "unknown_position"), (~c("shipping"), "not_eligible"), *_short(c("quantity"), c("physical_qty"), c("reserved_qty"), c("allocated_qty"))])
    return found.select("issue_id", "position_id", reason.alias("reason"), F.when(reason.isNull(), qty(-c("quantity"))).alias("physical_delta"))


def judge_movements(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """``requests`` (movement_id, source_id, target_id, quantity) with reason (null: accepted): both ends may move, differ in their
    anchor alone, and the source keeps what is committed.  ``positions``: position_id, the scope, quantities, movement."""
    def end(name: str, *more: Column) -> DataFrame:
        return positions.select(F.col("position_id").alias(f"{name}_id"), key_text(positions, *SCOPE).alias(f"{name}_scope"), F.col("movement").alias(f"{name}_moves"), *more)

    c = F.col
    committed = F.greatest("reserved_qty", "allocated_qty").alias("committed")
    found = requests.join(end("source", c("physical_qty"), committed), "source_id", "left")
    short = _first_reason(_short(c("quantity"), c("physical_qty"), c("committed"), c("committed")))
    found = found.select(*requests.columns, "source_scope", "source_moves", short.alias("short")).join(end("target"), "target_id", "left")
    reason = F.coalesce(_first_reason([
        (c("source_scope").isNull() | c("target_scope").isNull(), "unknown_position"), (~c("source_moves"), "source_not_eligible"), (~c("target_moves"), "target_not_eligible"), (c("source_scope") != c("target_scope"), "other_stock_identity"),
    ]), "short")
    return found.select(*requests.columns, reason.alias("reason"))


def movement_legs(judged: DataFrame) -> DataFrame:
    """movement_id, position_id, physical_delta: two legs of each accepted movement, which sum to zero."""
    return movement_outcomes(judged).where("reason is null").drop("reason")


def movement_outcomes(judged: DataFrame) -> DataFrame:
    """movement_id, reason, position_id, physical_delta: the legs of accepted movements, and one row for each refused one."""
    q = F.col("quantity")
    ends = F.array(*[F.struct(F.col(end).alias("position_id"), qty(moved).alias("physical_delta")) for end, moved in (("source_id", -q), ("target_id", q))])
    legs = F.when(F.col("reason").isNull(), ends)
    return judged.select("movement_id", "reason", F.explode_outer(legs).alias("leg")).select("movement_id", "reason", "leg.*")


def judge_reconciliations(counts: DataFrame, positions: DataFrame) -> DataFrame:
    """count_id, reason (null: accepted) and physical_delta of count results (count_id, position_id, state, system_qty, counted_qty).

    The position must still have the quantity that the count was held against.
    """
    found = counts.join(positions.select("position_id", "physical_qty", "reserved_qty", "allocated_qty"), "position_id", "left")
    c, variance = F.col, F.col("counted_qty") - F.col("system_qty")
    after = c("physical_qty") + variance
    reason = _first_reason([
        (c("physical_qty").isNull(), "unknown_position"), (c("state") != "observed", "already_reconciled"), (variance == 0, "zero_variance"), (c("physical_qty") != c("system_qty"), "stale_snapshot"),
        (after < 0, "negative_result"), (after < F.greatest(c("reserved_qty"), c("allocated_qty")), "strands_commitments"),
    ])
    return found.select("count_id", reason.alias("reason"), F.when(reason.isNull(), qty(variance)).alias("physical_delta"))


def hold_errors(holds: DataFrame, policies: DataFrame, positions: DataFrame) -> DataFrame:
    """hold_id and reason of holds whose policy or position is of another tenant, or whose scope is not the position's.
    ``policies``: policy_id, tenant_id."""
    known = positions.select("position_id", F.struct(*SCOPE).alias("_scope"))
    found = holds.join(policies.select("policy_id", F.col("tenant_id").alias("_tenant")), "policy_id", "left").join(known, "position_id", "left")
    c = F.col
    differs = reduce(lambda a, b: a | b, (~c(k).eqNullSafe(c(f"_scope.{k}")) for k in SCOPE[1:]))
    on_position = c("position_id").isNotNull()
    reason = _first_reason([
        (~c("_tenant").eqNullSafe(c("tenant_id")), "policy_of_another_tenant"), (on_position & ~c("_scope.tenant_id").eqNullSafe(c("tenant_id")), "position_of_another_tenant"), (on_position & differs, "scope_differs_from_position"),
    ])
    return found.select("hold_id", reason.alias("reason")).where("reason is not null")


def position_holds(requests: DataFrame, positions: DataFrame) -> DataFrame:
    """``requests`` (hold_id, policy_id, position_id, starts_at, expires_at) as holds with the scope of their position."""
    return requests.join(positions.select("position_id", *SCOPE), "position_id").select("hold_id", "policy_id", "position_id", *SCOPE, "starts_at", "expires_at", F.lit(None).cast("timestamp_ntz").alias("released_at"))


def release_holds(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """``holds`` with the first release of each (hold_id, at) that had none."""
    first = releases.groupBy("hold_id").agg(F.min("at").alias("_at"))
    return holds.join(first, "hold_id", "left").withColumn("released_at", F.coalesce("released_at", "_at")).select(*holds.columns)


def ineligible_allocations(changes: DataFrame, positions: DataFrame) -> DataFrame:
    """Changes of a position's allocation (change_id, position_id, before, after) that raise it while the position may not be allocated."""
    return changes.where("after > before").join(positions.where("not allocation").select("position_id"), "position_id", "left_semi")


def serial_errors(members: DataFrame, positions: DataFrame, tracking: DataFrame) -> DataFrame:
    """serial_id and reason of serial memberships (serial_id, position_id, item_id): the item is tracked by serial (``tracking``: item_id,
    exact), it is the position's, and no serial is in two positions."""
    twice = members.groupBy("serial_id").agg(F.min("position_id").alias("_least"), F.max("position_id").alias("_most"))
    found = members.join(twice, "serial_id").join(positions.select("position_id", F.col("item_id").alias("_item")), "position_id", "left").join(tracking, "item_id", "left")
    reason = _first_reason([(~F.coalesce("exact", F.lit(False)), "item_not_tracked"), (~F.col("item_id").eqNullSafe(F.col("_item")), "item_differs"), (F.col("_least") != F.col("_most"), "in_two_positions")])
    return found.select("serial_id", "position_id", reason.alias("reason")).where("reason is not null")


def serial_excess(members: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions with more serial members than physical quantity."""
    counted = members.groupBy("position_id").agg(F.count("*").alias("serials"))
    return counted.join(positions.select("position_id", "physical_qty"), "position_id").where("serials > physical_qty")
