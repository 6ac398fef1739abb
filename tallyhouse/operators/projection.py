"""Version-ordered projections in batch form.

A position's quantity follows its events in version order without gaps: the contiguous
prefix is applied, later versions wait in a buffer until the gap is filled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.availability import qty


def _deduplicated(events: DataFrame) -> DataFrame:
    """One event for each position and version (the least event id); two ids at one version are a conflict."""
    first = F.min(F.struct("event_id", "recorded_at", "delta")).alias("e")
    return events.groupBy("position_id", "version").agg(first, F.countDistinct("event_id").alias("ids")).select("position_id", "version", "e.*", "ids")


def conflicts(events: DataFrame) -> DataFrame:
    return _deduplicated(events).where("ids > 1").select("position_id", "version", "ids")


def _placed(events: DataFrame, base: DataFrame | None) -> DataFrame:
    """Events beyond the base version, numbered; an event is in the contiguous prefix iff its number fits its version."""
    own = _deduplicated(events)
    own = own.withColumn("base", F.lit(0).cast("long")) if base is None else own.join(base.select("position_id", F.col("version").alias("base")), "position_id", "left").fillna(0, ["base"])
    w = Window.partitionBy("position_id").orderBy("version")
    return own.where("version > base").withColumn("applied", F.col("version") - F.col("base") == F.row_number().over(w))


def apply_deltas(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Cursor of each position: version, quantity, and what is still pending behind a gap.

    ``base``: snapshot (position_id, version, quantity) that events up to its version are covered by.
    A position whose first event is behind a gap has a cursor at version 0.
    """
    placed = _placed(events, base)
    found = placed.groupBy("position_id").agg(
        F.coalesce(F.max(F.when(F.col("applied"), F.col("version"))), F.first("base")).alias("version"),
        qty(F.coalesce(F.sum(F.when(F.col("applied"), F.col("delta"))), F.lit(0))).alias("delta"),
        F.count_if(F.col("applied")).alias("applied"),
        F.count_if(~F.col("applied")).alias("pending"),
        F.min(F.when(~F.col("applied"), F.col("version"))).alias("first_pending_version"),
        F.max(F.when(~F.col("applied"), F.col("version"))).alias("last_pending_version"),
        F.min(F.when(~F.col("applied"), F.col("recorded_at"))).alias("oldest_pending_at"),
    )
    if base is None:
        return found.withColumnRenamed("delta", "quantity")
    joined = base.select("position_id", F.col("version").alias("v"), F.col("quantity").alias("q")).join(found, "position_id", "full")
    return joined.select(
        "position_id", F.coalesce("version", "v").alias("version"), qty(F.coalesce("q", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("quantity"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("applied", "pending")],
        "first_pending_version", "last_pending_version", "oldest_pending_at",
    )


def gaps(cursors: DataFrame) -> DataFrame:
    """Positions that wait for a missing version."""
    return cursors.where("pending > 0").select("position_id", (F.col("version") + 1).alias("expected_version"), "first_pending_version", "last_pending_version", "pending", "oldest_pending_at")


def rebuild(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A rebuild from a verified snapshot: covered events are superseded, contiguous ones drained, the rest remains."""
    cursors = apply_deltas(events, snapshot)
    covered = _deduplicated(events).join(snapshot.select("position_id", F.col("version").alias("v")), "position_id").where("version <= v").groupBy("position_id").agg(F.count("*").alias("superseded"))
    found = cursors.join(covered, "position_id", "left")
    return found.select("position_id", "version", "quantity", F.coalesce("superseded", F.lit(0)).alias("superseded"), F.col("applied").alias("drained"), F.col("pending").alias("remaining"))


def work_states(events: DataFrame) -> DataFrame:
    """Work-state projection, strict: versions without gaps and each previous_state equal to the state before.

    ``events``: work_id, version, previous_state, state.  Returns the last good state of each work and the
    first version that breaks the order (there the reference rolls its receipt back).
    """
    w = Window.partitionBy("work_id").orderBy("version")
    before = F.lag("state").over(w)
    good = (F.col("version") == F.row_number().over(w)) & (before.isNull() | before.eqNullSafe(F.col("previous_state")))
    broken = F.min(F.when(~F.col("good"), F.col("version"))).over(Window.partitionBy("work_id"))
    checked = events.withColumn("good", good).withColumn("broken_version", broken)
    fine = F.col("broken_version").isNull() | (F.col("version") < F.col("broken_version"))
    return checked.groupBy("work_id").agg(F.max(F.when(fine, F.struct("version", "state"))).alias("last"), F.max("broken_version").alias("broken_version")).select("work_id", "last.version", "last.state", "broken_version")


def plan_rebuilds(cursors: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether each requested rebuild may go on: (position_id, expected_version, expected_pending, snapshot_version, disposition).

    The expectations must hold, the snapshot must not move the cursor back, and ``require-empty`` needs an empty buffer.
    """
    joined = requests.join(cursors.select("position_id", "version", "pending"), "position_id", "left")
    reason = (
        F.when(F.col("version").isNull(), "unknown_position")
        .when(F.col("version") != F.col("expected_version"), "version_changed")
        .when(F.col("pending") != F.col("expected_pending"), "pending_changed")
        .when(F.col("snapshot_version") < F.col("version"), "moves_backward")
        .when((F.col("disposition") == "require-empty") & (F.col("pending") > 0), "pending_not_empty")
        .when(~F.col("disposition").isin("require-empty", "supersede-covered-retain-future"), "unknown_disposition")
    )
    return joined.select("position_id", "snapshot_version", "disposition", reason.isNull().alias("accepted"), reason.alias("reason"))


#: What makes two bootstrap requests the same; fixed values.
BOOTSTRAP = ("version", "quantity", "checksum")


def bootstrap(requests: DataFrame, cursors: DataFrame, fences: DataFrame) -> DataFrame:
    """bootstrap_id, position_id and outcome of requests to start a cursor from a snapshot (bootstrap_id, position_id, version, quantity,
    checksum, requested_at): bootstrapped, duplicate (same id and payload), conflict, fence_active or invalid_snapshot.

    Nothing is overwritten: ``cursors`` (position_id, and bootstrap_id, version, quantity, checksum of the bootstrap, null if there was none)
    keep what they have.  ``fences``: position_id of active rebuilds.
    """
    first = requests.groupBy("position_id").agg(F.min(F.struct("requested_at", "bootstrap_id", *BOOTSTRAP)).alias("f"))
    known = cursors.select("position_id", F.struct("bootstrap_id", *BOOTSTRAP).alias("k"))
    found = requests.join(first, "position_id").join(known, "position_id", "left").join(fences.select("position_id").distinct().withColumn("_fenced", F.lit(True)), "position_id", "left")

    def is_that(owner: str) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{owner}.{c}")) for c in ("bootstrap_id", *BOOTSTRAP)))

    created = F.col("k").isNull() & (F.col("requested_at") == F.col("f.requested_at"))
    same = F.when(F.col("k").isNotNull(), is_that("k")).otherwise(is_that("f"))
    outcome = F.when((F.col("version") < 1) | (F.col("quantity") < 0), "invalid_snapshot").when(F.col("_fenced"), "fence_active").when(created, "bootstrapped").when(same, "duplicate").otherwise("conflict")
    return found.select("bootstrap_id", "position_id", outcome.alias("outcome"))


def cancel_rebuilds(rebuilds: DataFrame, requests: DataFrame) -> DataFrame:
    """rebuild_id and outcome of requests to cancel (rebuild_id, cancelled_by, reason) prepared rebuilds (rebuild_id, status, cancelled_by,
    reason): cancelled, duplicate, conflict (cancelled otherwise), not_prepared or unknown_rebuild."""
    found = requests.join(rebuilds.select("rebuild_id", "status", F.col("cancelled_by").alias("_by"), F.col("reason").alias("_reason")), "rebuild_id", "left")
    same = F.col("cancelled_by").eqNullSafe(F.col("_by")) & F.col("reason").eqNullSafe(F.col("_reason"))
    outcome = F.when(F.col("status").isNull(), "unknown_rebuild").when(F.col("status") == "prepared", "cancelled").when(F.col("status") != "cancelled", "not_prepared").when(same, "duplicate").otherwise("conflict")
    return found.select("rebuild_id", outcome.alias("outcome"))
