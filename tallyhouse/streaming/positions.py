"""Streaming form of the position projection: a keyed cursor with a buffer for versions behind a gap.

State never expires: a version may come however late.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOMES = "position_id long, version long, quantity decimal(24,6), pending long, event_id long, event_version long, outcome string"
STATE = "version long, quantity decimal(24,6), last_event long, base long, waiting array<struct<version:long,event_id:long,delta:decimal(24,6)>>"


def _step(version: int, quantity: Decimal, last_event: int | None, waiting: dict[int, tuple[int, Decimal]], event: tuple[int, int, Decimal]) -> tuple[int, Decimal, int | None, str]:
    """Cursor after one event, and its outcome: applied, buffered, duplicate, stale or conflict."""
    at, event_id, delta = event
    if at <= version:
        return version, quantity, last_event, "duplicate" if at == version and event_id == last_event else "stale"
    if at > version + 1:
        if at in waiting:
            return version, quantity, last_event, "duplicate" if waiting[at][0] == event_id else "conflict"
        waiting[at] = (event_id, delta)
        return version, quantity, last_event, "buffered"
    if at in waiting and waiting[at][0] != event_id:
        return version, quantity, last_event, "conflict"
    waiting.pop(at, None)
    version, quantity, last_event = at, quantity + delta, event_id
    while version + 1 in waiting:
        last_event, more = waiting.pop(version + 1)
        version, quantity = version + 1, quantity + more
    return version, quantity, last_event, "applied"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, quantity, last_event, base, rows = state.get if state.exists else (0, Decimal(0), None, 0, [])
    waiting = {int(r[0]): (int(r[1]), r[2]) for r in rows}
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            version, quantity, last_event, outcome = _step(version, quantity, last_event, waiting, (int(r.version), int(r.event_id), r.delta))
            out.append((key[0], version, quantity, len(waiting), int(r.event_id), int(r.version), outcome))
        yield pd.DataFrame(out, columns=["position_id", "version", "quantity", "pending", "event_id", "event_version", "outcome"])
    state.update((version, quantity, last_event, base, [(v, e, d) for v, (e, d) in sorted(waiting.items())]))


def project(events: DataFrame) -> DataFrame:
    """Stream of outcomes for a stream of (position_id, version, event_id, delta); write it in append mode."""
    own = events.select("position_id", "version", "event_id", "delta")
    return own.groupBy("position_id").applyInPandasWithState(_update, OUTCOMES, STATE, "append", GroupStateTimeout.NoTimeout)


def first_receipts(deliveries: DataFrame) -> DataFrame:
    """Stream of first deliveries by consumer and event."""
    return deliveries.dropDuplicates(["consumer_name", "event_id"])
