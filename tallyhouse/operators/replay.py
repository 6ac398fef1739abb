"""Replay of order-dependent commands: each key's log is read in order by one task.

Commitments of one scope depend on each other through what is still available, so a
scope is the unit of serialisation (plain work commands: the work).  Scopes are many
and their logs short beside the whole; Python keeps only running totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING = Decimal(0)
DECISIONS = "command_id string, scope string, kind string, accepted boolean, reason string, available decimal(24,6)"


def in_order(commands: DataFrame, key: str) -> DataFrame:
    """``commands`` with the logs of each key one after another in one task, each in the order of (recorded_at, command_id), nulls last:
    a task reads many short logs as one stream, and keeps the state of one key at a time."""
    return commands.repartition(key).sortWithinPartitions(key, *_order())


def _order() -> list[Column]:
    return [F.asc_nulls_last("recorded_at"), F.asc_nulls_last("command_id")]


def _values(column: pa.Array) -> list:
    """Python values; texts and decimals by way of an array of objects, which is several times as fast."""
    objects = pa.types.is_string(column.type) or pa.types.is_decimal(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if objects else column.to_pylist()


class ScopeState:
    """Physical, allocated and reserved totals of one scope, and its open reservations."""

    def __init__(self) -> None:
        self.physical = self.allocated = self.reserved = Decimal(0)
        self.reservations: dict[str, Decimal] = {}
        self.allocations: dict[str, tuple[Decimal, str | None]] = {}
        self.keys: dict[str, str] = {}
        self.held = False

    @property
    def available(self) -> Decimal:
        free = Decimal(0) if self.held else self.physical - self.allocated
        return max(free - self.reserved, Decimal(0))

    def apply(self, kind: str, quantity: Decimal, command_id: str, reference: str | None) -> str | None:
        """Why the command is rejected, or None once it is applied."""
        if kind in ("receipt", "issue", "reserve", "allocate") and quantity <= 0:
            return "quantity_not_positive"
        if kind == "receipt":
            self.physical += quantity
        elif kind == "issue":
            if quantity > self.physical:
                return "insufficient_physical"
            if self.physical - quantity < self.allocated + self.reserved:
                return "strands_commitments"
            self.physical -= quantity
        elif kind == "reserve":
            if quantity > self.available:
                return "insufficient_availability"
            self.reserved += quantity - self.reservations.get(command_id, NOTHING)
            self.reservations[command_id] = quantity
        elif kind == "release":
            if reference not in self.reservations:
                return "reservation_not_open"
            self.reserved -= self.reservations.pop(reference)
        elif kind == "allocate":
            if self.held:
                return "held"
            if reference is None:
                if quantity > self.available:
                    return "insufficient_availability"
            elif reference not in self.reservations:
                return "reservation_not_open"
            elif quantity > self.reservations[reference]:
                return "exceeds_reservation"
            if quantity > self.physical - self.allocated:
                return "insufficient_free_quantity"
            if reference is not None:
                self.reservations[reference] -= quantity
                self.reserved -= quantity
            self.allocated += quantity
            self.allocations[command_id] = (quantity, reference)
        elif kind == "deallocate":
            if reference not in self.allocations:
                return "allocation_not_open"
            back, reservation = self.allocations.pop(reference)
            self.allocated -= back
            if reservation in self.reservations:
                self.reservations[reservation] += back
                self.reserved += back
        elif kind == "consume":
            if reference not in self.allocations:
                return "allocation_not_open"
            back, _ = self.allocations.pop(reference)
            self.allocated -= back
            self.physical -= back
        elif kind in ("hold", "unhold"):
            self.held = kind == "hold"
        else:
            return "unknown_command"
        return None


def replay_scopes(commands: DataFrame) -> DataFrame:
    """Decisions on ``commands`` (command_id, scope, kind, quantity, reference, idempotency_key, fingerprint, recorded_at).

    A repeated key with the same fingerprint is accepted as a replay, with another one it is a conflict;
    a rejected command doesn't use up its key.
    """

    def decided(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, scope, first = ScopeState(), None, True
        for batch in rows:
            out: list[tuple[bool, str | None, Decimal]] = []
            for at, kind, quantity, command_id, reference, key, fingerprint in zip(*[_values(batch.column(c)) for c in ("scope", "kind", "quantity", "command_id", "reference", "idempotency_key", "fingerprint")], strict=True):
                if first or at != scope:
                    state, scope, first = ScopeState(), at, False
                if key is not None and key in state.keys:
                    same = state.keys[key] == fingerprint
                    out.append((same, "replayed" if same else "idempotency_conflict", state.available))
                    continue
                why = state.apply(kind, NOTHING if quantity is None else quantity, command_id, reference)
                if why is None and key is not None:
                    state.keys[key] = fingerprint
                out.append((why is None, why, state.available))
            accepted, reason, available = zip(*out, strict=True) if out else ((), (), ())
            told = [pa.array(accepted, pa.bool_()), pa.array(reason, pa.string()), pa.array(available, pa.decimal128(24, 6))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("command_id", "scope", "kind")], *told], ["command_id", "scope", "kind", "accepted", "reason", "available"])

    own = commands.select("command_id", "scope", "kind", "quantity", "reference", "idempotency_key", "fingerprint", "recorded_at")
    return in_order(own, "scope").mapInArrow(decided, DECISIONS)


WORK_DECISIONS = "command string, task int, state string, accepted boolean, reason string"


class WorkState:
    """A work with its tasks by sequence, and the resource that claimed it."""

    def __init__(self, tasks: int) -> None:
        self.state, self.owner = "planned", None
        self.tasks = dict.fromkeys(range(1, tasks + 1), "pending")

    def _next(self, after: int = 0) -> int | None:
        return next((t for t, state in self.tasks.items() if t > after and state not in ("completed", "cancelled")), None)

    def apply(self, command: str, task: int | None, resource: str | None) -> str | None:
        """Why the command is rejected, or None once it is applied."""
        step = getattr(self, f"_{command}", None) if command in ("release", "claim", "start", "confirm", "raise", "resume", "cancel") else None
        return "unknown_command" if step is None else step(task, resource)

    def _release(self, task: int | None, resource: str | None) -> str | None:
        first = self._next()
        if self.state != "planned" or first is None or set(self.tasks.values()) != {"pending"}:
            return "not_planned"
        self.state, self.tasks[first] = "released", "ready"
        return None

    def _claim(self, task: int | None, resource: str | None) -> str | None:
        if self.state != "released":
            return "not_released"
        self.state, self.owner = "assigned", resource
        return None

    def _start(self, task: int | None, resource: str | None) -> str | None:
        if self.state not in ("assigned", "in_progress"):
            return "not_executable"
        if self.tasks.get(task) != "ready":
            return "task_not_ready"
        if self._next() != task:
            return "sequence_skipped"
        if resource != self.owner:
            return "not_the_assigned_resource"
        self.state = self.tasks[task] = "in_progress"
        return None

    def _confirm(self, task: int | None, resource: str | None) -> str | None:
        if self.tasks.get(task) != "in_progress" or resource != self.owner:
            return "no_live_execution"
        self.tasks[task] = "completed"
        if (after := self._next(task)) is not None:
            self.tasks[after] = "ready"
        else:
            self.state, self.owner = "completed", None
        return None

    def _raise(self, task: int | None, resource: str | None) -> str | None:
        if self.tasks.get(task) != "in_progress" or resource != self.owner:
            return "no_live_execution"
        self.state = self.tasks[task] = "exception"
        return None

    def _resume(self, task: int | None, resource: str | None) -> str | None:
        if self.tasks.get(task) != "exception":
            return "no_open_exception"
        self.state, self.tasks[task] = "assigned", "ready"
        return None

    def _cancel(self, task: int | None, resource: str | None) -> str | None:
        if self.state not in ("planned", "released", "assigned") or not set(self.tasks.values()) <= {"pending", "ready", "cancelled"}:
            return "execution_began"
        self.state, self.owner = "cancelled", None
        self.tasks = dict.fromkeys(self.tasks, "cancelled")
        return None


def replay_works(commands: DataFrame) -> DataFrame:
    """Decisions on ``commands`` (work_id, command_id, command, task, tasks, resource_id, recorded_at); ``tasks``: how many the work has."""

    def decided(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, current, first = WorkState(0), None, True
        for batch in rows:
            out: list[tuple[str, bool, str | None]] = []
            for work_id, most, command, task, resource in zip(*[_values(batch.column(c)) for c in ("work_id", "most", "command", "task", "resource_id")], strict=True):
                if first or work_id != current:
                    work, current, first = WorkState(most or 0), work_id, False
                why = work.apply(command, task, resource)
                out.append((work.state, why is None, why))
            state, accepted, reason = zip(*out, strict=True) if out else ((), (), ())
            told = [pa.array(state, pa.string()), pa.array(accepted, pa.bool_()), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("work_id", "command_id", "command")], batch.column("task").cast(pa.int32()), *told], ["work_id", "command_id", "command", "task", "state", "accepted", "reason"])

    kinds = dict(commands.dtypes)
    own = commands.select("work_id", "command_id", "command", "task", "tasks", "resource_id", "recorded_at")
    most = F.max("tasks").over(Window.partitionBy("work_id").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return in_order(own, "work_id").withColumn("most", most).sortWithinPartitions("work_id", *_order()).mapInArrow(decided, f"work_id {kinds['work_id']}, command_id {kinds['command_id']}, {WORK_DECISIONS}")
