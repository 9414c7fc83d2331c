"""Folds over a stream in the order of its events, whatever order they come in, with state that ends.

Every key keeps what its fold needs and the events that are still to be put in order: an event waits until the watermark
is past it, so events may be late by the watermark's delay. A timer a key, set to its first waiting event, takes them out
in order; the fold's state is dropped once a key has had no event for `idle_seconds`. What a key holds is bounded by the
delay, not by its backlog, and rows go through one by one. A restart from the checkpoint goes on where the state is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.session import python_ready

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: state, an event's values -> the next state and what comes out of it (None: nothing).
Step = Callable[..., tuple[tuple, tuple | None]]


class InOrder(StatefulProcessor):
    """Waiting events and the fold's state of a key."""

    def __init__(self, start: tuple, state_kind: StructType, event_kind: StructType, step: Step, names: tuple[str, ...], idle_ms: int):
        self.start, self.state_kind, self.event_kind, self.step, self.names, self.idle = start, state_kind, event_kind, step, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", self.state_kind)
        place = StructType([StructField("at", LongType()), StructField("nth", LongType())])
        self.waiting = handle.getMapState("waiting", place, self.event_kind)
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))

    def _ring(self, at: int) -> None:
        """One timer a key: the earliest that is wanted."""
        set_for = self.due.get()[0] if self.due.exists() else None
        if set_for is not None and set_for <= at:
            return
        if set_for is not None:
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = None
        for row in rows:
            at = row["event_ms"]
            self.waiting.updateValue((at, row["event_nth"]), tuple(row[c] for c in self.event_kind.names))
            first = at if first is None else min(first, at)
        if first is not None:
            self._ring(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        past = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        held = sorted(((place[0], place[1]), tuple(values)) for place, values in self.waiting.iterator())
        state = tuple(self.folded.get()) if self.folded.exists() else self.start
        last = None
        out = []
        for (at, nth), values in held:
            if at > past:
                self._ring(at)
                break
            state, made = self.step(state, *values)
            self.waiting.removeKey((at, nth))
            last = at
            if made is not None:
                out.append(Row(*self.names)(key[0], nth, *made))
        if last is not None:
            self.folded.update(state)
            if not self.due.exists():
                self._ring(last + self.idle)
        elif not self.due.exists():
            self.folded.clear()  # nothing for so long
        return iter(out)

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, order: str, values: dict[str, str], start: tuple, state: str, step: Step, returns: str, delay: str, idle_seconds: float, time: str = "ts") -> DataFrame:
    """Each event's result of an ordered fold: key, order and the columns `returns`.

    events: a stream with key, time (a timestamp), order (whole numbers, none twice in a key; they settle equal times)
    and values (name to type). state: the type of the fold's state, a DDL. Events without a key, a time or an order are left out.
    """
    spark = events.sparkSession
    python_ready(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keeps state on disk, and timers
    timed = events.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull()).withWatermark(time, delay)
    slim = timed.select(key, time, F.unix_millis(time).alias("event_ms"), F.col(order).cast("long").alias("event_nth"), *values)
    kind = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in values.items()))
    out = StructType.fromDDL(f"{key} {events.schema[key].dataType.simpleString()}, {order} long, {returns}")
    processor = InOrder(start, StructType.fromDDL(state), kind, step, tuple(out.names), int(idle_seconds * 1000))
    return slim.groupBy(key).transformWithState(processor, out, "Append", "EventTime")
