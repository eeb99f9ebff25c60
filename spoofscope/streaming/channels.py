"""Receiver tracking rows as a stream: overlapping windows from keyed state.

Every channel keeps a ring buffer in state: the rows that a window to come
still needs, at most one window's worth besides the newest rows.  A window is
emitted once and whole, in the micro-batch in which its last row arrives, so a
micro-batch sink can reduce it with the batch operator.  When a channel has
been silent for the watermark's delay, a timer emits its trailing windows and
the state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spoofscope.operators import tracking as trk
from spoofscope.session import ship_package
from spoofscope.streaming.state import timer, use_rocksdb

#: A channel that is silent for so long, in event time, is over.
SILENCE = "10 minutes"


class ChannelWindows(StatefulProcessor):
    """Rows of one channel -> (row, rn, window_id, late)."""

    def __init__(self, schema: T.StructType, order: Sequence[str], time_ms: str, size: int, step: int) -> None:
        self.schema, self.size, self.step = schema, size, step
        self.places = [schema.fieldNames().index(c) for c in order]
        self.time = schema.fieldNames().index(time_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        # position of the first held row, next window, position after the last emitted row, registered timer
        self.place = handle.getValueState("place", "first bigint, window bigint, sent bigint, due bigint")

    def _order(self, row: Sequence[Any]) -> tuple:
        return tuple((row[p] is not None, row[p]) if row[p] is not None else (False, 0) for p in self.places)

    def _emitted(self, rows: list[tuple], first: int, window: int) -> Iterator[Row]:
        start = window * self.step
        for at in range(max(start, first), min(start + self.size, first + len(rows))):
            yield self._out(rows[at - first], at, window, False)

    def _out(self, row: tuple, at: int | None, window: int | None, late: bool) -> Row:
        return Row(*self.schema.fieldNames(), "rn", "window_id", "late")(*row, at, window, late)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, window, sent, due = self.place.get() if self.place.exists() else (0, 0, 0, None)
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        new = [tuple(r) for r in rows]
        fixed = max(0, sent - first)
        if fixed:  # what has been emitted can't be renumbered
            last = self._order(held[fixed - 1])
            for r in new:
                if self._order(r) < last:
                    yield self._out(r, None, None, True)
            new = [r for r in new if self._order(r) >= last]
        held = held[:fixed] + sorted(held[fixed:] + new, key=self._order)
        while first + len(held) >= window * self.step + self.size:
            yield from self._emitted(held, first, window)
            sent = window * self.step + self.size
            window += 1
        keep = min(max(window * self.step - first, 0), len(held))
        held, first = held[keep:], first + keep
        # the watermark is behind by the allowed silence already
        due = timer(self.handle, due, max([t for t in [due, *(r[self.time] for r in new)] if t is not None], default=None))
        self.held.put(held) if held else self.held.clear()
        self.place.update((first, window, sent, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first, window, _, _ = self.place.get()
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        while window * self.step < first + len(held):
            yield from self._emitted(held, first, window)
            window += 1
        self.held.clear()
        self.place.clear()

    def close(self) -> None:
        pass


def window_stream(rows: DataFrame, size: int = trk.WINDOW_SIZE, step: int = trk.WINDOW_STEP, keys: Sequence[str] = trk.GROUP_KEYS,
                  order: Sequence[str] = ("PRN_start_sample_count",), event_time: str = "event_time", silence: str = SILENCE) -> DataFrame:
    """The stream twin of ``tracking_windows`` over cleaned rows with an
    ``event_time``: every row once per window, with ``rn``, ``window_id`` and
    ``late``.

    Rows may come in any order as long as no window has been emitted with a
    later row of their channel; such rows come out once, with ``late`` set
    and no window.  Windows come out whole; the trailing ones of a channel
    when it has been silent for ``silence``.
    """
    if step > size:
        raise ValueError("windows must touch: step is larger than size")
    use_rocksdb(rows.sparkSession)
    ship_package(rows.sparkSession)
    timed = rows.withWatermark(event_time, silence).withColumn("_ms", F.unix_millis(event_time))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in timed.schema.fields])
    out = T.StructType([*schema.fields, T.StructField("rn", T.LongType()), T.StructField("window_id", T.LongType()), T.StructField("late", T.BooleanType())])
    return timed.groupBy(*keys).transformWithState(ChannelWindows(schema, list(order), "_ms", size, step), out, "append", "EventTime").drop("_ms")
