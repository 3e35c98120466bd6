"""Sessions kept open in state of their own, and given out as they close.

The state of a user is the sessions that may still grow: a start, a last event
and a count each, at most one per gap of the time not yet closed, however many
events there were. A timer at the first end wakes the user up without any event.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assetloom.operators.activity import IDLE_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OPEN = "starts array<bigint>, lasts array<bigint>, counts array<bigint>"
_SESSIONS = "user_id {}, session_start bigint, session_end bigint, events bigint"
_Session = Row("user_id", "session_start", "session_end", "events")
_EPOCH, _MICROSECOND = datetime(1970, 1, 1, tzinfo=UTC), timedelta(microseconds=1)
# Events of a user that are merged at once.
_PIECE = 10_000


@contextmanager
def state_beyond_the_heap(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which ``transformWithState`` asks for."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def merged(starts: np.ndarray, lasts: np.ndarray, counts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sessions, in any order, joined where one begins at most ``gap`` after another's last event."""
    if not len(starts):
        return starts, lasts, counts
    order = np.argsort(starts, kind="stable")
    starts, lasts, counts = starts[order], lasts[order], counts[order]
    reach = np.maximum.accumulate(lasts)
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1] + gap))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1], np.add.reduceat(counts, first)


class SessionProcessor(StatefulProcessor):
    """Times are microseconds; a session closes once the watermark is past its last event and the gap.

    A user has one timer, at the first end of what is held, so the state tells
    it. Most users have few events in a micro-batch: rows are plain, as a
    pandas frame for each user costs more than its events.
    """

    def __init__(self, gap_seconds: int) -> None:
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = held = self._held()
        while at := [(row.ts - _EPOCH) // _MICROSECOND for row in islice(rows, _PIECE)]:
            at = np.array(at, np.int64)
            new = (at, at, np.ones(len(at), np.int64))
            held = merged(*(np.concatenate(pair) for pair in zip(held, new)), self.gap)
        return self._settled(key, before, held, timerValues, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        return self._settled(key, held, held, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _held(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(values, np.int64) for values in self.open.get() or ([], [], []))

    def _settled(self, key, before: tuple[np.ndarray, ...], held: tuple[np.ndarray, ...], timerValues, fired: int | None) -> Iterator[Row]:
        """Closed sessions go out; the others stay, with a timer at the first that can close."""
        wakes = lambda lasts: (lasts + self.gap) // 1000 + 1  # noqa: E731, milliseconds, as watermarks are
        starts, lasts, counts = held
        wake = wakes(lasts)
        still = wake > timerValues.getCurrentWatermarkInMs()
        timer = int(wakes(before[1]).min()) if len(before[1]) else None
        next_end = int(wake[still].min()) if still.any() else None
        if next_end is not None:
            self.open.update(tuple(values[still].tolist() for values in held))
        elif timer is not None:
            self.open.clear()
        if timer != next_end:
            if timer not in (None, fired):
                self.handle.deleteTimer(timer)
            if next_end is not None:
                self.handle.registerTimer(next_end)
        for start, last, count in zip(starts[~still].tolist(), lasts[~still].tolist(), counts[~still].tolist()):
            yield _Session(key[0], start, last + self.gap, count)


def session_state_stream(events: DataFrame, gap_seconds: int = IDLE_SECONDS, watermark: str = "2 hours") -> DataFrame:
    """``user_id, session_start, session_end, events`` of sessions as they close; events behind the watermark fall away.

    Neighbours at most ``gap_seconds`` apart share a session. Start it inside
    ``state_beyond_the_heap``.
    """
    kind = dict(events.dtypes)["user_id"]
    by_user = events.select("user_id", "ts").withWatermark("ts", watermark).groupBy("user_id")
    closed = by_user.transformWithState(SessionProcessor(gap_seconds), _SESSIONS.format(kind), "Append", "EventTime")
    return closed.withColumns({c: F.timestamp_micros(F.col(c)) for c in ("session_start", "session_end")})
