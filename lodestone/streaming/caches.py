"""The cache of recent questions as state of a stream: least recently used goes first, entries expire in event time.

The state lies in the state store, in three parts: entries by key, keys by the place at which they were last asked for, and the clock. A batch reads the
entries that it asks for and writes those that it changed, so its work follows its rows, not the size of the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.state import SECOND


class _Held:
    """A map of the state store that a batch reads through and writes at its end, changed keys only."""

    def __init__(self, stored):
        self.stored, self.seen, self.before = stored, {}, {}

    def get(self, key):
        if key not in self.seen:
            self.seen[key] = self.before[key] = self.stored.getValue((key,)) if self.stored.containsKey((key,)) else None
        return self.seen[key]

    def put(self, key, value: tuple | None) -> None:
        self.get(key)
        self.seen[key] = value

    def save(self) -> None:
        for key, value in self.seen.items():
            if value is None and self.before[key] is not None:
                self.stored.removeKey((key,))
            elif value is not None and value != self.before[key]:
                self.stored.updateValue((key,), value)


class RecentQuestions(StatefulProcessor):
    """Rows (cache, key, event_id, ts) to (cache, event_id, hit); one cache of ``size`` keys for each value of ``cache``."""

    def __init__(self, size: int, ttl: int):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "place long, born long")
        self.places = handle.getMapState("places", "place long", "key string")
        self.clock = handle.getValueState("clock", "next long, oldest long, held long, newest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [(b["ts"].astype("datetime64[us]").to_numpy().astype(np.int64), b["event_id"].to_numpy(), b["key"].to_numpy()) for b in rows]
        times, ids, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        entries, places = _Held(self.entries), _Held(self.places)
        clock, oldest, held, newest = self.clock.get() if self.clock.exists() else (0, 0, 0, 0)
        hits = np.zeros(len(ids), bool)
        for i in order if self.size > 0 else ():
            asked, now = str(keys[i]), int(times[i])
            entry = entries.get(asked)
            hits[i] = entry is not None and now - entry[1] <= self.ttl
            if entry is not None:
                places.put(entry[0], None)
                held -= 1
            born = entry[1] if hits[i] else now
            entries.put(asked, (clock, born))
            places.put(clock, (asked,))
            clock, held, newest = clock + 1, held + 1, max(newest, born)
            while held > self.size:  # every place is passed once
                gone = places.get(oldest)
                if gone is not None:
                    entries.put(gone[0], None)
                    places.put(oldest, None)
                    held -= 1
                oldest += 1
        if self.size > 0:
            entries.save()
            places.save()
            self.clock.update((clock, oldest, held, newest))
            self._expire_at((newest + self.ttl) // 1000 + 1, timerValues)
        yield pd.DataFrame({"cache": np.full(len(ids), key[0]), "event_id": ids, "hit": hits})

    def _expire_at(self, when: int, timerValues: TimerValues) -> None:
        for earlier in list(self.handle.listTimers()):
            self.handle.deleteTimer(earlier)
        self.handle.registerTimer(max(when, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All entries have expired, so none can be asked for in time any more. (One that has expired stays until then: it holds its place.)"""
        for state in (self.entries, self.places, self.clock):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_questions(questions: DataFrame, cache: str, key: str, size: int, ttl_s: float, late: str = "1 hour") -> DataFrame:
    """(cache, event_id, hit) of a stream (``cache``, ``key``, event_id, ts), as ``operators.state.recent_hits`` gives them for a table; misses are what is to be answered.

    Within a batch questions are taken in the order of their time; those later than the watermark are dropped, others that come in a later batch than younger
    ones are decided after them. Null keys are one key, null caches one cache. State: ``size`` entries for each cache at most, none once the watermark says
    that all have expired. The session needs the RocksDB state store (``session`` sets it)."""
    kind = questions.schema[cache].dataType.simpleString()
    timed = questions.withWatermark("ts", late).select(F.col(cache).alias("cache"), F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("key"), "event_id", "ts")
    made = RecentQuestions(size, round(ttl_s * SECOND))
    return timed.groupBy("cache").transformWithStateInPandas(made, f"cache {kind}, event_id long, hit boolean", "append", "eventTime")
