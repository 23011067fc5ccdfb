"""Per-key state over logs in batch: rate limiter and expiring caches, as array passes over sorted times.

Both rules let a stretch of rows go by without a change of state, so a pass does not walk the rows: it jumps from one change to
the next by binary search. Of a key only its last changes are kept between Arrow batches, however many rows it has. Times are
whole microseconds, so nothing is rounded.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000


def admissions(times: np.ndarray, limit: int, window: int, earlier: np.ndarray = np.zeros(0, np.int64)) -> tuple[np.ndarray, np.ndarray]:
    """(wait, last admitted times) of calls at ascending ``times``: 0 for one that passes, else the time until one would.

    A call passes if the ``limit``-th last admitted one is ``window`` ago or more; refused calls do not count. A limit of 0 is off."""
    if limit <= 0:
        return np.zeros(len(times), np.int64), earlier
    passed, at = list(earlier[-limit:]), 0
    known, places = len(passed), []
    while True:
        if len(passed) >= limit:
            at = max(at, int(np.searchsorted(times, passed[-limit] + window)))
        if at >= len(times):
            break
        places.append(at)
        passed.append(int(times[at]))
        at += 1
    wait = np.zeros(len(times), np.int64)
    refused = np.setdiff1d(np.arange(len(times)), places)
    if len(refused):
        before = known + np.searchsorted(np.array(places, np.int64), refused)  # admitted calls ahead of each refused one
        wait[refused] = np.array(passed)[before - limit] + window - times[refused]
    return wait, np.array(passed[-limit:], np.int64)


def expiring_hits(times: np.ndarray, ttl: int, born: int | None = None) -> tuple[np.ndarray, int | None]:
    """(hit, when the entry was put) of one entry asked for at ascending ``times``; it is gone when older than ``ttl``, and a hit does not renew it."""
    hit, at = np.ones(len(times), bool), 0
    while True:
        if born is not None:
            at = max(at, int(np.searchsorted(times, born + ttl, "right")))
        if at >= len(times):
            return hit, born
        hit[at], born = False, int(times[at])


class RecentEntries:
    """A cache of the ``size`` keys asked for last, whose entries expire after ``ttl``.

    As every question touches its key, the keys held are those of the latest ``size`` distinct places, so the places alone tell
    whether an entry is still there."""

    def __init__(self, size: int, ttl: int):
        self.size, self.ttl, self.clock = size, ttl, 0
        self.places: list[int] = []  # ascending: where each held key was last asked for
        self.of: dict[object, tuple[int, int]] = {}  # key: its place, when its entry was put
        self.key_at: dict[int, object] = {}

    def ask(self, key: object, now: int) -> bool:
        if self.size <= 0:
            return False
        self.clock += 1
        place, born = self.of.get(key, (-1, 0))
        fresh = place >= 0 and now - born <= self.ttl
        if place >= 0:
            del self.places[bisect.bisect_left(self.places, place)], self.key_at[place]
        self.places.append(self.clock)
        self.of[key], self.key_at[self.clock] = (self.clock, born if fresh else now), key
        if len(self.places) > self.size:
            del self.of[self.key_at.pop(self.places.pop(0))]
        return fresh


def _per_key(events: DataFrame, key: str, order: list[str], start: Callable, step: Callable, column: str, kind: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """``step(state, times, *extra)`` -> (values, state) for each stretch of one key, in order; state lasts over Arrow batches."""
    names = events.columns
    timed = events.withColumn("__us", F.unix_micros(F.col(order[0]).cast("timestamp"))).withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\0")))  # a null is a key of its own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            keys = batch["__key"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            parts = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != last:
                    last, state = keys[lo], start()
                values, state = step(state, batch["__us"].to_numpy()[lo:hi], *(batch[c].to_numpy()[lo:hi] for c in extra))
                parts.append(values)
            yield batch[names].assign(**{column: np.concatenate(parts) if parts else []})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + f", {column} {kind}"
    return timed.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limited(events: DataFrame, key: str, order: list[str], limit: int, window: float) -> DataFrame:
    """``events`` with ``wait_s`` (one place): 0 for calls that pass. At most ``limit`` calls of a key in ``window`` seconds."""

    def step(earlier: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wait, last = admissions(times, limit, round(window * SECOND), earlier)
        return np.where(wait > 0, np.maximum(np.round(wait / SECOND, 1), 0.1), 0.0), last

    return _per_key(events, key, order, lambda: np.zeros(0, np.int64), step, "wait_s", "double")


def cache_hits(events: DataFrame, key: str, order: list[str], ttl: float) -> DataFrame:
    """``events`` with ``hit``: the key's entry is there and not older than ``ttl`` seconds; only misses put one."""
    return _per_key(events, key, order, lambda: None, lambda born, times: expiring_hits(times, round(ttl * SECOND), born), "hit", "boolean")


def recent_hits(events: DataFrame, cache: str, key: str, order: list[str], size: int, ttl: float) -> DataFrame:
    """``events`` with ``hit``, of one least-recently-used cache for each value of ``cache`` (a server, a process)."""

    def step(held: RecentEntries, times: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, RecentEntries]:
        return np.fromiter((held.ask(k, int(t)) for k, t in zip(keys, times, strict=True)), bool, len(times)), held

    return _per_key(events, cache, order, lambda: RecentEntries(size, round(ttl * SECOND)), step, "hit", "boolean", [key])
