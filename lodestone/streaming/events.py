"""Request-log analytics and stateful serving as Structured Streaming, over ``events`` (ts, user_id, event_type, value).

Late data: rows older than the watermark are dropped, windows are final once it has passed them (our own policy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import SECOND, admissions, expiring_hits

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Event time as a timestamp in the session's zone: watermarks do not take zoneless ones."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def aggregates() -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("largest")]


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(*aggregates()).select(F.col("w.start").alias("start"), "event_type", "n", "total", "largest")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(*aggregates()).select(F.col("w.start").alias("start"), "n", "total", "largest")


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def limited(events: DataFrame, limit: int, window_s: float, late: str = "1 hour") -> DataFrame:
    """Sliding-log limiter for each user: (user_id, event_id, allowed), decided in event time.

    State: the last ``limit`` admitted times; it goes once the watermark says that no call can meet them any more. Within a batch
    calls are taken in the order of their time; calls later than the watermark are dropped, others that come in a later batch than
    younger calls are decided after them. Of a user's batch only times and ids are held."""
    window = round(window_s * SECOND)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        earlier = np.array(state.get[0], np.int64) if state.exists else np.zeros(0, np.int64)
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(b["ts"].astype("datetime64[us]").to_numpy().astype(np.int64), b["event_id"].to_numpy()) for b in batches]
        times, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        wait, last = admissions(np.maximum(times, earlier[-1]) if len(earlier) else times, limit, window, earlier)
        state.update((last.tolist(),))
        state.setTimeoutTimestamp(max((int(times[-1]) + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": np.full(len(ids), key[0]), "event_id": ids, "allowed": wait == 0})

    timed = events.withWatermark("ts", late).select("user_id", "event_id", "ts")
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "admitted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_questions(questions: DataFrame, key: str, ttl_s: float, late: str = "1 hour") -> DataFrame:
    """Cache misses of a stream: (key, event_id, ts) of the first question of each key and of each after its entry's time to live.

    State: when the key's entry was put; it goes once the watermark says that it has expired."""
    ttl, kind = round(ttl_s * SECOND), questions.schema[key].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [(b["ts"].astype("datetime64[us]").to_numpy().astype(np.int64), b["event_id"].to_numpy()) for b in batches]
        times, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((ids, times))
        hit, born = expiring_hits(times[order], ttl, state.get[0] if state.exists else None)
        state.update((born,))
        state.setTimeoutTimestamp(max((born + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        missed = order[~hit]
        yield pd.DataFrame({"key": [keys[0]] * len(missed), "event_id": ids[missed], "ts": pd.to_datetime(times[missed], unit="us")})

    timed = questions.withWatermark("ts", late).select(F.col(key).alias("key"), "event_id", "ts")
    return timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, ts timestamp", "born long", "append", GroupStateTimeout.EventTimeTimeout)
