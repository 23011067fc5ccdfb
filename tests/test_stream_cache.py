"""The cache of recent questions as a stream: equal to its batch, bounded, kept over a restart, forgotten when all has expired."""

from __future__ import annotations

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.operators import state
from lodestone.streaming import caches

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = "event_id long, at long, server string, question string"


def put(spark, where, number, rows):
    """One file, hence one batch: rows (event_id, seconds, server, question)."""
    made = spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.col("at"))).drop("at")
    raw = where.parent / f"{where.name}-{number}"
    made.coalesce(1).write.parquet(f"file://{raw}")
    where.mkdir(exist_ok=True)
    shutil.move(next(raw.glob("*.parquet")), where / f"{number}.parquet")
    os.utime(where / f"{number}.parquet", (1_700_000_000 + number * 60,) * 2)


def served(spark, where, out, checkpoint, size, ttl, late="1 hour"):
    """Runs until all files are read; (rows of the sink, progress of the last batch)."""
    source = spark.readStream.schema("event_id long, server string, question string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{where}")
    made = caches.recent_questions(source, "server", "question", size, ttl, late)
    q = made.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{checkpoint}").outputMode("append").start()
    try:
        q.processAllAvailable()
        held = q.lastProgress["stateOperators"][0] if q.lastProgress else {}
    finally:
        q.stop()
    return sorted((r.event_id, r.hit) for r in spark.read.parquet(f"file://{out}").collect()), held


def table(spark, where):
    return spark.read.parquet(f"file://{where}")


@pytest.fixture(scope="module")
def questions():
    import random

    draw = random.Random(5)
    return [(i, i * 7, f"s{draw.randrange(2)}", f"q{int(draw.paretovariate(0.7)) % 40}" if draw.random() > 0.05 else None) for i in range(600)]


@pytest.mark.parametrize(("size", "ttl"), [(6, 300.0), (1, 50.0), (0, 100.0)])
def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path, questions, size, ttl):
    where = tmp_path / "in"
    for n in range(2):
        put(spark, where, n, questions[n * 200 : n * 200 + 200])
    served(spark, where, tmp_path / "out", tmp_path / "point", size, ttl)
    put(spark, where, 2, questions[400:])
    got, held = served(spark, where, tmp_path / "out", tmp_path / "point", size, ttl)  # a new query on the old checkpoint
    batch = state.recent_hits(table(spark, where), "server", "question", ["ts", "event_id"], size, ttl)
    assert got == sorted((r.event_id, r.hit) for r in batch.collect()) and len(got) == 600
    assert any(hit for _, hit in got) == (size > 0)
    assert held["numRowsTotal"] <= 2 * (2 * size + 1) + 4  # entries, places, clock and a timer with its index, of two servers


def test_all_goes_when_all_has_expired_and_late_rows_are_dropped(spark, tmp_path):
    where = tmp_path / "in"
    put(spark, where, 0, [(1, 0, "a", "x"), (2, 10, "a", "x"), (3, 20, "b", "x")])
    put(spark, where, 1, [(4, 90_000, "c", "y")])
    put(spark, where, 2, [(8, 90_005, "c", "z")])  # a batch's late rows are told by the watermark of the one before
    put(spark, where, 3, [(5, 30, "a", "x"), (6, 90_010, "a", "x"), (7, 90_020, "c", "y")])
    got, held = served(spark, where, tmp_path / "out", tmp_path / "point", 5, 600.0)
    assert got == [(1, False), (2, True), (3, False), (4, False), (6, False), (7, True), (8, False)]
    assert held["numRowsTotal"] <= (2 + 1 + 2) + (4 + 1 + 2)  # a has one key, c two; nothing of b is left
