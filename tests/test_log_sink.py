"""The request log as the sink of a stream: killed and started again, turned over, with late rows."""

from __future__ import annotations

import json
import os

import pytest

from lodestone.sources import shared, store


def source(spark, folder, files):
    """A stream of JSON files, one a batch."""
    for i, rows in enumerate(files):
        name = f"{folder}/{i:03d}.json".replace("file://", "")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema("question string, found boolean, asked_at timestamp").option("maxFilesPerTrigger", 1).json(folder)


def run(stream, sink, checkpoint):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def questions(spark, path):
    return sorted(r.question for r in store.read_log(spark, path).collect())


def test_a_killed_stream_that_starts_again_logs_each_row_once(spark):
    base = shared.fresh_path(spark, "sink")
    stream = source(spark, f"{base}/in", [[{"question": f"q{b}{i}", "found": True} for i in range(3)] for b in range(4)])
    plain, died = store.LogSink(f"{base}/log"), []

    def kill(rows, batch):
        plain(rows, batch)
        if batch == 1 and not died:  # the batch is in the log, but Spark does not know yet
            died.append(batch)
            raise KeyError("killed")

    with pytest.raises(Exception):
        run(stream, kill, f"{base}/checkpoint")
    assert died and len(questions(spark, f"{base}/log")) == 6
    run(stream, kill, f"{base}/checkpoint")
    assert questions(spark, f"{base}/log") == sorted(f"q{b}{i}" for b in range(4) for i in range(3))
    plain(spark.createDataFrame([("again", True)], "question string, found boolean"), 2)
    assert "again" not in questions(spark, f"{base}/log")


def test_a_batch_that_was_cut_off_is_written_anew_and_the_log_turns_over(spark):
    base = shared.fresh_path(spark, "sink")
    rows = lambda *q: spark.createDataFrame([(x, True) for x in q], "question string, found boolean")
    sink = store.LogSink(f"{base}/log", most_bytes=10)
    sink(rows("a", "b"), 0)
    shared.remove(spark, f"{base}/log/stream-{0:012d}/_SUCCESS")
    sink(rows("a", "b"), 0)
    every = [q for log in ("log", "log.1") if store.exists(spark, f"{base}/{log}") for q in questions(spark, f"{base}/{log}")]
    assert sorted(every) == ["a", "b"] and questions(spark, f"{base}/log") == ["a", "b"]
    sink(rows("c"), 1)
    assert questions(spark, f"{base}/log") == ["c"] and questions(spark, f"{base}/log.1") == ["a", "b"]
    sink(rows("c"), 1)
    assert questions(spark, f"{base}/log") == ["c"]


def test_late_rows_are_kept_apart(spark):
    base = shared.fresh_path(spark, "sink")
    at = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    files = [[{"question": "first", "asked_at": at(30)}], [{"question": "late", "asked_at": at(10)}, {"question": "fine", "asked_at": at(25)}, {"question": "timeless"}], [{"question": "last", "asked_at": at(31)}]]
    run(source(spark, f"{base}/in", files), store.LogSink(f"{base}/log", time="asked_at", late_s=600), f"{base}/checkpoint")
    assert questions(spark, f"{base}/log") == ["fine", "first", "last", "timeless"] and questions(spark, f"{base}/log-late") == ["late"]
