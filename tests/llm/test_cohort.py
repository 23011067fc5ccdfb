from __future__ import annotations

import datetime as dt
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import cohort as C
from lodestone.llm import registry
from tests.conftest import comparable

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
EPOCH, UNTIL = dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 1)
COLUMNS = ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]


def crc(n):
    return zlib.crc32(str(n).encode())


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def plain(clicks, clients):
    """The cells by loops over clients."""
    rows, cells, starts = {r for r in clicks if r[1] is not None and r[3] is not None}, {}, {}
    city = {}
    for client, name in clients:
        if name is not None:
            city[client] = max(name, city.get(client, name))

    def known(r, state):
        if state:
            return True
        late = r[0] is not None and crc(r[0]) % 3 == 0
        return r[2] is not None and r[2] + dt.timedelta(days=crc(r[0]) % 100 if late else 0) < UNTIL

    for state in (0, 1):
        for r in rows:
            if known(r, state) and r[4] == "purchase":
                starts[state, r[3]] = min(micros(r[1]), starts.get((state, r[3]), 1 << 62))
    size = 3 * C.DAY
    for state in (0, 1):
        for r in rows:
            start = starts.get((state, r[3]))
            if start is None or not known(r, state) or micros(r[1]) < start:
                continue
            both = [starts[s, r[3]] // size for s in (0, 1) if (s, r[3]) in starts]
            users, cents = cells.setdefault((state, city.get(r[3]) or "", start // size, (micros(r[1]) - start) // size), [{}, 0])
            users[r[3]] = len(both) == 2 and both[0] != both[1]
            cells[(state, city.get(r[3]) or "", start // size, (micros(r[1]) - start) // size)][1] = cents + (0 if r[5] is None else math.floor(100 * r[5] + 0.5))
    return sorted([(*k, len(u), sum(map(crc, u)), sum(u.values()), c) for k, (u, c) in cells.items()], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select(COLUMNS).collect()], key=str)


def made(seed, n=3000, hot=0.4):
    rng = random.Random(seed)
    first = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = first + dt.timedelta(microseconds=rng.randrange(120 * C.DAY))
        rows.append((i if rng.random() < 0.98 else None, ts if rng.random() < 0.98 else None, ts + dt.timedelta(seconds=rng.randrange(9999)) if rng.random() < 0.95 else None,
                     7 if rng.random() < hot else rng.choice([None, *range(40)]), rng.choice(["purchase", "view", "view", None]), rng.choice([None, 1.005, 2.5, -3.335, 10.0]), None))
    return rows + rows[:300]


def test_query_equals_its_sql(spark, duck):
    df = registry.QUERIES["op12_cohort_retention"](spark, "/root/testdata/sf0.001")
    names, rows = duck("sf0.001", registry.ORACLE_SQL["op12_cohort_retention"])
    assert comparable([tuple(r) for r in df.collect()], df.columns, sorted(names)) == comparable(rows, names, sorted(names))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_loops_with_nulls_repeats_and_a_hot_client(spark, seed):
    clicks = made(seed)
    clients = [(i, f"city{i % 5}" if i % 7 else None) for i in range(30)] + [(None, "nowhere"), (3, "zz"), (3, None)]
    df = C.retention(spark.createDataFrame(clicks, CLICKS).repartition(3), spark.createDataFrame(clients, "client_id long, city string"), "2024-03-01 00:00:00")
    assert got(df) == plain(clicks, clients)


def test_hot_clients_are_dealt_and_change_nothing(spark, monkeypatch):
    clicks = spark.createDataFrame(made(3), CLICKS)
    clients = spark.createDataFrame([(7, "a")], "client_id long, city string")
    assert 7 in C.hot_clients(clicks)
    with_hot = got(C.retention(clicks, clients, "2024-03-01"))
    monkeypatch.setattr(C, "hot_clients", lambda *_: [])
    assert got(C.retention(clicks, clients, "2024-03-01")) == with_hot


def test_periods_are_exact_to_the_microsecond(spark):
    start = dt.datetime(2024, 1, 5, 13, 7, 1, 999_999)
    edge = start + dt.timedelta(days=3)
    rows = [(1, start, start, 1, "purchase", 1.0, None), (2, edge, edge, 1, "view", 1.0, None), (4, edge - dt.timedelta(microseconds=1), edge, 1, "view", 1.0, None), (5, start - dt.timedelta(microseconds=1), start, 1, "view", 1.0, None)]
    df = C.retention(spark.createDataFrame(rows, CLICKS), spark.createDataFrame([], "client_id long, city string"), "2025-01-01")
    final = [r for r in got(df) if r[0] == 1]
    assert [(r[3], r[7]) for r in final] == [(0, 200), (1, 100)]


def test_times_without_a_zone_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = [dt.datetime(2024, 3, 10, 2, 30, 0, 5), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(2024, 11, 3, 1, 30)]
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(C.micros(F.col("t")))
        assert sorted(r[0] for r in df.collect()) == sorted(map(micros, times))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], CLICKS)
    clients = spark.createDataFrame([(7, "a")], "client_id long, city string")
    assert C.retention(none, clients, "2024-03-01").collect() == []
    rows = made(4, 400)
    clicks = spark.createDataFrame(rows, CLICKS)
    for name in ("state", "at", "client", "salt", "pick", "early", "start0", "first0", "cents"):
        clicks = clicks.withColumn(name, F.lit("x"))
    assert got(C.retention(clicks, clients.withColumn("segment", F.lit("y")), "2024-03-01")) == plain(rows, [(7, "a")])
