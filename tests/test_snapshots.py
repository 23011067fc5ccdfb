"""Collections: changes touch few buckets, readers keep their snapshot, a crash changes nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import shared, snapshots
from lodestone.sources.snapshots import Collection, Conflict


@pytest.fixture
def made(spark, request):
    c = Collection(spark, shared.fresh_path(spark, "collection"), "doc", 32)
    c.upsert(spark.range(2000).selectExpr("id AS doc", "id * 10 AS v"))
    return c


def content(rows):
    return {r.doc: r.v for r in rows.collect()}


def files(spark, path):
    where, fs = shared.located(spark, path)
    found, it = {}, fs.listFiles(where, True)
    while it.hasNext():
        f = it.next()
        if f.getPath().getName().endswith(".parquet"):
            found[f.getPath().toString()] = f.getLen()
    return found


def test_an_upsert_writes_only_the_buckets_of_its_keys(spark, made):
    before, first = files(spark, made.path), made.manifest()
    of = spark.range(2000).select("id", F.pmod(F.xxhash64("id"), F.lit(32)).alias("b"))
    keys = [r.id for r in of.where("b = 5").orderBy("id").limit(20).collect()]  # one hundredth of the keys
    now = made.upsert(spark.createDataFrame([(k, -k) for k in keys] + [(10_000, 1)], "doc long, v long"))
    changed = {b for b in range(32) if first.segments.get(b) != now.segments.get(b)}
    assert 5 in changed and len(changed) <= 2
    after = files(spark, made.path)
    assert before.items() <= after.items() and sum(after.values()) - sum(before.values()) < sum(before.values()) / 5
    want = {i: i * 10 for i in range(2000)} | {k: -k for k in keys} | {10_000: 1}
    assert content(made.read()) == want


def test_readers_keep_their_snapshot(spark, made):
    old = made.read()
    made.upsert(spark.createDataFrame([(1, 0)], "doc long, v long"))
    made.delete(spark.createDataFrame([(2,), (3,)], "doc long"))
    assert content(old)[1] == 10 and 2 in content(old)
    now = content(made.read())
    assert now[1] == 0 and 2 not in now and len(now) == 1998
    assert content(made.read(1)) == {i: i * 10 for i in range(2000)}


def test_a_crash_before_the_rename_changes_nothing(spark, made, monkeypatch):
    def crash(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Collection, "_publish", crash)
        with pytest.raises(KeyboardInterrupt):
            made.upsert(spark.createDataFrame([(1, 0)], "doc long, v long"))
    assert made.versions() == [1] and content(made.read())[1] == 10
    made.upsert(spark.createDataFrame([(4, 0)], "doc long, v long"))
    assert content(made.read())[4] == 0 and content(made.read())[1] == 10
    assert made.vacuum(1) == 1 and content(made.read())[4] == 0  # the crashed segment


def test_a_change_that_comes_second_keeps_the_first(spark, made, monkeypatch):
    plain, other, raced = Collection._publish, Collection(spark, made.path), []

    def race(self, manifest):
        if not raced:
            raced.append(1)
            other.upsert(spark.createDataFrame([(1, 111)], "doc long, v long"))
        return plain(self, manifest)

    monkeypatch.setattr(Collection, "_publish", race)
    made.upsert(spark.createDataFrame([(2, 222)], "doc long, v long"))
    now = content(made.read())
    assert (now[1], now[2]) == (111, 222) and made.versions() == [1, 2, 3]
    monkeypatch.setattr(Collection, "_publish", lambda *_: False)
    with pytest.raises(Conflict):
        made.upsert(spark.createDataFrame([(2, 0)], "doc long, v long"))


def test_random_changes_equal_a_dictionary(spark):
    rng = random.Random(8)
    c, want = Collection(spark, shared.fresh_path(spark, "collection"), "doc", 4), {}
    for step in range(8):
        rows = {rng.randrange(60): rng.randrange(1000) for _ in range(25)}
        c.upsert(spark.createDataFrame(list(rows.items()), "doc long, v long"))
        want |= rows
        gone = [rng.randrange(60) for _ in range(8)]
        c.delete(spark.createDataFrame([(k,) for k in gone], "doc long"))
        want = {k: v for k, v in want.items() if k not in gone}
        if step % 3 == 2:
            m = c.compact(3)
            assert max(map(len, m.segments.values())) <= 3
            c.vacuum(1)
        assert content(c.read()) == want


def test_only_changed_rows_and_new_columns(spark, made):
    rows = spark.createDataFrame([(1, 10), (2, 21), (5000, 7)], "doc long, v long")
    assert sorted(r.doc for r in made.changed(rows).collect()) == [2, 5000]
    made.upsert(spark.createDataFrame([(9, 90, "x")], "doc long, v long, note string"))
    assert {r.doc: r.note for r in made.read().where("doc in (8, 9)").collect()} == {8: None, 9: "x"}
    twice = spark.createDataFrame([(7, 1), (7, 2), (7, 1)], "doc long, v long")
    made.upsert(twice)
    assert content(made.read().where("doc = 7"))[7] in (1, 2) and made.read().where("doc = 7").count() == 1


def test_an_empty_place_and_empty_changes(spark, made):
    nothing = Collection(spark, shared.fresh_path(spark, "collection"))
    with pytest.raises(FileNotFoundError):
        nothing.read()
    assert nothing.manifest() == snapshots.Manifest() and nothing.vacuum() == 0
    assert made.upsert(spark.createDataFrame([], "doc long, v long")).version == 1
    assert made.compact().version == 1
