from __future__ import annotations

import random

import numpy as np
import pytest

from lodestone.llm import near_dedup as N

from . import helpers

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = helpers.WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n):
    """(id, text) -> (set size, component), by comparing all pairs; rows of one id hang together."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) or rows[i][0] == rows[j][0]:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def made(seed):
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(150):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
        else:
            w = ["shared"] * rng.randint(0, 2) + ["and the passage that many have in common here"] * rng.randint(0, 3) + [f"t{rng.randrange(3000)}" for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(w))
        rows.append((rng.randrange(10_000) * 200 + i, texts[-1].upper() if rng.random() < 0.2 else texts[-1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = made(seed)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Dedup(words=4))
    assert sorted(tuple(r) for r in got.select("id", "n", "component", "kept").collect()) == brute(rows, 4)


def test_mixed_buckets_are_compared_in_blocks(spark):
    """Without star rounds all links come from the blocks; tiny blocks split every bucket."""
    rows = made(3)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Dedup(words=4, rounds=0, block=3, salt_rows=2))
    assert sorted(tuple(r) for r in got.select("id", "n", "component", "kept").collect()) == brute(rows, 4)


def test_a_common_passage_makes_no_quadratic_rows(spark, monkeypatch):
    """Unlike documents that share half of their words, some of them near copies: large mixed buckets are broken up by further coordinates."""
    rng = random.Random(11)
    common = " ".join(f"c{i}" for i in range(44))
    rows = [(i, common + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))) for i in range(1200)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(0, 1200, 50)]
    seen, real = [], N._finer

    def finer(members, docs, how, text_col):
        out = real(members, docs, how, text_col)
        seen.append((N._block_rows(members, how), N._block_rows(out, how)))
        return out

    monkeypatch.setattr(N, "_finer", finer)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Dedup(words=4, block=1, rounds=1, comparisons=1, levels=2))
    assert {r.id: r.component for r in got.collect()} == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    before, after = seen[0]
    assert before > 20_000 and after < before / 4


def test_groups_in_slices(spark):
    """Groups held in slices of a few shingles give the same links."""
    rows = made(4)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), N.Dedup(words=4, rounds=0, held=120, salt_members=2))
    assert sorted(tuple(r) for r in got.select("id", "n", "component", "kept").collect()) == brute(rows, 4)


def test_intermediate_tables_go(spark):
    import glob

    from lodestone.llm import state

    folder = state.shared_dir(spark).removeprefix("file://") + "/lodestone/*"
    before = set(glob.glob(folder))
    N.near_duplicates(spark.createDataFrame(made(1)[:40], "doc_id long, text string"))
    assert len(set(glob.glob(folder)) - before) == 1


def test_table_equals_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in N.op2(spark, path).collect()) == brute(rows, 4)


def test_query_equals_sql(spark, duck):
    names, rows = duck("sf0.001", N.OP2_SQL)
    got = N.op2(spark, "/root/testdata/sf0.001").select(*names)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "bigint", "bigint", "boolean"]
    assert sorted(map(tuple, got.collect())) == sorted(rows)


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_documents(spark, clash):
    df = helpers.awkward(spark, clash)
    rows = [(r[0], r[1]) for r in helpers.AWKWARD if r[0] is not None]
    got = N.near_duplicates(df, N.Dedup(words=5))
    assert sorted(tuple(r) for r in got.where("id is not null").select("id", "n", "component", "kept").collect()) == brute(rows, 5)
    assert [(r.component, r.kept) for r in got.where("id is null").collect()] == [(None, True)] * 2
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    lowest = {c for _, _, c, _ in brute(rows, 5)}
    assert sorted(i for i in ids if i is not None) == sorted(lowest) and ids.count(None) == 2
    assert N.near_duplicates(helpers.empty(spark)).count() == 0 and N.drop_near_duplicates(helpers.empty(spark)).count() == 0


def test_components_of_long_chains(spark):
    order = list(range(400))
    random.Random(5).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299)] + [(order[i], order[i + 1]) for i in range(300, 399)]
    got = dict(N.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: min(part) for part in (order[:300], order[300:]) for x in part}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    grams = np.concatenate([np.sort(base), np.sort(np.concatenate([base[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))])
    sig = N.signatures(grams, np.array([0, 1000, 2000]), 512, 3)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.07
    pieces = N.signatures(grams, np.array([0, 1000, 2000]), 64, 3, piece=128)
    assert (pieces == sig[:, :64]).all()


def test_a_bucket_above_the_blocks_loses_no_link(spark):
    """Unlike documents with a long common passage, and near copies of some: one bucket of many blocks, every link of which is found."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common + [f"d{i}x{j}" for j in range(40)])) for i in range(260)]
    rows += [(1000 + i, rows[rng.randrange(260)][1] + f" tail{i}") for i in range(60)]
    how = N.Dedup(words=4, block=16, rounds=1, comparisons=0)
    assert how.levels == 0 and len(rows) > how.block * 16
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), how)
    assert sorted((r.id, r.n, r.component, r.kept) for r in got.collect()) == brute(rows, 4)


def test_components_of_a_hot_centre_are_salted(spark):
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(399, 1000)]
    found = N.components(spark.createDataFrame(links, "a long, b long"), salt_members=16)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in [*range(400), *range(1000, 1061)]}
