from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lexical as L
from lodestone.llm import registry
from tests.conftest import comparable

from . import helpers

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(FOLD)))


def plain(docs, items, k=20):
    """(item, rank, id, score) by scoring every document for every item."""
    counted = [(d, t) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n_all, total, df = len(counted), sum(sum(t.values()) for _, t in counted), Counter(x for _, t in counted for x in t)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, t in counted:
            m = 100 - 25 + 25 * sum(t.values()) * n_all // total
            score = sum(times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * (10**9 * t[x] // (1000 * t[x] + 12 * m)) for x, times in terms(text).items() if x in t)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_query_equals_its_sql(spark, duck):
    df = registry.QUERIES["op13_ranked_search"](spark, "/root/testdata/sf0.001")
    names, rows = duck("sf0.001", registry.ORACLE_SQL["op13_ranked_search"])
    assert comparable([tuple(r) for r in df.collect()], df.columns, sorted(names)) == comparable(rows, names, sorted(names))
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


@pytest.mark.parametrize("shard", [20, 900, 10**9])
def test_awkward_rows_and_any_shard_size(spark, shard):
    docs = helpers.awkward(spark, clash=True)
    asked = [(1, "WORD1 word2 word2 one"), (2, None), (3, ""), (4, "nothing of this occurs"), (None, "two row"), (5, "é 漢字"), (1, "one two"), (1, "one two"), (6, " ".join(f"long{i}" for i in range(2000)))]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("shard", F.lit(1))
    got = sorted([tuple(r) for r in L.top_documents(docs, items, shard=shard).collect()], key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], asked)


def test_copies_tie_and_are_ranked_by_id(spark):
    rng = random.Random(5)
    docs = [(i, "the same passage about loans and rates") for i in rng.sample(range(10_000), 300)] + [(20_000 + i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    items = [(1, "loans rates a"), (2, "a b c"), (3, "j")]
    got = L.top_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), shard=300)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(docs, items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert L.top_documents(helpers.empty(spark), items).collect() == []
    assert L.top_documents(helpers.awkward(spark), items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_tree_search_is_exact_and_prunes(seed):
    rng = np.random.default_rng(seed)
    documents, vocabulary = int(rng.integers(1, 3000)), 60
    pairs = np.unique(rng.integers(0, documents * vocabulary, documents * 8))
    doc, term = pairs // vocabulary, pairs % vocabulary
    impact = rng.integers(1, 40 if seed % 2 else 1_000_000, len(pairs))
    tree = L.grown(term, doc, impact, documents)
    for _ in range(10):
        asked = rng.choice(vocabulary + 5, int(rng.integers(1, 20)), replace=False)
        weights = rng.integers(0, 9000, len(asked))
        scores = np.zeros(documents, np.int64)
        for t, w in zip(asked, weights, strict=True):
            scores[doc[term == t]] += w * impact[term == t]
        want = [(d, scores[d]) for d in np.lexsort((np.arange(documents), -scores))[:20] if scores[d] > 0]
        found, got, _ = L.best(tree, asked, weights, 20)
        assert list(zip(found, got, strict=True)) == want


def test_a_rare_term_opens_few_nodes():
    documents = 1 << 14
    doc = np.arange(documents)
    term, impact = np.zeros(documents, np.int64), np.full(documents, 5)
    rare = np.array([77, 9000])
    tree = L.grown(np.append(term, [1, 1]), np.append(doc, rare), np.append(impact, [900_000, 800_000]), documents)
    found, _, opened = L.best(tree, np.array([0, 1]), np.array([1, 5000]), 2)
    assert found.tolist() == [77, 9000] and opened < documents / 10
