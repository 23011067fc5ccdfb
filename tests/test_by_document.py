"""The index by document: same rows as the inverted one, no shuffle of postings; what goes to the driver and to Python at once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import grams
from lodestone.functions import python as P
from lodestone.functions import text as X
from lodestone.functions.grams import QuoteGrams
from lodestone.operators import answers, grid, search
from lodestone.operators import retrieval as R
from lodestone.plans import answering as A
from lodestone.plans import catalogue as C
from lodestone.sources import shared, store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def both(spark):
    """(by document, inverted, questions): topics, more copies than any k that is asked for, empty texts, questions without known words."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 50)))) for i in range(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(700)] + [(3000, None), (3001, ""), (3002, "the of")]
    asked = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(6))) for i in range(20)] + [(20, docs[3][1]), (21, "unknown words"), (22, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    made = [save(rows, f"{shared.folder(spark)}/idx-{n}") for n, save in (("doc", store.save_document_index), ("inv", store.save_keyword_index))]
    return *made, spark.createDataFrame(asked, "item_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_search_by_document_equals_the_inverted_index(both, k):
    by_doc, inverted, asked = both
    assert rows(R.bm25_search(by_doc, asked, k)) == rows(R.bm25_search(inverted, asked, k))
    assert rows(R.bm25_search(by_doc, asked, k, k1=1.2, b=0.3)) == rows(R.bm25_search(inverted, asked, k, k1=1.2, b=0.3))
    assert rows(R.overlap(by_doc, asked, k)) == rows(R.overlap(inverted, asked, k))


def test_candidates_are_scored_without_the_other_documents(both):
    by_doc, inverted, asked = both
    wanted = asked.select(F.col("item_id").alias("query")).crossJoin(inverted.postings.select("doc").distinct().where("doc % 50 = 0"))
    got = R.overlap_scores(by_doc, asked, candidates=wanted)
    assert rows(got) == rows(R.overlap_scores(inverted, asked, candidates=wanted)) and "SortMergeJoin" not in plan(got)


def test_structs_and_strings_name_questions_and_documents(spark, both):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "y")], "doc_id string, text string")
    index = store.save_document_index(docs, f"{shared.folder(spark)}/idx-names")
    asked = spark.createDataFrame([(1, "x y")], "n int, text string").select(F.struct("n", F.lit(0).alias("variant")).alias("item_id"), "text")
    assert [(r.query.n, r.doc, r["rank"]) for r in R.bm25_search(index, asked, 2).orderBy("rank").collect()] == [(1, "a", 1), (1, "b", 2)]


def test_postings_are_counted_without_a_shuffle(spark, both):
    docs = spark.createDataFrame([(1, "b a b", ), (2, None)], "doc_id long, text string").repartition(2)
    posts = R.postings(R.tokenised(docs, "doc_id", "text").withColumn("tokens", F.split(F.lit("b c b"), " ")).where("doc = 1"))
    assert rows(posts) == [(1, "b", 2, 3), (1, "c", 1, 3)]
    assert plan(R.postings(R.tokenised(docs, "doc_id", "text"))).count("Exchange") == 1  # the repartition above
    assert both[0].corpus.first() == both[1].corpus.first()
    assert rows(both[0].postings.select("doc", "term", "tf", "dl")) == rows(both[1].postings.select("doc", "term", "tf", "dl"))


def test_term_counts_are_read_not_counted_again(spark):
    assert "Exchange" not in plan(C.term_document_freq(spark, SF))


def test_corpus_stats_make_no_index(spark, monkeypatch):
    monkeypatch.setattr(C, "index", lambda *_: pytest.fail("two sums need no index"))
    assert C.bm25_corpus_stats(spark, SF).first().n == C.table(spark, SF, "documents").count()


def test_each_list_of_search_modes_is_searched_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(search, "first_stage", lambda *a, f=search.first_stage: calls.append(a[3]) or f(*a))
    A.search_modes(spark, SF).collect()
    assert sorted(calls) == ["bm25", "dense"]


def test_grid_keeps_indexes_by_document(spark):
    docs = spark.createDataFrame([("1", "One two three."), ("2", "Two four.")], "doc_id string, text string").withColumn("source", F.lit("s"))
    items = spark.createDataFrame([("q", "two", "single", [(None, "One two three.")])], "id string, question string, kind string, evidence array<struct<doc_id:string,quote:string>>")
    made = grid.Grid(spark, shared.fresh_path(spark, "grid"), A.plain_documents(docs), {"original": items}, {"hashing": search.hashing_embedder()})
    assert made._keywords("section")[1].forward is not None


def test_texts_of_hits_are_read_without_a_shuffle(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(A.shared, "written", lambda df, name, f=shared.written: plans.setdefault(name, plan(df)) and f(df, name))
    A._answered(spark, SF).collect()
    assert "BroadcastHashJoin" in plans["hits"] and "SortMergeJoin" not in plans["hits"] and "hashpartitioning" not in plans["hits"]


def test_a_text_is_split_into_sentences_once(spark):
    made = spark.createDataFrame([("See No. 5. It is so; Yes.",)], "text string").select(X.sentences(F.col("text")).alias("s"))
    assert made.first().s == ["See No. 5.", "It is so;", "Yes."]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def test_more_questions_than_vectors_do_not_go_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vecs, asked = rng.normal(size=(7, 4)).round(1), rng.normal(size=(60, 4)).round(1)
    vecs[3] = vecs[5]
    frame = lambda name, m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vec array<double>").repartition(3)
    read = []
    monkeypatch.setattr(DataFrame, "toArrow", lambda self, f=DataFrame.toArrow: read.append(f(self)) or read[-1], raising=False)
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self, f=type(spark.range(0)).toArrow: read.append(f(self)) or read[-1])
    want = rows(R.dense(frame("doc", vecs), frame("query", asked), 3))
    assert max(t.num_rows for t in read) == 60  # few questions are held
    monkeypatch.setattr(R, "FEW", 10)
    read.clear()
    assert rows(R.dense(frame("doc", vecs), frame("query", asked), 3)) == want and len(want) == 180
    assert max(t.num_rows for t in read) == 7


def test_a_call_gets_a_bounded_number_of_prompts(spark):
    asked = spark.range(1000).coalesce(1).select("id", F.col("id").cast("string").alias("prompt"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("some"))
    got = answers.complete(asked, lambda prompts: [str(len(prompts))] * len(prompts)).collect()
    assert max(int(r.reply) for r in got) <= 256 and sum(r.some is None for r in got) == 500 and {r.status for r in got} == {"ok"}
    failed = answers.complete(asked.limit(2), lambda prompts: ["one"]).collect()
    assert [r.reply for r in failed] == [None, None] and all("1 replies" in r.status for r in failed)


def test_strings_are_made_in_slices():
    seen = []
    out = P.in_slices(lambda t: seen.append(t) or (t and t.upper()), pa.array(["a", None] * 300))
    assert out.to_pylist() == ["A", None] * 300 and P.in_slices(str, pa.array([], pa.string())).to_pylist() == []


def test_places_are_compared_only_where_enough_runs_meet(monkeypatch):
    """The table of cells leaves out nothing, and unlike lines do not come to the comparison of places."""
    rng = random.Random(2)
    said = lambda n, letters="abcde ": "".join(rng.choice(letters) for _ in range(n))
    index = QuoteGrams([said(rng.randrange(4, 60)) for _ in range(60)] + ["aaaaaaaaaa", "abc"])
    texts = [said(rng.randrange(120)) for _ in range(200)] + [said(20) + q[:9] + "x" + q[10:] + said(9) for q in index.quotes] + ["a" * 50, "", said(80, "uvwxyz")]
    got = [sorted(index.candidates(t)) for t in texts]
    monkeypatch.setattr(grams, "CELLS", 0)
    assert got == [sorted(index.candidates(t)) for t in texts] and sum(map(len, got)) > 30
    monkeypatch.setattr(grams, "CELLS", 2_000_000)
    index = QuoteGrams([said(60) for _ in range(30)])
    monkeypatch.setattr(grams.np, "unique", lambda *_, **__: pytest.fail("places were compared"))
    assert index.candidates(said(80)) == []
