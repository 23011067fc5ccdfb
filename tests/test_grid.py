"""The evaluation grid: equal to searching and scoring each setting by itself; stages are shared, found again, and made anew only where a change reaches them."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.engine import plain_documents
from lodestone.functions import text as X
from lodestone.operators import chunk, evaluate, grid, retrieval, search
from lodestone.sources import store

DATA = "/root/testdata/sf0.001"


def reversed_embedder(texts):
    return search.hashing_embedder(48)([t[::-1] for t in texts])


def overlap_scorer(pairs):
    return [len(set(a.lower().split()) & set(b.lower().split())) + len(b) / 1e6 for a, b in pairs]


def halves(questions):
    words = F.split("text", " ")
    n = F.ceil(F.size(words) / 2).cast("int")
    return questions.select("text", F.array(F.array_join(F.slice(words, 1, n), " "), F.array_join(F.slice(words, n, n + 1), " ")).alias("queries"))


@pytest.fixture(scope="module")
def inputs(spark):
    docs = plain_documents(spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL")).withColumn("doc_id", F.col("doc_id").cast("string"))
    full = docs.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.text").where(F.size(F.split("text", " ")) >= 12)
    quotes = full.groupBy("doc_id").agg(F.min("text").alias("quote")).orderBy("doc_id").limit(24)
    kind = F.when(F.crc32("doc_id") % 6 == 0, "unanswerable").otherwise("single")
    said = quotes.select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("quote", " "), 2, 9), " ").alias("question"), kind.alias("kind"), F.array(F.struct("doc_id", "quote")).alias("evidence"))
    said = spark.createDataFrame(said.collect(), said.schema)
    return docs, {"original": said, "paraphrased": said.withColumn("question", F.concat_ws(" ", F.reverse(F.split("question", " "))))}


def made(spark, folder, inputs, **more):
    docs, datasets = inputs
    parts = {"embedders": {"hashing": search.hashing_embedder(), "reversed": reversed_embedder}, "scorers": {"counting": overlap_scorer}, "rewrite": halves, "rewriter": "halves", "sizes": (60, 10, 20), "k": 10, "deep": 15}
    return grid.Grid(spark, folder, docs, datasets, **(parts | more))


WANTED = [
    *grid.settings(mode=["hybrid"]),
    *grid.settings(mode=["bm25"], embedding=["hashing", "reversed"]),
    *grid.settings(dataset=["paraphrased"], rewrite=["yes"], rerank=["none", "lexical", "counting"]),
    *grid.settings(strategy=["fixed"], embedding=["reversed"], mode=["dense"]),
]


def alone(spark, inputs, s, path):
    """The setting's scores by the plain way: one search, then coverage and scores."""
    docs, datasets = inputs
    chunks = chunk.chunk_document(docs, s["strategy"], 60, 10, 20).withColumn("index_text", X.index_text(F.col("header"), F.col("text")))
    embedder = {"hashing": search.hashing_embedder(), "reversed": reversed_embedder}[s["embedding"]]
    index = store.save_keyword_index(chunks, path, "chunk_id", "index_text")
    vectors = search.embed_documents(chunks.select(F.col("chunk_id").alias("doc"), "index_text"), "index_text", embedder)
    records = datasets[s["dataset"]].where("kind <> 'unanswerable'").withColumnRenamed("id", "query")
    asked = search.embed_questions(records.select("query", F.col("question").alias("text")), "text", embedder)
    variants = search.embed_questions(search.variants_of(asked, halves(asked.select("text").distinct())), "text", embedder) if s["rewrite"] == "yes" else None
    scorer = {"none": None, "lexical": lambda c: retrieval.overlap_scores(index, asked, "query", "text", c), "counting": search.pair_scorer(chunks.select(F.col("chunk_id").alias("doc"), "index_text"), overlap_scorer)}[s["rerank"]]
    hits = search.search(index, vectors, asked, s["mode"], 10, variants, scorer, 10, 15)
    evidence = records.select("query", F.posexplode("evidence").alias("ev", "e")).select("query", "ev", F.col("e.doc_id").alias("source"), F.col("e.quote").alias("quote"))
    truth = evaluate.coverage(chunks.select(F.col("chunk_id").alias("doc"), F.col("doc_id").alias("source"), "text"), evidence)
    per = evaluate.ranking_scores(hits, truth, records.select("query", F.size("evidence").alias("n_evidence")))
    return evaluate.mean_scores(per, []).first().asDict()


def test_equal_to_each_setting_alone_and_shared_over_settings_and_runs(spark, tmp_path, inputs):
    folder = f"file://{tmp_path}/grid"
    first = made(spark, folder, inputs)
    rows = {tuple(r[a] for a in grid.AXES): r.asDict() for r in first.run(WANTED).collect()}
    assert len(rows) == len({tuple(s.values()) for s in WANTED}) == 7
    for i, s in enumerate((WANTED[5], WANTED[6])):
        got, want = rows[tuple(s[a] for a in grid.AXES)], alone(spark, inputs, s, f"file://{tmp_path}/alone{i}")
        assert {m: got[m] for m in want} == want and got["questions"] > 5 and got["ms_per_query"] > 0
    assert any(r["recall_5"] > 0.5 for r in rows.values())
    n = Counter(first.stages.made)
    assert (n["chunks"], n["keywords"], n["vectors"], n["truth"], n["phrasings"]) == (2, 1, 2, 2, 1)
    assert n["lists"] == 2 + 4 + 1  # hybrid and its parts: words and vectors; paraphrased: both, of questions and of phrasings; fixed: vectors
    assert n["hits"] == n["scores"] == 6  # the words of a setting are those of any embedding

    again = made(spark, folder, inputs)
    assert sorted(map(tuple, again.run(WANTED).collect())) == sorted(tuple(r.values()) for r in rows.values()) and again.stages.made == []

    docs, datasets = inputs
    other = made(spark, folder, (docs, datasets | {"paraphrased": datasets["paraphrased"].withColumn("question", F.concat("question", F.lit(" please")))}))
    other.run(WANTED)
    assert Counter(other.stages.made) == {"phrasings": 1, "lists": 4, "hits": 3, "scores": 3}  # that data set's, nothing of the corpus

    named = made(spark, folder, inputs, scorers={"counting": overlap_scorer, "other": overlap_scorer})
    named.run(grid.settings(rerank=["counting", "other"]))
    assert Counter(named.stages.made) == {"hits": 2, "scores": 2}


def test_a_stage_that_fails_leaves_nothing_and_the_first_to_end_is_kept(spark, tmp_path):
    stages = grid.Stages(spark, f"file://{tmp_path}/s")

    def broken(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        stages.get("x", "a", broken)
    assert not (tmp_path / "s" / "x" / "a").exists()

    def slower(path):  # another one makes the same stage meanwhile
        spark.range(5).write.parquet(path)
        grid.Stages(spark, f"file://{tmp_path}/s").get("x", "a", lambda p: spark.range(7).write.parquet(p))

    assert spark.read.parquet(stages.get("x", "a", slower)).count() == 7


def test_content_sees_rows_not_their_order(spark):
    rows = [(1, "a", {"x": 1}), (1, "a", {"x": 1}), (2, None, None)]
    kinds = "i int, t string, m map<string,int>"
    a, b = spark.createDataFrame(rows, kinds), spark.createDataFrame(rows[::-1], kinds).repartition(3)
    assert grid.content(a) == grid.content(b) == grid.content(a.select("i", "t", "m"))
    assert len({grid.content(x) for x in (a, a.dropDuplicates(["i"]), a.limit(0), a.withColumn("t", F.lit("")), a.withColumnRenamed("t", "u"))}) == 5


def test_registered_query_has_a_row_for_each_setting(spark):
    from lodestone.plans import answering

    rows = answering.WITHOUT_SQL["eval_settings"](spark, DATA).collect()
    assert len(rows) == 5 and {r.questions for r in rows} == {spark.read.parquet(f"{DATA}/benchmark.parquet").count()}
    by = {(r.dataset, r["mode"]): r.recall_10 for r in rows}
    assert by["original", "hybrid"] > 0 and by["original", "bm25"] == by["paraphrased", "bm25"]  # words have no order there


def test_unknown_axis_and_missing_rewriter(spark, tmp_path, inputs):
    with pytest.raises(ValueError, match="unknown axes"):
        grid.settings(colour=["red"])
    with pytest.raises(ValueError, match="rewriter"):
        made(spark, f"file://{tmp_path}", inputs, rewrite=None).run(grid.settings(rewrite=["yes"]))
