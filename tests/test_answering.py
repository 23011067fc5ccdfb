"""Options, retriever, model stage, cached answers, test-set construction and stores: cases that the registered queries do not show."""

from __future__ import annotations

import json
import random
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import python as P
from lodestone.functions.grams import QuoteGrams
from lodestone.operators import answers, evaluate, ingest, retrieval, search, testset
from lodestone.options import MissingKey, Options
from lodestone.plans import answering
from lodestone.sources import store, tables


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_options_are_read_and_checked():
    o = Options.read({"LODESTONE_MODE": "bm25", "LODESTONE_FINAL": "8", "LODESTONE_REWRITING": "no", "LODESTONE_PROVIDERS": "local, far", "LODESTONE_PROVIDER": "far", "LODESTONE_MODEL": "m:1"})
    assert (o.mode, o.final, o.rewriting, o.providers) == ("bm25", 8, False, ("local", "far"))
    assert o.route() == ("far", "m:1") and o.route("judge") == ("local", "offline-judge") and o.route(name="local:x:y") == ("local", "x:y") and o.route(name="else:z") == ("far", "else:z")
    with pytest.raises(ValueError):
        Options(mode="sparse")
    with pytest.raises(ValueError):
        Options(provider="nobody")
    with pytest.raises(MissingKey):
        o.key("far", {})
    assert o.key("far", {"FAR_API_KEY": "k"}) == "k" and not o.configured({}) and o.configured({"FAR_API_KEY": "k"})


def served(*responses):
    """A service that gives the responses in turn, and what it was asked and how long was waited."""
    asked, waits, left = [], [], list(responses)

    def post(model, prompt):
        asked.append(model)
        return left.pop(0)

    return post, waits.append, asked, waits


def test_calls_are_repeated_fall_back_and_give_up():
    R = answers.Response
    post, sleep, asked, waits = served(R(0), R(503), R(429, headers={"Retry-After": "7"}), R(503), R(503), R(200, "fine", prompt_tokens=3))
    got = answers.call(post, "p", "big", "small", sleep=sleep)
    assert got["reply"] == "fine" and got["model"] == "small" and asked == ["big"] * 5 + ["small"] and waits == [1, 2, 8, 8, 16]
    post, sleep, asked, _ = served(R(429, "quota Per Day"))
    assert answers.call(post, "p", "m", sleep=sleep)["status"] == "quota" and len(asked) == 1
    post, sleep, asked, _ = served(R(404, "no such model"))
    assert answers.call(post, "p", "m", sleep=sleep)["status"].startswith("404") and len(asked) == 1
    post, sleep, asked, waits = served(*[R(500, "x" * 900)] * 11)
    got = answers.call(post, "p", "m", sleep=sleep)
    assert len(asked) == 11 and len(waits) == 10 and max(waits) == 60 and len(got["status"]) == 300


def test_a_spent_quota_stops_a_task(spark):
    calls = spark.createDataFrame([(i, "p") for i in range(5)], "query int, prompt string").coalesce(1)

    def post(model, prompt):
        return answers.Response(429, "per day")

    out = answers.ask_model(calls, post, "m").collect()
    assert [r.status for r in out] == ["quota"] * 5


def test_cache_keeps_refusals_but_not_failures(spark):
    kind = "key string, value struct<answer:string,found:boolean,tokens:map<string,bigint>,status:string>, put_at timestamp, used_at timestamp"
    at = lambda s: f"timestamp_seconds({s})"
    ask = lambda *rows: spark.createDataFrame([(q, t, s) for q, t, s in rows], "query string, question string, s long").select("query", "question", F.timestamp_seconds("s").alias("at"))
    seen = []

    def respond(asked):
        seen.extend(r.question for r in asked.collect())
        n = F.length("question").cast("long")
        return asked.select("query", F.concat(F.lit("to "), "question").alias("answer"), F.lit(False).alias("found"), F.create_map(F.lit("prompt"), n).alias("tokens"), F.when(F.col("question").contains("bad"), "down").otherwise("ok").alias("status"))

    out, cache = answers.ask_with_cache(ask(("1", " What is it? ", 10), ("2", "what  IS it", 20), ("3", "bad one", 30), ("4", "other", 40)), spark.createDataFrame([], kind), respond, size=2, ttl_s=100)
    assert {r.query: (r.cached, r.tokens["prompt"]) for r in out.collect()} == {"1": (False, 11), "2": (True, 0), "3": (False, 7), "4": (False, 5)}
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    assert sorted(r.key for r in cache.collect()) == ["other", "what is it"]
    seen.clear()
    out, cache = answers.ask_with_cache(ask(("5", "What is it!", 105), ("6", "Other?", 141), ("7", "third", 142)), cache, respond, size=2, ttl_s=100)
    got = {r.query: r for r in out.collect()}
    assert got["5"].cached and got["5"].question == "What is it!" and got["5"].answer == "to What is it?" and not got["6"].cached  # put at 40: a second too old
    assert set(seen) == {"Other?", "third"} and sorted(r.key for r in cache.collect()) == ["other", "third"]
    assert at(1) and answers.public(out.withColumn("retrieved", F.lit(1))).columns.count("retrieved") == 0


def test_search_fuses_variants_and_scores_again(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue pear"), (4, "pear pie")], "doc_id int, text string")
    path = f"{store.folder(spark)}/idx-search"
    index = store.save_keyword_index(docs, path)
    asked = spark.createDataFrame([("a", "apple"), ("b", "pear")], "query string, text string")
    more = search.variants_of(asked, spark.createDataFrame([("apple", ["pie", "pie crust"])], "text string, queries array<string>"))
    assert rows_of(more) == [("a", 1, "pie"), ("a", 2, "pie crust")]
    plain = search.search(index, None, asked, "bm25", 2)
    assert rows_of(plain, "query", "doc", "rank") == [("a", 1, 2), ("a", 2, 1), ("b", 3, 1), ("b", 4, 2)] or rows_of(plain, "query", "doc") == [("a", 1), ("a", 2), ("b", 3), ("b", 4)]
    both = {(r["query"], r.doc): r["rank"] for r in search.search(index, None, asked, "bm25", 3, more).collect()}
    assert both["a", 1] == 1 and ("a", 4) in both and both["b", 3] in (1, 2)
    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("index_text"))
    scorer = search.pair_scorer(texts, lambda pairs: [-float(len(b)) for _, b in pairs], batch=1)
    ranked = search.search(index, None, asked, "bm25", 1, None, scorer).collect()
    assert {(r["query"], r.doc, r["rank"]) for r in ranked} == {("a", 2, 1), ("b", 4, 1)} and all(r.first_stage_rank in (1, 2) for r in ranked)
    with pytest.raises(ValueError):
        search.first_stage(index, None, asked, "sparse", 3)


def test_embedding_stage_gives_unit_vectors(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a b c")], "doc_id int, text string")
    seen = search.embedded(docs, "text", search.hashing_embedder(16), "query: ", batch=2).collect()
    by = {r.doc_id: np.array(r.vec) for r in seen}
    assert np.allclose(np.linalg.norm(by[1]), 1) and np.allclose(by[1], by[3]) and not np.allclose(by[1], by[2])
    assert not np.array(search.embedded(docs, "text", search.hashing_embedder(16)).where("doc_id = 2").first().vec).any()


def test_vectors_must_match_their_chunks(spark):
    where = f"{store.folder(spark)}/vectors-test"
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc int, vec array<double>")
    store.upsert_vectors(rows, where)
    store.upsert_vectors(spark.createDataFrame([(2, [5.0]), (3, [3.0])], "doc int, vec array<double>"), where)
    assert rows_of(store.read_vectors(spark, where), "doc", "vec") == [(1, [1.0]), (2, [5.0]), (3, [3.0])]
    assert store.drop_stale(where, rows.select("doc")).count() == 2
    with pytest.raises(store.IndexFault):
        store.drop_stale(where, spark.createDataFrame([(1,), (2,), (9,)], "doc int"))


def test_logs_rotate_and_indexes_are_found_and_exported(spark):
    base = f"{store.folder(spark)}/stores"
    rows = spark.createDataFrame([("q", True)], "question string, found boolean")
    store.append_log(rows, f"{base}/log")
    store.append_log(rows, f"{base}/log")
    assert store.read_log(spark, f"{base}/log").count() == 2
    store.append_log(rows, f"{base}/log", most_bytes=1)
    assert store.read_log(spark, f"{base}/log").count() == 1 and store.read_log(spark, f"{base}/log.1").count() == 2
    first = store.read_log(spark, f"{base}/log").first()
    assert len(first.request_id) == 12 and first.time.endswith("+00:00") and first.time[10] == "T"
    assert store.default_index(spark, [f"{base}/none", f"{base}/prebuilt"]) == f"{base}/prebuilt"
    chunks = spark.createDataFrame([("d:section:0000", "section", "t"), ("d:fixed:0000", "fixed", "t")], "chunk_id string, strategy string, text string")
    tables.write_partition(chunks, f"{base}/idx/chunks", "strategy")
    store.upsert_vectors(chunks.where("strategy = 'section'").select(F.col("chunk_id").alias("doc"), F.array(F.lit(1.0)).alias("vec")), store.vector_table(f"{base}/idx", "section", "a/B"))
    assert store.default_index(spark, [f"{base}/idx", f"{base}/prebuilt"]) == f"{base}/idx"
    assert store.export_index(spark, f"{base}/idx", f"{base}/out", "section", "a/B") == 1
    with pytest.raises(Exception):
        store.export_index(spark, f"{base}/idx", f"{base}/out", "fixed", "a/B")


def test_partitions_newest_and_parsed_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "strategy string, n int")
    tables.write_partition(rows, f"file://{tmp_path}/p", "strategy")
    tables.write_partition(spark.createDataFrame([("b", 3)], "strategy string, n int"), f"file://{tmp_path}/p", "strategy")
    assert rows_of(spark.read.parquet(f"file://{tmp_path}/p"), "strategy", "n") == [("a", 1), ("b", 3)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b.json").write_text('{"doc_id": "b",\n "n": 2}')
    (tmp_path / "j" / "a.json").write_text('{"doc_id": "a",\n "n": 1}')
    assert [r.doc_id for r in tables.parsed_documents(spark, f"file://{tmp_path}/j").orderBy("file").collect()] == ["a", "b"]
    found = spark.createDataFrame([("x", 1, "p1"), ("x", 2, "p2"), ("y", 1, "p3")], "stem string, modified int, path string")
    assert rows_of(tables.newest(found), "path") == [("p2",), ("p3",)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "late.pdf").write_bytes(b"<html>" + b" " * 10_000 + b"CAPTCHA")
    assert tables.files(spark, f"file://{tmp_path}/f", "late.pdf").first().kind == "blocked"


def test_judging_reads_and_refuses(spark):
    made = spark.createDataFrame([("q", "ref", "ans", []), ("r", "ref", "ans", [(1, "id", "c", "body", "u")])], f"question string, reference string, answer string, sources array<{answers.SOURCE}>")
    shown = {r.question: r.prompt for r in evaluate.judge_prompts(made).collect()}
    assert "(none cited)" in shown["q"] and "[1] body" in shown["r"]
    v = spark.range(1).select(evaluate.verdict(F.lit('x {"correctness": "Partial", "faithfulness": "partially supported", "reason": "' + "r" * 400 + '"}')).alias("v"), evaluate.verdict(F.lit('{"correctness": "yes"}')).alias("w")).first()
    assert v.v.faithfulness == "partially_supported" and len(v.v.reason) == 300 and v.w is None


def test_summary_has_tokens_and_scores(spark):
    rows = [("single", True, "correct", "supported", True, None, 0, 1.0, 10, 4, 1.0), ("unanswerable", False, None, None, None, True, 0, 3.0, 21, 5, None), ("multi", False, None, None, False, None, 1, 2.0, 30, 7, 0.5)]
    made = spark.createDataFrame(rows, "kind string, found boolean, correctness string, faithfulness string, cites_evidence boolean, refusal_correct boolean, n_invalid int, total_s double, prompt_tokens int, completion_tokens int, recall_5 double")
    s = evaluate.summary(made).first()
    assert (s.answerable, s.answered, s.correct_refusal, s.faithful, s.p50, s.p95, s.prompt_tokens, s.completion_tokens, s.recall_5) == (2, 0.5, 1.0, 1.0, 2.0, 3.0, 20, 5, 0.75)


def test_upserts_fill_in_defaults_and_resume(spark):
    old = spark.createDataFrame([("bm25", 1, 0.5)], "mode string, run int, recall_5 double")
    new = spark.createDataFrame([("original", "bm25", 2, 0.7), ("paraphrased", "bm25", 2, 0.1)], "dataset string, mode string, run int, recall_5 double")
    assert rows_of(evaluate.upsert_results(old, new, "run"), "dataset", "mode", "rerank", "recall_5") == [("original", "bm25", "none", 0.7), ("paraphrased", "bm25", "none", 0.1)]
    todo, done = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1,)], "id int")
    ok, left = evaluate.resumed(todo, done, "id", lambda rows: rows.withColumn("status", F.when(F.col("id") == 2, "ok").otherwise("quota")))
    assert rows_of(ok) == [(2, "ok")] and rows_of(left) == [(3, "quota")]
    assert rows_of(evaluate.unknown_keys(todo, spark.createDataFrame([(3,), (9,), (9,)], "id int"), "id")) == [(9,)]


def test_relevance_by_span_or_run(spark):
    text = "the bank shall pay the full amount to every holder of a card within ten days of the claim made"
    texts = spark.createDataFrame([(1, "s", "x " + text.upper()), (2, "s", "it says the bank shall pay the full amount to every other"), (3, "t", "it says the bank shall pay the full amount to every other"), (4, "s", "ﬁrst – “quoted” rule"), (5, "s", None)], "doc int, source string, text string")
    long = text + " by the holder under these rules"
    evidence = spark.createDataFrame([("q", 0, "s", text), ("q", 1, "s", "the bank shall pay the full amount to every person or firm that asks for it today"), ("r", 0, "s", 'first - "quoted" rule'), ("n", 0, "s", None), ("l", 0, "s", long)], "query string, ev int, source string, quote string")
    assert rows_of(evaluate.coverage(texts, evidence), "query", "ev", "doc") == [("l", 0, 1), ("q", 0, 1), ("q", 1, 1), ("q", 1, 2), ("r", 0, 4)]
    assert P.run_length("a b c d", "xa b cx d") == 3 and P.run_length("", "x") == 0 and P.run_length("a b", "c") == 0


def test_passages_are_useful_and_picked(spark):
    assert spark.range(1).select(testset.useful(F.lit("Chapter 1"), F.lit("banks shall pay")).alias("a"), testset.useful(F.lit("Repealed rules"), F.lit("1 2 3")).alias("b"), testset.useful(F.lit("x"), F.lit("circular " * 5 + "7")).alias("c"), testset.useful(F.lit("x"), F.lit("words alone")).alias("d")).first() == (True, False, False, False)
    rows = [("d", c, n) for n, c in enumerate("AAABBC")]
    made = spark.createDataFrame(rows, "doc_id string, chapter string, passage_no int")
    got = testset.pick_passages(made, 3).collect()
    assert sorted(r.chapter for r in got) == ["A", "B", "C"] and sorted(r.pick for r in got) == [1, 2, 3]
    assert testset.pick_passages(made, 5).count() == 5 and testset.pick_passages(made, 9).count() == 6


def chat(asked, replies):
    return answers.complete(asked, lambda prompts: [replies(p) for p in prompts])


def test_questions_are_generated_and_resumed(spark):
    passages = spark.createDataFrame([("a", 0, 1, "t", "S", "one rule stands here.\nthe bank shall pay in 3 days.", "x"), ("a", 1, 2, "t", "S", "nothing of use 4", "x"), ("b", 0, 1, "t", "S", "the card shall be free of 5 charges.", "x")], "doc_id string, passage_no int, pick int, title string, section string, text string, topic string")
    paras = passages.select("doc_id", "passage_no", F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("para", F.concat(F.lit("p"), "seq")).withColumn("page_start", F.col("seq") + 1)

    def reply(p):
        if "nothing of use" in p:
            return '{"skip": true}'
        return json.dumps({"question": " When? ", "answer": "soon", "question_type": "fact", "evidence_quote": "The bank shall pay in 3 days" if "one rule" in p else "not said at all anywhere"})

    records, progress = testset.generate_single(passages, paras, lambda asked: chat(asked, reply))
    (one,) = records.collect()
    assert one.key == "single:a:1" and one.question == "When?" and one.evidence[0] == ("a", "the bank shall pay in 3 days", "p1", 2) and progress.where("status = 'ok'").count() == 3
    again, progress = testset.generate_single(passages, paras, lambda asked: chat(asked, reply), progress.select("key"))
    assert again.count() == 0 and progress.count() == 0
    assert [r.id for r in testset.numbered(records, "s", 4, ["key"]).collect()] == ["s005"]
    pairs = testset.draw_pairs(passages, 2)
    assert 1 <= pairs.count() <= 2 and all(r.a.text != r.b.text for r in pairs.collect())

    def both(p):
        parts = [x.split("\n")[-1] for x in p.split("\n\n")[1:]]
        return json.dumps({"question": "q", "answer": "a", "evidence_a": parts[0], "evidence_b": parts[1]})

    multi, _ = testset.generate_multi(pairs, paras, lambda asked: chat(asked, both))
    assert all(len(r.evidence) == 2 and r.kind == "multi" for r in multi.collect()) and multi.count() == pairs.count()
    failing = spark.createDataFrame([(i, s) for i, s in enumerate(["ok", "x", "x", "ok", "x", "x", "x"])], "n int, status string")
    assert testset.give_up(failing, ["n"]) and not testset.give_up(failing.where("n < 6"), ["n"])


def test_written_and_unanswerable_records(spark):
    paras = spark.createDataFrame([("d", 0, "intro", "", 1), ("d", 1, "the limit is 9 lakh rupees a year", "4", 2)], "doc_id string, seq int, text string, para string, page_start int")
    items = spark.createDataFrame([("h1", "d", "q", "a", "fact", "The limit is 9 lakh  rupees"), ("h2", "d", "q", "a", "fact", "something else entirely said")], "key string, doc_id string, question string, answer string, qtype string, quote string")
    (one,) = testset.generate_handwritten(items, paras).collect()
    assert one.key == "h1" and one.evidence[0].para == "4" and one.origin == "handwritten"
    lost = {r.item: r.quote for r in testset.find_evidence(items.select(F.col("key").alias("item"), "doc_id", "quote"), paras).collect()}
    assert lost == {"h1": "the limit is 9 lakh rupees", "h2": None}
    asked = spark.createDataFrame([("u1", "q1", "outside: law"), ("u2", "q2", "future")], "key string, question string, reason string")
    said = spark.createDataFrame([("u1", True, "it is so"), ("u2", False, "no")], "query string, found boolean, answer string")
    got = {r.key: r for r in testset.generate_unanswerable(asked, said).collect()}
    assert "CHECK" in got["u1"].note and got["u1"].qtype == "outside" and "CHECK" not in got["u2"].note and got["u2"].evidence == []
    assert testset.to_review(spark.createDataFrame([("multi", "pending"), ("multi", "kept"), ("single", "pending")], "kind string, status string"), ["multi"]).count() == 1


def test_contents_pages_and_report(spark, tmp_path):
    page = lambda p, lines: [(1, p, p * 100 + i, t, 12.0) for i, t in enumerate(lines)]
    entry = lambda n: f"Rule {n} ......... {n}"
    rows = page(1, ["Contents", entry(1), entry(2), entry(3)]) + page(2, [entry(4), entry(5), entry(6)]) + page(3, [f"Body line {w} is long enough to be no entry of any list of contents, surely." for w in ("one", "two", "three", "four", "five")]) + page(4, [entry(7), entry(8), entry(9)])
    lines = spark.createDataFrame(rows, "doc int, page int, seq long, text string, size double")
    assert rows_of(ingest.contents_pages(lines)) == [(1, 1), (1, 2)]
    kinds = {(r.page, r.noise) for r in ingest.classified(lines).collect()}
    assert {(1, "contents"), (2, "contents"), (3, None)} <= kinds
    stats = ingest.parse_stats(spark.createDataFrame([(1, "t" * 90, "c", "1"), (1, "u", "c", "")], "doc int, text string, chapter string, para string"), spark.createDataFrame([(1, 2)], "doc int, pages long"))
    ingest.save_report(stats, f"file://{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/report").first().warnings == "little text"


def test_preview_and_info(spark):
    assert spark.range(1).select(search.preview(F.lit("x" * 500)).alias("a"), search.preview(F.lit("short")).alias("b")).first() == ("x" * 400 + "...", "short")
    cache = spark.createDataFrame([("k",)], "key string")
    assert answers.info(cache, cache, Options(), cache).first().answer_cache == "1 of 256"


def test_index_parameters(spark):
    docs = spark.createDataFrame([(1, "card card fee"), (2, "card"), (3, "loan")], "doc_id int, text string")
    index = store.save_keyword_index(docs, f"{store.folder(spark)}/idx-parameters")
    asked = spark.createDataFrame([(1, "cards")], "item_id int, text string")
    flat = {r.doc: r.score for r in retrieval.bm25_search(index, asked, k1=0.0).collect()}
    assert flat[1] == flat[2] and rows_of(index.corpus) == [(3, pytest.approx(5 / 3))]
    assert rows_of(retrieval.bm25(docs, asked)) == rows_of(retrieval.bm25_search(index, asked))
    assert store.save_keyword_index(docs.limit(0), f"{store.folder(spark)}/idx-empty").corpus.first().avg_len == 0


def test_engine_builds_searches_and_answers(spark, capsys):
    from lodestone import engine as E

    folder = f"{store.folder(spark)}/engine"
    docs = spark.createDataFrame([(1, "Loans are repaid in ten days.\nCards cost nothing.", "s1"), (2, "Apples grow on trees.", "s2")], "doc_id long, text string, source string")
    docs.write.parquet(f"{folder}-docs")
    with pytest.raises(FileNotFoundError):
        E.Engine(spark, folder)
    assert E.main(["index", folder, f"{folder}-docs"], spark) == 0
    engine = E.Engine(spark, folder, chat=E.quoting)
    asked = spark.createDataFrame([(1, "when are loans repaid")], "query long, question string")
    hits = engine.search(asked, "hybrid", 2).orderBy("rank").collect()
    assert hits[0].chunk_id == "1:section:0000" and "Loans" in hits[0].text and hits[0].citation.startswith("s1")
    said = engine.ask(asked).first()
    assert said.found and said.sources[0].chunk_id == "1:section:0000" and said.status == "ok"
    assert engine.info(docs).first().chunks == 2
    assert E.main(["search", folder, "apples", "--mode", "bm25"], spark) == 0 and "Apples grow" in capsys.readouterr().out
    assert E.main(["ask", folder, "apples"], spark) == 0 and "[1]" in capsys.readouterr().out
    store.upsert_vectors(spark.createDataFrame([("x", "9", [1.0])], "doc string, doc_id string, vec array<double>").withColumn("doc_id", F.lit(9).cast("long")), store.vector_table(folder, "section", "hashing"))
    with pytest.raises(store.IndexFault):
        E.Engine(spark, folder)


def test_quote_index_leaves_no_near_quote_out():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))) for _ in range(80)]
    quotes = []
    for _ in range(80):
        text = rng.choice(texts)
        at = rng.randrange(max(1, len(text) - 30))
        quote = list(text[at : at + rng.randrange(3, 150)])
        for _ in range(int(len(quote) * rng.choice([0, 0.03, 0.08, 0.1, 0.15]))):
            i = rng.randrange(len(quote))
            quote[i] = rng.choice(["z", "", quote[i] + "y"])
        quotes.append(P.plain("".join(quote)))
    index, near, tried = QuoteGrams(quotes), 0, 0
    for text in texts:
        found = set(index.candidates(text))
        tried += len(found)
        said = {i for i, q in enumerate(quotes) if P.near_quote(q, text) is not None}
        assert said <= found
        near += len(said)
    assert near > 50 and tried < len(texts) * len(quotes) / 8


def test_misquoted_lines_equal_trying_every_pair(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((r.item, r.doc_id, r.seq, r.exact) for r in answering.WITHOUT_SQL["misquoted"](spark, sf).collect())
    lines = [(r.doc_id, i, x) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() for i, x in enumerate((r.text or "").split("\n")) if x.strip(" ")]
    items = [(r.item_id, P.plain(re.sub(r"(?s)(.{19}).", r"\1~", r.text[:120]))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{q[i : i + 4] for i in range(len(q) - 3)} for _, q in items]  # a near quote keeps 30 of its 117 runs
    want = []
    for doc, seq, line in lines:
        text = P.plain(line)
        mine = {text[i : i + 4] for i in range(len(text) - 3)}
        want += [(item, doc, seq, said) for (item, quote), g in zip(items, grams, strict=True) if len(g & mine) >= 24 and (said := P.near_quote(quote, text)) is not None]
    assert got == sorted(want) and got


def test_pairs_are_drawn_in_buckets(spark):
    rows = [(d, i, f"title{d}", "s", f"text {d} {i}", f"topic{d % 2}") for d in range(6) for i in range(40)]
    passages = spark.createDataFrame(rows, "doc_id long, passage_no long, title string, section string, text string, topic string")
    for of_bucket in (10, 1000):
        pairs = testset.draw_pairs(passages, 25, of_bucket=of_bucket).collect()
        assert [r.key for r in pairs] == [f"multi:{i}" for i in range(1, 26)] and len({r.a.text for r in pairs}) == 25
        assert all(r.a.text != r.b.text and r.a.doc_id % 2 == r.b.doc_id % 2 for r in pairs) and {r.a.doc_id % 2 for r in pairs} == {0, 1}


class FakeClock:
    def __init__(self):
        self.now, self.naps = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.naps.append(seconds)
        self.now += seconds


def test_calls_in_flight_stay_below_the_bound_and_results_keep_their_order():
    lock, now, most = threading.Lock(), 0, 0

    def post(model, prompt):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01 * (int(prompt) % 3))
        with lock:
            now -= 1
        return answers.Response(200, f"re {prompt}", prompt_tokens=1)

    got = answers.call_all(post, [str(i) for i in range(40)], "m", in_flight=4)
    assert [r["reply"] for r in got] == [f"re {i}" for i in range(40)] and 1 < most <= 4


def test_a_refused_call_is_put_back_and_others_go_first():
    clock, seen = FakeClock(), []

    def post(model, prompt):
        seen.append((prompt, clock.now, model))
        tries = sum(p == prompt for p, _, _ in seen)
        return answers.Response(503) if prompt == "a" and tries < 5 else answers.Response(200, prompt)

    got = answers.call_all(post, ["a", "b", "c"], "big", "small", in_flight=1, clock=clock, sleep=clock.sleep)
    assert [r["reply"] for r in got] == ["a", "b", "c"] and got[0]["model"] == "small" and got[1]["model"] == "big"
    assert [p for p, _, _ in seen[:3]] == ["a", "b", "c"] and [t for p, t, _ in seen if p == "a"] == [0, 1, 3, 7, 15]
    assert sum(clock.naps) == 15


def test_the_bucket_spaces_calls_and_a_quota_ends_them():
    clock, seen = FakeClock(), []

    def post(model, prompt):
        seen.append(clock.now)
        return answers.Response(429, "per day") if prompt == "4" else answers.Response(200, prompt)

    got = answers.call_all(post, [str(i) for i in range(8)], "m", in_flight=3, bucket=answers.Bucket(per_minute=30), clock=clock, sleep=clock.sleep)
    assert [round(b - a, 6) for a, b in zip(seen, seen[1:], strict=False)] == [2.0] * (len(seen) - 1)
    assert [r["status"] for r in got[:5]] == ["ok"] * 4 + ["quota"] and {r["status"] for r in got[5:]} == {"quota"} and len(seen) == 5
    assert answers.call_all(post, [], "m") == []


def test_the_model_stage_divides_a_rate_over_its_tasks(spark):
    asked = spark.range(12).selectExpr("id", "cast(id as string) as prompt")
    out = answers.ask_model(asked, lambda model, prompt: answers.Response(200, "re " + prompt), "m", sleep=lambda s: None, in_flight=2, per_minute=600, tasks=3)
    assert sorted((r.id, r.reply, r.status) for r in out.collect()) == [(i, f"re {i}", "ok") for i in range(12)]
