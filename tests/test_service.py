"""The service: every option that it reads changes what it does."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone import engine as E
from lodestone.operators import answers
from lodestone.options import Options
from lodestone.service import Service
from lodestone.sources import shared, store

BASE = Options(mode="bm25", rewriting=False, per_minute=0)
LINES = ["Loans are repaid in ten days.", "Cards cost nothing at all.", "Apples grow on old trees.", "Interest on loans is paid monthly.", "A card that is lost is blocked."]


@pytest.fixture(scope="module")
def built(spark):
    folder = shared.fresh_path(spark, "service-index")
    rows = [(i, line, f"s{i}") for i, line in enumerate(LINES)]
    E.Engine.build(E.plain_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")), folder, BASE)
    return folder


def client(calls=None, fail=()):
    """``connect`` whose model quotes nothing but its settings; its failures come first."""

    def connect(provider, temperature, reply_tokens):
        def post(model, prompt):
            if model in fail:
                return answers.Response(503, "busy")
            if prompt.startswith("Write "):
                return answers.Response(200, json.dumps({"queries": ["apples trees", "cards cost", "third"]}))
            told = f"{provider} {model} {temperature} {reply_tokens} [1]"
            return answers.Response(200, json.dumps({"found": True, "answer": told, "citations": [1]}), prompt_tokens=7, completion_tokens=2)

        return post

    return connect


def service(spark, built, options=BASE, folder=None, scorer=None, **more):
    engine = E.Engine(spark, built, options, scorer=scorer)
    return Service(engine, folder or shared.fresh_path(spark, "service"), client(**more), in_flight=2, sleep=lambda s: None)


def requests(spark, *rows):
    return spark.createDataFrame([(str(i), q, t, c) for i, (q, t, c) in enumerate(rows)], "query string, question string, t long, client string").select("query", "question", F.timestamp_seconds("t").alias("at"), "client")


def served(s, spark, *rows):
    return {r.query: r for r in s.serve(requests(spark, *rows)).collect()}


def test_a_batch_with_all_kinds_of_requests(spark, built):
    s = service(spark, built, replace(BASE, per_minute=2, temperature=0.5, reply_tokens=99, model="big"))
    got = served(s, spark, ("when are loans repaid?", 0, "a"), (" When are LOANS repaid", 1, "a"), ("cards", 2, "a"), ("no", 3, "b"), ("x" * 501, 4, "b"), ("lost card", 5, "b"))
    assert [got[str(i)].code for i in range(6)] == [200, 200, 429, 422, 422, 200]
    assert got["0"].found and not got["0"].cached and got["1"].cached and got["1"].tokens == {"prompt": 0, "completion": 0}
    assert got["0"].answer == "local big 0.5 99 [1]" and got["0"].sources[0].text == LINES[0] and got["2"].wait_s > 0 and got["2"].answer is None
    log = {r.question: r for r in store.read_log(spark, s.log).collect()}
    assert set(log) == {"when are loans repaid?", "When are LOANS repaid", "lost card"} and log["When are LOANS repaid"].cached
    first = log["when are loans repaid?"]
    assert set(first.timings) == {"retrieval_s", "llm_s", "total_s"} and first.timings["total_s"] >= first.timings["retrieval_s"] > 0
    assert first.retrieved and first.cited and first.model == "big" and first.tokens["prompt"] == 7


def test_the_cache_is_kept_between_batches_and_bounded(spark, built):
    folder = shared.fresh_path(spark, "service")
    small = replace(BASE, cache_size=1, cache_hours=1.0)
    assert not served(service(spark, built, small, folder), spark, ("loans repaid", 0, "a"), ("lost card", 10, "a"))["0"].cached
    got = served(service(spark, built, small, folder), spark, ("lost card?", 100, "a"), ("loans repaid", 101, "a"))
    assert got["0"].cached and not got["1"].cached  # one entry stays, the one used last
    assert not served(service(spark, built, small, folder), spark, ("loans repaid", 101 + 3700, "a"))["0"].cached  # too old by now


def test_rewriting_and_its_number_change_what_is_found(spark, built):
    for rewriting, n in ((False, 2), (True, 1), (True, 2)):
        s = service(spark, built, replace(BASE, rewriting=rewriting, rewrites=n, final=5))
        asked = spark.createDataFrame([("q", "loans repaid")], "query string, question string")
        hits = {r.retrieved[i].chunk_id.split(":")[0] for r in s.respond(asked).collect() for i in range(len(r.retrieved))}
        assert ("2" in hits) == rewriting and ("1" in hits) == (rewriting and n == 2)
        if rewriting:
            assert {r.text: len(r.queries) for r in s.phrasings.read().collect()} == {"loans repaid": n}


def test_reranker_attempts_and_fallback(spark, built):
    asked = spark.createDataFrame([("q", "loans paid cards")], "query string, question string")
    order = lambda options, scorer=None: [r.chunk_id for r in E.Engine(spark, built, options, scorer=scorer).search(asked).orderBy("rank").collect()]
    last = lambda pairs: [float("Apples" in text) - len(text) / 1000 for _, text in pairs]
    plain = order(BASE, last)
    assert sorted(plain) == sorted(order(replace(BASE, reranker="model"), last)) and plain != order(replace(BASE, reranker="model"), last)
    assert order(replace(BASE, reranker="lexical"))[0].startswith("3:")
    with pytest.raises(RuntimeError):
        order(replace(BASE, reranker="model"))
    busy = replace(BASE, model="big", attempts=4)
    failed = served(service(spark, built, busy, fail=("big",)), spark, ("loans repaid", 0, "a"))["0"]
    assert failed.code == 502 and not failed.found
    rescued = served(service(spark, built, replace(busy, fallback_model="small"), fail=("big",)), spark, ("loans repaid", 0, "a"))["0"]
    assert rescued.code == 200 and rescued.answer.startswith("local small")
    assert served(service(spark, built, replace(busy, fallback_model="small", attempts=3), fail=("big",)), spark, ("loans repaid", 0, "a"))["0"].code == 502


def test_the_log_turns_over_at_its_size(spark, built):
    folder = shared.fresh_path(spark, "service")
    for i in range(3):
        served(service(spark, built, replace(BASE, log_bytes=10), folder), spark, (f"question number {i}", i, "a"))
    s = service(spark, built, BASE, folder)
    assert [r.question for r in store.read_log(spark, s.log).collect()] == ["question number 2"] and [r.question for r in store.read_log(spark, f"{s.log}.1").collect()] == ["question number 1"]
