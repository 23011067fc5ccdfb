"""Behaviour of operators that the queries over the tables do not show."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.runs import RunFinder
from lodestone.operators import answers, chunk, evaluate, ingest, ranks, retrieval, state


def one(spark, column, **values):
    names, row = list(values), list(values.values())
    return spark.createDataFrame([row], names).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_tokens_keep_numbers_and_stem_plurals(spark):
    text = "The cards of 3,40,000 under 41B and 7.3 for business, process and gas"
    assert one(spark, X.tokens(F.lit(text))) == ["card", "3,40,000", "41b", "7.3", "business", "process", "gas"]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_titles_headers_citations(spark):
    assert one(spark, X.short_title(F.lit("Master Directions – on Loans, dated June 2"))) == "Loans"
    assert one(spark, X.section_header(F.lit("A"), F.lit(""), F.lit("C"))) == "A > C"
    assert one(spark, X.citation(F.lit("T"), F.lit(""), F.lit("4"), F.lit("6"), F.lit(2), F.lit(3))) == "T, paras 4–6, pp. 2–3"
    assert one(spark, X.cache_key(F.lit("  What   IS it ?! "))) == "what is it"


@pytest.mark.parametrize(("sign", "number"), [("IV", 4), ("XIX", 19), ("12", 12), ("XC", 90)])
def test_chapter_number(spark, sign, number):
    assert one(spark, X.chapter_number(F.lit(sign))) == number


def test_sentences_glue_abbreviations(spark):
    assert one(spark, X.sentences(F.lit("See No. 5 of it. Then stop; Go on."))) == ["See No. 5 of it.", "Then stop;", "Go on."]


@pytest.mark.parametrize(
    ("reply", "found", "citations"),
    [('{"answer": "a [1]", "citations": [1, "2", "x"]}', True, [1, 2]), ('```{"found": false, "answer": "n"}```', False, []), ('{"found": "false"}', True, []), ("no json", None, None), ('{"found": 0}', False, [])],
)
def test_parsed_reply(spark, reply, found, citations):
    got = one(spark, X.parsed_reply(F.lit(reply)))
    assert (got and got.found, got and got.citations) == (found, citations)


def test_answers_need_a_valid_citation(spark):
    rows = [(1, 2, '{"found": true, "answer": "yes [2] and [9]", "citations": [1]}'), (2, 2, '{"found": true, "answer": "yes [7]"}'), (3, 2, "broken")]
    got = {r.query: r for r in answers.checked(spark.createDataFrame(rows, "query int, n_sources int, reply string")).collect()}
    assert got[1].found and got[1].cited == [1, 2] and got[1].invalid == [9]
    assert not got[2].found and got[2].cited == [] and got[2].invalid == [7]
    assert not got[3].found and got[3].answer == answers.NOT_FOUND


def test_model_stage_reports_errors_as_status(spark):
    def chat(prompts):
        raise RuntimeError("quota")

    asked = spark.createDataFrame([(1, "p")], "query int, prompt string")
    assert answers.complete(asked, chat).first().status == "quota"
    assert answers.complete(asked, lambda p: [x.upper() for x in p]).first().reply == "P"


def test_fusion_ties_keep_the_earlier_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query int, doc int, rank int")
    b = spark.createDataFrame([(1, 30, 1), (1, 40, 2)], "query int, doc int, rank int")
    assert [r.doc for r in retrieval.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()] == [10, 30, 20, 40]
    with pytest.raises(ValueError):
        retrieval.candidate_depth(5, 5, False, 0, "other")


def greedy(sizes, most):
    out = []
    for s in sizes:
        if out and sum(out[-1]) + s <= most:
            out[-1].append(s)
        else:
            out.append([s])
    return [len(g) for g in out]


def test_greedy_merge_is_lossless_and_greedy(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join("w" * rng.randint(1, 30)) for _ in range(rng.randint(1, 12)))) for i in range(20)]
    got = chunk.recursive_chunks(spark.createDataFrame(rows, "doc_id int, text string"), 40)
    by = {}
    for r in got.orderBy("doc", "chunk_no").collect():
        by.setdefault(r.doc, []).append(r.n_pieces)
    assert by == {i: greedy([len(x.split()) for x in t.split("\n")], 40) for i, t in rows}


def test_windows_overlap_and_end(spark):
    text = " ".join(str(i) for i in range(75))
    got = chunk.fixed_windows(spark.createDataFrame([(1, text)], "doc_id int, text string"), 30, 10).orderBy("chunk_no").collect()
    assert [(r["first"], r.n_words) for r in got] == [(0, 30), (20, 30), (40, 30), (60, 15)]


def test_merge_breaks_on_paragraphs(spark):
    assert chunk.grouped([5, 5, 5, 1], 100, ["1", "1", "2", "3"], 6) == [2, 4]
    assert chunk.grouped([60, 60, 200, 1], 100) == [1, 2, 3, 4] and chunk.grouped([], 5) == []
    assert one(spark, chunk.run_dedup(F.array(*map(F.lit, ["1", "1", "", "2", "1"])))) == ["1", "2", "1"]


def test_scores_of_two_evidences(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query int, doc int, rank int")
    truth = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "query int, doc int, ev int")
    evidence = spark.createDataFrame([(1, 2), (2, 1)], "query int, n_evidence int")
    got = {r["query"]: r for r in evaluate.ranking_scores(hits, truth, evidence).collect()}
    assert got[1].recall_1 == 0.5 and got[1].hit_1 == 0 and got[1].hit_3 == 1 and got[1].ndcg_5 == 1 and got[1].mrr == 1
    assert got[2].mrr == 0 and got[2].recall_10 == 0


def test_nearest_rank_for_all_sizes(spark):
    rows = [(n, float(i * i)) for n in (1, 2, 3, 20, 41) for i in range(n)] + [(None, 7.0), (None, None), (99, None), (3, float("nan"))]
    found = {r.g: (r.p50, r.p95) for r in ranks.nearest_ranks(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [50, 95]).collect()}
    assert found == {n: tuple(float((max(0, math.ceil(p / 100 * n) - 1)) ** 2) for p in (50, 95)) for n in (1, 2, 3, 20, 41)} | {None: (7.0, 7.0)}


def test_ranks_are_selected_in_rounds(spark, monkeypatch):
    """A skewed group with values of very unlike sizes, more than a task is to hold: counted in rounds, equal to sorting."""
    rng = random.Random(2)
    rows = [("hot", rng.choice([1e-300, 1.0, 1e6, -1e300, 1e300]) * rng.random()) for _ in range(4000)] + [("hot", 5.0)] * 500 + [("cold", float(i)) for i in range(7)] + [("one", 3.0), ("far", -1.7e308), ("far", 1.7e308), ("far", float("inf"))]
    turns, plain = [], ranks._narrowed
    monkeypatch.setattr(ranks, "_narrowed", lambda *a: turns.append(1) or plain(*a))
    got = ranks.select_ranks(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", {f"r{p}": ranks.nearest_rank_of(p) for p in (1, 37, 50, 99)}, parts=8, small=3)
    want = {}
    for g in ("hot", "cold", "one", "far"):
        v = sorted(min(v, 1.7976931348623157e308) for x, v in rows if x == g)
        want[g] = tuple(v[max(0, math.ceil(p / 100 * len(v)) - 1)] for p in (1, 37, 50, 99))
    assert {r.g: tuple(r)[1:] for r in got.collect()} == want and len(turns) > 2


def test_limiter_ignores_refused_calls_and_tells_the_wait():
    times = np.array([0, 10, 20, 59, 60, 61]) * state.SECOND
    wait, last = state.admissions(times, 2, 60 * state.SECOND)
    assert (wait / state.SECOND).tolist() == [0, 0, 40, 1, 0, 9] and (last / state.SECOND).tolist() == [10, 60]
    assert state.admissions(times, 0, 60)[0].tolist() == [0] * 6
    rng = random.Random(6)
    for limit in (1, 3):
        times = np.sort(np.array([rng.randint(0, 400) for _ in range(200)]))
        hits, want = [], []
        for t in times:
            live = [h for h in hits if t - h < 50]
            want.append(0 if len(live) < limit else 50 - (t - live[-limit]))
            if len(live) < limit:
                hits.append(t)
        parts, last = [], np.zeros(0, np.int64)
        for piece in np.array_split(times, 7):
            wait, last = state.admissions(piece, limit, 50, last)
            parts += wait.tolist()
        assert parts == want


def test_cache_expires_and_evicts():
    c = state.RecentEntries(2, 10)
    asked = [("a", 0), ("a", 10), ("a", 11), ("b", 12), ("a", 13), ("c", 14), ("b", 15)]
    assert [c.ask(*x) for x in asked] == [False, True, False, False, True, False, False]
    assert not state.RecentEntries(0, 10).ask("a", 1)
    hit, born = state.expiring_hits(np.array([0, 10, 11, 15, 30]), 10)
    assert hit.tolist() == [False, True, False, True, False] and born == 30


def test_refused_calls_always_wait(spark):
    calls = spark.createDataFrame([("u", 1, 0.0), ("u", 2, 59.99), (None, 3, 1.0), (None, 4, 2.0)], "k string, event_id int, s double").selectExpr("k", "event_id", "timestamp_micros(cast(s * 1000000 as long)) as ts")
    assert {r.event_id: r.wait_s for r in state.rate_limited(calls, "k", ["ts", "event_id"], 1, 60.0).collect()} == {1: 0.0, 2: 0.1, 3: 0.0, 4: 59.0}
    got = state.recent_hits(calls.withColumn("c", F.lit(1)), "c", "k", ["ts", "event_id"], 1, 3600.0)
    assert {r.event_id: r.hit for r in got.collect()} == {1: False, 2: False, 3: False, 4: True}


def reader(lines):
    r = ingest.Reading()
    for page, text in lines:
        ingest.read_line(r, text, page)
    return r.rows


def test_paragraph_reader():
    got = reader([(1, "Chapter I"), (1, "Preliminary matters"), (1, "A. Scope of"), (1, "these rules"), (1, "1. First text that goes on-"), (2, "ward here"), (2, "(a) a part"), (2, "Chapter III of the other law"), (2, "2."), (2, "Second text")])
    assert [(p["text"], p["kind"], p["para"]) for p in got] == [
        ("Chapter I – Preliminary matters", "heading", ""), ("A. Scope of these rules", "heading", ""), ("1. First text that goes onward here", "text", "1"),
        ("(a) a part Chapter III of the other law", "text", "1"), ("2. Second text", "text", "2"),
    ]
    assert got[2]["page_end"] == 2 and got[3]["chapter"] == "Chapter I – Preliminary matters"
    annex = reader([(1, "Part B Loans"), (1, "Chapter I – One"), (1, "1. x"), (1, "Annex II Forms")])
    assert annex[-1]["chapter"] == "Annex II Forms" and annex[-1]["para"] == "" and annex[1]["heading"] == ""


def test_paragraphs_of_many_documents(spark):
    rows = [(d, p, s, f"{s + 1}. text {d}") for d in range(5) for p in (1, 2) for s in range(p * 3 - 3, p * 3)]
    got = ingest.paragraphs(spark.createDataFrame(rows, "doc int, page int, seq long, text string"))
    assert got.groupBy("doc").count().orderBy("doc").collect() == [(d, 6) for d in range(5)]


def test_noise_classes(spark):
    rows, seq = [], 0
    for page in range(1, 6):
        for text, size in [(f"Header {page}", 12.0), ("Body one is long enough to be body text here", 12.0), ("page 3 of 9", 12.0), ("another body line stays as it is in here", 12.0), ("1 a footnote in small print", 9.0), (f"{page}", 9.0)]:
            rows.append((1, page, seq, text, size))
            seq += 1
    got = ingest.classified(spark.createDataFrame(rows, "doc int, page int, seq long, text string, size double"))
    counts = {r.noise: r["count"] for r in got.groupBy("noise").count().collect()}
    assert counts["footnote"] == 10 and counts["repeated"] >= 5 and counts.get("page_number", 0) == 5


def test_rows_merge_to_their_anchor(spark):
    rows = [(1, 1, 0, "a", 10.0, 0.0), (1, 1, 1, "b", 12.0, 1.5), (1, 1, 2, "c", 9.0, 2.5)]
    got = ingest.merge_rows(spark.createDataFrame(rows, "doc int, page int, seq long, text string, size double, y0 double")).orderBy("seq").collect()
    assert [(r.text, r.size) for r in got] == [("a b", 12.0), ("c", 9.0)]


def test_log_streams_equal_their_batch(spark, tmp_path):
    from lodestone.streaming import events as log

    from .conftest import DATA

    stream = log.source(spark, f"{DATA}/sf0.001")
    for name, make in (("tumbled", log.tumbling), ("slid", log.sliding)):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        batch = make(spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_limiter_equals_batch(spark, tmp_path):
    from lodestone.streaming import events as log

    from .conftest import DATA

    q = log.limited(log.source(spark, f"{DATA}/sf0.001"), 2, 21600.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"file://{tmp_path}/limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("user_id", "event_id", "ts")
    batch = state.rate_limited(e, "user_id", ["ts", "event_id"], 2, 21600.0)
    assert sorted((r.event_id, r.allowed) for r in spark.table("limited").collect()) == sorted((r.event_id, r.wait_s == 0) for r in batch.collect())


def test_streams_drop_late_rows_and_forget_old_state(spark, tmp_path):
    """Four files, one a batch: the second moves the watermark, so the last one's old row is too late."""
    from lodestone.streaming import events as log

    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00")], [(3, "2024-01-02 00:00:00")], [(5, "2024-01-02 00:01:00")], [(4, "2024-01-01 00:20:00"), (6, "2024-01-02 00:02:00")]]
    for i, part in enumerate(rows):
        made = spark.createDataFrame([(e, t, 7, "a", 1.0, "{}") for e, t in part], "event_id long, t string, user_id long, event_type string, value double, props string")
        made.selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    import shutil

    (tmp_path / "flat").mkdir()
    for i in range(4):
        part = next((tmp_path / "in" / str(i)).glob("*.parquet"))
        shutil.move(part, tmp_path / "flat" / f"{i}.parquet")
        os.utime(tmp_path / "flat" / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/flat").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, made, mode in (("late_limit", log.limited(stream, 1, 3600.0, "1 hour"), "append"), ("late_hours", log.tumbling(stream, "1 hour", "1 hour"), "update"), ("late_questions", log.distinct_questions(stream, "event_type", 3600.0), "append")):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {r.event_id: r.allowed for r in spark.table("late_limit").collect()} == {1: True, 2: False, 3: True, 5: False, 6: False}
    assert sorted(r.n for r in spark.table("late_hours").collect()) == [1, 2, 2, 3]  # hour of day one: 2; of day two: 1, then 2, then 3
    assert sorted(r.event_id for r in spark.table("late_questions").collect()) == [1, 3]


def test_sources(spark, tmp_path):
    from lodestone.sources import tables

    (tmp_path / "a.csv").write_text('doc_id,topic,title,issued,page_url,file_url,size_kb\n1,T,"x, ""y""",d,u,f,3\n')
    assert tables.listing(tables.catalogue(spark, f"file://{tmp_path}/a.csv")).first().title == 'x, "y"'
    (tmp_path / "Doc.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "doc (1).pdf").write_bytes(b"<html>captcha")
    found = tables.files(spark, f"file://{tmp_path}", "*.pdf")
    assert {r.name: r.kind for r in found.collect()} in ({"Doc.pdf": "pdf", "doc (1).pdf": "blocked"}, {"Doc.pdf": "pdf", "doc%20(1).pdf": "blocked"})
    assert tables.json_lines(spark, f"file://{tmp_path}/none.jsonl", "id string").count() == 0
    rows = spark.createDataFrame([("1", "é")], "id string, text string")
    tables.save_json_lines(rows, f"file://{tmp_path}/out")
    assert tables.json_lines(spark, f"file://{tmp_path}/out", "id string, text string").collect() == rows.collect()
    assert spark.createDataFrame([("<a>", "u?a&b")], "title string, url string").select(tables.link_page(None)).first()[0] == '<li><a href="u?a&amp;b">&lt;a&gt;</a></li>'


def test_python_functions(spark):
    from lodestone.functions.python import located_quote, near_quote, nfkc, normal_form

    made = spark.createDataFrame([("ﬁn – “X”  y",)], "t string")
    assert made.select(nfkc("t")).first()[0] == "fin – “X”  y" and made.select(normal_form(F.col("t"))).first()[0] == 'fin - "x" y'
    assert near_quote("Bank  shall lend", "the BANK shall lend now") == "bank shall lend"
    near = near_quote("the bank shall lend to any person today", "now the bank shal lend to any person today too")
    assert near is not None and "bank shal lend" in near
    assert near_quote("nothing like it", "some other words here") is None and near_quote("", "text") is None and near_quote("abc", "") is None
    assert near_quote("“quoted” – text", 'a "quoted" - text') == '"quoted" - text'
    pairs = spark.createDataFrame([("shall lend", "It SHALL  lend."), (None, "x"), ("x", None)], "q string, t string")
    assert [r[0] for r in pairs.select(located_quote("q", "t")).collect()] == ["shall lend", None, None]


def test_retry_rules(spark):
    assert one(spark, X.retry_delay(F.lit(100.0), F.lit(1))) == 90 and one(spark, X.retry_delay(F.lit(None).cast("double"), F.lit(3))) == 8
    assert one(spark, X.daily_limit(F.lit(429), F.lit("Requests Per Day"))) and not one(spark, X.daily_limit(F.lit(500), F.lit("per day")))
    assert one(spark, X.daily_limit(F.lit(429), F.lit("PerDay limit"))) and not one(spark, X.daily_limit(F.lit(429), F.lit("per_day, per-day")))
    assert one(spark, X.client_key(F.lit(" 1.2.3.4, 5"), F.lit("h"))) == "1.2.3.4" and one(spark, X.client_key(F.lit(None).cast("string"), F.lit(""))) == "?"
    assert one(spark, X.parsed_queries(F.lit('x {"queries": [" a ", "", "b"]} y'))) == ["a", "b"]
    assert one(spark, X.parsed_queries(F.lit('{"queries": ["\\n0 x 1\\t", null, 3]}'))) == ["0 x 1", "3"] and one(spark, X.parsed_queries(F.lit("{broken}"))) == []


def test_evidence_has_no_limit_of_quotes(spark, monkeypatch):
    monkeypatch.setattr(evaluate.held_quotes, "__defaults__", (40,))
    rng = random.Random(5)
    made = lambda n: " ".join(rng.choice(["ab", "b", "ba", "a", "abba"]) for _ in range(n))
    docs = [(i % 40, made(rng.randint(0, 60))) for i in range(50)] + [(99, None)]
    quotes = [(i, made(rng.randint(0, 5))) for i in range(40)] + [(50 + i, docs[i][1][1:30]) for i in range(20)] + [(7, "ab b ba"), (80, None)]
    got = evaluate.evidence_matches(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, text string"))

    def span(text):
        w = (text or "").split()
        at = max((len(w) - 12) // 2, 0)
        return " ".join(w[at : at + 12])

    want = [(q, d) for q, quote in quotes for d, text in docs if span(quote) and span(quote) in (text or "")]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200


def test_dense_in_blocks_of_queries(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(30)], "doc int, vec array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query int, vec array<double>")
    whole, parts = ({tuple(r) for r in retrieval.dense(vectors, asked, 4, most).collect()} for most in (100, 2))
    assert whole == parts and len(parts) == 36
    assert retrieval.dense(vectors, asked.limit(0)).count() == 0


def para(text, number="", chapter="", heading="", page=1, kind="text"):
    return (text, page, page, chapter, heading, number, kind)


def parsed(spark, *paras):
    kind = "doc_id string, title string, topic string, source_url string, paragraphs array<struct<text:string,page_start:long,page_end:long,chapter:string,heading:string,para:string,kind:string>>"
    return spark.createDataFrame([("d", "Master Direction – Loans, dated June 2", "t", "u", list(paras)), ("e", None, None, None, None)], kind)


def test_long_lines_are_split_to_fit(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    got = chunk.chunk_document(parsed(spark, para("First words. " + long, "1")), "recursive", 100).orderBy("chunk_no").collect()
    assert max(r.n_tokens for r in got) == 100 and " ".join(r.text for r in got) == "First words. " + long
    count = lambda t: len(t.replace(" ", ""))
    text = "Aa bb. Cc No. 5 dd; Eeeeee fffff ggggg hhhhh. Ii."
    assert chunk.split_to_fit(text, 12, count) == ["Aa bb.", "Cc No. 5 dd;", "Eeeeee fffff", "ggggg hhhhh.", "Ii."]
    assert chunk.split_to_fit(text, 12, count, compat=True) == ["Aa bb.", "Eeeeee fffff", "Cc No. 5 dd;", "ggggg hhhhh.", "Ii."]


def test_section_chunks_hold_text_and_place(spark):
    paras = [para("Head", kind="heading"), para("a b c", "1", "C1"), para("d e", "1.2", "C1", page=2), para("f g", "2", "C1", page=3), para("h", "3", "C2", "H", 4)]
    got = chunk.chunk_document(parsed(spark, *paras), "section", 100, min_tokens=4).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.header, r.text, r.paras, r.page_start, r.page_end, r.n_tokens) for r in got] == [
        ("d:section:0000", "Loans > C1", "a b c d e", ["1", "1.2"], 1, 2, 8), ("d:section:0001", "Loans > C1", "f g", ["2"], 3, 3, 5), ("d:section:0002", "Loans > C2 > H", "h", ["3"], 4, 4, 6),
    ]
    with pytest.raises(ValueError):
        chunk.chunk_document(parsed(spark), "other")
    fixed = chunk.chunk_document(parsed(spark, *paras), "fixed", 4, 1).orderBy("chunk_no").collect()
    assert [(r.text, r.paras) for r in fixed] == [("Head a b c", ["1"]), ("c d e f", ["1", "1.2", "2"]), ("f g h", ["2", "3"])]


def test_runs_of_an_automaton_equal_trying_all():
    rng = random.Random(0)

    def plain(quote, text):
        return max((j - i for i in range(len(quote)) for j in range(i + 1, len(quote) + 1) if any(text[k : k + j - i] == quote[i:j] for k in range(len(text)))), default=0)

    for _ in range(300):
        letters = "abcdefgh"[: rng.randrange(1, 6)]
        quotes = [[rng.choice(letters) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 6))]
        least = rng.randrange(1, 4)
        finder = RunFinder(quotes, least)
        for _ in range(3):
            text = [rng.choice(letters + "x") for _ in range(rng.randrange(25))]
            assert finder.runs(text) == {i: n for i, q in enumerate(quotes) if (n := plain(q, text)) >= least}


def test_window_spans_and_packing_equal_stepwise_versions():
    def stepwise(cost, size, overlap):
        spans, at = [], 0
        while True:
            end = at
            while end < len(cost) and sum(cost[at : end + 1]) <= size + 1e-9:
                end += 1
            end = max(end, at + 1)
            spans.append((at, end))
            if end >= len(cost):
                return spans
            back = end
            while back > at + 1 and sum(cost[back - 1 : end]) <= overlap + 1e-9:
                back -= 1
            at = back

    rng = random.Random(1)
    for _ in range(300):
        cost = [rng.choice([1, 1, 2, 0.5, 3.3, 0.0]) for _ in range(rng.randrange(1, 60))]
        size, overlap = rng.choice([1, 3, 10, 30]), rng.choice([0, 1, 5, 29])
        assert chunk.window_spans(np.array(cost), size, overlap) == stepwise(cost, size, overlap)
        parts, most = ["w" * rng.randrange(1, 9) + " x" * rng.randrange(4) for _ in range(rng.randrange(50))], rng.randrange(1, 40)
        for count in (chunk.word_total, len):
            want, now = [], []
            for p in parts:
                if now and count(" ".join([*now, p])) > most:
                    want.append(" ".join(now))
                    now = []
                now.append(p)
            assert chunk.packed(parts, most, count) == want + ([" ".join(now)] if now else [])


def test_windows_share_exactly_the_overlap():
    text = " ".join(f"t{i}" for i in range(75))
    piece = {"text": text, "tokens": 75, "para": "2.1", "chapter": "c", "heading": "h", "page_start": 3, "page_end": 4, "kind": "text"}
    made = [c["text"].split() for c in chunk._fixed([piece], chunk.word_total, 30, 10)]
    assert [len(w) for w in made] == [30, 30, 30, 15] and all(a[-10:] == b[:10] for a, b in zip(made, made[1:], strict=False))
