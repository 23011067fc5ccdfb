"""Registered queries of the retriever, of answering with its service rules, of evaluation reports and of test-set construction.

Models are offline stand-ins whose replies follow from the prompt, so that SQL can state the result.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tables as table_functions
from ..functions.python import normal_form
from ..operators import answers, chunk, evaluate, grid, ingest, retrieval, search, state, testset
from ..engine import Engine, plain_documents
from ..options import Options
from ..service import Service
from ..sources import shared, store, tables
from . import catalogue as C
from .catalogue import WITHOUT_SQL, register, table

# retriever

_VECTORS = "dense_all AS (SELECT q.item_id AS query, e.vec_id AS doc, list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id, embeddings e)"
_DENSE = "dense{k} AS (SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM dense_all) WHERE rank <= {k})"


def _questions(spark, sf_dir):
    """The benchmark's items with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query"), "text", "vec")


def _modes_sql() -> str:
    lists = "SELECT query, doc, rank, 0 AS list_no FROM dense30 UNION ALL SELECT query, doc, rank, 1 FROM b30 WHERE query IN (SELECT query FROM dense_all)"
    sql = f"""{C._BASE}, {_VECTORS}, {_DENSE.format(k=30)}, {C._bm25_sql('b30', k=30)}, {C._RRF.format(n='both_', lists=lists)}
SELECT 'dense' AS mode, query, doc, round(score, 6) AS score, rank::BIGINT AS rank FROM dense30 WHERE rank <= 5 UNION ALL SELECT 'bm25', query, doc, score, rank::BIGINT FROM b30 WHERE rank <= 5 AND query IN (SELECT query FROM dense_all)
UNION ALL SELECT 'hybrid', query, doc, score, rank::BIGINT FROM both_ WHERE rank <= 5"""
    for part in ("dense_all", "b30_all", "b30", "posts", "tok"):  # else they are computed once for every use
        sql = sql.replace(f"{part} AS (", f"{part} AS MATERIALIZED (", 1)
    return sql


@register(_modes_sql())
def search_modes(spark, sf_dir):
    """The five best of every question in each mode; hybrid fuses lists of thirty."""
    stored, asked = C.index(spark, sf_dir), shared.written(_questions(spark, sf_dir), "asked")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
    lists = {m: shared.written(search.first_stage(stored, vectors, asked, m, 30), m) for m in ("dense", "bm25")}  # each searched once for all modes
    first = lambda _, mode, n: search.first_of(*(lists[m].where(F.col("rank") <= n) for m in ("dense", "bm25")), mode, n)
    parts = [search.search(None, None, asked, mode, 5, first=first).select(F.lit(mode).alias("mode"), "query", "doc", "score", F.col("rank").cast("long").alias("rank")) for mode in ("dense", "bm25", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"WITH {C._TOK}, {C._POSTS}, {C._CORPUS} SELECT (SELECT count(*) FROM posts)::BIGINT AS postings, (SELECT count(DISTINCT term) FROM posts)::BIGINT AS terms, n::BIGINT AS n, (SELECT sum(tf) FROM posts)::BIGINT AS tokens FROM corpus")
def stored_index(spark, sf_dir):
    """What the stored keyword index holds."""
    stored = C.index(spark, sf_dir)
    posts = stored.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return posts.crossJoin(stored.terms.agg(F.count("*").alias("terms"))).crossJoin(stored.corpus.select("n")).select("postings", "terms", "n", "tokens")  # one row each


@register("SELECT vec_id AS doc, CASE WHEN vec_id % 3 <> 0 THEN label ELSE label + 100 END::BIGINT AS label FROM embeddings WHERE (vec_id % 2 = 0 OR vec_id % 3 <> 0) AND vec_id % 5 <> 0")
def vector_upsert(spark, sf_dir):
    """A collection written, written again in part, and rid of vectors whose chunk is gone."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))
    where = store.vector_table(shared.fresh_path(spark, "vectors"), "section", "some/Model")
    store.upsert_vectors(rows.where("doc % 2 = 0").withColumn("label", F.col("label") + 100), where)
    store.upsert_vectors(rows.where("doc % 3 <> 0"), where)
    chunks = rows.where("(doc % 2 = 0 OR doc % 3 <> 0) AND doc % 5 <> 0").select("doc")
    return store.drop_stale(where, chunks).select("doc", "label")


@register("SELECT text, ['formal ' || text, 'again'] AS queries, item_id % 3 <> 0 AS fresh FROM (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text) WHERE item_id % 3 <> 0 UNION ALL SELECT text, ['kept'], false FROM (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text) WHERE item_id % 3 = 0")
def rewrite_cache(spark, sf_dir):
    """Phrasings from the cache for every third question, from the model for the others; the third query that it writes is cut off."""
    asked = table(spark, sf_dir, "benchmark").groupBy("text").agg(F.min("item_id").alias("item_id"))
    cache = asked.where("item_id % 3 = 0").select("text", F.array(F.lit("kept")).alias("queries"))

    def chat(prompts: list[str]) -> list[str]:
        return [json.dumps({"queries": [" formal " + p.split("Question: ", 1)[1], "again ", "too many"]}) for p in prompts]

    return search.rewritten(asked, chat, 2, cache)


def embedding_stage(spark, sf_dir):
    """Documents through the offline embedder: unit vectors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.embed_documents(docs, "text", search.hashing_embedder(32), "intfloat/e5-base-v2").select("doc_id", "vec")


# answering


def _replies(prompts: list[str]) -> list[str]:
    """A model that finds the answer to questions of even length."""
    out = []
    for p in prompts:
        even = len(p.rsplit("Question: ", 1)[1]) % 2 == 0
        out.append("Sure: " + json.dumps({"found": even, "answer": "Yes [1], but see [9]." if even else "", "citations": [2, "x"] if even else []}))
    return out


def _answered(spark, sf_dir):
    found = retrieval.small(shared.written(C._hits(spark, sf_dir, 3), "found"))  # the hits go to the texts, not the texts to the hits
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "text").join(found, "doc")
    hits = shared.written(hits.select("query", "rank", F.col("doc").cast("string").alias("chunk_id"), F.concat_ws(", ", "source", F.lit("p. 1")).alias("citation"), "text", F.lit("u").alias("url")), "hits")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    return answers.answer(asked, hits, lambda prompts: answers.complete(prompts, _replies))


_ANSWERED = "an AS (SELECT b.item_id AS query, b.text AS question, length(b.text) % 2 = 0 AS even, (SELECT list(h.doc ORDER BY rank) FROM hits h WHERE h.query = b.item_id) AS docs FROM benchmark b)"


@register(
    f"""{C._BASE}, {C._bm25_sql('hits', k=3)}, {_ANSWERED} SELECT query, even AND len(docs) >= 1 AS found, CASE WHEN even THEN 'Yes [1], but see [9].' ELSE 'The sources do not answer this question.' END AS answer,
CASE WHEN even THEN array_to_string(docs[:2], ',') ELSE '' END AS cited, CASE WHEN NOT even THEN '' WHEN len(docs) < 2 THEN '2,9' ELSE '9' END AS invalid, array_to_string(docs, ',') AS retrieved FROM an"""
)
def answer_questions(spark, sf_dir):
    """Search, prompt, model, checks: answers with the sources they cite."""
    text = lambda c: F.array_join(F.transform(c, lambda s: s["chunk_id"]), ",")
    return _answered(spark, sf_dir).select("query", "found", "answer", text("sources").alias("cited"), F.array_join(F.col("invalid_citations").cast("array<string>"), ",").alias("invalid"), text("retrieved").alias("retrieved"))


_KEY = r"regexp_replace(trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')), '[?.! ]+$', '')"


@register(
    f"""WITH r AS (SELECT conv_id * 1000 + turn AS query, trim(text) AS question, conv_id * 60 + turn AS tm, {_KEY} AS key FROM conversations WHERE role = 'user'),
f AS (SELECT key, arg_min(query, row(tm, query)) AS asker, arg_min(question, row(tm, query)) AS first FROM r GROUP BY key)
SELECT query, md5(first) AS answer, length(first) % 2 = 0 AS found, query <> asker AS cached, CASE WHEN query <> asker THEN 0 ELSE length(first) END::BIGINT AS prompt_tokens FROM r JOIN f USING (key)"""
)
def ask_cached(spark, sf_dir):
    """A batch of logged questions against an empty cache: each distinct one is asked once."""
    requests = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.col("text").alias("question"), F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn")).alias("at"))

    def respond(asked):
        n = F.length("question").cast("long")
        return asked.select("query", F.md5("question").alias("answer"), (n % 2 == 0).alias("found"), F.create_map(F.lit("prompt"), n).alias("tokens"), F.lit("ok").alias("status"))

    cache = spark.createDataFrame([], "key string, value struct<answer:string,found:boolean,tokens:map<string,bigint>,status:string>, put_at timestamp, used_at timestamp")
    out, _ = answers.ask_with_cache(requests, cache, respond)
    return out.select("query", "answer", "found", "cached", F.col("tokens")["prompt"].alias("prompt_tokens"))


@register(
    f"""WITH r AS (SELECT conv_id * 1000 + turn AS query, trim(text) AS question, conv_id * 60 + turn AS tm, {_KEY} AS key, length(trim(text)) BETWEEN 3 AND 500 AS fine FROM conversations WHERE role = 'user' AND text IS NOT NULL),
f AS (SELECT key, arg_min(query, row(tm, query)) AS asker, arg_min(question, row(tm, query)) AS first FROM r WHERE fine GROUP BY key)
SELECT query, CASE WHEN fine THEN 200 ELSE 422 END::BIGINT AS code, fine AND query <> asker AS cached, CASE WHEN fine THEN length(first) % 2 = 0 END AS found FROM r LEFT JOIN f USING (key)"""
)
def engine_ask(spark, sf_dir):
    """All logged questions as one batch of the service over an index of the benchmark's items, each distinct one answered once."""
    folder, o = shared.fresh_path(spark, "engine"), Options(mode="dense", rewriting=False, per_minute=0, final=2, cache_size=1_000_000)
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source"))
    engine = Engine.build(plain_documents(docs), folder, o)

    def post(model: str, prompt: str) -> answers.Response:
        even = len(prompt.rsplit("Question: ", 1)[1]) % 2 == 0
        return answers.Response(200, json.dumps({"found": even, "answer": "It is so [1]." if even else "", "citations": [1]}))

    requests = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.col("text").alias("question"), F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn")).alias("at"), F.col("conv_id").cast("string").alias("client"))
    out = Service(engine, folder, lambda *_: post).serve(requests)
    return out.select("query", F.col("code").cast("long").alias("code"), "cached", "found")


@register(
    """WITH r AS (SELECT (event_id * 37) % 600 AS n, CASE WHEN user_id % 9 = 0 THEN value ELSE 0 END AS wait, CASE event_id % 4 WHEN 0 THEN 'quota' WHEN 1 THEN 'broken' ELSE 'ok' END AS status FROM events)
SELECT CASE WHEN n NOT BETWEEN 3 AND 500 THEN 422 WHEN wait > 0 THEN 429 WHEN status = 'quota' THEN 503 WHEN status <> 'ok' THEN 502 ELSE 200 END::BIGINT AS code, count(*)::BIGINT AS n, max(CASE WHEN wait > 0 THEN floor(wait) + 1 END)::BIGINT AS longest FROM r GROUP BY ALL"""
)
def service_codes(spark, sf_dir):
    """The answer codes of a front end, from question lengths, waits and call states of the log."""
    n, wait = (F.col("event_id") * 37 % 600).cast("int"), F.when(F.col("user_id") % 9 == 0, F.col("value")).otherwise(0.0)
    status = F.when(F.col("event_id") % 4 == 0, "quota").when(F.col("event_id") % 4 == 1, "broken").otherwise("ok")
    e = table(spark, sf_dir, "events").select(F.repeat(F.lit("q"), n).alias("question"), wait.alias("wait"), status.alias("status"))
    code = answers.http_status(F.col("question"), F.col("wait"), F.col("status")).cast("long")
    return e.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.max(answers.retry_after(F.col("wait"))).cast("long").alias("longest"))


@register("SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM pages)::BIGINT AS chunks, 'section' AS chunking, 'hybrid' AS search, 'local:offline' AS answer_model, 5::BIGINT AS top_k, '0 of 256' AS answer_cache")
def service_info(spark, sf_dir):
    row = answers.info(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"), Options())
    return row.select("documents", "chunks", "chunking", "search", "answer_model", F.col("top_k").cast("long").alias("top_k"), "answer_cache")


@register("SELECT event_type AS question, count(*)::BIGINT AS n, count(*) FILTER (WHERE event_id % 3 = 0)::BIGINT AS failed, 12::BIGINT AS id_length, 300::BIGINT AS longest_error FROM events GROUP BY event_type")
def request_log(spark, sf_dir):
    """The log's rows, written and read again: a request id of twelve digits, errors cut to 300 characters."""
    path = shared.fresh_path(spark, "log")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("question"), (F.col("event_id") % 2 == 0).alias("found"), F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("x"), 400)).alias("error"))
    store.append_log(rows, path)
    log = store.read_log(spark, path)
    return log.groupBy("question").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max(F.length("request_id")).cast("long").alias("id_length"), F.max(F.length("error")).cast("long").alias("longest_error"))


@register(
    """SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0 AND lower('Requests Per Day') SIMILAR TO '.*per ?day.*' AND user_id % 2 = 0)::BIGINT AS daily, round(sum(CASE WHEN user_id % 5 = 0 THEN least(value + 1, 90) ELSE least(pow(2, event_id % 8), 60) END), 4) AS waits,
min(CASE WHEN user_id % 4 = 0 THEN 'host' ELSE '10.0.0.' || (user_id % 3) END) AS first_client FROM events GROUP BY event_type"""
)
def retry_rules(spark, sf_dir):
    """Daily limits, waits before a retry and callers' addresses."""
    user, event = F.col("user_id"), F.col("event_id")
    daily = X.daily_limit(F.when(event % 3 == 0, 429).otherwise(500), F.when(user % 2 == 0, "Requests Per Day used up").otherwise("per_day"))
    wait = X.retry_delay(F.when(user % 5 == 0, F.col("value")), event % 8)
    client = X.client_key(F.when(user % 4 == 0, "").otherwise(F.concat(F.lit(" 10.0.0."), (user % 3).cast("string"), F.lit(" , 1.1.1.1"))), F.lit("host"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(daily.cast("long")).alias("daily"), F.round(F.sum(wait), 4).alias("waits"), F.min(client).alias("first_client"))


@register(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE lang || chr(10) END || source AS index_text, source || '__some-model' AS collection, source || ' **[' || doc_id % 7 || ']** and **[12]**' AS marked FROM documents"""
)
def text_forms(spark, sf_dir):
    """Text as it is indexed, names of collections, marked citations."""
    answer = F.concat("source", F.lit(" ["), (F.col("doc_id") % 7).cast("string"), F.lit("] and [12]"))
    return table(spark, sf_dir, "documents").select("doc_id", X.index_text(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("source")).alias("index_text"), X.collection_name(F.col("source"), F.lit("org/Some-Model")).alias("collection"), X.highlighted(answer).alias("marked"))


@register(
    """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_type, event_id, k, false AS hit, [user_id] AS keys, [s] AS born FROM e WHERE k = 1 UNION ALL
SELECT event_type, event_id, k, hit, list_append(list_filter(keys, lambda x: x <> user_id), user_id)[-20:], list_append(list_filter(born, lambda x, i: keys[i] <> user_id), CASE WHEN hit THEN old ELSE s END)[-20:]
FROM (SELECT e.event_type, e.event_id, e.k, e.user_id, e.s, r.keys, r.born, r.born[list_position(r.keys, e.user_id)] AS old, coalesce(e.s - r.born[list_position(r.keys, e.user_id)] <= 172800, false) AS hit FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1))
SELECT event_type, event_id, hit FROM r"""
)
def lru_cache_hits(spark, sf_dir):
    """A least-recently-used cache of twenty users for each event type, two days to live."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "ts")
    return state.recent_hits(rows, "event_type", "user_id", ["ts", "event_id"], 20, 172_800.0).select("event_type", "event_id", "hit")


# evaluation

_SPANNED = f"{C._EVIDENCE}, src AS (SELECT t.query, min(d.source) AS source FROM truth t JOIN documents d ON d.doc_id = t.doc GROUP BY t.query)"


def _evidence(spark, sf_dir):
    """Each answerable item with two evidences: its text, and its first ten words with nine others, both of one source that holds it."""
    truth = C._truth(spark, sf_dir)[0].join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    src = truth.groupBy("query").agg(F.min("source").alias("source")).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), "query")
    cut = F.concat_ws(" ", F.array_join(F.slice(F.split(normal_form(F.col("text")), " "), 1, 10), " "), F.lit("zq1 zq2 zq3 zq4 zq5 zq6 zq7 zq8 zq9"))
    return src.select("query", F.lit(0).alias("ev"), "source", F.col("text").alias("quote")).unionByName(src.select("query", F.lit(1).alias("ev"), "source", cut.alias("quote")))


_COVERED = f"""{_SPANNED}, cov AS (SELECT query, 0 AS ev, doc FROM truth UNION ALL SELECT s.query, 1, d.doc_id FROM src s JOIN qn ON qn.item_id = s.query JOIN documents d ON d.source = s.source JOIN dn ON dn.doc = d.doc_id WHERE contains(dn.t, array_to_string(qn.w[1:10], ' ')))"""


@register(f"WITH {_COVERED} SELECT query, ev::BIGINT AS ev, doc FROM cov")
def relevance_coverage(spark, sf_dir):
    """Which documents hold which evidence: the key span anywhere, or half of the quote in one run in its own source."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "text")
    return evaluate.coverage(texts, _evidence(spark, sf_dir)).select("query", F.col("ev").cast("long").alias("ev"), "doc")


@register(
    f"""{C._BASE}, {C._bm25_sql('hits', k=3)}, {_ANSWERED}, {_SPANNED}, a AS (SELECT an.*, CASE WHEN query % 4 = 0 THEN 'unanswerable' ELSE 'single' END AS kind, even AND len(docs) >= 1 AS found, CASE WHEN even THEN docs[:2] ELSE [] END AS cited FROM an),
c AS (SELECT a.*, len(list_filter(docs, lambda d: d IN (SELECT doc FROM truth t WHERE false))) AS nothing FROM a), h AS (SELECT query, min(rank) AS first FROM hits JOIN truth USING (query, doc) GROUP BY query),
x AS (SELECT query, count(*) AS n FROM (SELECT query, unnest(cited) AS doc FROM a) JOIN truth USING (query, doc) GROUP BY query)
SELECT a.query, kind, CASE WHEN kind = 'unanswerable' THEN NOT found END AS refusal_correct, CASE WHEN kind <> 'unanswerable' THEN coalesce(x.n, 0) > 0 END AS cites_evidence, CASE WHEN kind <> 'unanswerable' THEN round(coalesce(1.0::DOUBLE / h.first, 0), 6) END AS mrr,
CASE WHEN found AND kind <> 'unanswerable' THEN 'partially_supported' END AS faithfulness FROM a LEFT JOIN x USING (query) LEFT JOIN h USING (query)"""
)
def answer_rows(spark, sf_dir):
    """Answers held against their evidence and graded by a judge."""
    truth = C._truth(spark, sf_dir)[0].select("query", "ev", F.col("doc").cast("string").alias("doc"))
    kind = F.when(F.col("item_id") % 4 == 0, "unanswerable").otherwise("single")
    records = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), kind.alias("kind"), F.lit(1).alias("n_evidence"), F.col("text").alias("reference"))
    given = shared.written(_answered(spark, sf_dir), "given")  # the judge and the scores read it
    asked = evaluate.judge_prompts(given.where("found").join(records.where("kind <> 'unanswerable'").select("query", "reference"), "query"))
    judged = answers.complete(asked, lambda prompts: ['{"correctness": " Correct", "faithfulness": "Partially supported", "reason": "' + "r" * 400 + '"}' for _ in prompts])
    verdicts = judged.select("query", evaluate.verdict(F.col("reply")).alias("verdict"))
    return evaluate.answer_rows(records, given, truth, verdicts).select("query", "kind", "refusal_correct", "cites_evidence", "mrr", "faithfulness")


@register("SELECT event_type, count(*) FILTER (WHERE event_id % 4 IN (0, 1))::BIGINT AS valid, count(*) FILTER (WHERE event_id % 4 = 0)::BIGINT AS correct, count(*) FILTER (WHERE event_id % 4 = 1)::BIGINT AS partially FROM events GROUP BY event_type")
def judge_verdicts(spark, sf_dir):
    """Verdicts read from replies; unknown grades and broken JSON are none."""
    k = F.col("event_id") % 4
    reply = F.when(k == 0, '```{"correctness": "CORRECT ", "faithfulness": "supported"}```').when(k == 1, '{"correctness": "partial", "faithfulness": "Partially Supported", "reason": "x"}').when(k == 2, '{"correctness": "fine", "faithfulness": "supported"}').otherwise("none")
    v = table(spark, sf_dir, "events").select("event_type", evaluate.verdict(reply).alias("v"))
    one = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return v.groupBy("event_type").agg(one(F.col("v").isNotNull()).alias("valid"), one(F.col("v.correctness") == "correct").alias("correct"), one(F.col("v.faithfulness") == "partially_supported").alias("partially"))


_RESULTS = "r AS (SELECT CASE p_size % 2 WHEN 0 THEN 'original' ELSE 'paraphrased' END AS dataset, CASE p_size % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS mode, CASE WHEN p_size % 5 = 0 THEN 'model' ELSE 'none' END AS rerank, CASE WHEN p_size % 7 = 0 THEN 'yes' ELSE 'no' END AS rewrite, round(avg(p_retailprice), 4) AS recall_5 FROM part GROUP BY ALL)"


def _results(spark, sf_dir):
    n = F.col("p_size")
    keys = [F.when(n % 2 == 0, "original").otherwise("paraphrased").alias("dataset"), F.when(n % 3 == 0, "bm25").when(n % 3 == 1, "dense").otherwise("hybrid").alias("mode"), F.when(n % 5 == 0, "model").alias("rerank"), F.when(n % 7 == 0, "yes").otherwise("no").alias("rewrite")]
    return table(spark, sf_dir, "part").groupBy(*keys).agg(F.round(F.avg("p_retailprice"), 4).alias("recall_5"))


@register(
    f"""WITH {_RESULTS} SELECT dataset, 'section' AS strategy, CASE mode WHEN 'bm25' THEN 'BM25' WHEN 'dense' THEN 'Dense' ELSE 'Hybrid' END || CASE WHEN rewrite = 'yes' THEN ' + rewriting' ELSE '' END || CASE WHEN rerank <> 'none' THEN ' + model reranker' ELSE '' END AS label, recall_5,
row_number() OVER (ORDER BY dataset, recall_5 DESC, mode, rerank, rewrite)::BIGINT AS place FROM r"""
)
def retrieval_report(spark, sf_dir):
    """Results of many settings in words and in order; parts of a setting that are not stored have their defaults."""
    return evaluate.retrieval_table(_results(spark, sf_dir)).select("dataset", "strategy", "label", "recall_5", F.col("place").cast("long").alias("place"))


@register("SELECT event_type, user_id % 3 AS third, (CASE WHEN GROUPING(event_type) = 1 THEN 2 WHEN GROUPING(user_id % 3) = 1 THEN 1 ELSE 0 END)::BIGINT AS level, count(*)::BIGINT AS n, round(avg(value), 4) AS mean FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def report_levels(spark, sf_dir):
    """Counts and means by two levels, with their totals."""
    return evaluate.by_level(table(spark, sf_dir, "events").withColumn("third", F.col("user_id") % 3), ["event_type", "third"], "value").select("event_type", "third", "level", "n", "mean")


def _records(spark, sf_dir):
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "single").when(k == 1, "multi").when(k == 2, "unanswerable").when(k == 3, "other").otherwise("single")
    quote = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("doc_id") % 12).cast("int")), " ").alias("quote"), F.lit("").alias("para"), F.lit(1).alias("page"))
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).cast("string").alias("id"), F.when(F.col("lang") == "fr", " ").otherwise(F.col("lang")).alias("question"), F.when(F.col("doc_id") % 11 == 0, "").otherwise("a").alias("answer"), kind.alias("kind"),
        F.when(F.col("doc_id") % 13 == 0, "pending").otherwise("approved").alias("status"), F.array_repeat(quote, (F.col("doc_id") % 3).cast("int")).alias("evidence"))


@register(
    """WITH r AS (SELECT doc_id, (doc_id % 700)::VARCHAR AS id, lang, doc_id % 5 AS k, doc_id % 3 AS n, len(list_filter(string_split(array_to_string(string_split(text, ' ')[1:doc_id % 12], ' '), ' '), lambda w: trim(w, ' ' || chr(10) || chr(9)) <> '')) AS w, regexp_extract_all(array_to_string(string_split(text, ' ')[1:doc_id % 12], ' '), '[^ \\t\\n\\r\\f\\v]+') AS ws FROM documents),
f AS (SELECT id, 'kind' AS fault FROM r WHERE k = 3 UNION ALL SELECT id, 'status' FROM r WHERE doc_id % 13 = 0 UNION ALL SELECT id, 'question' FROM r WHERE lang = 'fr' UNION ALL SELECT id, 'answer' FROM r WHERE k <> 2 AND doc_id % 11 = 0
UNION ALL SELECT id, 'evidence' FROM r WHERE CASE WHEN k <> 2 THEN n <= 0 ELSE n > 0 END UNION ALL SELECT id, 'two evidences' FROM r WHERE k = 1 AND n <> 2 UNION ALL SELECT id, 'short quote' FROM r WHERE k <> 2 AND n > 0 AND len(ws) < 8
UNION ALL SELECT id, 'repeated id' FROM r GROUP BY id HAVING count(*) > 1) SELECT fault, count(*)::BIGINT AS n FROM f GROUP BY fault"""
)
def record_integrity(spark, sf_dir):
    """Broken rules of a reviewed data set."""
    return evaluate.record_faults(_records(spark, sf_dir)).groupBy("fault").agg(F.count("*").alias("n"))


@register("SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 7 = 1 THEN 'changed' END AS fault, count(*)::BIGINT AS n FROM labels WHERE doc_id % 7 IN (0, 1) GROUP BY ALL UNION ALL SELECT 'unknown', count(*)::BIGINT FROM (SELECT doc_id FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)")
def paraphrase_integrity(spark, sf_dir):
    """Paraphrased records held against the originals."""
    none = F.array().cast(testset.EVIDENCE)
    original = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("a").alias("answer"), none.alias("evidence"))
    second = original.where("cast(id as long) % 7 <> 0").withColumn("answer", F.when(F.col("id").cast("long") % 7 == 1, "b").otherwise("a"))
    extra = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), "item_id").select(F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("id"), F.lit("a").alias("answer"), none.alias("evidence"))
    return evaluate.paraphrase_faults(original, second.unionByName(extra)).groupBy("fault").agg(F.count("*").alias("n"))


# test set


def _passages(spark, sf_dir):
    return chunk.passages(C._parsed(spark, sf_dir)).withColumn("chapter", F.col("section")).withColumn("title", F.col("section")).withColumn("topic", F.lit("all"))


_PASSAGES = C.ORACLE_SQL["passage_runs"].replace("SELECT doc_id, (row_number()", "passages AS (SELECT doc_id, (row_number()", 1) + ")"
_PASSAGES = _PASSAGES.replace("\npassages AS", ",\npassages AS") if ",\npassages" not in _PASSAGES else _PASSAGES
_USEFUL = r"NOT contains(lower(section), 'repeal') AND len(regexp_extract_all(lower(text), 'circular')) <= 4 AND (regexp_matches(text, '\d') OR contains(lower(text), 'shall'))"


@register(f"{_PASSAGES} SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE {_USEFUL})::BIGINT AS useful FROM passages GROUP BY doc_id")
def useful_passages(spark, sf_dir):
    """Passages worth a question."""
    found = _passages(spark, sf_dir).withColumn("good", testset.useful(F.col("section"), F.col("text")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("useful"))


_PICKED = "o AS (SELECT *, md5('7:' || doc_id || ':' || passage_no) AS o FROM passages), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY o, passage_no) > 1 AS again FROM o), pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY again, o, passage_no) AS pick FROM g)"


@register(f"{_PASSAGES}, {_PICKED} SELECT doc_id, passage_no, pick::BIGINT AS pick FROM pk WHERE pick <= 2")
def picked_passages(spark, sf_dir):
    """Two passages of each document, of different chapters if there are."""
    return testset.pick_passages(_passages(spark, sf_dir), 2).select("doc_id", "passage_no", F.col("pick").cast("long").alias("pick"))


def _write_questions(asked):
    """A model that asks about a passage's last line."""

    def chat(prompts: list[str]) -> list[str]:
        return [json.dumps({"question": " Which? ", "answer": "This.", "question_type": "fact", "evidence_quote": p.rsplit("\n", 1)[1]}) for p in prompts]

    return answers.complete(asked, chat)


def generated_questions(spark, sf_dir):
    """One question for each picked passage, with its quote found again."""
    passages = _passages(spark, sf_dir)
    paras = passages.select("doc_id", "passage_no", F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("para", F.col("seq").cast("string")).withColumn("page_start", F.lit(1))
    records, _ = testset.generate_single(testset.pick_passages(passages, 1), paras, _write_questions)
    return records.select("key", "question", "kind", "qtype", "origin", "status", F.col("evidence")[0]["quote"].alias("quote"), F.col("evidence")[0]["para"].alias("para"))


def misquoted(spark, sf_dir):
    """Every benchmark item with a wrong letter for each of twenty, looked for in all lines of all documents."""
    paras = chunk.lines(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "seq", F.col("line").alias("text"), F.col("seq").cast("string").alias("para"), F.lit(1).alias("page_start"))
    wrong = F.regexp_replace(F.substring("text", 1, 120), r"(?s)(.{19}).", "$1~")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.lit(None).cast("long").alias("doc_id"), wrong.alias("quote"))
    return testset.near_quotes(asked, paras).select("item", "doc_id", "seq", "exact")


def eval_settings(spark, sf_dir):
    """Mean scores of settings over all axes: every benchmark item asked for in its words and in their reverse order, in the chunks of all documents."""
    docs = plain_documents(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("string"))
    evidence = F.array(F.struct(F.lit(None).cast("string").alias("doc_id"), F.col("text").alias("quote")))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("single").alias("kind"), evidence.alias("evidence"))
    turned = items.withColumn("question", F.array_join(F.reverse(F.split("question", " ")), " "))

    def first_half(questions):
        words = F.split("text", " ")
        return questions.select("text", F.array(F.array_join(F.slice(words, 1, F.ceil(F.size(words) / 2).cast("int")), " ")).alias("queries"))

    made = grid.Grid(spark, shared.fresh_path(spark, "grid"), docs, {"original": items, "paraphrased": turned}, {"hashing": search.hashing_embedder(), "wide": search.hashing_embedder(128)}, rewrite=first_half, rewriter="first half")
    wanted = grid.settings(mode=["hybrid", "bm25"]) + grid.settings(dataset=["paraphrased"], mode=["bm25"]) + grid.settings(rewrite=["yes"], rerank=["lexical"]) + grid.settings(strategy=["fixed"], mode=["dense"], embedding=["wide"])
    return made.run(wanted).drop("ms_per_query")


def _kept_lines(spark, sf_dir):
    """Every document's lines, forty to a page."""
    lines = chunk.lines(table(spark, sf_dir, "documents"))
    return lines.select("doc", F.floor(F.col("seq") / 40 + 1).alias("page"), "seq", F.col("line").alias("text"))


def paragraph_table(spark, sf_dir):
    """Paragraphs of all documents by the table function, from SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT doc, seq, text, page_start, page_end, kind FROM paragraphs(TABLE(SELECT * FROM {lines}) PARTITION BY doc ORDER BY (page, seq))", lines=_kept_lines(spark, sf_dir))


WITHOUT_SQL |= {f.__name__: f for f in (embedding_stage, eval_settings, generated_questions, misquoted, paragraph_table)}


@register("SELECT doc_id::VARCHAR AS id, CASE WHEN toxic = 1 THEN 'q' || doc_id WHEN doc_id % 3 = 0 THEN 'done' ELSE 'plainly' END AS question FROM labels WHERE toxic = 1 OR doc_id % 3 = 0 OR doc_id % 5 <> 0")
def paraphrased_set(spark, sf_dir):
    """Records in everyday words: some were done before, unanswerable ones are copied, failed ones wait."""
    records = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.when(F.col("toxic") == 1, "unanswerable").otherwise("single").alias("kind"), F.lit("").alias("note"))
    done = records.where("kind = 'single' AND cast(id as long) % 3 = 0").withColumn("question", F.lit("done"))

    def chat(prompts: list[str]) -> list[str]:
        return ['{"question": ""}' if int(p.rsplit("q", 1)[1]) % 5 == 0 else '{"question": " plainly "}' for p in prompts]

    return testset.paraphrased(records, done, lambda asked: answers.complete(asked, chat)).select("id", "question")


@register("SELECT CASE WHEN toxic = 1 THEN 'multi' ELSE 'single' END AS kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE doc_id % 4 <> 0)::BIGINT AS reviewed, count(*) FILTER (WHERE doc_id % 4 <> 0 AND quality = 1)::BIGINT AS kept, count(*) FILTER (WHERE doc_id % 4 = 0)::BIGINT AS pending FROM labels GROUP BY ALL")
def review_progress(spark, sf_dir):
    status = F.when(F.col("doc_id") % 4 == 0, "pending").when(F.col("quality") == 1, "approved").otherwise("rejected")
    records = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "multi").otherwise("single").alias("kind"), status.alias("status"))
    return testset.review_progress(records)


@register(
    f"""WITH {_SPANNED}, first_doc AS (SELECT query, min(doc) AS doc_id FROM truth GROUP BY query), ln AS (SELECT doc_id, i - 1 AS seq, x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
m AS (SELECT f.query AS item, ln.seq, {C._NORM} AS norm, span FROM first_doc f JOIN ln USING (doc_id) JOIN span ON span.query = f.query) SELECT item, min(seq)::BIGINT AS seq FROM m WHERE contains(norm, span) GROUP BY item"""
)
def source_paragraphs(spark, sf_dir):
    """The line of a document that holds a quote's key span."""
    docs = C._truth(spark, sf_dir)[0].groupBy("query").agg(F.min("doc").alias("doc_id"))
    quotes = table(spark, sf_dir, "benchmark").join(docs, F.col("item_id") == F.col("query")).select(F.col("item_id").alias("item"), "doc_id", F.col("text").alias("quote"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return testset.source_paragraph(quotes, lines).select("item", F.col("seq").cast("long").alias("seq"))


# sources and lines


@register("SELECT page_id::VARCHAR AS doc_id, 'T' || page_id % 4 AS topic, url || ', \"quoted\"' AS title, 'May ' || page_id AS issued, url FROM pages")
def catalogue_listing(spark, sf_dir):
    """A catalogue as CSV with quoted fields, read back and listed."""
    path = shared.fresh_path(spark, "catalogue")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.concat(F.lit("T"), (F.col("page_id") % 4).cast("string")).alias("topic"), F.concat("url", F.lit(', "quoted"')).alias("title"), F.concat(F.lit("May "), F.col("page_id").cast("string")).alias("issued"), F.col("url").alias("page_url"), F.lit("f").alias("file_url"), F.lit("1").alias("size_kb"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.listing(tables.catalogue(spark, path))


@register("SELECT doc_id::VARCHAR AS id, kind, len(q)::BIGINT AS n_evidence FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'multi' ELSE 'single' END AS kind, range(quality + toxic) AS q FROM labels)")
def record_lines(spark, sf_dir):
    """Records as JSON lines, written and read strictly."""
    path = shared.fresh_path(spark, "records")
    one = F.struct(F.lit("d").alias("doc_id"), F.lit("q").alias("quote"), F.lit("1").alias("para"), F.lit(1).alias("page"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("é").alias("answer"), F.when(F.col("toxic") == 1, "multi").otherwise("single").alias("kind"), F.lit("").alias("qtype"), F.array_repeat(one, F.col("quality") + F.col("toxic")).alias("evidence"), F.lit("").alias("origin"), F.lit("pending").alias("status"), F.lit("").alias("note"))
    tables.save_json_lines(rows, path)
    return tables.json_lines(spark, path, tables.RECORDS).select("id", "kind", F.size("evidence").cast("long").alias("n_evidence"))


_LN = "ln AS (SELECT doc_id, i - 1 AS seq, x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


@register(f"WITH {_LN}, k AS (SELECT doc_id, seq // 3 AS row, seq, text FROM ln WHERE trim(text) <> '') SELECT doc_id AS doc, min(seq)::BIGINT AS seq, md5(string_agg(text, ' ' ORDER BY seq)) AS digest, max(seq % 5)::DOUBLE AS size FROM k GROUP BY doc_id, row")
def merged_rows(spark, sf_dir):
    """Lines that lie on one row of a page are joined; three lines share a row."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).where(F.trim("text") != "")
    placed = lines.withColumn("size", (F.col("seq") % 5).cast("double")).withColumn("y0", F.floor(F.col("seq") / 3) * 10.0 + F.col("seq") % 3 * 0.9)
    return ingest.merge_rows(placed).select("doc", "seq", F.md5("text").alias("digest"), "size")


@register(
    rf"""WITH {_LN}, s AS (SELECT doc_id, seq, j, w FROM (SELECT doc_id, seq, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) - 1 AS j FROM ln))
SELECT doc_id AS doc, seq::BIGINT AS seq, md5(string_agg(w, ' ' ORDER BY j)) AS digest, max(10 + j % 3)::DOUBLE AS size FROM s WHERE j % 4 <> 3 GROUP BY doc_id, seq"""
)
def span_lines(spark, sf_dir):
    """Lines put together from spans of one word each; every fourth is a superscript and goes. Lines of a repeated document meet before they become spans, which take
    several times a line's room."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    met = lines.groupBy("doc", "page", F.col("seq").cast("long").alias("seq")).agg(F.collect_list("line").alias("lines"))

    def span(word, i):
        return F.struct(i.alias("span"), F.concat(F.lit("  "), word, F.lit(" ")).alias("text"), F.when(i % 4 == 3, 1).otherwise(4).alias("flags"), (10 + i % 3).cast("double").alias("size"), F.lit(0.0).alias("y0"))

    words = F.transform("lines", lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"([^\x20\t-\r]+)"), 1), span))
    return ingest.spans_to_lines(met.select("doc", "page", "seq", F.flatten(words).alias("spans"))).select("doc", "seq", F.md5("text").alias("digest"), "size")


@register(rf"WITH {_LN} SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < 0.95)::BIGINT AS accented FROM (SELECT doc_id, text FROM ln) GROUP BY doc_id")
def accented_lines(spark, sf_dir):
    """Lines by their share of ASCII letters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(X.mostly_non_latin(F.col("text"), 0.95).cast("long")).alias("accented"))


@register(
    rf"""WITH {C._PAGES}, z AS (SELECT *, CASE WHEN length(text) % 4 = 0 THEN 9.0 ELSE 12.0 END AS size, regexp_matches(text, '(?i)^\s*(page\s*)?\d{{1,3}}(\s*(of|/)\s*\d{{1,3}})?\s*$') AS number FROM l),
sz AS (SELECT doc, size, sum(length(text)) AS chars, min(seq) AS seen FROM z GROUP BY doc, size), body AS (SELECT doc, arg_max(size, (chars, -seen)) AS body FROM sz GROUP BY doc),
m AS (SELECT z.*, body, size < body - 1 AS small FROM z JOIN body USING (doc)), b AS (SELECT *, max(CASE WHEN NOT small AND NOT number THEN seq END) OVER (PARTITION BY doc, page) AS block FROM m)
SELECT doc, any_value(body)::DOUBLE AS body, count(*) FILTER (WHERE seq >= note)::BIGINT AS footnotes, count(*)::BIGINT AS n FROM (SELECT *, min(CASE WHEN small AND seq > coalesce(block, -1) THEN seq END) OVER (PARTITION BY doc, page) AS note FROM b) GROUP BY doc"""
)
def footnote_lines(spark, sf_dir):
    """The body's font size, and small print at the end of pages."""
    lines = C._page_lines(spark, sf_dir).withColumn("size", F.when(F.length("text") % 4 == 0, 9.0).otherwise(12.0))
    marked = ingest.classified(lines).groupBy("doc").agg(F.sum(F.when(F.col("noise") == "footnote", 1).otherwise(0)).cast("long").alias("footnotes"), F.count("*").alias("n"))
    return marked.join(ingest.body_size(lines), "doc").select("doc", "body", "footnotes", "n")
