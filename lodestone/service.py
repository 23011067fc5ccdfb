"""What a call of a user goes through, for a batch of requests: checks, limit, cache, rewriting, search, reranking, answer, log.

The folder of the service keeps what outlives a batch: the cache of answers and the cache of phrasings as snapshots, and the request log.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .operators import answers, search, state
from .sources import store
from .sources.shared import scratch, written
from .sources.snapshots import Collection

NOTHING = {"answer": "string", "found": "boolean", "sources": f"array<{answers.SOURCE}>", "invalid_citations": "array<int>", "tokens": "map<string,bigint>", "status": "string"}
VALUE = "struct<" + ",".join(f"{n}:{t}" for n, t in NOTHING.items()) + ">"


class Service:
    """``connect(provider, temperature, reply_tokens)`` gives the provider's ``post(model, prompt)``; it is called when a batch is served. All
    else is said by the engine's options."""

    def __init__(self, engine: Engine, folder: str, connect: Callable[[str, float, int], Callable[[str, str], answers.Response]], in_flight: int = 8, sleep: Callable[[float], None] | None = None):
        self.engine, self.options, self.spark, self.connect, self.in_flight, self.sleep = engine, engine.options, engine.spark, connect, in_flight, sleep
        self.log = f"{folder}/log"
        self.cache, self.phrasings = (Collection(self.spark, f"{folder}/{n}", k, 16) for n, k in (("answers", "key"), ("phrasings", "text")))

    def _ask(self, prompts: DataFrame) -> DataFrame:
        o = self.options
        provider, model = o.route()
        post = self.connect(provider, o.temperature, o.reply_tokens)
        return answers.ask_model(prompts, post, model, o.fallback_model, rules=answers.Attempts(o.attempts), in_flight=self.in_flight, sleep=self.sleep)

    def rewrites(self, questions: DataFrame) -> DataFrame | None:
        """(text, queries) of questions (query, question), from the kept phrasings or the model, if the option ``rewriting`` is set; new ones are kept."""
        if not self.options.rewriting:
            return None
        known = self.phrasings.read() if self.phrasings.versions() else self.spark.createDataFrame([], "text string, queries array<string>")
        made = written(search.rewritten(questions.select(F.col("question").alias("text")), None, self.options.rewrites, known, self._ask), "rewrites")
        self.phrasings.upsert(made.where("fresh").select("text", "queries"))
        return made.select("text", "queries")

    def respond(self, questions: DataFrame) -> DataFrame:
        """Answers (``answers.answer``) of questions (query, question). ``timings`` has llm_s, the call's own seconds, and retrieval_s and total_s, for which
        the batch's seconds of a step are shared by its questions."""
        asked = written(questions, "questions")
        n, started = max(1, asked.count()), time.perf_counter()
        hits = written(self.engine.search(asked, rewrites=self.rewrites(asked)), "hits")
        retrieval = time.perf_counter() - started
        out = written(answers.answer(asked, hits, self._ask), "answers")
        total = time.perf_counter() - started
        steps = F.create_map(F.lit("retrieval_s"), F.lit(round(retrieval / n, 3)), F.lit("total_s"), F.lit(round(total / n, 3)))
        return out.withColumn("timings", F.map_concat("timings", steps))

    def serve(self, requests: DataFrame) -> DataFrame:
        """(query, question, code, wait_s, answer, found, sources, invalid_citations, tokens, cached) of requests (query, question, at, client).

        Only questions of 3 to 500 characters count against a client's calls of a minute; only calls within them are answered, from the cache or by the model, and
        logged."""
        o = self.options
        with scratch(self.spark) as keep:
            rows = requests.select("query", F.trim("question").alias("question"), "at", "client")
            fine = answers.question_ok(F.col("question"))
            limited = state.rate_limited(rows.where(fine), "client", ["at", "query"], o.per_minute, 60.0)
            checked = written(limited.unionByName(rows.where(~fine).withColumn("wait_s", F.lit(0.0))), "checked")
            passed = checked.where(answers.question_ok(F.col("question")) & (F.col("wait_s") == 0)).select("query", "question", "at")
            held = self.cache.read() if self.cache.versions() else self.spark.createDataFrame([], f"key string, value {VALUE}, put_at timestamp, used_at timestamp")
            told: list[DataFrame] = []

            def respond(asked: DataFrame) -> DataFrame:
                told.append(self.respond(asked))
                return told[0]

            said, kept = answers.ask_with_cache(passed, held, respond, o.cache_size, o.cache_hours * 3600)
            said, kept = written(said, "said"), written(kept, "kept")
            self._log(said, told[0], o)
            self.cache.upsert(self.cache.changed(kept))
            self.cache.delete(held.join(kept, "key", "left_anti"))
            for c in (self.cache, self.phrasings):
                c.compact()
            out = checked.join(said.drop("question"), "query", "left")
            code = answers.http_status(F.col("question"), F.col("wait_s"), F.coalesce("status", F.lit("ok")))
            return keep(out.select("query", "question", code.alias("code"), "wait_s", *(c for c in NOTHING if c != "status"), F.coalesce("cached", F.lit(False)).alias("cached")), "served")

    def _log(self, said: DataFrame, told: DataFrame, o) -> None:
        fresh = told.select("query", F.transform("retrieved", lambda s: s["chunk_id"]).alias("retrieved"), "timings", F.col("status").alias("end"))
        cited = F.transform(F.coalesce("sources", F.array().cast(NOTHING["sources"])), lambda s: s["citation"])
        failed = F.when(F.col("status") != "ok", F.col("status"))
        rows = said.join(fresh, "query", "left").select("question", "found", cited.alias("cited"), "retrieved", "timings", "tokens", "cached", F.lit(o.model).alias("model"), failed.alias("error"))
        store.append_log(rows, self.log, o.log_bytes)
