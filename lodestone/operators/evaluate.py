"""Evaluation: evidence, coverage, ranking metrics, shares, percentiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.python import TEXTS, normal_form, run_length
from ..functions.runs import RunFinder
from ..session import spread
from .ranks import nearest_rank_of, select_ranks
from .retrieval import blocks

KS = (1, 3, 5, 10)
#: Most words of quotes that one reading of the texts looks for; more are cut into blocks, each of which reads the texts once.
MOST_WORDS = 200_000
#: Fewer words than this in a span or a run are looked for as characters, quote by quote.
FEW = 4


def evidence_matches(docs: DataFrame, quotes: DataFrame, doc_col: str = "doc_id", text_col: str = "text", quote_col: str = "item_id", quote_text: str = "text") -> DataFrame:
    """(query, doc): documents whose normalised text holds the quote's key span; any number of quotes."""
    asked = quotes.select(F.col(quote_col).alias("item"), F.lit(None).cast("string").alias("source"), normal_form(F.col(quote_text)).alias("quote"))
    texts = spread(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")))
    found = held_quotes(texts.select("doc", F.lit(None).cast("string").alias("source"), normal_form(F.col("text")).alias("text")), asked)
    return found.select(F.col("item").alias("query"), "doc")


def held_quotes(texts: DataFrame, asked: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(item, doc) of quotes and texts, both in normal form: ``texts`` (doc, source, text), ``asked`` (item, source, quote).

    A text holds a quote if it has the quote's key span, or if it is of the quote's own source and has ``least_run`` of its words in one run. Both are
    meant as characters: the first and the last word may stand inside longer ones. A block of quotes goes into one suffix automaton and each text is read
    once for all of them; only where the run of whole words falls short by what the words at its ends may add, the quote itself is looked at.
    No shuffle; a text and a quote give one row at most."""
    words = F.size(X.words(F.col("quote")))
    rows = asked.where("quote IS NOT NULL").withColumn("span", X.key_span(F.col("quote"))).withColumn("need", least_run(F.col("quote"))).where("span != ''")
    total = rows.agg(F.sum(words)).first()[0] or 0
    kinds = texts.schema["doc"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    spark, parts = texts.sparkSession, []
    for block in blocks(rows.select("item", "source", "quote", "span", "need"), ["quote"], total, most_words):
        held = spark.sparkContext.broadcast(block.toArrow().combine_chunks())  # one block of bounded size

        def read(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            quotes = _Quotes(held.value)
            for batch in batches:
                row, quote = [], []
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    for i, (source, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True), at):
                        found = quotes.held_by(source, text) if text else []
                        row += [i] * len(found)
                        quote += found
                yield pa.record_batch([quotes.items.take(pa.array(quote, pa.int64())), batch.column(0).take(pa.array(row, pa.int64()))], names=["item", "doc"])

        parts.append(texts.select("doc", "source", "text").mapInArrow(read, f"item {kinds[1]}, doc {kinds[0]}"))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], f"item {kinds[1]}, doc {kinds[0]}")


class _Quotes:
    """A block of quotes: which of them a text holds."""

    def __init__(self, rows: pa.Table):
        self.items = rows.column("item").combine_chunks()
        self.source, self.quote, self.span, self.need = (rows.column(c).to_pylist() for c in ("source", "quote", "span", "need"))
        self.inner = [len(s.split(" ")) - 2 for s in self.span]
        self.short = [i for i, n in enumerate(self.inner) if n < FEW]
        self.finder = RunFinder([q.split(" ") for q in self.quote], FEW)

    def held_by(self, source: str | None, text: str) -> list[int]:
        found = []
        for i, run in self.finder.runs(text.split(" ")).items():
            own = source is not None and source == self.source[i]
            whole = own and run >= self.need[i]  # words at both ends of a run may be parts of the text's words
            if whole or self.inner[i] >= FEW and run >= self.inner[i] and self.span[i] in text or own and run >= self.need[i] - 2 and run_length(self.quote[i], text) >= self.need[i]:
                found.append(i)
        seen = set(found)
        return found + [i for i in self.short if i not in seen and self.span[i] in text]


def least_run(quote: Column) -> Column:
    """Words in a run that make a text of the quote's own source relevant: half of the quote, rounded up, and six at least."""
    return F.greatest(F.lit(6), F.ceil(F.size(X.words(quote)) / 2))


def coverage(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query, ev, doc): the texts (doc, source, text) that hold each evidence (query, ev, source, quote).

    A text holds an evidence if it has the quote's key span, whichever source it is of (one rule may stand in two), or if it is of
    the evidence's own source and has half of the quote and six words at least in one run, as where a chunk's border cuts a quote."""
    asked = evidence.select(F.struct("query", "ev").alias("item"), "source", normal_form(F.col("quote")).alias("quote"))
    own = spread(texts.select("doc", "source", "text"))
    found = held_quotes(own.select("doc", "source", normal_form(F.col("text")).alias("text")), asked)
    return found.select("item.query", "item.ev", "doc").distinct()


def ranking_scores(hits: DataFrame, truth: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per query with evidence: recall@k, hit@k, mrr, ndcg@5.

    ``hits`` (query, doc, rank), ``truth`` (query, doc, ev): which evidence a document holds, ``evidence`` (query, n_evidence). Every
    relevant row gains 1, so ndcg may pass 1."""
    covered = hits.join(truth, ["query", "doc"])
    rows = covered.groupBy("query", "rank").agg(F.collect_set("ev").alias("evs"))
    found = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("evs"))))))
    gain = F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    per = rows.groupBy("query").agg(*(found(k).alias(f"found_{k}") for k in KS), F.min("rank").alias("first"), gain.alias("dcg"))
    both = evidence.join(per, "query", "left")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n_evidence"), F.lit(5)).cast("int")), lambda r: 1 / F.log2(r + 1)), F.lit(0.0), lambda s, x: s + x)
    none = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "query",
        *(F.round(none(F.col(f"found_{k}")) / F.col("n_evidence"), 6).alias(f"recall_{k}") for k in KS),
        *(F.when(none(F.col(f"found_{k}")) == F.col("n_evidence"), 1.0).otherwise(0.0).alias(f"hit_{k}") for k in KS),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg_5"),
    )


def mean_scores(scores: DataFrame, group: list[str]) -> DataFrame:
    names = [c for c in scores.columns if c not in (*group, "query")]
    return scores.groupBy(*group).agg(*(F.round(F.avg(c), 4).alias(c) for c in names))


def grid(runs: dict[str, DataFrame], truth: DataFrame, evidence: DataFrame) -> DataFrame:
    """Mean scores of many rankings (query, doc, rank) in one job; the names of ``runs`` say the setting, "/" between its parts."""
    parts = [hits.select(F.struct(F.lit(name).alias("run"), F.col("query").alias("query")).alias("query"), "doc", "rank") for name, hits in runs.items()]
    named = lambda rows: reduce(DataFrame.unionAll, [rows.withColumn("query", F.struct(F.lit(n).alias("run"), F.col("query").alias("query"))) for n in runs])
    per = ranking_scores(reduce(DataFrame.unionAll, parts), named(truth), named(evidence))
    return mean_scores(per.withColumn("run", F.col("query.run")), ["run"])


def share(test: Column, of: Column) -> Column:
    """Share of the rows ``of`` that pass ``test``, 4 places; null without such rows."""
    return F.round(F.try_divide(F.sum(F.when(of & test, 1).otherwise(0)).cast("double"), F.sum(F.when(of, 1).otherwise(0))), 4)


SHARES = ("questions", "answerable", "answered", "false_refusal", "correct", "correct_or_partial", "correctness_score", "faithful", "cites_evidence", "invalid_citations", "correct_refusal", "multi_correct")


def summary(rows: DataFrame) -> DataFrame:
    """One row over (kind, found, correctness, faithfulness, cites_evidence, refusal_correct, n_invalid, total_s and, where there are such columns, prompt_tokens,
    completion_tokens and retrieval scores): shares with their own denominators. Scores average over answerable rows, tokens over all."""
    answerable, correct = F.col("kind") != "unanswerable", F.col("correctness")
    answered = answerable & F.col("found")
    judged = answered & correct.isNotNull()
    weight = F.when(correct == "correct", 1.0).when(correct == "partial", 0.5).otherwise(0.0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    tokens = [F.bround(F.avg(c)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens") if c in rows.columns]
    scores = [F.bround(F.avg(F.when(answerable, F.col(c))), 4).alias(c) for c in rows.columns if c.startswith(("recall_", "hit_", "ndcg_")) or c == "mrr"]
    return rows.agg(
        F.count("*").alias("questions"), F.sum(F.when(answerable, 1).otherwise(0)).alias("answerable"), share(yes(F.col("found")), answerable).alias("answered"),
        share(~F.col("found"), answerable).alias("false_refusal"), share(yes(correct == "correct"), answerable).alias("correct"), share(yes(correct.isin("correct", "partial")), answerable).alias("correct_or_partial"),
        F.round(F.avg(F.when(judged, weight)), 4).alias("correctness_score"), share(yes(F.col("faithfulness") == "supported"), judged).alias("faithful"), share(yes(F.col("cites_evidence")), answered).alias("cites_evidence"),
        share(F.col("n_invalid") > 0, answerable).alias("invalid_citations"), share(yes(F.col("refusal_correct")), ~answerable).alias("correct_refusal"),
        share(yes(correct == "correct"), F.col("kind") == "multi").alias("multi_correct"), *tokens, *scores,
    ).crossJoin(F.broadcast(_times(rows))).select(*SHARES, "p50", "p95", *(c for c in ("prompt_tokens", "completion_tokens") if c in rows.columns), *(c for c in rows.columns if c.startswith(("recall_", "hit_", "ndcg_")) or c == "mrr"))  # fmt: skip  one row each


def _times(rows: DataFrame) -> DataFrame:
    """One row: median (the mean of the two middle values) and nearest-rank 95th percentile of the times; null without any."""
    middle = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2), "p95": nearest_rank_of(95)}
    return select_ranks(rows, [], "total_s", middle).agg(F.round((F.max("low") + F.max("high")) / 2, 2).alias("p50"), F.round(F.max("p95"), 2).alias("p95"))


# judging and reports

CORRECTNESS = ("correct", "partial", "incorrect")
FAITHFULNESS = ("supported", "partially_supported", "unsupported")
JUDGE = "Grade an answer. correctness against the reference: correct (all its key facts), partial (something important is missing or wrong) or incorrect. faithfulness to the cited sources alone: supported, partially_supported or unsupported. Reply as JSON: correctness, faithfulness, reason."


def judge_prompts(answers: DataFrame) -> DataFrame:
    """``answers`` (question, reference, answer, sources) with ``prompt``; only cited sources are shown to the judge."""
    shown = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), s["text"])), "\n\n")
    parts = [F.lit(JUDGE), F.concat(F.lit("Question: "), F.col("question")), F.concat(F.lit("Reference: "), F.col("reference")), F.concat(F.lit("Answer: "), F.col("answer")), F.concat(F.lit("Sources:\n"), F.coalesce(F.nullif(shown, F.lit("")), F.lit("(none cited)")))]
    return answers.withColumn("prompt", F.concat_ws("\n\n", *parts))


def verdict(reply: Column) -> Column:
    """struct<correctness, faithfulness, reason> of the outermost braces; null if a grade is none of the known ones."""
    data = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "correctness string, faithfulness string, reason string")
    correct = F.lower(F.trim(F.coalesce(data["correctness"], F.lit(""))))
    faithful = F.replace(F.lower(F.trim(F.coalesce(data["faithfulness"], F.lit("")))), F.lit(" "), F.lit("_"))
    whole = F.struct(correct.alias("correctness"), faithful.alias("faithfulness"), F.substring(F.coalesce(data["reason"], F.lit("")), 1, 300).alias("reason"))
    return F.when(correct.isin(*CORRECTNESS) & faithful.isin(*FAITHFULNESS), whole)


def answer_rows(records: DataFrame, answers: DataFrame, truth: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row for each answered record (query, kind): whether a refusal was right, whether the cited sources hold any and all of its
    evidence, retrieval scores, and the verdict of answers that were found.

    ``answers``: query, found, sources, retrieved (both arrays of numbered sources), invalid_citations; ``truth`` (query, ev, doc): which
    chunk holds which evidence; ``records`` also has n_evidence."""
    both = records.select("query", "kind", "n_evidence").join(answers, "query")
    of = lambda c: both.select("query", F.explode(c).alias("s")).select("query", F.col("s.n").alias("rank"), F.col("s.chunk_id").alias("doc"))
    cited = of("sources").join(truth, ["query", "doc"]).groupBy("query").agg(F.countDistinct("ev").alias("n_cited"))
    scores = ranking_scores(of("retrieved"), truth, records.where("kind <> 'unanswerable'").select("query", "n_evidence"))
    out = both.join(cited, "query", "left").join(scores, "query", "left")
    answerable, n = F.col("kind") != "unanswerable", F.coalesce("n_cited", F.lit(0))
    out = out.withColumn("refusal_correct", F.when(~answerable, ~F.col("found"))).withColumn("cites_evidence", F.when(answerable, n > 0)).withColumn("cites_all_evidence", F.when(answerable, n == F.col("n_evidence")))
    out = out.withColumn("n_invalid", F.size("invalid_citations")).drop("n_cited")
    if verdicts is None:
        return out
    graded = verdicts.select("query", F.col("verdict.correctness").alias("correctness"), F.col("verdict.faithfulness").alias("faithfulness"), F.col("verdict.reason").alias("reason"))
    return out.join(graded, "query", "left")


def setup_label(mode: Column, embedding: Column, rewrite: Column, rerank: Column) -> Column:
    """A setting in words, such as "Hybrid + rewriting + model reranker"."""
    name = F.when(mode == "bm25", "BM25").otherwise(F.initcap(mode))
    big = F.when(F.coalesce(embedding, F.lit("")).contains("base"), " (base)").otherwise("")
    return F.concat(name, big, F.when(F.coalesce(rewrite, F.lit("no")) == "yes", " + rewriting").otherwise(""), F.when(F.coalesce(rerank, F.lit("none")) != "none", F.concat(F.lit(" + "), rerank, F.lit(" reranker"))).otherwise(""))


SETTING = {"dataset": "original", "strategy": "section", "mode": "hybrid", "embedding": "hashing", "rerank": "none", "rewrite": "no"}


def retrieval_table(results: DataFrame) -> DataFrame:
    """Results with a default for each part of the setting that is missing or null, their label, and their place: by data set, then the best recall at five first."""
    have = set(results.columns)
    filled = results.select(*(F.coalesce(F.col(c), F.lit(d)).alias(c) if c in have else F.lit(d).alias(c) for c, d in SETTING.items()), *(c for c in results.columns if c not in SETTING))
    named = filled.withColumn("label", setup_label(F.col("mode"), F.col("embedding"), F.col("rewrite"), F.col("rerank")))
    order = Window.orderBy("dataset", F.desc("recall_5"), *SETTING)  # one row for each setting
    return named.withColumn("place", F.row_number().over(order))


def upsert_results(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``upsert`` of retrieval results by their whole setting, whose missing parts have their defaults."""
    fill = lambda rows: rows.select(*(F.coalesce(F.col(c), F.lit(d)).alias(c) if c in rows.columns else F.lit(d).alias(c) for c, d in SETTING.items()), *(c for c in rows.columns if c not in SETTING))
    return upsert(fill(old), fill(new), list(SETTING), order)


def by_level(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Counts and means over all levels of a report, totals included; ``level`` is the number of columns summed over."""
    out = rows.rollup(*levels).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.grouping_id().alias("bits"))
    return out.withColumn("level", F.bit_count("bits").cast("long")).drop("bits")


def agreement(first: DataFrame, second: DataFrame, key: str, grade: str, share_of: float = 1.0, seed: int = 7, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., n, agreed, agreement) of two graders of the same rows, over a sample of keys by hash (the sample is the purpose)."""
    picked = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < F.lit(round(share_of * 10_000))
    both = first.where(picked).select(key, *by, F.col(grade).alias("one")).join(second.select(key, F.col(grade).alias("two")), key)
    same = F.sum(F.when(F.col("one").eqNullSafe(F.col("two")), 1).otherwise(0))
    return both.groupBy(*by).agg(F.count("*").alias("n"), same.alias("agreed"), F.round(F.avg(F.col("one").eqNullSafe(F.col("two")).cast("int")), 4).alias("agreement"))


KINDS, KEPT = ("single", "multi", "unanswerable"), ("approved", "edited")


def record_faults(records: DataFrame) -> DataFrame:
    """(id, fault) of a reviewed data set (id, question, answer, kind, status, evidence): a row for each broken rule; empty for a sound one."""
    n, blank = F.coalesce(F.size("evidence"), F.lit(0)), lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    answerable = F.col("kind") != "unanswerable"
    rules = {
        "kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "status": ~F.coalesce(F.col("status").isin(*KEPT), F.lit(False)), "question": blank("question"), "answer": answerable & blank("answer"),
        "evidence": F.when(answerable, n <= 0).otherwise(n > 0), "two evidences": (F.col("kind") == "multi") & (n != 2), "short quote": answerable & F.exists("evidence", lambda e: F.size(X.words(e["quote"])) < 8),
    }
    each = records.select("id", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))).alias("fault"))
    return each.unionByName(records.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("fault")))


def paraphrase_faults(original: DataFrame, paraphrased: DataFrame) -> DataFrame:
    """(id, fault): paraphrased records that are missing, unknown, or changed in answer or evidence."""
    a, b = (x.select("id", F.struct("answer", "evidence").alias(n)) for x, n in ((original, "a"), (paraphrased, "b")))
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "id", "full").select("id", fault.alias("fault")).where("fault IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, for each key the one with the highest ``order``; columns that one side lacks are null."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def resumed(todo: DataFrame, done: DataFrame, key: str, run) -> tuple[DataFrame, DataFrame]:
    """(rows to append to ``done``, keys left over for the next run): ``run`` gives a status for each open row; only ``ok`` ones are done."""
    made = run(remaining(todo, done, key))
    return made.where("status = 'ok'"), made.where("status <> 'ok'").select(key, "status")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def decide(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Status by precedence edit, keep or unanswerable, reject; rows that nobody decided are ``undecided``. Unknown keys: ``unknown_keys``."""
    d = decisions.select(key, "action")
    by = rows.join(d.groupBy(key).agg(F.collect_set("action").alias("actions")), key, "left")
    has = lambda a: F.coalesce(F.array_contains("actions", a), F.lit(False))
    status = F.when(has("edit"), "edited").when(has("keep") | has("unanswerable"), "approved").when(has("reject"), "rejected").otherwise("undecided")
    return by.withColumn("status", status).drop("actions")


def unknown_keys(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return decisions.select(key).distinct().join(rows.select(key), key, "left_anti")
