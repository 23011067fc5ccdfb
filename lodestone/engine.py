"""One loaded index with its options and models: search, answer and describe, in bulk; and the command line over it.

    python -m lodestone.engine index  FOLDER DOCUMENTS.parquet
    python -m lodestone.engine search FOLDER "a question" ["another" ...]
    python -m lodestone.engine ask    FOLDER "a question" ["another" ...]
    python -m lodestone.engine report SUMMARIES
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import answers, chunk, retrieval, search
from .options import Options
from .session import session
from .sources import store


class Engine:
    """``chat`` adds reply and status to prompts; without one, questions can be searched but not answered."""

    def __init__(self, spark: SparkSession, folder: str, options: Options = Options(), embedder: search.Embedder | None = None, chat: Callable[[DataFrame], DataFrame] | None = None, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None):
        self.spark, self.folder, self.options, self.chat, self.scorer = spark, folder, options, chat, scorer
        self.embedder = embedder or search.hashing_embedder()
        if not store.exists(spark, f"{folder}/chunks"):
            raise FileNotFoundError(f"no index for {options.strategy!r} in {folder}: build one first")
        self.chunks = spark.read.parquet(f"{folder}/chunks").where(F.col("strategy") == options.strategy)
        self.index = store.keyword_index(spark, folder)
        where = store.vector_table(folder, options.strategy, options.embedder)
        if not store.exists(spark, where):
            raise FileNotFoundError(f"no vectors {where}: build the index with this embedder")
        self.vectors = store.read_vectors(spark, where)
        n, m = self.chunks.count(), self.vectors.count()
        if n != m:
            raise store.IndexFault(f"{where}: {m} vectors for {n} chunks; build the index again")

    @classmethod
    def build(cls, docs: DataFrame, folder: str, options: Options = Options(), embedder: search.Embedder | None = None, **parts) -> Engine:
        """Chunks, keyword tables and vectors of ``docs`` (doc_id, title, topic, source_url, paragraphs) in ``folder``; returns the loaded engine."""
        spark, embedder = docs.sparkSession, embedder or search.hashing_embedder()
        made = chunk.chunk_document(docs, options.strategy, options.chunk_tokens, options.chunk_overlap, options.section_tokens)
        made.withColumn("index_text", X.index_text(F.col("header"), F.col("text"))).write.mode("overwrite").partitionBy("strategy").parquet(f"{folder}/chunks")
        chunks = spark.read.parquet(f"{folder}/chunks")
        store.save_keyword_index(chunks, folder, "chunk_id", "index_text")
        where = store.vector_table(folder, options.strategy, options.embedder)
        vectors = search.embed_documents(chunks.select("chunk_id", "doc_id", "index_text"), "index_text", embedder, options.embedder)
        store.upsert_vectors(vectors.select(F.col("chunk_id").alias("doc"), "doc_id", "vec"), where)
        store.drop_stale(where, chunks, "doc", "chunk_id")
        return cls(spark, folder, options, embedder, **parts)

    def search(self, questions: DataFrame, mode: str | None = None, k: int | None = None, rewrites: DataFrame | None = None) -> DataFrame:
        """(query, chunk_id, score, rank, first_stage_rank, citation, text, url) of questions (query, question)."""
        o = self.options
        asked = search.embed_questions(questions.select("query", F.col("question").alias("text")), "text", self.embedder, o.embedder)
        variants = search.embed_questions(search.variants_of(asked, rewrites), "text", self.embedder, o.embedder) if rewrites is not None else None
        found = search.search(self.index, self.vectors.select("doc", "vec"), asked, mode or o.mode, k, variants, self._scorer(asked), o.final, o.candidates)
        cite = X.citation(F.col("doc_title"), F.col("chapter"), F.element_at("paras", 1), F.element_at("paras", -1), F.col("page_start"), F.col("page_end"))
        shown = self.chunks.select(F.col("chunk_id").alias("doc"), cite.alias("citation"), "text", F.col("source_url").alias("url"))
        return found.join(shown, "doc").select("query", F.col("doc").alias("chunk_id"), "score", "rank", "first_stage_rank", "citation", "text", "url")

    def _scorer(self, asked: DataFrame) -> Callable[[DataFrame], DataFrame] | None:
        """What scores the candidates again, by the option ``reranker``."""
        if self.options.reranker == "none":
            return None
        if self.options.reranker == "lexical":
            return lambda candidates: retrieval.overlap_scores(self.index, asked, "query", "text", candidates)
        if self.scorer is None:
            raise RuntimeError("the reranker 'model' needs a scorer")
        return search.pair_scorer(self.chunks.select(F.col("chunk_id").alias("doc"), "index_text"), self.scorer)

    def ask(self, questions: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
        """Answers (``answers.answer``) of questions (query, question)."""
        if self.chat is None:
            raise RuntimeError("no model to answer with")
        return answers.answer(questions, self.search(questions, rewrites=rewrites), self.chat)

    def info(self, documents: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        return answers.info(documents, self.chunks, self.options, cache)


def plain_documents(rows: DataFrame) -> DataFrame:
    """Documents (doc_id, text, source) as one paragraph for each line that is not blank."""
    place = lambda x, i: F.struct(x.alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("").alias("chapter"), F.lit("").alias("heading"), (i + 1).cast("string").alias("para"), F.lit("text").alias("kind"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return rows.select("doc_id", F.col("source").alias("title"), F.col("source").alias("topic"), F.lit("").alias("source_url"), F.transform(lines, place).alias("paragraphs"))


def quoting(asked: DataFrame) -> DataFrame:
    """Offline stand-in for a model: says the first source."""
    first = F.regexp_extract("prompt", r"(?s)^\[1\] [^\n]*\n(.*?)(?:\n\n\[2\]|\n\nQuestion: )", 1)
    reply = F.to_json(F.struct((first != "").alias("found"), F.concat(F.substring(first, 1, 300), F.lit(" [1]")).alias("answer")))
    return asked.withColumn("reply", reply).withColumn("status", F.lit("ok"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone.engine")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("index", ["documents"]), ("search", ["questions"]), ("ask", ["questions"]), ("report", [])):
        p = commands.add_parser(name)
        p.add_argument("folder")
        for x in more:
            p.add_argument(x, nargs="+" if x == "questions" else None)
        p.add_argument("--mode", choices=("dense", "bm25", "hybrid"))
        p.add_argument("-k", type=int)
    a = parser.parse_args(arguments)
    spark, options = spark or session("engine"), Options.read()
    if a.command == "report":
        for r in spark.read.json(a.folder).orderBy("name").collect():  # one row a run
            print("  ".join(f"{k} {v}" for k, v in r.asDict().items()))
        return 0
    if a.command == "index":
        print(f"{Engine.build(plain_documents(spark.read.parquet(a.documents)), a.folder, options).chunks.count()} chunks")
        return 0
    asked = spark.createDataFrame(list(enumerate(a.questions)), "query long, question string")
    engine = Engine(spark, a.folder, options, chat=quoting)
    if a.command == "search":
        for r in engine.search(asked, a.mode, a.k).withColumn("shown", search.preview(F.col("text"))).orderBy("query", "rank").collect():
            print(f"{a.questions[r['query']]}\n{r['rank']}. {r.score:.4f} {r.citation}\n   {r.shown}\n")
    else:
        for r in engine.ask(asked).orderBy("query").collect():
            print(f"{r.question}\n{r.answer}\n" + "".join(f"  [{s.n}] {s.citation}\n" for s in r.sources))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
