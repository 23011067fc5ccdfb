"""Retriever: all questions, with all their phrasings, through one first stage, fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import retrieval
from .answers import complete

Embedder = Callable[[list[str]], np.ndarray]

# What some published models want before a question or a passage.
QUERY_PREFIX = {
    "BAAI/bge-small-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "BAAI/bge-base-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "intfloat/e5-base-v2": "query: ",
}
PASSAGE_PREFIX = {"intfloat/e5-base-v2": "passage: "}


def hashing_embedder(width: int = 64) -> Embedder:
    """Offline stand-in for a model: words counted in ``width`` hashed places with hashed signs."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % width] += 1 if h >> 16 & 1 else -1
        return out

    return embed


def embedded(rows: DataFrame, text_col: str, embedder: Embedder, prefix: str = "", batch: int = 32, column: str = "vec") -> DataFrame:
    """``rows`` with unit vectors of ``prefix`` + text in ``column``; the embedder gets ``batch`` texts at a time. Texts without any
    direction, nulls among them, have the zero vector."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for lo in range(0, part.num_rows, batch):
                piece = part.slice(lo, batch)
                raw = np.asarray(embedder([prefix + (t or "") for t in piece.column(at).to_pylist()]), float)
                size = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                unit = np.divide(raw, size, out=np.zeros_like(raw), where=size > 0)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(list(unit), pa.list_(pa.float64()))], names=[*piece.schema.names, column])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, ArrayType(DoubleType()))]))


def embed_documents(rows: DataFrame, text_col: str, embedder: Embedder, model: str = "") -> DataFrame:
    return embedded(rows, text_col, embedder, PASSAGE_PREFIX.get(model, ""))


def embed_questions(rows: DataFrame, text_col: str, embedder: Embedder, model: str = "") -> DataFrame:
    return embedded(rows, text_col, embedder, QUERY_PREFIX.get(model, ""))


def fused(rankings: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (by..., list_no, doc, rank) over ``list_no``; ties keep the earlier list, then the earlier rank."""
    sums = rankings.groupBy(*by, "doc").agg(F.sum(1.0 / (retrieval.RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", retrieval.PLACES)), "seen")
    ranked = sums.withColumn("rank", F.row_number().over(order)).select(*by, "doc", F.round("score", 9).alias("score"), "rank")
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def first_stage(index: retrieval.Index | None, vectors: DataFrame | None, questions: DataFrame, mode: str, n: int) -> DataFrame:
    """(query, doc, score, rank) of questions (query, text, vec; vec only for dense and hybrid) in one mode."""
    if mode not in retrieval.MODES:
        raise ValueError(f"unknown mode {mode!r}; choose from {retrieval.MODES}")
    dense = retrieval.dense(vectors, questions, n) if mode != "bm25" else None
    words = retrieval.bm25_search(index, questions, n, "query", "text") if mode != "dense" else None
    return first_of(dense, words, mode, n)


def first_of(dense: DataFrame | None, words: DataFrame | None, mode: str, n: int) -> DataFrame:
    """The first stage of a mode from its lists (query, doc, score, rank), each ``n`` deep."""
    if mode != "hybrid":
        return dense if mode == "dense" else words
    both = dense.withColumn("list_no", F.lit(0)).unionByName(words.withColumn("list_no", F.lit(1)))
    return fused(both, ["query"], n)


def search(
    index: retrieval.Index | None, vectors: DataFrame | None, questions: DataFrame, mode: str = "hybrid", k: int | None = None, variants: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None, default: int = 5, deep: int = 30, first: Callable[[DataFrame, str, int], DataFrame] | None = None,
) -> DataFrame:
    """(query, doc, score, rank, first_stage_rank) of ``questions`` (query, text, vec).

    ``variants`` (query, variant from 1, text, vec) are other phrasings: question and phrasings go through one first stage, and each
    question's rankings are fused. ``scorer`` gets the candidates (query, doc, rank, text of the question itself) and gives (query,
    doc, score); without one, scores are those of the first stage, or fused, and there is no first-stage rank. ``first`` (questions, mode, n) stands for
    ``first_stage`` where its lists are stored already."""
    first = first or partial(first_stage, index, vectors)
    # how deep, is known before the plan is made: whether anything is to be fused or scored again
    many = variants is not None and not variants.isEmpty()
    n = retrieval.candidate_depth(k, default, scorer is not None, int(many), mode, deep)
    own = [c for c in ("text", "vec") if c in questions.columns]
    if many:
        asked = questions.select("query", F.lit(0).alias("variant"), *own).unionByName(variants.select("query", F.col("variant").cast("int").alias("variant"), *own))
        name = F.struct("query", "variant")  # one key for each phrasing
        found = first(asked.withColumn("key", name).select(F.col("key").alias("query"), *own), mode, n)
        named = found.withColumnRenamed("query", "key").join(asked.select(name.alias("key"), "query", F.col("variant").alias("list_no")), "key")
        several = variants.select("query").distinct().withColumn("several", F.lit(True))
        rows = named.join(several, "query", "left")
        ranked = fused(rows.where("several"), ["query"], n).unionByName(rows.where("several IS NULL").select("query", "doc", "score", "rank"))
    else:
        ranked = first(questions, mode, n)
    k = k or default
    if scorer is None:
        return ranked.where(F.col("rank") <= k).select("query", "doc", "score", "rank", F.lit(None).cast("int").alias("first_stage_rank"))
    wanted = ranked.select("query", "doc", "rank").join(questions.select("query", "text"), "query")
    return retrieval.rerank(ranked, scorer(wanted), k).select("query", "doc", "score", "rank", "first_stage_rank")


def pair_scorer(texts: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a cross-encoder: ``texts`` (doc, index_text) of the candidates only, ``batch`` pairs at a time."""

    def run(candidates: DataFrame) -> DataFrame:
        pairs = candidates.join(texts.select("doc", "index_text"), "doc").select("query", "doc", "text", "index_text")

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                found: list[float] = []
                for at in range(0, len(part), batch):
                    piece = part.iloc[at : at + batch]
                    found += list(score(list(zip(piece["text"], piece["index_text"], strict=True))))
                yield part[["query", "doc"]].assign(score=np.asarray(found, float))

        kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
        return pairs.mapInPandas(each, f"query {kinds['query']}, doc {kinds['doc']}, score double")

    return run


REWRITE = "Write {n} short search queries that say this question in the formal words of a regulation; keep to the question and do not answer it. Reply as JSON: queries.\n\nQuestion: "


def rewritten(questions: DataFrame, chat: Callable | None, n: int = 2, cache: DataFrame | None = None, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(text, queries, fresh) of every distinct question text: at most ``n`` phrasings, from ``cache`` (text, queries) where it has the exact
    text, else from the model (``chat``, for a list of prompts, or ``ask``, a model stage). ``fresh`` rows are to be added to the cache; a failed call
    gives none and is not fresh."""
    texts = questions.select("text").distinct()
    none = F.array().cast("array<string>")
    if cache is not None:
        known = texts.join(cache.select("text", "queries"), "text").select("text", "queries", F.lit(False).alias("fresh"))
        texts = texts.join(cache.select("text"), "text", "left_anti")
    prompted = texts.withColumn("prompt", F.concat(F.lit(REWRITE.format(n=n)), F.col("text")))
    asked = ask(prompted) if ask else complete(prompted, chat)
    got = asked.select("text", F.slice(F.coalesce(X.parsed_queries(F.col("reply")), none), 1, n).alias("queries"), (F.col("status") == "ok").alias("fresh"))
    return got if cache is None else known.unionByName(got)


def variants_of(questions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(query, variant, text) from (text, queries)."""
    asked = questions.select("query", F.col("text")).join(rewrites.select("text", "queries"), "text")
    return asked.select("query", F.posexplode("queries").alias("at", "text")).select("query", (F.col("at") + 1).alias("variant"), "text")


def preview(text: Column, most: int = 400) -> Column:
    """What a listing shows of a passage."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
