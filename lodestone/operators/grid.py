"""Evaluation of search over data set, strategy, mode, embedding, reranker and rewriting, from stages that settings and runs share.

A stage is a table in the grid's folder, named by a fingerprint of what it is made of: the content of its inputs, the options it reads, the names of its
models. Two settings that need the same stage find the same folder, and so does the next run; after a change only the stages that it reaches are
made anew. A stage appears by one rename, so that a stop loses the one being made. A model is known by its name: a changed one needs a new one.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import store
from ..sources.shared import located, remove
from . import chunk, evaluate, retrieval, search

AXES = tuple(evaluate.SETTING)
#: What a stage's code gives; raised when it changes, so that older folders are not taken for it.
EDITION = 1


def content(rows: DataFrame) -> str:
    """A digest of the rows, whatever their order, and of their columns: one aggregate over the table."""
    kinds = dict(rows.dtypes)
    each = F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in rows.columns), F.lit(EDITION))
    n, low, high = rows.select(each.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(20,0)")), F.sum(F.xxhash64("h").cast("decimal(20,0)"))).first()
    return named(sorted(kinds.items()), n, str(low), str(high))


def named(*parts) -> str:
    """A fingerprint of plain values."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:24]


class Stages:
    """Folders by fingerprint. ``made`` lists the kinds of those that this object had to make, in turn."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []
        self._read: dict[str, DataFrame] = {}

    def get(self, kind: str, fingerprint: str, make: Callable[[str], None]) -> str:
        """The stage's folder; if there is none, ``make(path)`` fills one that then takes its name. Of two makers the first to end is kept."""
        path = f"{self.folder}/{kind}/{fingerprint}"
        if store.exists(self.spark, path):
            return path
        self.made.append(kind)
        draft = f"{self.folder}/drafts/{kind}-{uuid.uuid4().hex}"
        make(draft)
        target, files = located(self.spark, path)
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(located(self.spark, draft)[0], target):
            remove(self.spark, draft)
            if not files.exists(target):
                raise OSError(f"{path} could not be made")
        return path

    def table(self, kind: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.get(kind, fingerprint, lambda path: make().write.parquet(path))
        if path not in self._read:  # reading the schema is a job
            self._read[path] = self.spark.read.parquet(path)
        return self._read[path]


def settings(**axes: Iterable[str]) -> list[dict[str, str]]:
    """Every combination of the values given for some axes; the others have their defaults."""
    if unknown := set(axes) - set(AXES):
        raise ValueError(f"unknown axes {sorted(unknown)}; choose from {AXES}")
    return [evaluate.SETTING | dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


class Grid:
    """Mean scores of search settings.

    ``docs``: (doc_id, title, topic, source_url, paragraphs), ids as text. ``datasets``: by name, records (id, question, kind, evidence: array of doc_id, quote);
    those of kind ``unanswerable`` do not count, nor those without evidence. ``embedders`` and ``scorers`` (question, passage pairs; ``lexical`` is there
    already) by name. ``rewrite(questions)`` gives (text, queries) of questions (text); ``rewriter`` is its name."""

    def __init__(
        self, spark: SparkSession, folder: str, docs: DataFrame, datasets: dict[str, DataFrame], embedders: dict[str, search.Embedder] | None = None,
        scorers: dict[str, Callable[[list[tuple[str, str]]], list[float]]] | None = None, rewrite: Callable[[DataFrame], DataFrame] | None = None, rewriter: str = "",
        k: int = 10, deep: int = 30, sizes: tuple[int, int, int] = (400, 60, 150),
    ):
        self.spark, self.stages, self.docs, self.datasets = spark, Stages(spark, folder), docs, datasets
        self.embedders, self.scorers = embedders or {"hashing": search.hashing_embedder()}, scorers or {}
        self.rewrite, self.rewriter, self.k, self.deep, self.sizes = rewrite, rewriter, k, deep, sizes
        self._known: dict[str, str] = {}
        self._indexes: dict[str, retrieval.Index] = {}

    # inputs

    def _content(self, name: str, rows: DataFrame) -> str:
        """The digest of an input: taken once for each object."""
        if name not in self._known:
            self._known[name] = content(rows)
        return self._known[name]

    def _docs(self) -> str:
        return self._content("documents", self.docs)

    def _records(self, dataset: str) -> tuple[str, DataFrame]:
        rows = self.datasets[dataset].where("kind <> 'unanswerable' AND size(evidence) > 0").select(F.col("id").alias("query"), "question", "evidence")
        return self._content(f"dataset {dataset}", rows), rows

    # stages

    def _chunks(self, strategy: str) -> tuple[str, DataFrame]:
        mark = named(self._docs(), strategy, self.sizes)
        made = lambda: chunk.chunk_document(self.docs, strategy, *self.sizes).select("chunk_id", "doc_id", "header", "text")
        stored = self.stages.table("chunks", mark, made)
        return mark, stored.withColumn("index_text", X.index_text(F.col("header"), F.col("text")))  # what follows from the row is not stored

    def _keywords(self, strategy: str) -> tuple[str, retrieval.Index]:
        mark, chunks = self._chunks(strategy)
        where = self.stages.get("keywords", mark, lambda path: store.save_document_index(chunks, path, "chunk_id", "index_text"))
        if where not in self._indexes:
            self._indexes[where] = store.document_index(self.spark, where)
        return mark, self._indexes[where]

    def _vectors(self, strategy: str, embedding: str) -> tuple[str, DataFrame]:
        of, chunks = self._chunks(strategy)
        mark = named(of, embedding)
        made = lambda: search.embed_documents(chunks.select(F.col("chunk_id").alias("doc"), "index_text"), "index_text", self.embedders[embedding], embedding).select("doc", "vec")
        return mark, self.stages.table("vectors", mark, made)

    def _phrasings(self, dataset: str) -> tuple[str, DataFrame]:
        """(query, variant from 1, text)."""
        of, rows = self._records(dataset)
        mark = named(of, self.rewriter)
        asked = rows.select("query", F.col("question").alias("text"))
        return mark, self.stages.table("phrasings", mark, lambda: search.variants_of(asked, self.rewrite(asked.select("text").distinct())))

    def _list(self, dataset: str, strategy: str, which: str, embedding: str, rewritten: bool) -> tuple[str, DataFrame]:
        """(query: of query and variant, doc, score, rank) of the questions or of their other phrasings, by words or by vectors, as deep as any setting wants."""
        of, rows = self._phrasings(dataset) if rewritten else self._records(dataset)
        texts = rows if rewritten else rows.select("query", F.lit(0).alias("variant"), F.col("question").alias("text"))
        asked, depth = texts.select(F.struct("query", F.col("variant").cast("int").alias("variant")).alias("query"), "text"), max(self.k, self.deep)
        if which == "bm25":
            by, index = self._keywords(strategy)
            return (mark := named(of, by, which, depth)), self.stages.table("lists", mark, lambda: retrieval.bm25_search(index, asked, depth, "query", "text"))
        by, vectors = self._vectors(strategy, embedding)
        made = lambda: retrieval.dense(vectors, search.embed_questions(asked, "text", self.embedders[embedding], embedding), depth)
        return (mark := named(of, by, which, depth)), self.stages.table("lists", mark, made)

    def _truth(self, dataset: str, strategy: str) -> tuple[str, DataFrame]:
        """(query, ev, doc): which chunk holds which evidence; the chunk's own words count, not its header. Data sets that ask otherwise for
        the same evidence share it."""
        evidence = self._records(dataset)[1].select("query", F.posexplode("evidence").alias("ev", "e")).select("query", "ev", F.col("e.doc_id").alias("source"), F.col("e.quote").alias("quote"))
        by, chunks = self._chunks(strategy)
        mark = named(self._content(f"evidence {dataset}", evidence), by)
        texts = chunks.select(F.col("chunk_id").alias("doc"), F.col("doc_id").cast("string").alias("source"), "text")
        return mark, self.stages.table("truth", mark, lambda: evaluate.coverage(texts, evidence))

    def _scorer(self, dataset: str, setting: dict) -> Callable[[DataFrame], DataFrame] | None:
        if setting["rerank"] == "none":
            return None
        if setting["rerank"] == "lexical":
            asked = self._records(dataset)[1].select("query", F.col("question").alias("text"))
            return lambda candidates: retrieval.overlap_scores(self._keywords(setting["strategy"])[1], asked, "query", "text", candidates)
        texts = self._chunks(setting["strategy"])[1].select(F.col("chunk_id").alias("doc"), "index_text")
        return search.pair_scorer(texts, self.scorers[setting["rerank"]])

    def hits(self, setting: dict[str, str]) -> tuple[str, DataFrame]:
        """(fingerprint, rankings) of a setting: (query, doc, rank) and the seconds that the batch took, each question's share of it."""
        dataset, strategy, mode, embedding = (setting[a] for a in ("dataset", "strategy", "mode", "embedding"))
        phrased = setting["rewrite"] == "yes"
        kinds = {"dense": ["dense"], "bm25": ["bm25"], "hybrid": ["dense", "bm25"]}[mode]
        lists = {w: [self._list(dataset, strategy, w, embedding, r) for r in ((False, True) if phrased else (False,))] for w in kinds}
        marks = [m for w in kinds for m, _ in lists[w]]
        of, records = self._records(dataset)
        mark = named(of, marks, mode, setting["rerank"], self.k, self.deep)
        rows = {w: reduce(DataFrame.unionByName, [t for _, t in lists[w]]) for w in kinds}
        asked = records.select("query", F.col("question").alias("text"))
        variants = self._phrasings(dataset)[1] if phrased else None

        def first(texts: DataFrame, mode: str, n: int) -> DataFrame:
            return search.first_of(*(self._part(rows.get(w), texts, n) for w in ("dense", "bm25")), mode, n)

        def make(path: str) -> None:
            started = time.perf_counter()
            found = search.search(None, None, asked, mode, self.k, variants, self._scorer(dataset, setting), self.k, self.deep, first)
            found.select("query", "doc", "rank").write.parquet(f"{path}/rows")
            self.spark.range(1).select(F.lit(time.perf_counter() - started).alias("seconds")).write.parquet(f"{path}/seconds")

        return mark, self.spark.read.parquet(f"{self.stages.get('hits', mark, make)}/rows")

    @staticmethod
    def _part(rows: DataFrame | None, texts: DataFrame, n: int) -> DataFrame | None:
        """The first ``n`` of the lists, with the keys that ``texts`` has: question and phrasing, or the question alone."""
        if rows is None:
            return None
        top = rows.where(F.col("rank") <= n)
        if dict(texts.dtypes)["query"] == dict(rows.dtypes)["query"]:
            return top
        return top.where("query.variant = 0").withColumn("query", F.col("query.query"))

    def scores(self, setting: dict[str, str]) -> DataFrame:
        """One row: the setting, the number of questions, mean scores, ms_per_query (of fusing and scoring, whose lists are shared)."""
        if setting["rewrite"] == "yes" and self.rewrite is None:
            raise ValueError("rewriting needs a rewriter")
        ranked, hits = self.hits(setting)
        held, truth = self._truth(setting["dataset"], setting["strategy"])
        of, records = self._records(setting["dataset"])

        def made() -> DataFrame:
            per = evaluate.ranking_scores(hits, truth, records.select("query", F.size("evidence").alias("n_evidence")))
            means = evaluate.mean_scores(per, []).crossJoin(F.broadcast(per.agg(F.count("*").alias("questions"))))  # one row each
            seconds = self.spark.read.parquet(f"{self.stages.folder}/hits/{ranked}/seconds")
            timed = means.crossJoin(F.broadcast(seconds)).withColumn("ms_per_query", F.round(1000 * F.try_divide(F.col("seconds"), F.col("questions")), 1)).drop("seconds")
            return timed.coalesce(1)

        row = self.stages.table("scores", named(ranked, held, of), made)
        return row.select(*(F.lit(setting[a]).alias(a) for a in AXES), *row.columns)

    def run(self, wanted: list[dict[str, str]]) -> DataFrame:
        """A row for each setting; what earlier runs have made is read."""
        return reduce(DataFrame.unionByName, [self.scores(evaluate.SETTING | s) for s in wanted])
