"""Stored indexes and logs: tables in one folder, written once and read by every search.

An index folder holds ``chunks``, ``postings``, ``blocks``, ``terms``, ``corpus`` and ``vectors/<collection>``. Vectors are checked against the
chunks after every write, so that a search can trust the pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from .shared import folder, located, remove  # noqa: F401  the folder belongs to the store's interface
from .snapshots import Collection
from .tables import index_faults


class IndexFault(RuntimeError):
    """The vectors and the chunks of an index do not belong together."""


def exists(spark: SparkSession, path: str) -> bool:
    where, files = located(spark, path)
    return files.exists(where)


def size(spark: SparkSession, path: str) -> int:
    where, files = located(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, time of the last change): tells whether a stored index is still that of its texts."""
    where, files = located(spark, path)
    return files.getContentSummary(where).getLength(), files.getFileStatus(where).getModificationTime()


def move(spark: SparkSession, path: str, target: str) -> None:
    """``path`` takes the place of ``target``."""
    where, files = located(spark, path)
    there, _ = located(spark, target)
    files.delete(there, True)
    files.mkdirs(there.getParent())
    files.rename(where, there)


# keyword index


def save_keyword_index(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text", posts_of_bucket: int = 2_000_000) -> retrieval.Index:
    """Postings and their blocks' maxima in folders by a hash of the term, sorted by term and block, the terms' weights and the corpus row.

    Each text is tokenised once. There are 16 to 4,096 folders, one for each ``posts_of_bucket`` postings; a term's folder may have many files."""
    spark = docs.sparkSession
    posts = retrieval.postings(retrieval.blocked(retrieval.tokenised(docs, doc_col, text_col)))
    posts.write.mode("overwrite").parquet(f"{path}/raw-postings")
    posts = spark.read.parquet(f"{path}/raw-postings")
    sums = posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row each
    sums.select("n", F.when(F.col("n") > 0, F.col("tokens") / F.col("n")).otherwise(0.0).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus")
    count = posts.count()
    n, by = min(max(-(-count // posts_of_bucket), 16), 4096), ["bucket"] if count else []  # nothing to write leaves no folder whose columns could be read
    terms = retrieval.term_table(posts, corpus)
    terms.withColumn("term", F.col("term").alias("term", metadata={"buckets": n})).write.mode("overwrite").parquet(f"{path}/terms")
    for name, rows in (("postings", posts), ("blocks", retrieval.block_table(posts, corpus))):
        dealt = rows.withColumn("bucket", retrieval.bucket_of(F.col("term"), n)).repartitionByRange("bucket", "term", "block")
        dealt.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
    remove(spark, f"{path}/raw-postings")
    return keyword_index(spark, path)


def save_document_index(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> retrieval.Index:
    """An index by document: each text is tokenised once where it lies, and only the counts of terms are shuffled. For searches whose questions have most of the
    terms, as those of a test set do; ``save_keyword_index`` is for few questions at a time."""
    spark = docs.sparkSession
    retrieval.counted(retrieval.tokenised(docs, doc_col, text_col)).write.mode("overwrite").parquet(f"{path}/documents")
    rows = spark.read.parquet(f"{path}/documents")
    rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/corpus")
    counts = rows.select(F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("t.tfs").alias("cf"))
    corpus = spark.read.parquet(f"{path}/corpus")
    terms = counts.crossJoin(F.broadcast(corpus)).select("term", "df", "cf", retrieval.idf(F.col("n"), F.col("df")).alias("idf"))  # corpus: one row
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    return document_index(spark, path)


def document_index(spark: SparkSession, path: str) -> retrieval.Index:
    rows, terms, corpus = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "terms", "corpus"))
    return retrieval.Index(retrieval.unfolded(rows), terms, corpus, forward=rows)


def keyword_index(spark: SparkSession, path: str) -> retrieval.Index:
    return retrieval.Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "corpus", "blocks")))


# vectors


def vector_table(path: str, strategy: str, model: str) -> str:
    """``functions.text.collection_name`` as a folder."""
    return f"{path}/vectors/{strategy}__{model.split('/')[-1].lower()}"


def upsert_vectors(rows: DataFrame, where: str, key: str = "doc") -> DataFrame:
    """Adds the rows (``key``, vec, ...) to a collection; a row takes the place of the stored one of its key. Only rows that differ are written."""
    stored = Collection(rows.sparkSession, where, key)
    stored.upsert(stored.changed(rows))
    stored.compact()
    return stored.read()


def read_vectors(spark: SparkSession, where: str, key: str = "doc") -> DataFrame:
    return Collection(spark, where, key).read()


def drop_stale(where: str, chunks: DataFrame, key: str = "doc", chunk_key: str = "doc") -> DataFrame:
    """Removes vectors whose chunk is gone; fails if then a chunk has no vector, or a key repeats."""
    stored = Collection(chunks.sparkSession, where, key)
    stored.delete(stored.read().join(chunks.select(F.col(chunk_key).alias(key)), key, "left_anti"))
    kept = stored.read()
    have, want = kept.count(), chunks.count()
    if have != want or not index_faults(chunks, kept, chunk_key, key).isEmpty():
        raise IndexFault(f"{where}: {have} vectors for {want} chunks")
    return kept


# whole indexes


def default_index(spark: SparkSession, folders: list[str]) -> str:
    """The first folder with a complete index (chunks of some strategy, and vectors), else the last one."""
    for path in folders[:-1]:
        if exists(spark, f"{path}/vectors") and exists(spark, f"{path}/chunks"):
            return path
    return folders[-1]


def export_index(spark: SparkSession, path: str, target: str, strategy: str, model: str) -> int:
    """Copies one strategy's chunks and vectors with its keyword tables; returns the chunks, which must be as many as the vectors."""
    chunks = spark.read.parquet(f"{path}/chunks").where(F.col("strategy") == strategy)
    vectors = read_vectors(spark, vector_table(path, strategy, model))
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(f"{target}/chunks")
    remove(spark, vector_table(target, strategy, model))
    Collection(spark, vector_table(target, strategy, model)).upsert(vectors)
    for name in ("postings", "blocks", "terms", "corpus"):
        if exists(spark, f"{path}/{name}"):
            rows = spark.read.parquet(f"{path}/{name}")
            by = [c for c in ("bucket",) if c in rows.columns]
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{target}/{name}")
    n, m = chunks.count(), vectors.count()
    if n != m:
        raise IndexFault(f"{target}: {m} vectors for {n} chunks")
    return n


# request log

LOG = "time string, request_id string, question string, found boolean, cited array<string>, retrieved array<string>, timings map<string,double>, tokens map<string,bigint>, cached boolean, model string, error string"


def log_rows(rows: DataFrame) -> DataFrame:
    """Rows as they stand in the log: the UTC second first, a request id of 12 hex digits where there is none, 300 characters of an error."""
    have = set(rows.columns)
    time = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    request = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    named = [x.strip().split(" ", 1) for x in ("request_id string; question string; found boolean; cited array<string>; retrieved array<string>; timings map<string,double>; tokens map<string,bigint>; cached boolean; model string; error string").split(";")]
    made = {"request_id": F.coalesce(F.col("request_id"), request) if "request_id" in have else request, "error": F.substring("error", 1, 300) if "error" in have else F.lit(None).cast("string")}
    return rows.select(time.alias("time"), *(made.get(n, F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in named))


def append_log(rows: DataFrame, path: str, most_bytes: int = 5_000_000) -> None:
    """Appends rows as JSON lines; a log that has outgrown ``most_bytes`` first becomes ``<path>.1``, in place of an earlier one."""
    spark = rows.sparkSession
    if size(spark, path) > most_bytes:
        move(spark, path, f"{path}.1")
    log_rows(rows).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a log, those of ``append_log`` and those of a ``LogSink``."""
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").json(path)


@dataclass(frozen=True)
class LogSink:
    """The request log as the sink of a stream: ``rows.writeStream.foreachBatch(LogSink(...))``, each row once, whatever is killed when.

    A batch is written to a folder of its own number. The folders are the ledger: a batch that is whole in the log, or in the one that was turned over, is not written
    again, and one that was cut off is written anew in place of what there is of it. With ``time``, rows that are more than ``late_s`` older than the latest of
    all earlier batches go to ``<path>-late`` instead. ``query`` names the stream, as several may share a log."""

    path: str
    query: str = "stream"
    most_bytes: int = 5_000_000
    time: str | None = None
    late_s: float = 600.0

    def _whole(self, spark: SparkSession, name: str) -> bool:
        return any(exists(spark, f"{log}/{name}/_SUCCESS") for log in (self.path, f"{self.path}.1"))

    def _latest(self, spark: SparkSession, before: int) -> float | None:
        """The latest time of the batches before this one."""
        where = f"{self.path}-times"
        found = spark.read.schema("batch long, latest double").option("recursiveFileLookup", "true").json(where) if exists(spark, where) else None
        return found.where(F.col("batch") < before).agg(F.max("latest")).first()[0] if found is not None else None  # a row for each batch

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, name = rows.sparkSession, f"{self.query}-{batch:012d}"
        if self._whole(spark, name):
            return
        remove(spark, f"{self.path}/{name}")  # what there is of it
        if size(spark, self.path) > self.most_bytes:
            move(spark, self.path, f"{self.path}.1")
        if self.time:
            at, latest = F.unix_micros(F.col(self.time).cast("timestamp")) / 1e6, self._latest(spark, batch)
            late = F.coalesce(at < F.lit(latest - self.late_s), F.lit(False)) if latest is not None else F.lit(False)
            log_rows(rows.where(late)).write.mode("overwrite").json(f"{self.path}-late/{name}")
            rows.agg(F.lit(batch).alias("batch"), F.max(at).alias("latest")).write.mode("overwrite").json(f"{self.path}-times/{name}")
            rows = rows.where(~late)
        log_rows(rows).write.mode("overwrite").json(f"{self.path}/{name}")


