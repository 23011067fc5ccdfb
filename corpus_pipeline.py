"""Corpus pipeline: toxicity, near-dedup, secret scans, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``docs``; the last returns the packed pieces. Empty tables pass through; nulls and repeated rows are
treated as the operators' docstrings say. Copies that the mix makes of a document carry its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_dedup, packing, secret_scan, state, toxicity

#: The stages are more than SQL can express; tests hold them against brute-force versions.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The lexicon is learned from labelled rows of ``docs`` itself."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fitted(spark, docs, labels))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at five words and similarity 0.8, the document with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span is replaced by a mark; no document goes."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole or in parts, up to twice, so that each source's words meet its target."""
    return mixing.mix_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    packed = packing.pack_documents(docs)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again. Only the last stage's rows stay there."""
    with state.scratch(spark) as keep:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            with state.scratch(spark) as hand_over:
                docs = hand_over(stage(spark, docs, sf_dir), f"stage-{name}")
        return keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
