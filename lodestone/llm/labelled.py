"""Bounded samples of labelled rows, for the operators that are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """(__text, __label) of at most ``most`` labelled training ids of each class, by smallest id hash; of the texts of one id,
    the one with the smallest hash.

    Ids without a label or with both labels are left out. The joined side holds at most ``2 * most`` ids, whatever the input: that
    bound is what allows the broadcast, and as many rows come out, however often an id repeats.
    """
    ids = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__label"), F.max(label).alias("__top"))
    ids = ids.where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & (F.col("__label") == F.col("__top")) & train).drop("__top")
    order = F.xxhash64(F.col("__id"), F.lit(7))
    both = [ids.where(F.col("__label") == c).orderBy(order).limit(most) for c in (0, 1)]
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    found = texts.join(F.broadcast(both[0].unionAll(both[1])), "__id")
    one = found.groupBy("__id", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    return one.select("__text", F.col("__label").cast("int").alias("__label"))
