"""Documents with every awkward case, and plain versions of shared definitions."""

from __future__ import annotations

import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

BODY = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, BODY, "en", "a", 3), (2, BODY, "en", "a", 3), (3, None, "en", "a", None), (4, "", None, None, 0), (5, "  \n\t ", "en", "b", 5), (None, BODY + " x", "en", "b", 1), (None, None, None, None, None),
    (6, "one two", "en", "b", 7), (7, "one two", "en", "c", 7), (8, "ONE TWO", "en", "c", 7), (9, "é ß 漢字 🙂 \x1c ok", "fr", "c", 9), (10, " ".join(f"long{i % 977}" for i in range(40_000)), "en", "a", 1), (10, "other text of a repeated id " * 5, "en", "a", 1),
    (11, "same row", "en", "b", 8), (11, "same row", "en", "b", 8), (12, "x" * 300_000, "en", "a", 300_000), (13, BODY.replace("word30", "changed"), "en", None, 1),
]


def awkward(spark, clash: bool = False):
    """Documents with nulls in every column, empty and very long texts, ties and repeated rows."""
    df = spark.createDataFrame(AWKWARD, DOCS).repartition(3)
    if clash:
        for name in ("id", "key", "spans", "score", "size", "label", "start", "parts", "k1", "kept", "__x", "n"):
            df = df.withColumn(name, df["lang"])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
