"""Table functions for SQL: sentences packed to a size, windows of words, and paragraphs of sorted lines.

``register(spark)`` makes them callable from ``spark.sql``. ``paragraphs`` takes a table that is partitioned by document and sorted; its rows come from the same reading
of lines as ``ingest.paragraphs``, document by document, and each document's state is all that a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import chunk, ingest


@udtf(returnType="part_no int, part string, n_words int")
class SplitToFit:
    """(text, most): parts of at most ``most`` words, sentences first; nothing of a null text."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        for i, part in enumerate(chunk.split_to_fit(text, most) if text else []):
            yield i, part, chunk.word_total(part)


@udtf(returnType="window_no int, first int, n_words int, part string")
class WordWindows:
    """(text, size, overlap): windows of ``size`` words that share ``overlap`` with the one before."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        words = text.split() if text else []
        spans = chunk.window_spans([1.0] * len(words), size, overlap) if words else []
        for i, (lo, hi) in enumerate(spans):
            yield i, lo, hi - lo, " ".join(words[lo:hi])


@udtf
class Paragraphs:
    """(TABLE(doc, page, text, ...) PARTITION BY doc ORDER BY (page, place)): the document's paragraphs from its kept lines."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in lines.dataType.fields}
        missing = {"doc", "page", "text"} - set(kinds)
        if missing:
            raise ValueError(f"the table of lines has no column {', '.join(sorted(missing))}")
        rest = [StructField(c, LongType() if c in ("seq", "page_start", "page_end") else StringType()) for c in ("seq", "text", "page_start", "page_end", "chapter", "heading", "para", "kind")]
        return AnalyzeResult(StructType([StructField("doc", kinds["doc"]), *rest]))

    def __init__(self) -> None:
        self.doc, self.read = None, ingest.Reading()

    def eval(self, line) -> None:
        self.doc = line["doc"]
        ingest.read_line(self.read, line["text"], int(line["page"]))

    def terminate(self) -> Iterator[tuple]:
        for seq, r in enumerate(p for p in self.read.rows if p["text"].strip()):
            yield self.doc, seq, r["text"], r["page_start"], r["page_end"], r["chapter"], r["heading"], r["para"], r["kind"]


FUNCTIONS = {"split_to_fit": SplitToFit, "word_windows": WordWindows, "paragraphs": Paragraphs}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
