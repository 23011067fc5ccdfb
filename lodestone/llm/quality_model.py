"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Fitting needs only counts, sums and cross products of the transformed statistics for each class;
workers add them up, so the driver sees two small matrices. Class covariances are shrunk towards
the mean of both diagonals; scores are the logistic of the difference of the two Gaussian log densities, from
Cholesky factors that are computed once and travel with the task. Scoring is one pass, no shuffle.

Labelled rows: at most ``Fit.most`` ids of each class (smallest id hash), never held-out ones. Without
rows of both classes every score is the share of the class that there is (0.5 without labels).
Nulls: a null text is empty and scored like one; a null id gives a null ``held_out``. Repeated rows
are scored alike, ties in the sample's hash order cannot change its size. An empty table gives an empty result. Very long texts are a
chunk of their own, in memory whole. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import text as K
from .quality_rules import _SYMBOL, _ends_sentence


@dataclass(frozen=True)
class Fit:
    most: int = 20_000
    shrinkage: float = 0.1
    ridge: float = 1e-3


def _flag(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_UPPER, _LETTER, _DIGIT = _flag(*range(65, 91)), _flag(*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)), _flag(*range(48, 58))
_PUNCT, _BANG = _flag(*b".,;:?!\"'()-"), _flag(*b"!")
STATISTICS = (
    "words", "word_length", "symbols", "upper", "digits", "exclamations", "punctuation", "repeated", "adjacent", "distinct", "duplicate_lines", "open_lines", "line_words", "long_words", "short_words",
)


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row for each document: logs of counts, roots of shares. Shares have
    pseudo-counts below, so that a few characters or lines are not taken for a whole text's habit."""
    starts, ends, first = K.words(raw, offs)
    n = np.diff(first).astype(float)
    at_least = n + 20
    points = K.code_points(raw)
    body = np.maximum(K.per_document(points & ~K._SPACE[raw], offs).astype(float), 1)
    chars = body + 100
    share = lambda flags: K.per_document(flags[raw], offs) / chars
    letters = K.per_document(_LETTER[raw], offs) + 100
    hashes = K.span_hashes(raw, starts, ends)
    doc = K.document_of(first)

    windows, at, window_offs = K.grams(hashes, first, 4)
    _, later = K.repeated(K.within(windows, K.document_of(window_offs)))
    repeats = K.per_document(later, window_offs) / at_least
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    _, old = K.repeated(K.within(hashes, doc))
    distinct = n - K.per_document(old, first)
    length = ends - starts

    l_start, l_end, _ = K.lines(raw, offs)
    l_first = np.searchsorted(l_start, offs)
    n_lines = np.diff(l_first) + 4
    _, dup = K.repeated(K.within(K.span_hashes(raw, l_start, l_end), K.document_of(l_first)))
    open_end = ~_ends_sentence(raw, l_end) if len(l_end) else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(n), np.log((body + 100) / at_least), np.sqrt(share(_SYMBOL)), np.sqrt(K.per_document(_UPPER[raw], offs) / letters),
        np.sqrt(share(_DIGIT)), np.sqrt(share(_BANG)), np.sqrt(share(_PUNCT)), np.sqrt(repeats), np.sqrt(K.per_document(same, first) / at_least),
        np.log(distinct + 20) - 0.85 * np.log(at_least), np.sqrt(K.per_document(dup, l_first) / n_lines), np.sqrt(K.per_document(open_end, l_first) / n_lines),
        np.log1p(n / n_lines), np.sqrt(K.per_document(length >= 14, first) / at_least), np.sqrt(K.per_document(length <= 2, first) / at_least),
    ])


@dataclass(frozen=True)
class Model:
    """For each class: mean, inverse of the Cholesky factor, log density offset; or only a constant score."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    offsets: np.ndarray | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = [b - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, b in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def solve(n: np.ndarray, sums: np.ndarray, cross: np.ndarray, fit: Fit = Fit()) -> Model:
    """The discriminant from class counts, sums and cross products."""
    if not n.all():
        return Model(None, None, None, float(n[1] / n.sum()) if n.sum() else 0.5)
    means, whiten, offsets = [], [], []
    p = sums.shape[1]
    within = [cross[c] / n[c] - np.outer(sums[c] / n[c], sums[c] / n[c]) for c in (0, 1)]
    target = np.diag(np.diag(within[0] + within[1]) / 2)  # lends each class some of the other's spread: heavier tails
    for c in (0, 1):
        a = min(1.0, fit.shrinkage + p / (n[c] + p))  # few rows: closer to the diagonal
        cov = (1 - a) * within[c] + a * target + fit.ridge * np.eye(p)
        factor = np.linalg.cholesky(cov)
        means.append(sums[c] / n[c])
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(whiten), np.array(offsets))


def fit_model(rows: DataFrame, fit: Fit = Fit()) -> Model:
    """Fits on (__text, __label) rows; workers return sums, never rows."""
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch, raw, offs in K.chunks(batches, "__text"):
            x, y = statistics(raw, offs), batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).reshape(-1)])
        for c in (0, 1):
            yield pa.record_batch([pa.array(np.full(total.shape[1], c)), pa.array(np.arange(total.shape[1])), pa.array(total[c])], names=["c", "k", "v"])

    sums = np.zeros((2, 1 + p + p * p))
    for r in rows.mapInArrow(run, "c long, k long, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect():  # 2 x (1 + p + p * p) rows
        sums[r.c, r.k] = r.v
    return solve(sums[:, 0], sums[:, 1 : 1 + p], sums[:, 1 + p :].reshape(2, p, p), fit)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            yield pa.record_batch([batch.column(0), pa.array(np.round(model.score(statistics(raw, offs)), 9))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op10(spark, sf_dir: str, fit: Fit = Fit()) -> DataFrame:
    """Contract query: held-out rows are those whose id's crc32 leaves no remainder by 5."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled.sample(docs, labels, "quality", labelled.remainder(F.col("__id"), 5) != 0, fit.most, "doc_id", "text")
    scored = score_documents(docs, fit_model(rows, fit))
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
