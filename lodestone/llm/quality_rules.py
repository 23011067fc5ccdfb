"""Quality rules, line first: failing lines go, then documents that lost too much text are rejected.

Each line with a word is judged by itself: *navigation* (separator words make up a quarter of it or
more), *boilerplate* (a known phrase in a line of at most ``boilerplate_words`` words), *symbols* (a
tenth of its characters or more are markup symbols) and *punctuation* (no sentence end at its end).
The last is the weakest sign, so its lines count as lost only when most lines of the text
fail it, as in lists; headings and single fragments stay. A document goes if the lost lines hold more
than ``max_loss`` of its word characters. One pass over Arrow buffers, no shuffle, whole texts.

Nulls: a null or empty text has no words, hence fails the base rule; a null id is carried along.
Repeated rows each give a row, an empty table gives none, other columns, of whatever name, are not read. Ties do not arise. A very long
text is a chunk of its own, in memory whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as K

#: Fixed values.
SYMBOLS = b"#*$%&|<>"
BOILERPLATE = (
    b"all rights reserved", b"licensed under", b"copyright", b"cookie policy", b"privacy policy", b"terms of use",
    b"terms of service", b"enable javascript", b"subscribe to", b"sign in", b"log in", b"skip to content", b"read more", b"share this",
)
SEPARATORS = (b"|", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xe2\x80\xa2", b"\xc2\xb7", b"/")
ENDS = b".!?:;\"')]"


@dataclass(frozen=True)
class LineRules:
    navigation_share: float = 0.25
    boilerplate_words: int = 40
    symbol_share: float = 0.1
    unpunctuated_share: float = 0.7
    max_loss: float = 0.5


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_END[0x80:] = True  # quotation marks and other scripts' sentence ends
_SEPARATOR_KEYS = K.span_hashes(np.frombuffer(b" ".join(SEPARATORS), np.uint8), *K.words(np.frombuffer(b" ".join(SEPARATORS), np.uint8), np.array([0, len(b" ".join(SEPARATORS))]))[:2])


def _ends_sentence(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the last character of each span ends a sentence; letters of other scripts do not."""
    last = raw[ends - 1]
    out = _END[last] & (last < 0x80)
    for i in np.flatnonzero(last >= 0x80):
        tail = raw[max(0, int(ends[i]) - 4) : ends[i]].tobytes().decode("utf-8", "ignore")[-1:]
        out[i] = bool(tail) and not tail.isalnum()
    return out


def measure(raw: np.ndarray, offs: np.ndarray, rules: LineRules) -> dict[str, np.ndarray]:
    """The base counts and the verdict of each document of a chunk."""
    starts, ends, first = K.words(raw, offs)
    points = K.code_points(raw) & ~K._SPACE[raw]
    word_chars = K.per_document(points, offs)
    hashes = K.span_hashes(raw, starts, ends)
    n_words = np.diff(first)

    windows, window_word, window_offs = K.grams(hashes, first, 8)
    many, _ = K.repeated(K.within(windows, K.document_of(window_offs)))
    cover = np.zeros(len(starts) + 8, np.int64)
    np.add.at(cover, window_word[many], 1)
    np.add.at(cover, window_word[many] + 8, -1)
    n_repeat = K.per_document(np.cumsum(cover)[: len(starts)] > 0, first)

    l_start, l_end, _ = K.lines(raw, offs)
    word_at = np.searchsorted(starts, l_start)
    l_words = np.searchsorted(starts, l_end) - word_at
    keep = l_words > 0
    l_start, l_end, l_words, word_at = l_start[keep], l_end[keep], l_words[keep], word_at[keep]
    l_first = np.searchsorted(l_start, offs)
    l_doc = K.document_of(l_first)
    _, later = K.repeated(K.within(K.span_hashes(raw, l_start, l_end), l_doc))
    n_dup = K.per_document(later, l_first)

    # line rules
    sums = np.concatenate([[0], np.cumsum(points)])
    chars = sums[l_end] - sums[l_start]
    sums = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    symbols = sums[l_end] - sums[l_start]
    sums = np.concatenate([[0], np.cumsum(np.isin(hashes, _SEPARATOR_KEYS))])
    separators = sums[word_at + l_words] - sums[word_at]
    lost = (separators >= rules.navigation_share * l_words) & (separators > 1)
    lost |= symbols >= rules.symbol_share * chars
    lowered = K._LOWER[raw].tobytes()
    for phrase in BOILERPLATE:
        at = lowered.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(l_start, at, "right")) - 1
            if line >= 0 and at + len(phrase) <= l_end[line] and l_words[line] <= rules.boilerplate_words:
                lost[line] = True
            at = lowered.find(phrase, at + 1)
    open_end = ~_ends_sentence(raw, ends[word_at + l_words - 1])
    bare = K.per_document(open_end & ~lost, l_first) > rules.unpunctuated_share * np.maximum(K.per_document(~lost, l_first), 1)
    bare &= np.diff(l_first) > 2  # a list has lines; one or two fragments are no list
    lost |= open_end & bare[l_doc]
    lost_chars = K.per_document(np.where(lost, chars, 0), l_first)

    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    kept = ~base_failed & (lost_chars <= rules.max_loss * word_chars)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": K.per_document(_SYMBOL[raw], offs), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": kept, "lost_chars": lost_chars, "lost_lines": K.per_document(lost, l_first), "_lost": lost, "_lines": (l_start, l_end, l_first),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), cleaned: bool = True) -> DataFrame:
    """One row for each row of ``docs``: id, counts, ``base_failed``, ``kept``, ``lost_chars``, ``lost_lines`` and
    ``cleaned``, the text without the failing lines (null for a null text; with ``cleaned=False`` for all, and none is built)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            m = measure(raw, offs, rules)
            texts = batch.column(1).to_pylist() if cleaned else [None] * batch.num_rows
            l_start, l_end, l_first = m["_lines"]
            for doc in np.flatnonzero(m["lost_lines"]) if cleaned else ():
                body, parts, last = raw[offs[doc] : offs[doc + 1]].tobytes(), [], 0
                for line in range(l_first[doc], l_first[doc + 1]):
                    if m["_lost"][line]:
                        a, b = int(l_start[line] - offs[doc]), int(l_end[line] - offs[doc])
                        parts.append(body[last:a])
                        last = b + 1
                texts[doc] = b"".join([*parts, body[last:]]).decode()
            names = [*_COUNTS, "base_failed", "kept", "lost_chars", "lost_lines"]
            yield pa.record_batch([batch.column(0), *(pa.array(m[k]) for k in names), pa.array(texts, pa.string())], names=[id_col, *names, "cleaned"])

    schema = f"`{id_col}` {kind}, {', '.join(f'{k} long' for k in _COUNTS)}, base_failed boolean, kept boolean, lost_chars long, lost_lines long, cleaned string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: base counts and the verdict on every document."""
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), cleaned=False).drop("cleaned", "lost_lines")

