"""What Spark has no function for: compatibility forms and near quotes, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


#: Texts of a batch that are Python strings at once.
TEXTS = 256


def in_slices(f: Callable, *columns: pa.Array) -> pa.Array:
    """Strings ``f`` of the columns' values, of which only ``TEXTS`` rows at a time are Python objects."""
    rows = lambda at: zip(*(c.slice(at, TEXTS).to_pylist() for c in columns), strict=True)
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([f(*r) for r in rows(at)], pa.string()) for at in range(0, len(columns[0]), TEXTS))])


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return in_slices(lambda t: None if t is None else unicodedata.normalize("NFKC", t), text)


def normal_form(text: Column) -> Column:
    """Compatibility forms, plain quotes and dashes, lower case, single blanks. ASCII texts are not sent to Python."""
    return X.normalised(F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def plain(text: str) -> str:
    """``normal_form`` of one string."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(str.maketrans("‘’“”–—‑", "''\"\"---")).lower().split())


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _common(quote: str, windows: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``quote`` with each of ``windows``, one row of all their tables at a time."""
    signs = np.full((len(windows), max(map(len, windows), default=0)), 0xFFFFFFFF, np.uint32)  # no character
    for i, w in enumerate(windows):
        signs[i, : len(w)] = _signs(w)
    row = np.zeros((len(windows), signs.shape[1] + 1), np.int64)
    for c in _signs(quote):
        reached = np.maximum(row[:, 1:], np.where(signs == c, row[:, :-1] + 1, 0))
        row[:, 1:] = np.maximum.accumulate(reached, axis=1)
    return row[:, -1]


def near_quote(quote: str, text: str, alike: float = 0.9, gram: int = 4) -> str | None:
    """The stretch of ``text`` that says ``quote``, both in normal form: the quote itself, else the best window of its length that
    shares ``alike`` of its characters in order; null for an empty quote or if none does.

    Windows worth comparing begin where the text's character runs of length ``gram`` vote for one offset: each run that both have
    votes for the offset at which it would match."""
    quote, text = plain(quote), plain(text)
    if not quote or quote in text:
        return quote or None
    if len(text) < gram or len(quote) < gram:
        return None
    places: dict[str, list[int]] = {}
    for i in range(len(quote) - gram + 1):
        places.setdefault(quote[i : i + gram], []).append(i)
    votes = np.zeros(len(text) + len(quote), np.int64)
    for j in range(len(text) - gram + 1):
        for i in places.get(text[j : j + gram], ()):
            votes[j - i + len(quote)] += 1
    wide = np.convolve(votes, np.ones(2 * max(1, len(quote) // 20) + 1, np.int64), "same")  # an edit moves what follows by one
    offsets = [int(o) for o in np.argsort(-wide, kind="stable")[:8] if wide[o]]
    windows = [text[at : at + len(quote)] for at in (max(0, o - len(quote)) for o in offsets)]
    best, found = 0.0, None
    for window, common in zip(windows, _common(quote, windows), strict=True):
        share = 2 * int(common) / (len(window) + len(quote))
        if share >= alike and share > best:
            best, found = share, window.strip()
    return found


@F.arrow_udf(T.StringType())
def located_quote(quote: pa.Array, text: pa.Array) -> pa.Array:
    return in_slices(lambda q, t: None if q is None or t is None else near_quote(q, t), quote, text)


def run_length(quote: str, text: str) -> int:
    """Words in the longest run of the quote's words that the text holds as characters, both in normal form.

    Whatever is held, its parts are held: so a window over the quote only ever moves on."""
    words, text = plain(quote).split(), plain(text)
    first = best = 0
    for end in range(1, len(words) + 1):
        while first < end and " ".join(words[first:end]) not in text:
            first += 1
        best = max(best, end - first)
    return best
