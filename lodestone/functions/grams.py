"""Which of many quotes a text may nearly say: an index of the quotes' character runs, a filter by their places and one by their number."""

from __future__ import annotations

import math

import numpy as np

GRAM = 4
#: Cells (quotes x stretches of a text) that are counted in one table.
CELLS = 2_000_000


def _grams(text: str) -> np.ndarray:
    """A hash of every run of ``GRAM`` characters; equal runs, equal hashes."""
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(signs) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + signs[i : i + n]
    return out ^ (out >> np.uint64(29))


def least_shared(n: int, alike: float) -> int:
    """Runs of a quote of ``n`` characters that stand in any window which shares ``alike`` of both's characters in order.

    With a characters of the quote lost and b put in, a + b is at most 2 (1 - alike) / alike of those kept; a lost one breaks ``GRAM`` runs, one
    put in a run less. The most breaks where nothing is put in."""
    loss = 2 * (1 - alike) / alike
    return max(1, math.ceil(n - GRAM + 1 - GRAM * n * loss / (1 + loss) - 1e-9))


class QuoteGrams:
    """An index of ``quotes`` (normal forms)."""

    def __init__(self, quotes: list[str], alike: float = 0.9):
        self.quotes = quotes
        self.short = [i for i, q in enumerate(quotes) if 0 < len(q) < GRAM]
        each = [_grams(q) for q in quotes]
        sizes = np.array([len(g) for g in each], np.int64)
        grams = np.concatenate([np.zeros(0, np.uint64), *each])
        quote, place = np.repeat(np.arange(len(quotes)), sizes), np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.quote, self.place = grams[order], quote[order], place[order]
        lengths = [len(q) for q in quotes]
        self.need = np.array([least_shared(n, alike) for n in lengths], np.int64)
        loss = 2 * (1 - alike) / alike
        self.known = np.zeros(1 << 20, bool)  # the quotes' runs by their last bits: many runs of a text are none of them
        self.known[self._bits(self.grams)] = True
        self.reach = np.array([max(1, math.ceil(n * loss / (1 + loss))) + 1 for n in lengths], np.int64)  # how far apart offsets of one window are

    @staticmethod
    def _bits(grams: np.ndarray) -> np.ndarray:
        return (grams & np.uint64((1 << 20) - 1)).astype(np.int64)

    def candidates(self, text: str) -> list[int]:
        """Numbers of the quotes that ``text`` may say: all that it does, and few others."""
        found = [i for i in self.short if self.quotes[i] in text]
        grams = _grams(text)
        at = np.flatnonzero(self.known[self._bits(grams)])
        lo, hi = (np.searchsorted(self.grams, grams[at], side) for side in ("left", "right"))
        n = hi - lo
        if not n.sum():
            return found
        at = np.repeat(at, n)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        quote, place = self.quote[entry], self.place[entry]
        # a window's offsets lie within ``reach``: all in one stretch of that length or in two neighbours, counted once for each place of the quote
        most = int(self.place.max()) + 1
        stretch = (at - place + most) // self.reach[quote]
        width = int(stretch.max()) + 2
        # first all that met in a cell and the next one, repeated places too: where these are too few, the places are
        cell = quote * width + stretch
        if len(self.quotes) * width <= CELLS:
            some = np.bincount(cell, minlength=len(self.quotes) * width + 1)
            some = some[:-1] + some[1:] >= np.repeat(self.need, width)
            some[1:] |= some[:-1]  # the second of the two
            kept = some[cell]
            if not kept.any():
                return found
            quote, stretch, place = quote[kept], stretch[kept], place[kept]
        met = np.unique((quote * width + stretch) * most + place)
        cells, counts = np.unique(met // most, return_counts=True)
        following = np.searchsorted(cells, cells + 1)
        next_to = np.where((following < len(cells)) & (cells[np.minimum(following, len(cells) - 1)] == cells + 1), counts[np.minimum(following, len(cells) - 1)], 0)
        enough = counts + next_to >= self.need[cells // width]
        return found + np.unique(cells[enough] // width).tolist()
