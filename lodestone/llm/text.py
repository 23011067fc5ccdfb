"""Vectorised text kernels over Arrow buffers: word, line and shingle hashing without per-row Python.

All functions work on one flat ``uint8`` buffer of UTF-8 text plus document offsets, exactly the
layout Arrow hands to ``mapInArrow``, so a batch costs a few NumPy passes however many rows it has.
Work is cut into chunks of whole documents of about ``CHUNK_BYTES``; a longer document is a chunk
of its own, and hashing walks it in windows, so memory follows the longest document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
WINDOW_BYTES = 1 << 17

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial hash
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_keys() -> np.ndarray:
    raw = b"".join(hashlib.blake2b(bytes([i]), digest_size=8, person=b"byte-key").digest() for i in range(256))
    return np.frombuffer(raw, "<u8").copy()


_KEYS = _byte_keys()
_KEYS_LOWER = _KEYS[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


_POW = _powers(_ODD, WINDOW_BYTES + 1)
_INV = _powers(pow(_ODD, -1, 1 << 64), WINDOW_BYTES + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (splitmix64) of a uint64 array; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def as_text(column: pa.Array) -> pa.Array:
    """A string column without nulls (null counts as empty) and without a slice offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    column = as_text(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of about ``size`` text bytes, with their text buffer and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end


def runs(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that never cross a document border."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    inner = offs[(offs > 0) & (offs < len(flag))]
    first[inner] = flag[inner]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    last[inner - 1] = flag[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each document, the offset of its first word."""
    starts, ends = runs(~_SPACE[raw], offs)
    return starts, ends, np.searchsorted(starts, offs)


def lines(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty ``\\n``-split lines, and each document's first line."""
    starts, ends = runs(raw != 10, offs)
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span (ascending, disjoint); equal bytes, equal hash. ``lower`` folds A-Z."""
    out = np.empty(len(starts), U64)
    keys = _KEYS_LOWER if lower else _KEYS
    at, n = 0, len(starts)
    while at < n:
        base = int(starts[at])
        end = int(np.searchsorted(ends, base + WINDOW_BYTES, "right"))
        if end <= at:  # one span longer than the window
            piece = _LOWER[raw[base : ends[at]]] if lower else raw[base : ends[at]]
            out[at] = int.from_bytes(hashlib.blake2b(piece.tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        part = raw[base : ends[end - 1]]
        sums = np.empty(len(part) + 1, U64)
        sums[0] = 0
        np.cumsum(keys[part] * _POW[: len(part)], out=sums[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        h = (sums[e] - sums[s]) * _INV[s]
        out[at:end] = mix64(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = end
    return out


def grams(hashes: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows: (hash, first word, each document's first window)."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = np.flatnonzero(doc[:m] == doc[n - 1 :])
    total = np.zeros(m, U64)
    for j in range(n):
        total *= U64(0xFF51AFD7ED558CCD)
        total += hashes[j : j + m]
    return mix64(total[first]), first, np.searchsorted(first, offs)


def per_document(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's range; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def document_of(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash keys that are equal only for equal hashes of the same document of this chunk."""
    return mix64(hashes + doc.astype(U64) * U64(0xA24BAED4963EE407))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags for each key: occurs more than once; is not the first occurrence."""
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:]] = same
        many[order[1:]] |= same
        many[order[:-1]] |= same
    return many, later


def code_points(raw: np.ndarray) -> np.ndarray:
    """Flag of the bytes that begin a code point."""
    return (raw & 0xC0) != 0x80
