"""Best-fit packing in bulk-synchronous rounds over range-sorted documents and gaps.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut, the first piece takes the remainder). Pieces are
range-sorted by length, and each gets its rank among the pieces of its length by prefix sums over the sorted ranges. Sorted by
length, pieces and gaps are runs: (length, ranks from, to) and (gap, sequences from, to); there are at most ``capacity`` lengths and as
many gaps, however many pieces.

Pieces of more than half the capacity open a sequence each, for no two of them fit together. Then rounds repeat: the runs are sorted into
ranges of neighbouring sizes, and all ranges are swept at the same time, each as a task of its own. A sweep goes from the longest
piece down and gives every run of pieces its successor, the smallest gap of the range that holds it; where several want one
gap, the longer one, then the lower rank, has it. Gaps shrink and are sorted into the next round's ranges, which are half as many, so that
what found no gap in its own range meets those of the next ones. The last round has one range, and opens sequences for what fits no
gap any more. Ranks, sweeps and the join of pieces with the plan's rank ranges are distributed; of each round only runs reach
the driver. The packing needs as many sequences as best-fit decreasing on single pieces, but for a few at most.

Nulls: a null text is an empty document (one piece with the end id), a null id is carried along. Repeated rows are documents of
their own, also very many of one row; ties are free to take any rank. Very long texts give many pieces. An empty table gives no
sequences. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as K
from . import tokens
from .state import scratch, written

#: Plans of more rows are joined by shuffle instead of broadcast.
BROADCAST_PLAN = 200_000
#: Ranks of one length that share a key of that join.
RANKS_A_KEY = 1 << 17
RANGES = (8, 4, 2, 1)
RUNS = "kind int, size int, lo long, hi long, sequence long, place int"
_PLACED, _GAP, _LEFT = range(3)


def cut_points(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces of documents of ``n`` tokens; the first piece may be shorter."""
    pieces = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = np.where(n % capacity, n % capacity, capacity)[doc]
    start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head, capacity)


def pieces_of(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc): every document's ids, then ``end``, in pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(vocabulary or tokens.default_vocabulary())
        for batch, raw, offs in K.chunks(batches, "__text"):
            ids, at = own.encode(raw, offs)
            flat = memoryview(np.insert(ids.astype("<u4"), at[1:], end)).cast("B")
            first = at[:-1] + np.arange(len(at) - 1)
            doc, piece, start, length = cut_points(np.diff(at) + 1, capacity)
            begin = (first[doc] + start) * 4
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "crc"])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long")


class Runs:
    """Sorted runs of equal size: size -> list of [from, to)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.spans: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, lo: int, hi: int) -> None:
        if hi > lo and size > 0:
            if size not in self.spans:
                bisect.insort(self.sizes, size)
                self.spans[size] = []
            self.spans[size].append((lo, hi))

    def merge(self) -> None:
        """Joins neighbouring runs, so that their number does not grow with the rounds."""
        for size, spans in self.spans.items():
            spans.sort()
            out = [spans[0]]
            for lo, hi in spans[1:]:
                if lo == out[-1][1]:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
            self.spans[size] = out

    def successor(self, size: int) -> int | None:
        at = bisect.bisect_left(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, size: int, most: int) -> tuple[int, int]:
        lo, hi = self.spans[size].pop(0)
        if hi - lo > most:
            self.spans[size].insert(0, (lo + most, hi))
            hi = lo + most
        if not self.spans[size]:
            del self.spans[size]
            self.sizes.remove(size)
        return lo, hi

    def drop(self, size: int) -> None:
        del self.spans[size]
        self.sizes.remove(size)


@dataclass
class Sweep:
    """What a sweep gives: placements (length, rank from, rank to, sequence of the first, place), gaps and the pieces left."""

    placed: list[tuple[int, int, int, int, int]]
    gaps: list[tuple[int, int, int]]
    left: list[tuple[int, int, int]]


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, fresh: int | None = None) -> Sweep:
    """Best-fit of runs of ``pieces`` (length, from, to) in runs of ``gaps``, longest first; with ``fresh``, the number of the next
    sequence, those that fit no gap open new ones."""
    free, out = Runs(), []
    for gap in gaps:
        free.add(*gap)
    free.merge()
    waiting = Runs()
    for run in pieces:
        waiting.add(*run)
    waiting.merge()
    while True:
        moved, changes = False, []
        for length in list(reversed(waiting.sizes)):  # rank order: the longer has the gap
            while length in waiting.spans and (gap := free.successor(length)) is not None:
                at, most = waiting.spans[length][0]
                lo, hi = free.take(gap, most - at)
                waiting.take(length, hi - lo)
                out.append((length, at, at + hi - lo, lo, capacity - gap))
                changes.append((gap - length, lo, hi))
                moved = True
        for change in changes:  # the sweep's gaps take effect for the next one
            free.add(*change)
        free.merge()
        if moved:
            continue
        if fresh is None or not waiting.sizes:
            break
        length = waiting.sizes[-1]  # no gap holds any: the longest open sequences, as many as they fill
        fit = capacity // length
        for at, most in waiting.spans[length]:
            full = (most - at) // fit
            for k in range(fit if full else 0):
                out.append((length, at + k * full, at + (k + 1) * full, fresh, k * length))
            free.add(capacity - fit * length, fresh, fresh + full)
            fresh += full
            rest = most - at - fit * full
            for k in range(rest):
                out.append((length, at + fit * full + k, at + fit * full + k + 1, fresh, k * length))
            if rest:
                free.add(capacity - rest * length, fresh, fresh + 1)
                fresh += 1
        waiting.drop(length)
        free.merge()
    runs = lambda r: [(size, lo, hi) for size in r.sizes for lo, hi in r.spans[size]]
    return Sweep(out, runs(free), runs(waiting))


def swept(spark, pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, ranges: int, fresh: int | None) -> Sweep:
    """One round: the runs in ``ranges`` ranges of sizes, each swept by a task of its own."""
    lengths = sorted({n for n, _, _ in pieces})
    cuts = [lengths[len(lengths) * i // ranges] for i in range(1, ranges)] if len(lengths) >= ranges else []  # the least size of each range but the first
    rows = [(bisect.bisect_right(cuts, size), kind, size, lo, hi) for kind, runs in ((_LEFT, pieces), (_GAP, gaps)) for size, lo, hi in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:  # runs of sizes: as many as there are sizes
            for where, *run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(where, []).append(run)
        for where in sorted(held):
            of = lambda kind: [tuple(r[1:]) for r in held[where] if r[0] == kind]  # noqa: B023, E731
            found = sweep(of(_LEFT), of(_GAP), capacity, fresh)
            out = [(_PLACED, n, lo, hi, at, place) for n, lo, hi, at, place in found.placed]
            out += [(kind, size, lo, hi, 0, 0) for kind, runs in ((_GAP, found.gaps), (_LEFT, found.left)) for size, lo, hi in runs]
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "size", "lo", "hi", "sequence", "place"])

    dealt = spark.createDataFrame(rows, "range int, kind int, size int, lo long, hi long").repartition(len(cuts) + 1, "range")
    got = dealt.mapInArrow(run, RUNS).collect()  # runs again
    of = lambda kind: [(r.size, r.lo, r.hi) for r in got if r.kind == kind]
    return Sweep([(r.size, r.lo, r.hi, r.sequence, r.place) for r in got if r.kind == _PLACED], of(_GAP), of(_LEFT))


def plan(spark, counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, sequence of the first, place): the packing of ``counts[length]`` pieces of each length."""
    out, gaps, fresh = [], [], 0
    for length in sorted((n for n, c in counts.items() if c and 2 * n > capacity), reverse=True):
        out.append((length, 0, counts[length], fresh, 0))
        if length < capacity:
            gaps.append((capacity - length, fresh, fresh + counts[length]))
        fresh += counts[length]
    left = [(n, 0, c) for n, c in sorted(counts.items()) if c and 2 * n <= capacity]
    for ranges in RANGES:
        if left:
            found = swept(spark, left, gaps, capacity, ranges, fresh if ranges == 1 else None)
            out, gaps, left = out + found.placed, found.gaps, found.left
    return out


def ranked(pieces: DataFrame, rows: int = 50_000) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with ``rank`` among those of its length, and the counts: a range sort, then prefix sums over its ranges.

    Rows of one length are dealt to ranges by the hash of a row number, so that neither a common length nor a row that repeats
    without end lies in one task."""
    ranges = max(1, -(-pieces.count() // rows))
    kind = pieces.schema["id"].dataType.simpleString()
    order = [F.col("length").desc(), F.xxhash64("turn").asc()]
    dealt = pieces.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(3).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]]))
            at = np.arange(len(length)) - np.repeat(start, np.diff(np.append(start, len(length))))
            if length[0] == last:
                at[: len(length) if len(start) == 1 else start[1]] += seen
            last, seen = length[-1], int(at[-1]) + 1
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(np.full(len(length), place)), pa.array(at)], names=["id", "piece", "start", "length", "crc", "range", "at"])

    table = written(dealt.select("id", "piece", "start", "length", "crc").mapInArrow(number, f"id {kind}, piece int, start long, length long, crc long, range long, at long"), "pieces-sorted")
    sums = written(table.groupBy("length", "range").agg(F.count("*").alias("c")), "piece-counts")
    before = sums.withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("range")) - F.col("c")).drop("c")
    counts = {r.length: r.c for r in sums.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    out = table.join(before, ["length", "range"])
    return out.select("id", "piece", "start", "length", "crc", (F.col("before") + F.col("at")).alias("rank")), counts


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with their sequence and place in it."""
    spark = pieces.sparkSession
    numbered, counts = ranked(pieces)
    steps = plan(spark, counts, capacity)
    table = spark.createDataFrame(steps, "n long, lo long, hi long, first long, place long")
    table = table.withColumn("key", F.explode(F.sequence(F.expr(f"lo div {RANKS_A_KEY}"), F.expr(f"(hi - 1) div {RANKS_A_KEY}"))))
    if len(steps) + sum(counts.values()) // RANKS_A_KEY <= BROADCAST_PLAN:
        table = F.broadcast(table)
    same = (F.col("length") == F.col("n")) & (F.expr(f"rank div {RANKS_A_KEY}") == F.col("key"))
    found = numbered.join(table, same & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("id", "piece", "start", "length", "crc", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("place").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) of every piece of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        return keep(pack(written(pieces_of(docs, capacity, vocabulary, 2, id_col, text_col), "pieces"), capacity), "packed")


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of 1024 tokens."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
