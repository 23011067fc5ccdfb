"""Exact vector search over stored cells: the triangle inequality says which cells cannot hold a better row.

Vectors lie in cells around centres. For a query q and a cell with centre c and radius r no row of the cell has a product with q above
q c + |q| r. Each query reads its cells in the order of that bound, a few first, then more, until none is left that reaches the k-th product found
so far. The result is that of comparing every query with every row; how many rows were left out follows the vectors: with clusters many, with vectors
that fill all dimensions evenly few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch, written
from .retrieval import PLACES, best, top

#: What rounding may hide.
SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """``members`` (cell, part, doc, vec), sorted by cell, and ``cells`` (cell, parts, n, radius, centre): ``most_cells`` rows at most."""

    members: DataFrame
    cells: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _far(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, by one matrix product."""
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)[None]


def centres_of(rows: np.ndarray, n: int, turns: int, seed: int) -> np.ndarray:
    """At most ``n`` centres: rows far from those chosen before come first, then means of the rows nearest to each."""
    rng = np.random.default_rng(seed)
    some = rows[np.sort(rng.permutation(len(rows))[: 16 * n])]
    chosen, far = [0], _far(some, some[:1])[:, 0]
    while len(chosen) < min(n, len(some)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _far(some, some[chosen[-1:]])[:, 0])
    centres = some[chosen].copy()
    for _ in range(turns):
        near = np.concatenate([_far(part, centres).argmin(axis=1) for part in np.array_split(rows, max(1, len(rows) * len(centres) // 8_000_000))])
        order = np.argsort(near, kind="stable")
        names, first = np.unique(near[order], return_index=True)
        centres[names] = np.add.reduceat(rows[order], first) / np.diff(np.append(first, len(near)))[:, None]
    return centres


def save_cells(vectors: DataFrame, path: str, most_cells: int = 4_096, sample: int = 65_536, part_rows: int = 50_000, turns: int = 5, seed: int = 7) -> Cells:
    """Cells of ``vectors`` (doc, vec), all of one length: about 2 sqrt(rows) of them. Centres come from a sample of ``sample`` rows by hash; every row is
    put into its nearest centre's cell, and each cell's radius is that of all its rows."""
    spark = vectors.sparkSession
    rows = vectors.select("doc", F.col("vec").cast("array<double>").alias("vec")).where(F.size("vec") > 0)
    total = rows.count()
    if not total:
        kind = rows.schema["doc"].dataType.simpleString()
        return Cells(spark.createDataFrame([], f"cell int, part int, doc {kind}, vec array<double>"), spark.createDataFrame([], "cell int, parts int, n long, radius double, centre array<double>"))
    picked = rows.where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 32)) < round(min(1.0, sample / total) * (1 << 32))).select("vec").toArrow()
    held = _matrix((picked if picked.num_rows else rows.limit(1).select("vec").toArrow())["vec"].combine_chunks())
    centres = spark.sparkContext.broadcast(centres_of(held, min(most_cells, int(2 * total**0.5) + 1), turns, seed))  # most_cells rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _matrix(batch.column(1))
                cell = _far(x, centres.value).argmin(axis=1)
                off = np.sqrt(((x - centres.value[cell]) ** 2).sum(axis=1))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(off), batch.column(0), batch.column(1)], names=["cell", "off", "doc", "vec"])

    dealt = rows.mapInArrow(deal, f"cell int, off double, doc {rows.schema['doc'].dataType.simpleString()}, vec array<double>")
    with scratch(spark):
        dealt = written(dealt, "dealt")
        sizes = written(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius"), F.ceil(F.count("*") / part_rows).cast("int").alias("parts")), "sizes")
        named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres.value)], "cell int, centre array<double>")
        sizes.join(named, "cell").select("cell", "parts", "n", "radius", "centre").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        part = F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("parts")).cast("int").alias("part")
        members = dealt.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", part, "doc", "vec")  # a row for each cell
        members.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{path}/members")
    return stored_cells(spark, path)


def stored_cells(spark, path: str) -> Cells:
    return Cells(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/cells"))


def nearest(stored: Cells, queries: DataFrame, k: int = 10, steps: tuple[int, ...] = (4, 32)) -> DataFrame:
    """(query, doc, score, rank) by product, ties to the smaller doc, as ``retrieval.dense`` gives it. ``steps``: how many cells each
    query has read after each step; the last step reads all that are left to read."""
    with scratch(queries.sparkSession) as keep:
        parts, _ = _searched(stored, queries, k, steps)
        return keep(best(reduce(DataFrame.unionAll, parts), k), "nearest")


def read_share(stored: Cells, queries: DataFrame, k: int = 10, steps: tuple[int, ...] = (4, 32)) -> float:
    """Share of all (query, row) products that a search makes."""
    with scratch(queries.sparkSession):
        _, visits = _searched(stored, queries, k, steps)
        sizes = stored.cells.select("cell", "n")
        made = reduce(DataFrame.unionAll, visits).join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0] or 0
        return made / max(1, queries.count() * (sizes.agg(F.sum("n")).first()[0] or 0))


def _searched(stored: Cells, queries: DataFrame, k: int, steps: tuple[int, ...]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Each step's rows (query, doc, score), and its visits (query, cell)."""
    spark = queries.sparkSession
    kind, name = stored.members.schema["doc"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    asked = written(queries.select("query", F.col("vec").cast("array<double>").alias("vec")), "asked")
    table = stored.cells.orderBy("cell").toArrow()  # most_cells rows at most
    if not table.num_rows:
        nothing = spark.createDataFrame([], f"query {name}, doc {kind}, score double")
        return [nothing], [spark.createDataFrame([], f"query {name}, cell int")]
    held = spark.sparkContext.broadcast((table["cell"].to_numpy(), _matrix(table["centre"].combine_chunks()), table["radius"].to_numpy()))

    def chosen(lo: int, hi: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Cells number ``lo`` to ``hi`` of each query by their bounds, as far as these reach the k-th product."""
            names, centres, radius = held.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    q = _matrix(batch.column(1))
                    bound = q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None]
                    turn = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
                    least = batch.column(2).to_numpy(zero_copy_only=False)
                    reach = np.take_along_axis(bound, turn, axis=1) >= (least - SLACK * (1 + np.abs(least)))[:, None] - SLACK
                    row, place = np.nonzero(reach)
                    yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(names[turn[row, place]].astype(np.int32))], names=["query", "vec", "cell"])

        return run

    def compared(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, docs, scores = [], [], []
        if mine.num_rows and theirs.num_rows:
            x, q = _matrix(mine["vec"].combine_chunks()), _matrix(theirs["vec"].combine_chunks())
            order = np.empty(len(x), np.int64)
            order[pc.array_sort_indices(mine["doc"].combine_chunks()).to_numpy()] = np.arange(len(x))
            for at in range(0, len(q), max(1, 4_000_000 // len(x))):
                near = q[at : at + max(1, 4_000_000 // len(x))] @ x.T
                least = np.partition(near, -k, axis=1)[:, -k] - SLACK if near.shape[1] > k else np.full(len(near), -np.inf)
                wanted = near >= least[:, None]
                for i in np.flatnonzero(wanted.sum(axis=1) > 4 * k):  # many equal rows: of those, the smallest ids count
                    tied = np.flatnonzero(wanted[i])
                    wanted[i] = False
                    wanted[i, tied[np.lexsort((order[tied], -np.round(near[i, tied], PLACES)))[:k]]] = True
                row, doc = np.nonzero(wanted)
                rows.append(row + at), docs.append(doc), scores.append(near[row, doc])
        none = np.zeros(0, np.int64)
        row, doc, score = (np.concatenate([empty, *x]) for empty, x in ((none, rows), (none, docs), (np.zeros(0), scores)))
        return pa.table([theirs["query"].take(pa.array(row)), mine["doc"].take(pa.array(doc)), pa.array(score)], names=["query", "doc", "score"])

    parts_of = F.broadcast(stored.cells.select("cell", "parts"))  # most_cells rows at most
    found: list[DataFrame] = []
    visits: list[DataFrame] = []
    for lo, hi in zip((0, *steps), (*steps, None), strict=True):
        if found:
            so_far = top(reduce(DataFrame.unionAll, found), k, [F.desc("score")]).where(F.col("rank") == k)
            left = asked.join(so_far.select("query", F.col("score").alias("least")), "query", "left").select("query", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        else:
            left = asked.select("query", "vec", F.lit(float("-inf")).alias("least"))
        step = written(left.mapInArrow(chosen(lo, hi), f"query {name}, vec array<double>, cell int"), "visits")
        if step.isEmpty():
            break
        visits.append(step.select("query", "cell"))
        theirs = step.join(parts_of, "cell").select("query", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        both = stored.members.groupBy("cell", "part").cogroup(theirs.groupBy("cell", "part"))
        found.append(written(both.applyInArrow(compared, f"query {name}, doc {kind}, score double"), "found"))
    return found or [spark.createDataFrame([], f"query {name}, doc {kind}, score double")], visits or [spark.createDataFrame([], f"query {name}, cell int")]
