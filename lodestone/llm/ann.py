"""Approximate nearest neighbours: stable projections into few dimensions, one kd-tree, a chi-square stopping test.

Unit vectors are projected by ``dims`` Gaussian (2-stable) directions. One kd-tree over the projections of a bounded sample gives the leaves: by hash
about ``sample`` rows, or sixteen for each leaf of ``leaf_rows`` rows that the table needs, ``most_sample`` at most. Beyond the 131,072 leaves of that, which
is beyond 268 million rows, leaves grow with the table, and are blocks in several parts. Every row of the table is dealt to its leaf, and each leaf's box is that of all its
rows. For a vector at distance d the squared projected distance is d^2 times a chi-square variable with ``dims`` degrees. So a query
visits leaves in the order of their boxes' projected distance, verifies the vectors there exactly, in double precision, and
stops once the next leaf's squared distance over the k-th best squared distance has a chi-square distribution function of
``confidence`` or more: a nearer neighbour would then lie beyond with probability 1 - confidence at most.

Neighbouring leaves lie in one block of about ``block_rows`` rows; a leaf with more is a block in several parts. A query first searches
the block of its own leaf, leaf by leaf. With the k-th distance of that it goes to the other blocks that have a leaf which the
test does not exclude, and only to those. So rows are shipped twice (and once more for every ``chunk_queries`` queries
of a block), whatever the number of blocks; queries once for each block they visit. How many those are depends on the vectors: with
clusters few, with vectors that fill all dimensions evenly most.

Nulls: vectors that are null, empty, zero or hold null or non-finite components take no part; neither do null ids. Vectors of
different lengths have no cosine: each length is searched by itself. Rows of one id are rows of their own; a query's own id is no
candidate. Ties go to the smaller id. An empty table gives none. Very long vectors are vectors like others; other columns,
of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import scratch, written


@dataclass(frozen=True)
class Index:
    k: int = 5
    dims: int = 8
    confidence: float = 0.98
    leaf_rows: int = 2_048
    block_rows: int = 32_768
    chunk_queries: int = 8_192
    sample: int = 32_768
    most_sample: int = 2_097_152
    seed: int = 5


def chi_square_quantile(p: float, dims: int) -> float:
    """x with distribution function p, for even ``dims``: by bisection of the closed form."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(width: int, ix: Index) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(ix.seed)).standard_normal((width, ix.dims))


@dataclass(frozen=True)
class Tree:
    """A complete kd-tree: inner node i splits ``axis[i]`` at ``cut[i]``, its children are 2 i + 1 and 2 i + 2; leaves are numbered from 0."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def fit_tree(points: np.ndarray, leaves: int) -> Tree:
    """Halves at the median of the widest dimension, ``leaves`` parts at least, as long as eight points are left for each."""
    depth = max(0, min((leaves - 1).bit_length(), (len(points) // 8).bit_length() - 1))
    axis, cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = [points]
    for level in range(depth):
        below = []
        for i, part in enumerate(parts):
            node = 2**level - 1 + i
            if len(part):
                axis[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                cut[node] = np.partition(part[:, axis[node]], (len(part) - 1) // 2)[(len(part) - 1) // 2]
            right = part[:, axis[node]] > cut[node]
            below += [part[~right], part[right]]
        parts = below
    return Tree(depth, axis, cut)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points x boxes) squared projected distances; empty boxes (low above high) are infinitely far."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return out


def search(ids: np.ndarray, raw: np.ndarray, leaf: np.ndarray, q_ids: np.ndarray, q_raw: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, cosine) of the best k rows of a block for each query, as far as the test asks.

    Queries go step by step to their next nearest leaf of the block; in a step all queries of a leaf share one matrix product."""
    limit, k = chi_square_quantile(ix.confidence, ix.dims), ix.k
    leaves = np.unique(leaf)
    unit, q_unit = _unit(raw), _unit(q_raw)
    q_points = q_unit @ directions(raw.shape[1], ix)
    far = box_distance(q_points, low[leaves], high[leaves])
    turn = np.argsort(far, axis=1, kind="stable")
    rows_of = [np.flatnonzero(leaf == x) for x in leaves]
    kth = bound.copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids)
    live = np.arange(len(q_ids))
    for step in range(len(leaves)):
        at = turn[live, step]
        live = live[far[live, at] <= limit * kth[live]]
        at = turn[live, step]
        for x in np.unique(at):
            rows = rows_of[x]
            for here in np.array_split(live[at == x], max(1, len(rows) * int((at == x).sum()) // 4_000_000)):
                near = q_unit[here] @ unit[rows].T
                near[q_ids[here][:, None] == ids[rows][None, :]] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(here), -np.inf)
                least = np.maximum(least, 1 - kth[here] / 2) - 1e-9  # what rounding may hide stays in
                for i, q in enumerate(here):
                    found = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
                    if not len(found):
                        continue
                    if len(found) > 4 * k:  # many equal rows: of those, only the smallest ids can count
                        score = np.round(near[i, found], 9)
                        found = found[np.lexsort((ids[rows[found]], -score))]
                        score = np.round(near[i, found], 9)
                        rank = np.arange(len(found)) - np.searchsorted(-score, -score)
                        found = found[rank < 4 * k]
                    mine = rows[found]
                    both = np.concatenate([best[q][0], exact_cosine(np.broadcast_to(q_raw[q], (len(mine), raw.shape[1])), raw[mine])])
                    mine = np.concatenate([best[q][1], mine])
                    keep = np.lexsort((ids[mine], -both))[:k]
                    best[q] = both[keep], mine[keep]
                    if len(keep) == k:
                        kth[q] = min(kth[q], max(0.0, 2 - 2 * float(both[keep[-1]])) + 1e-12)
    some = [q for q in range(len(q_ids)) if len(best[q][0])]
    return np.repeat(some, [len(best[q][0]) for q in some]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(best[q][1] for q in some)]), np.concatenate([np.zeros(0), *(best[q][0] for q in some)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): rows that take part."""
    vec = F.col(vector_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col(id_col).cast("long").isNotNull() & vec.isNotNull() & fine & some).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows of the original vectors, in double precision."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        plain = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    odd = ~np.isfinite(plain) | (plain == 0)
    return np.where(odd, (_unit(a) * _unit(b)).sum(axis=1), plain) if odd.any() else plain


def _of_one_width(rows: DataFrame, is_query: Column, width: int, ix: Index) -> DataFrame:
    """(query_id, key, vec_id, score): at least the k best of every query among rows of ``width`` components."""
    spark, axes = rows.sparkSession, directions(width, ix)
    kind = rows.schema["vec"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _unit(_matrix(batch.column(0))) @ axes
                yield pa.record_batch([pa.array(list(points), pa.list_(pa.float64()))], names=["p"])

    total = rows.count()
    hashed = F.xxhash64("id", F.lit(ix.seed), F.hash("vec"))
    leaves = max(1, -(-total // ix.leaf_rows))
    share = min(max(ix.sample, 16 * leaves), ix.most_sample) / max(total, 1)
    sampled = rows.where(F.pmod(hashed, F.lit(1 << 32)) < round(share * (1 << 32))).select("vec").mapInArrow(project, "p array<double>").toArrow()  # bounded by the parameters
    tree = fit_tree(sampled["p"].combine_chunks().flatten().to_numpy().reshape(-1, ix.dims), leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf_of(_unit(_matrix(batch.column(1))) @ axes)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], names=["id", "vec", "leaf"])

    dealt = written(rows.mapInArrow(deal, f"id long, vec {kind}, leaf int"), "ann-leaves")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, leaf = _unit(_matrix(batch.column(1))) @ axes, batch.column(2).to_numpy()
                order = np.argsort(leaf, kind="stable")
                names, first = np.unique(leaf[order], return_index=True)
                n = np.diff(np.append(first, len(leaf)))
                low, high = np.minimum.reduceat(points[order], first), np.maximum.reduceat(points[order], first)
                for d in range(ix.dims):
                    yield pa.record_batch([pa.array(names), pa.array(np.full(len(names), d, np.int32)), pa.array(n), pa.array(low[:, d]), pa.array(high[:, d])], names=["leaf", "d", "n", "low", "high"])

    low, high, count = np.full((2**tree.depth, ix.dims), np.inf), np.full((2**tree.depth, ix.dims), -np.inf), np.zeros(2**tree.depth, np.int64)
    for r in dealt.mapInArrow(boxes, "leaf int, d int, n long, low double, high double").groupBy("leaf", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():  # most_sample / 8 leaves at most
        low[r.leaf, r.d], high[r.leaf, r.d], count[r.leaf] = r.low, r.high, r.n
    block_of, parts = _blocks(count, ix)

    asked = written(dealt.where(is_query).select("id", "vec", "leaf").distinct().select("id", F.xxhash64("vec").alias("key"), "vec", "leaf"), "ann-queries")
    table = [(x, int(b), int(parts[b])) for x, b in enumerate(block_of)]
    home = asked.join(F.broadcast(spark.createDataFrame(table, "leaf int, block int, parts int")), "leaf").select("id", "key", "vec", "block", "parts", F.lit(4.0).alias("bound"))  # one row a leaf
    first = written(_visited(dealt, home, table, low, high, ix), "ann-first")
    kth = first.groupBy("query_id", "key").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    bound = F.when(F.col("n") >= ix.k, F.greatest(F.lit(0.0), 2 - 2 * F.col("s")) + 1e-12).otherwise(4.0)
    known = kth.select(F.col("query_id").alias("id"), "key", bound.alias("bound"))
    limit = chi_square_quantile(ix.confidence, ix.dims)

    def onwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each further block with a leaf that the test does not exclude."""
        for whole in batches:
            step = max(1, min(512, 4_000_000 // len(count)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                points, bounds = _unit(_matrix(batch.column(2))) @ axes, batch.column(4).to_numpy()
                reach = (box_distance(points, low, high) <= limit * bounds[:, None]) & (count > 0)
                wanted = np.zeros((batch.num_rows, len(parts)), bool)
                query, leaf = np.nonzero(reach)
                wanted[query, block_of[leaf]] = True
                wanted[np.arange(batch.num_rows), block_of[batch.column(3).to_numpy()]] = False
                query, block = np.nonzero(wanted)
                yield pa.record_batch([*(batch.column(i).take(pa.array(query)) for i in (0, 1, 2)), pa.array(block.astype(np.int32)), pa.array(parts[block].astype(np.int32)), pa.array(bounds[query])], names=["id", "key", "vec", "block", "parts", "bound"])

    left = asked.join(known, ["id", "key"], "left").select("id", "key", "vec", "leaf", F.coalesce("bound", F.lit(4.0)).alias("bound"))
    further = written(left.mapInArrow(onwards, f"id long, key long, vec {kind}, block int, parts int, bound double"), "ann-visits")
    return first.unionByName(_visited(dealt, further, table, low, high, ix))


def _blocks(count: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """(block of each leaf, parts of each block): neighbouring leaves together up to ``block_rows``; a larger leaf is a block in parts."""
    block_of, parts, held = np.zeros(len(count), np.int64), [], ix.block_rows + 1
    for leaf, n in enumerate(count.tolist()):
        if held + n > ix.block_rows:
            parts.append(max(1, -(-n // ix.block_rows)))
            held = 0
        held += n
        block_of[leaf] = len(parts) - 1
    return block_of, np.array(parts)


def _visited(dealt: DataFrame, visits: DataFrame, table: list[tuple[int, int, int]], low: np.ndarray, high: np.ndarray, ix: Index) -> DataFrame:
    """(query_id, key, vec_id, score): the best k of each visited block (of each part of it) for each query."""
    spark = dealt.sparkSession
    counts = [(r.block, -(-r["count"] // ix.chunk_queries)) for r in visits.groupBy("block").count().collect()]  # one row a block
    chunks_of = dict(counts)
    shared = F.broadcast(spark.createDataFrame([(x, b, p, chunks_of[b]) for x, b, p in table if b in chunks_of], "leaf int, block int, parts int, chunks int"))
    hashed = F.xxhash64("id", F.lit(ix.seed + 2), F.hash("vec"))
    mine = dealt.join(shared, "leaf").withColumn("part", F.pmod(hashed, F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    theirs = visits.join(F.broadcast(spark.createDataFrame(counts, "block int, chunks int")), "block").withColumn("chunk", F.pmod(F.xxhash64("id", "key", F.lit(ix.seed + 1)), F.col("chunks")).cast("int"))
    theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def block_search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if mine.num_rows and theirs.num_rows:
            ids, raw, leaf = mine["id"].to_numpy(), _matrix(mine["vec"].combine_chunks()), mine["leaf"].to_numpy()
            q_ids, q_raw = theirs["id"].to_numpy(), _matrix(theirs["vec"].combine_chunks())
            q, r, score = search(ids, raw, leaf, q_ids, q_raw, theirs["bound"].to_numpy(), low, high, ix)
            found = [q_ids[q], theirs["key"].to_numpy()[q], ids[r], score]
        return pa.table(found, names=["query_id", "key", "vec_id", "score"])

    by = ["block", "part", "chunk"]
    pairs = mine.select(*by, "id", "vec", "leaf").groupBy(*by).cogroup(theirs.select(*by, "id", "key", "vec", "bound").groupBy(*by))
    return pairs.applyInArrow(block_search, "query_id long, key long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", ix: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row that ``is_query`` (over column ``id``) picks.

    Equal query rows are one query; different vectors of one id are queries of their own, each with its ranks."""
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        rows = written(usable(vectors, id_col, vector_col), "ann-rows")
        widths = [r.w for r in rows.select(F.size("vec").alias("w")).distinct().collect()]  # one row for each length
        found = [_of_one_width(rows.where(F.size("vec") == w), is_query, w, ix) for w in sorted(widths)]
        if not found:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
        ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ix.k)
        return keep(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")


def op9(spark, sf_dir: str, ix: Index = Index()) -> DataFrame:
    """Contract query: every vector whose id is divisible by 50 against all rows."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, ix=ix)
