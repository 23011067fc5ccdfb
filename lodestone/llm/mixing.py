"""Mixing sources to target weights: word blocks, multinomial shard counts, index permutations, a join.

Every source's documents are laid end to end (in a pseudorandom order) and cut into blocks of
``block_words`` words. A source whose target is q whole passes and a part gets q slots for each block and
slots for the part; the last of these is trimmed, so that a source's words come out at its target to the word.
Slots are dealt to output shards by multinomial draws conditioned on these totals (a splitting
tree of hypergeometric draws, so that any shard is computed alone, from the seed and the totals).
The j-th slot of a source is mapped through the source's index permutation (a Feistel network with
cycle walking) to a block index, and blocks are joined by (source, index). ``mixed_blocks`` gives the shards with their blocks in
order; ``mix_documents`` gives the same words glued back to documents, and the contract query counts them.

Scale: prefix sums run over (source, bucket) pieces, so that a hot source is split over many tasks;
slots and blocks meet on a key that is unique but for repeats. Only one row for each source comes
to the driver. Nothing is sampled; reruns agree, as all draws come from hashes of the seed.

Nulls: a null source is a source of its own, last; a null text has no words; a null id is carried along. Repeated rows
are separate documents, ties in the layout's order are broken by their 128-bit keys. Very long texts span many blocks. An empty table gives an empty
mix. Other columns are carried by ``mix_documents``. The plan has one row for each source, on the driver and in every task: some hundred
thousand sources are fine, a source for each document of a very large corpus is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import text as K
from .state import scratch, written


#: Repeats of a row that one array holds.
REPEATS = 4_096


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)
    total: float = 1.5
    most: float = 2.0
    block_words: int = 128
    shard_slots: int = 4096
    bucket_rows: int = 4_096
    seed: int = 11


def targets(sizes: list[int], mix: Mix = Mix()) -> list[float]:
    """Target words of each source in order: weighted shares of the total, none above ``most`` times its
    size; what is above goes to the others by weight, until none is above."""
    weight = [float(mix.weights[i % len(mix.weights)]) for i in range(len(sizes))]
    left, out, free = mix.total * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    while free:
        share = left / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * share > mix.most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weight[i] * share
            break
        for i in full:
            out[i] = mix.most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def _hash64(*parts: int) -> int:
    x = 0
    for p in parts:
        x = int(K.mix64(np.array([(x ^ (p & K._MASK)) + 0x9E3779B97F4A7C15 & K._MASK], np.uint64))[0])
    return x


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Bijection of range(n) applied to ``j``: four Feistel rounds over the next even power of two, walking cycles."""
    if n <= 1:
        return j.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = j.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(4):
            left, right = right, left ^ (K.mix64(right + np.uint64(_hash64(key, r))) & low)
        x[todo] = left << np.uint64(half) | right
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def shard_counts(slots: np.ndarray, shard: int, shards: int, mix: Mix) -> tuple[np.ndarray, np.ndarray]:
    """(slots before, slots of) ``shard`` for each source: multinomial draws given the sources' totals."""
    left, before, lo, hi, total = slots.copy(), np.zeros_like(slots), 0, shards, int(slots.sum())
    begin = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        cut = min(total, mid * mix.shard_slots) - begin  # slots of the left half
        rng = np.random.Generator(np.random.Philox(key=_hash64(mix.seed, lo, hi)))
        part, rest_all, rest = np.zeros_like(left), int(left.sum()), cut
        for i, n in enumerate(left.tolist()):
            rest_all -= n
            part[i] = _hypergeometric(rng, n, rest_all, rest)
            rest -= int(part[i])
        if shard < mid:
            left, hi = part, mid
        else:
            before, left, lo, begin = before + part, left - part, mid, begin + cut
    return before, left


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not bad or not good or not draws:
        return min(good, draws) if not bad else 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad  # beyond the generator's range its normal limit is exact to the last few slots
    sd = (draws / n * good / n * bad * ((n - draws) / (n - 1))) ** 0.5
    return int(min(max(round(draws * good / n + sd * rng.standard_normal()), draws - bad, 0), good, draws))


@dataclass(frozen=True)
class Plan:
    """Sources in order with size, target and slots: whole passes, then the partial pass."""

    names: list[str | None]
    sizes: list[int]
    target: list[float]
    taken: list[int]
    mix: Mix

    def blocks(self, i: int) -> int:
        return -(-self.sizes[i] // self.mix.block_words)

    def slots(self) -> np.ndarray:
        out = []
        for i, n in enumerate(self.sizes):
            passes, rest = divmod(self.taken[i], n) if n else (0, 0)
            out.append(passes * self.blocks(i) + -(-rest // self.mix.block_words))
        return np.array(out, np.int64)

    def resolve(self, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block index, words taken of it) of the slots ``j`` of source ``i``. A short last block ends each
        pass, whole blocks come in the order of the pass's permutation."""
        size, b, n = self.sizes[i], self.mix.block_words, self.blocks(i)
        whole = size // b
        passes = j // n
        at = j % n
        index = at.copy()
        for p in np.unique(passes).tolist():
            here = (passes == p) & (at < whole)
            index[here] = permute(at[here], whole, _hash64(self.mix.seed, i, p))
        last = int(self.taken[i] // size)
        room = np.where(passes < last, size, self.taken[i] - last * size) - at * b
        return index, np.minimum(np.minimum(room, b), np.where(index < whole, b, size - whole * b))


def make_plan(sources: list[tuple[str | None, int]], mix: Mix = Mix()) -> Plan:
    """Sources in code point order, null last."""
    ordered = sorted(sources, key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [s for s, _ in ordered], [int(n) for _, n in ordered]
    target = targets(sizes, mix)
    return Plan(names, sizes, target, [min(round(t), int(mix.most * n)) for t, n in zip(target, sizes, strict=True)], mix)


def _keys(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """128 bits that name a document by id, source and text; nulls count as values of their own."""
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return [F.xxhash64(F.lit(n), *parts).alias(f"k{n}") for n in (1, 2)]


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, k1, k2, size): one row for each row of ``docs``; ``size`` counts the words ``[^\\x20\\x09-\\x0D]+``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            first = K.words(raw, offs)[2]
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(np.diff(first))], names=["id", "source", "k1", "k2", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *_keys(id_col, source_col, text_col), F.col(text_col).cast("string").alias("__text"))
    return bare.mapInArrow(run, f"id {kind}, source string, k1 long, k2 long, size long")


def laid_out(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """(one row for each document: ``id``, ``k1``, ``k2``, ``src`` number, ``size``, ``start`` of its words in its source; plan).

    The order within a source is by hash bucket, then id and key. Rows that are equal are counted first and
    laid out as one run, so that a document that repeats any number of times is no hot group."""
    bare = written(sized(docs, id_col, source_col, text_col).groupBy("id", "source", "k1", "k2", "size").agg(F.count("*").alias("m")), "mix-sizes")
    per_source = bare.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count("*").alias("n")).collect()  # one row for each source
    plan = make_plan([(r.source, r.size or 0) for r in per_source], mix)
    buckets = max([1, *(-(-r.n // mix.bucket_rows) for r in per_source)])
    table = docs.sparkSession.createDataFrame([(name, i) for i, name in enumerate(plan.names)] or [(None, 0)], "name string, src int")
    keyed = bare.join(table, F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int"))
    words = F.col("size") * F.col("m")
    sums = keyed.groupBy("src", "bucket").agg(F.sum(words).alias("words"))
    before = sums.select("src", "bucket", (F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("id", "k1", "k2", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("ahead", F.sum(words).over(inside) - words).join(before, ["src", "bucket"])
    few, many = placed.where(F.col("m") <= REPEATS), placed.where(F.col("m") > REPEATS)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    runs = many.withColumn("run", upto(F.ceil(F.col("m") / REPEATS))).repartition("k1", "run").withColumn("i", upto(F.least(F.lit(REPEATS).cast("long"), F.col("m") - F.col("run") * REPEATS)))
    placed = few.withColumn("i", upto(F.col("m"))).unionByName(runs.withColumn("i", F.col("run") * REPEATS + F.col("i")).drop("run"))
    return placed.select("id", "k1", "k2", "src", "size", (F.col("before") + F.col("ahead") + F.col("i") * F.col("size")).cast("long").alias("start")), plan


def slots_of(spark, plan: Plan) -> DataFrame:
    """(shard, place, src, block, words): every slot of the mix, shard by shard."""
    slots, mix = plan.slots(), plan.mix
    shards = max(1, -(-int(slots.sum()) // mix.shard_slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, count = shard_counts(slots, shard, shards, mix)
                src = np.repeat(np.arange(len(slots)), count)
                block, words = np.zeros(len(src), np.int64), np.zeros(len(src), np.int64)
                at = 0
                for i in np.flatnonzero(count):
                    block[at : at + count[i]], words[at : at + count[i]] = plan.resolve(int(i), before[i] + np.arange(count[i]))
                    at += count[i]
                place = permute(np.arange(len(src)), len(src), _hash64(mix.seed, 1 << 40, shard))
                yield pa.record_batch([pa.array(np.full(len(src), shard)), pa.array(place), pa.array(src.astype(np.int32)), pa.array(block), pa.array(words)], names=["shard", "place", "src", "block", "words"])

    parts = min(shards, max(spark.sparkContext.defaultParallelism, -(-shards // 64)))
    return spark.range(0, shards, 1, parts).mapInArrow(run, "shard long, place long, src int, block long, words long")


def block_texts(docs: DataFrame, placed: DataFrame, plan: Plan, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(src, block, text): the words of every block, by a blank; parts of one document keep the white space between their words."""
    b = plan.mix.block_words
    segments = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    lo = F.greatest(F.col("start"), F.col("block") * b)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    part = F.struct(F.col("src").alias("src"), F.col("block").cast("long").alias("block"), (lo - F.col("block") * b).cast("long").alias("at"), (lo - F.col("start")).cast("long").alias("first"), (hi - lo).cast("long").alias("n"))
    near = F.expr(f"start div {b * 256}")  # repeats of a document are many rows
    wanted = segments.groupBy("k1", "k2", "src", near.alias("near")).agg(F.collect_list(part).alias("parts"))
    texts = docs.select(*_keys(id_col, source_col, text_col), F.col(text_col).cast("string").alias("text")).dropDuplicates(["k1", "k2"])
    joined = wanted.hint("merge").join(texts, ["k1", "k2"]).select("parts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "text"):
            starts, ends, first = K.words(raw, offs)
            parts = batch.column(0)
            doc = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
            flat = parts.flatten()
            column = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("src", "block", "at", "first", "n")}
            begin = starts[first[doc] + column["first"]]
            end = ends[first[doc] + column["first"] + column["n"] - 1]
            cut = [raw[x:y].tobytes().decode() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.record_batch([pa.array(column["src"], pa.int32()), pa.array(column["block"], pa.int64()), pa.array(column["at"], pa.int64()), pa.array(cut, pa.string())], names=["src", "block", "at", "piece"])

    pieces = joined.mapInArrow(run, "src int, block long, at long, piece string")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])  # of block_words words at most
    return pieces.groupBy("src", "block").agg(F.array_join(ordered, " ").alias("text"))


def mixed_blocks(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(shard, place, source, block, words, text): the mixed corpus as output shards of ``shard_slots`` blocks in their drawn order.

    A slot whose block is cut, as the last one of a source's partial pass is, has the first ``words`` words."""
    spark = docs.sparkSession
    placed, plan = laid_out(docs, mix, id_col, source_col, text_col)
    placed = written(placed, "mix-layout")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(plan.names)] or [(0, None)], "src int, source string")  # one row a source
    joined = slots_of(spark, plan).join(block_texts(docs, placed, plan, id_col, source_col, text_col).hint("merge"), ["src", "block"])
    whole = joined.join(F.broadcast(names), "src").select("shard", "place", "source", "block", "words", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "text"):
            starts, ends, first = K.words(raw, offs)
            words = batch.column(4).to_numpy()
            last = ends[first[:-1] + words - 1] if len(words) else np.zeros(0, np.int64)
            cut = [raw[x:y].tobytes().decode() for x, y in zip(offs[:-1].tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cut, pa.string())], names=batch.schema.names)

    return whole.mapInArrow(run, "shard long, place long, source string, block long, words long, text string")


def taken_blocks(placed: DataFrame, plan: Plan) -> DataFrame:
    """Each document's part of each block that the mix uses: (k1, k2, src, start, size, first, n, uses).

    ``first`` and ``n`` are word positions in the document, ``uses`` how often they are taken."""
    b = plan.mix.block_words
    used = slots_of(placed.sparkSession, plan).groupBy("src", "block", "words").agg(F.count("*").alias("uses"))
    end = F.col("start") + F.col("size")
    segments = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    joined = segments.join(used.hint("merge"), ["src", "block"])  # sizes after explode are unknown to the planner: no broadcast
    lo = F.greatest(F.col("start"), F.col("block") * b)
    hi = F.least(end, F.col("block") * b + F.col("words"))
    return joined.where(hi > lo).select("k1", "k2", "src", "start", "size", (lo - F.col("start")).alias("first"), (hi - lo).alias("n"), "uses")


def op7(spark, sf_dir: str, mix: Mix = Mix()) -> DataFrame:
    """Contract query: how many words the mix takes of every document."""
    with scratch(spark) as keep:
        return keep(_taken(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), mix), "mix-taken")


def _taken(spark, docs: DataFrame, mix: Mix) -> DataFrame:
    placed, plan = laid_out(docs, mix)
    placed = written(placed, "mix-layout")
    took = taken_blocks(placed, plan).groupBy("src", "start", "size").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    sources = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(plan.sizes, plan.target, strict=True))], "src int, source_size long, target double")
    out = placed.where("size > 0").join(took, ["src", "start", "size"], "left")
    out = out.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))).join(sources, "src")  # empty texts share one place
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a row for each time (at most ``most``, rounded up) that words of a document
    are taken, its text cut to them. A document that is taken whole keeps its text as it is; parts of one are joined by a line end. Of rows that are equal in
    id, source and text, the other columns come from the one with the smallest hash, so that reruns agree."""
    placed, plan = laid_out(docs, mix, id_col, source_col, text_col)
    placed = written(placed, "mix-layout")
    parts = taken_blocks(placed, plan)
    passes = F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses")))
    picked = parts.withColumn("copy", passes).groupBy("k1", "k2", "start", "size", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("__parts"))
    names = docs.columns
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), *_keys(id_col, source_col, text_col))
    if not placed.groupBy("k1", "k2").count().where("count > 1").isEmpty():  # equal rows: each is laid out by itself, their text is wanted once
        texts = texts.groupBy("k1", "k2").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
    joined = picked.hint("merge").join(texts, ["k1", "k2"])
    joined = joined.select(*(F.col("__row")[c].alias(c) for c in names), "__parts", F.col("size").alias("__size"))
    at = names.index(text_col)
    schema = T.StructType([f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, text_col):
            starts, ends, first = K.words(raw, offs)
            texts = batch.column(at).to_pylist()
            for doc, (parts, size) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                spans: list[list[int]] = []
                for p in parts:
                    if spans and spans[-1][1] == p["first"]:
                        spans[-1][1] += p["n"]
                    else:
                        spans.append([p["first"], p["first"] + p["n"]])
                if spans != [[0, size]]:
                    texts[doc] = b"\n".join(raw[starts[first[doc] + a] : ends[first[doc] + b - 1]].tobytes() for a, b in spans).decode()
            yield pa.RecordBatch.from_arrays([batch.column(i) if i != at else pa.array(texts, batch.column(at).type) for i in range(len(names))], names=names)

    return joined.mapInArrow(run, schema)
