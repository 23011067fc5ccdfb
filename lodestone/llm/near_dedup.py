"""MinHash near-dedup: circulant MinHash signatures, banding, exact Jaccard verification, components.

A document's set holds its distinct ``words``-word shingles (A-Z folded; fewer words: the whole sequence is the one
shingle). Shingles are 64-bit hashes in a universe of 2^32 positions: one bijection of it scatters the set, a second one,
circularly shifted by k, gives coordinate k of the signature. ``bands`` bands of ``rows`` coordinates each make the
buckets; with 24 bands of 4 a pair at similarity 0.8 shares none with probability 3e-6, at 0.85 with 9e-9.

No bucket is ever expanded into its pairs. Documents with equal sets are one node first. In star rounds each bucket links
its members to one centre, the first in a hash order; links are verified on full sets and components are formed. Buckets whose members
are all in one component drop out; in the others the next round takes another centre, until ``rounds`` are over or what is left
needs at most ``comparisons`` comparisons. Members of a bucket then meet in blocks of bounded size, by 128-bit sketches of the signatures. Members that have a candidate in another component (sizes and
sketch allow the threshold; miss below 1e-6) gather in groups, and inside each group pairs of different components are verified on
full sets until none is left. So each pair of a bucket ends verified, excluded by its sketch or sizes, or inside one component, and no
cap is needed. Rows follow members, but for buckets that stay large and mixed (more than ``block`` documents, nearly alike and not alike): a member of m
gives m / ``block`` rows there. Where that is too much, ``levels`` may be 1 or 2: buckets of more than ``block * bands`` members then fall into
``bands`` further bands from the next coordinates of the same signature, as often as that leaves fewer rows; each time a pair at similarity 0.8 is
lost with the probability above. Without it, as by default, buckets of every size are treated alike.

Verification reads the wanted texts again and recomputes the sets: star pairs in salted pieces of a centre, groups in slices of about
``held`` shingles, so that no task holds more than that and its longest documents. Components: minimum labels with pointer jumping over
the verified links, until no label changes, each round written to the shared folder.

Nulls: a null or empty text has no shingles and links with nothing; rows with a null id are kept, in no component. Rows with one id
are one node of the graph, each is returned with its own set size. Ties: the smallest id names a component. Very long texts are read
whole. An empty table gives none; other columns, of whatever name, are not read, and ``drop_near_duplicates`` returns them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as K
from .state import scratch, written


@dataclass(frozen=True)
class Dedup:
    words: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 24
    rows: int = 4
    rounds: int = 3
    block: int = 2_048
    comparisons: int = 200_000_000
    levels: int = 0
    held: int = 2_000_000
    salt_rows: int = 256
    salt_members: int = 4_096
    broadcast_ids: int = 500_000
    seed: int = 3


def _scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of the 2^32 positions."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _shifted(x: np.ndarray, k: int, out: np.ndarray) -> np.ndarray:
    """The second bijection, circularly shifted by ``k`` places."""
    np.add(x, np.uint32(k), out=out)
    out *= np.uint32(0x9E3779B1)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA77)
    out ^= out >> np.uint32(13)
    return out


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles, ascending."""
    starts, ends, first = K.words(raw, offs)
    hashes = K.span_hashes(raw, starts, ends, lower=True)
    grams, _, at = K.grams(hashes, first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    doc = K.document_of(at)
    if len(short):
        whole = []
        for d in short:
            h = np.zeros(1, np.uint64)
            for w in hashes[first[d] : first[d + 1]]:
                h = h * np.uint64(0xFF51AFD7ED558CCD) + w
            whole.append(K.mix64(h + np.uint64(int(count[d])))[0])
        grams, doc = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc)) if len(offs) > 2 else np.argsort(grams)
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(offs)))


def signatures(grams: np.ndarray, offs: np.ndarray, coordinates: int, seed: int, piece: int = 1 << 15, first: int = 0) -> np.ndarray:
    """(documents x coordinates from ``first`` on) of circulant MinHash; documents without shingles get the highest value."""
    out = np.full((len(offs) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offs))
    if not len(some):
        return out
    x = _scatter((grams >> np.uint64(32)).astype(np.uint32) ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF))
    at = 0
    while at < len(some):  # pieces that stay in cache; a long document may span several
        a = offs[some[at]]
        end = max(at + 1, int(np.searchsorted(offs[some + 1], a + piece, "right")))
        here = some[at:end]
        for lo in range(a, offs[here[-1] + 1], piece) if len(here) == 1 else [a]:
            part = x[lo : min(lo + piece, offs[here[-1] + 1])] if len(here) == 1 else x[a : offs[here[-1] + 1]]
            begin = [0] if len(here) == 1 else offs[here] - a
            hold = np.empty_like(part)
            for k in range(coordinates):
                low = np.minimum.reduceat(_shifted(part, first + k, hold), begin)
                out[here, k] = np.minimum(out[here, k], low)
        at = end
    return out


def _sketch(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits: for coordinate k one bit of its value (the first 32 coordinates give a second one)."""
    n, c = sig.shape
    bits = np.concatenate([(sig >> np.uint32(7)) & np.uint32(1), (sig[:, : max(0, 128 - c)] >> np.uint32(19)) & np.uint32(1)], axis=1)[:, :128].astype(np.uint8)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 128 - bits.shape[1]))), axis=1).view(np.uint64)
    return packed[:, 0].view(np.int64), packed[:, 1].view(np.int64)


#: Of 128 sketch bits a pair at similarity 0.8 agrees in 115 on average, deviation below 4.
AGREE = 96


def nodes(docs: DataFrame, how: Dedup, text_col: str, level: int = 0) -> DataFrame:
    """(id, key, n, set_hi, set_lo, s1, s2, buckets): set size, 128-bit set hash, sketch and band hashes of every row;
    ``docs`` has columns id, key and ``text_col``. Each ``level`` has its own coordinates."""
    types = {c: docs.schema[c].dataType.simpleString() for c in ("id", "key")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            grams, at = shingle_sets(raw, offs, how.words)
            sig = signatures(grams, at, how.bands * how.rows, how.seed, first=level * how.bands * how.rows)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(K.mix64(grams + np.uint64(s)))]) for s in (1, 2)]
            keys = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
            bands = np.empty((len(sig), how.bands), np.uint64)
            for b in range(how.bands):
                h = np.full(len(sig), b + 1, np.uint64)
                for r in range(how.rows):
                    h = K.mix64(h + sig[:, b * how.rows + r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bands[:, b] = h
            s1, s2 = _sketch(sig)
            buckets = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, how.bands, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(keys[0]), pa.array(keys[1]), pa.array(s1), pa.array(s2), buckets], names=["id", "key", "n", "set_hi", "set_lo", "s1", "s2", "buckets"])

    rows = docs.select("id", "key", F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"id {types['id']}, key {types['key']}, n long, set_hi long, set_lo long, s1 long, s2 long, buckets array<long>")


def components(links: DataFrame, salt_members: int = 4_096) -> DataFrame:
    """(id, label): the smallest id of each id's component; ``links`` has columns a, b. Hash-to-min with pointer jumping.

    The links of an id with more than ``salt_members`` are dealt over so many keys, to each of which its label goes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    many = written(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > salt_members).select("b", F.ceil(F.col("n") / salt_members).cast("int").alias("salts")), "salts")
    if many.isEmpty():
        both, dealt = both.withColumn("salt", F.lit(0)), lambda labels: labels.withColumn("salt", F.lit(0))
    else:
        salts = F.coalesce("salts", F.lit(1))
        both = written(both.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt")), "links")
        dealt = lambda labels: labels.join(many, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    for turn in itertools.count():
        near = both.join(dealt(labels.select(F.col("id").alias("b"), "label")), ["b", "salt"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        if turn >= 2:  # stars are done by now; in long chains labels jump to their label's label, and roots learn from their members
            parent = new.select(F.col("id").alias("label"), F.col("label").alias("up"))
            new = new.join(parent, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
            told = new.where("label < old").groupBy(F.col("old").alias("id")).agg(F.min("label").alias("told"))
            new = new.join(told, "id", "left").select("id", "old", F.least("label", F.coalesce("told", "label")).alias("label"))
        new = written(new, "labels")
        labels = new.select("id", "label")
        if new.where("label < old").isEmpty():
            return labels


def _near(sizes, other, s1, s2, t1, t2, how: Dedup):
    """Column condition: sizes and sketches allow the threshold."""
    small, large = F.least(sizes, other), F.greatest(sizes, other)
    apart = F.bit_count(s1.bitwiseXOR(t1)) + F.bit_count(s2.bitwiseXOR(t2))
    return (small * how.denominator >= large * how.numerator) & (apart <= 128 - AGREE)


def _linked(a: np.ndarray, b: np.ndarray, how: Dedup) -> bool:
    """Whether two sets of hashes, ascending, reach the threshold."""
    if not len(a) or not len(b):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return how.denominator * common >= how.numerator * (len(a) + len(b) - common)


def _texts_of(keys: DataFrame, docs: DataFrame, how: Dedup, text_col: str) -> DataFrame:
    """(key, text) of the documents in ``keys``."""
    wanted = written(keys.distinct(), "wanted")
    few = wanted.count() <= how.broadcast_ids  # beyond it, the join deals out both sides
    return written(docs.select("key", F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted) if few else wanted, "key", "left_semi"), "wanted-texts")


def verified(pairs: DataFrame, docs: DataFrame, how: Dedup, text_col: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the threshold; pieces of ``salt_rows`` members of a centre b each."""
    texts = _texts_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), docs, how, text_col)
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / how.salt_rows).alias("salts"))
    salted = written(pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")), "salted")
    kind = docs.schema["key"].dataType.simpleString()
    members = salted.join(texts.withColumnRenamed("key", "a"), "a").select("b", "salt", "a", "text")
    centres = salted.select("b", "salt").distinct().join(texts.withColumnRenamed("key", "b"), "b").select("b", "salt", F.lit(None).cast(kind).alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch, raw, offs in K.chunks(batches, "text"):
            grams, at = shingle_sets(raw, offs, how.words)
            found = np.zeros(batch.num_rows, bool)
            first = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                own = grams[at[i] : at[i + 1]]
                if first[i]:
                    centre = own
                else:
                    found[i] = _linked(centre, own, how)
            yield pa.record_batch([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(found))

    dealt = members.unionByName(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return dealt.select("b", "salt", "a", "text").mapInArrow(run, f"a {kind}, b {kind}")


def _groups(members: DataFrame, how: Dedup) -> DataFrame:
    """(g1, g2, key, n, s1, s2, label): members of mixed buckets in groups that hold every pair of one bucket in different components
    whose sizes and sketches allow the threshold.

    A bucket of more than ``block`` members is split; every two of its pieces meet in one block of at most two pieces. Each block's graph of
    such pairs falls into groups named by a hash of their members, so that equal groups of several bands are one. A member gives a row
    for each group that it is in, never one for each pair."""
    kind = members.schema["key"].dataType.simpleString()
    pieces = members.groupBy("bucket").agg(F.ceil(F.count("*") / how.block).cast("int").alias("pieces"))
    split = members.join(pieces, "bucket").withColumn("piece", F.pmod(F.xxhash64("key", F.lit(9)), F.col("pieces")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    split = split.select("bucket", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "key", "n", "s1", "s2", "label")

    def groups_of(c: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Row numbers of each group of a block."""
        n, label, s1, s2 = c["n"], c["label"], c["s1"].view(np.uint64), c["s2"].view(np.uint64)
        if (label == label[0]).all():
            return
        near = np.zeros((len(n), len(n)), bool)
        for at in range(0, len(n), 256):
            i = slice(at, at + 256)
            apart = np.bitwise_count(s1[i, None] ^ s1[None, :]) + np.bitwise_count(s2[i, None] ^ s2[None, :])
            fit = np.minimum(n[i, None], n[None, :]) * how.denominator >= np.maximum(n[i, None], n[None, :]) * how.numerator
            near[i] = (apart <= 128 - AGREE) & fit & (label[i, None] != label[None, :])
        left = near.any(axis=1)
        while left.any():
            group = np.zeros(len(n), bool)
            edge = np.flatnonzero(left)[:1]
            while len(edge):
                group[edge] = True
                edge = np.flatnonzero(near[edge].any(axis=0) & ~group)
            left &= ~group
            yield np.flatnonzero(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for c, _ in _runs(batches, ["bucket", "lo", "hi"]):
            if len(c["n"]) < 2:
                continue
            for rows in groups_of(c):
                key = np.sort(c["key"][rows])
                name = hashlib.blake2b("\n".join(map(str, key.tolist())).encode(), digest_size=16).digest()
                marks = [np.full(len(rows), int.from_bytes(name[i : i + 8], "little", signed=True)) for i in (0, 8)]
                out.append((*marks, *(c[x][rows] for x in ("key", "n", "s1", "s2", "label"))))
            if sum(len(x[0]) for x in out[-64:]) > 20_000:
                yield _joined(out)
                out = []
        if out:
            yield _joined(out)

    dealt = split.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = dealt.mapInArrow(run, f"g1 long, g2 long, key {kind}, n long, s1 long, s2 long, label {kind}")
    return found.dropDuplicates(["g1", "g2", "key"])


def _joined(parts: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["g1", "g2", "key", "n", "s1", "s2", "label"])


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[dict[str, np.ndarray], list[pa.RecordBatch]]]:
    """The runs of rows that are equal in ``by``, the order of the input: their columns (but texts), and the slices that hold them."""
    held: list[tuple[dict[str, np.ndarray], pa.RecordBatch]] = []

    def whole() -> tuple[dict[str, np.ndarray], list[pa.RecordBatch]]:
        one = held[0][0] if len(held) == 1 else {x: np.concatenate([c[x] for c, _ in held]) for x in held[0][0]}
        return one, [b for _, b in held]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {x: batch.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(batch.schema.names) if x != "text"}
        cuts = np.flatnonzero(np.any([columns[x][1:] != columns[x][:-1] for x in by], axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = {x: v[lo:hi] for x, v in columns.items()}
            if held and any(held[-1][0][x][-1] != part[x][0] for x in by):
                yield whole()
                held = []
            held.append((part, batch.slice(lo, hi - lo)))
    if held:
        yield whole()


def _sliced(groups: DataFrame, how: Dedup) -> DataFrame:
    """``groups`` with ``piece``, ``lo`` and ``hi``: a group of more than ``held`` shingles falls into pieces, every two of which meet once."""
    totals = groups.groupBy("g1", "g2").agg(F.sum("n").alias("total")).where(F.col("total") > how.held)
    many = totals.select("g1", "g2", F.ceil(2 * F.col("total") / how.held).cast("int").alias("pieces"))
    split = groups.join(many, ["g1", "g2"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    split = split.withColumn("piece", F.pmod(F.xxhash64("key", F.lit(4)), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return split.withColumn("lo", F.least("piece", "other")).withColumn("hi", F.greatest("piece", "other")).drop("pieces", "other")


def _group_links(groups: DataFrame, docs: DataFrame, how: Dedup, text_col: str) -> DataFrame:
    """(a, b): verified links that join each group's components; pairs that earlier links of the slice already join are left out."""
    kind = docs.schema["key"].dataType.simpleString()
    texts = _texts_of(groups.select("key"), docs, how, text_col)

    def links_of(c: dict[str, np.ndarray], slices: list[pa.RecordBatch]) -> list[tuple]:
        sets: list[np.ndarray] = []
        for _, raw, offs in K.chunks(iter(slices), "text", 1 << 18):  # small chunks: only the sets of a slice stay
            grams, at = shingle_sets(raw, offs, how.words)
            sets += [grams[at[i] : at[i + 1]].copy() for i in range(len(at) - 1)]
        n, key, piece, crosses = np.array([len(x) for x in sets]), c["key"], c["piece"], bool(c["lo"][0] != c["hi"][0])
        _, root = np.unique(c["label"], return_inverse=True)
        s1, s2 = c["s1"].view(np.uint64), c["s2"].view(np.uint64)
        out = []
        for i in range(1, len(n)):
            apart = np.bitwise_count(s1[:i] ^ s1[i]) + np.bitwise_count(s2[:i] ^ s2[i])
            fit = np.minimum(n[:i], n[i]) * how.denominator >= np.maximum(n[:i], n[i]) * how.numerator
            if crosses:  # pairs of one piece meet where it is alone
                fit &= piece[:i] != piece[i]
            todo = np.flatnonzero((apart <= 128 - AGREE) & fit & (root[:i] != root[i]))
            for j in todo[np.argsort(apart[todo], kind="stable")].tolist():
                if root[j] != root[i] and _linked(sets[i], sets[j], how):
                    out.append((key[i], key[j]))
                    root[root == root[j]] = root[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, slices in _runs(batches, ["g1", "g2", "lo", "hi"]):
            found = links_of(c, slices)
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=["a", "b"])

    by = ["g1", "g2", "lo", "hi"]
    dealt = _sliced(groups, how).join(texts, "key").repartition(*by).sortWithinPartitions(*by, "n", "key")
    return dealt.select(*by, "piece", "key", "s1", "s2", "label", "text").mapInArrow(run, f"a {kind}, b {kind}")


def _mixed(members: DataFrame) -> DataFrame:
    """(bucket, members) of the buckets whose members are in different components."""
    by = members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members"))
    return by.where("x != y").select("bucket", "members")


def _block_rows(members: DataFrame, how: Dedup) -> int:
    """Rows that the buckets make when their members meet in blocks."""
    return members.agg(F.sum(F.ceil(F.col("members") / how.block))).first()[0] or 0


def _finer(members: DataFrame, docs: DataFrame, how: Dedup, text_col: str) -> DataFrame:
    """``members`` with large mixed buckets broken up by further coordinates, as long as that leaves fewer rows.

    Further bands give each member ``bands`` rows, blocks one for each ``block`` members: buckets with no more blocks than bands stay."""
    most = how.block * how.bands
    done, large = members.where(F.col("members") <= most), members.where(F.col("members") > most)
    for level in range(1, how.levels + 1):
        rows = _block_rows(large, how)
        if not rows:
            break
        texts = _texts_of(large.select("key"), docs, how, text_col)
        bands = nodes(texts.select(F.col("key").alias("id"), "key", F.col("text").alias(text_col)), how, text_col, level).select("key", F.explode("buckets").alias("sub"))
        split = written(large.join(bands, "key").withColumn("bucket", F.xxhash64("bucket", "sub")).drop("sub", "members"), "members")
        finer = written(split.join(_mixed(split), "bucket"), "members")
        if _block_rows(finer, how) >= rows:
            break
        done = done.unionByName(finer.where(F.col("members") <= most))
        large = finer.where(F.col("members") > most)
    return done.unionByName(large)


def near_duplicates(docs: DataFrame, how: Dedup = Dedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n, component, kept): one row for each row of ``docs``. ``key`` is the id, or id and text's digest where ids repeat."""
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, how, id_col, text_col), "near-duplicates")


def _near_duplicates(docs: DataFrame, how: Dedup, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = texts.where("id IS NOT NULL")
    unique = named.select("id").groupBy("id").count().where("count > 1").isEmpty()
    keyed = named.select("id", (F.col("id") if unique else F.md5(F.concat_ws("\x01", F.col("id").cast("string"), "text"))).alias("key"), "text")
    rows = written(nodes(keyed, how, "text"), "nodes")
    same_set = ["n", "set_hi", "set_lo"]
    some = rows.where("n > 0")
    first = some.groupBy(*same_set).agg(F.min(F.struct("key", "s1", "s2", "buckets")).alias("m"))
    classes = written(first.select(*same_set, F.col("m.key").alias("key"), "m.s1", "m.s2", "m.buckets"), "classes")

    exploded = classes.select(F.explode("buckets").alias("bucket"), "key", "n", "s1", "s2")
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = written(exploded.join(shared, "bucket"), "members").withColumn("label", F.col("key"))
    empty = docs.sparkSession.createDataFrame([], keyed.select(F.col("key").alias("a"), F.col("key").alias("b")).schema)
    links, labels = empty, None
    if not unique:  # rows of one id hang together
        by_id = some.join(classes.select(*same_set, F.col("key").alias("rep")), same_set).select("id", "rep")
        lowest = by_id.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b != top").select("id", "b")
        links = written(by_id.join(lowest, "id").select(F.col("rep").alias("a"), "b").where("a != b").distinct(), "id-links")
        labels = components(links)

    def salted(rows: DataFrame) -> DataFrame:
        """A common bucket falls into pieces of ``salt_members``."""
        return rows.withColumn("salts", F.ceil(F.col("members") / how.salt_members).cast("int")).withColumn("salt", F.pmod(F.xxhash64("key", F.lit(6)), F.col("salts")).cast("int"))

    def each_salt(one: DataFrame) -> DataFrame:
        return one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / how.salt_members).cast("int") - 1))).drop("members")

    def relabelled() -> DataFrame:
        out = members.drop("label")
        out = out.join(labels.select(F.col("id").alias("key"), "label"), "key", "left") if labels is not None else out.withColumn("label", F.col("key"))
        out = out.withColumn("label", F.coalesce("label", "key"))
        kept = salted(out).join(each_salt(_mixed(out)), ["bucket", "salt"], "left_semi")
        return written(kept.select("bucket", "key", "n", "s1", "s2", "label", "members"), "members")

    turn, last = 0, False
    while not last:
        if turn or labels is not None:
            members = relabelled()
            comparisons = members.agg(F.sum("members")).first()[0]
            if comparisons is None:
                break
            last = comparisons <= how.comparisons
        last = last or turn >= how.rounds
        if last:
            groups = written(_groups(_finer(members, keyed, how, "text"), how), "groups")
            found = None if groups.isEmpty() else _group_links(groups, keyed, how, "text")
        else:
            order = F.xxhash64("key", F.lit(turn)) if turn == 0 else F.xxhash64("key", "bucket", F.lit(turn))
            centre = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "key", "n", "s1", "s2", "label")).alias("c"), F.first("members").alias("members"))
            both = salted(members).join(each_salt(centre), ["bucket", "salt"]).where((F.col("key") != F.col("c.key")) & (F.col("label") != F.col("c.label")))
            near = both.where(_near(F.col("n"), F.col("c.n"), F.col("s1"), F.col("s2"), F.col("c.s1"), F.col("c.s2"), how))
            pairs = written(near.select(F.col("key").alias("a"), F.col("c.key").alias("b")).distinct(), "pairs")
            found = None if pairs.isEmpty() else verified(pairs, keyed, how, "text")
        turn += 1
        if found is not None:
            links = written(links.union(found), "links")
            labels = components(links)

    label_of = classes.select(*same_set, F.col("key").alias("rep"))
    if labels is not None:
        label_of = label_of.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("label", "rep")).drop("label")
    out = rows.select("id", "key", *same_set).join(label_of, same_set, "left").select("id", "key", "n", F.coalesce("rep", "key").alias("component"))
    if not unique:  # from keys back to ids: empty rows of an id that has texts belong to its component
        of_id = out.where("n > 0").groupBy("id").agg(F.min("component").alias("component"))
        out = out.drop("component").join(of_id, "id", "left").withColumn("component", F.coalesce("component", F.md5(F.col("id").cast("string"))))
        ids = out.groupBy("component").agg(F.min("id").alias("lowest"))
        out = out.join(ids, "component").select("id", "key", "n", F.col("lowest").alias("component"))
    out = out.withColumn("kept", F.col("id") == F.col("component"))
    blank = nodes(texts.where("id IS NULL").select("id", F.lit(None).cast(keyed.schema["key"].dataType).alias("key"), "text"), how, "text")
    return out.unionByName(blank.select("id", "key", "n", F.col("id").alias("component"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, how: Dedup = Dedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but of each component only the document with the smallest id (of its rows, one). Rows with a
    null id stay."""
    found = near_duplicates(docs, how, id_col, text_col).where("id IS NOT NULL")
    repeats = not found.groupBy("id").count().where("count > 1").isEmpty()
    gone, turn = (next(n for n in (f"{base}{i}" for i in itertools.count()) if n not in docs.columns) for base in ("gone", "turn"))
    lost = found.where(~F.col("kept")).select(F.col("id").alias(gone)).distinct()
    few = lost.count() <= how.broadcast_ids
    left = docs.join(F.broadcast(lost) if few else lost, F.col(id_col) == F.col(gone), "left_anti")
    if repeats:
        order = F.xxhash64(F.col(text_col))
        named = left.where(F.col(id_col).isNotNull())
        for by in ([F.col(id_col), F.pmod(order, F.lit(64))], [F.col(id_col)]):  # an id of very many rows is cut down in pieces first
            named = named.withColumn(turn, F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col(turn) == 1).drop(turn)
        left = named.unionByName(left.where(F.col(id_col).isNull()))
    return left


def op2(spark, sf_dir: str, how: Dedup = Dedup(words=4)) -> DataFrame:
    """Contract query: components of all documents at four-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), how)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


#: All pairs that share a shingle, for the scale of a correctness check.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sh), one AS (SELECT doc_id, unnest(s) AS x FROM sh),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""
