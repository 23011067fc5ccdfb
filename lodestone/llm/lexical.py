"""Ranked lexical search: a dual-sorted wavelet tree for each shard of the documents, exact top-k by best-first node intersection.

Documents are dealt to shards. In a shard every term's postings are ordered by falling impact, and the lists, one after another, form one
sequence of document numbers (numbered by ascending id). A wavelet matrix over it keeps that order in every node, so that

- a node is a range of document numbers, and each query term has one interval in it, found by ranks from the parent's interval: the tree is
  sorted by document as well, and going down intersects the terms' lists by ranges of documents;
- the first element of an interval has the highest impact that the term gives to any document of the node: the sum over the
  terms is a bound for the whole subtree, and exact where the node is one document.

Nodes are expanded best bound first, some at a time, until no node is left that could hold one of the k best. Each shard gives its k best, and those
are ranked again. Nothing is approximate.

Scores are whole numbers; a term is its 64-bit hash. Statistics (documents, terms in all, documents of each query term) come from all documents.
Postings of terms that no query has are left out early by a bitmap of fixed size (2 MB, whatever the queries); what passes by accident does no harm.

Scale: one pass over the texts; the postings that pass are written once, sorted by nothing, and shuffled once, to shards of about ``SHARD``
postings. Queries are dealt to every shard; they are never broadcast. Rows are dealt to shards by number, not by id, so that no id and no group of copies
makes a large shard.

Nulls: a null text has no terms, and a document without terms counts for nothing; a null id ranks after others of its score. A query
without terms has no rows. Equal rows of documents are documents of their own; equal queries count once, and queries that share an id but not a text are
ranked apart. Ties are ranked by id. Very long texts are read whole. Empty tables give none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as K
from .state import scratch, written

#: Postings of a shard, and nodes that are expanded at a time.
SHARD, AT_ONCE = 500_000, 64
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLACES, _CELL = 24, 1 << 15


def counted_terms(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, with repeats; hash, times and text number of each text's distinct terms, by text)."""
    starts, ends = K.runs(_TERM[raw], offs)
    hashes = K.span_hashes(raw, starts, ends, lower=True)
    at = np.searchsorted(starts, offs)
    doc = K.document_of(at)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(first)
    return np.diff(at), hashes[heads], np.diff(np.append(heads, len(hashes))), doc[heads]


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values))


def _counted(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Every column but the text, ``n`` (terms with repeats), ``terms`` and ``times``. ``wanted``: bitmap of terms that are kept."""
    for batch, raw, offs in K.chunks(batches, "text"):
        n, hashes, times, doc = counted_terms(raw, offs)
        if wanted is not None:
            place = hashes >> K.U64(64 - _PLACES)
            keep = (wanted[place >> K.U64(3)] >> (place & K.U64(7)).astype(np.uint8)) & 1 == 1
            hashes, times, doc = hashes[keep], times[keep], doc[keep]
        names = [x for x in batch.schema.names if x != "text"]
        lists = [_lists(x, doc, batch.num_rows) for x in (hashes.view(np.int64), times.astype(np.int64))]
        yield pa.record_batch([*(batch.column(x) for x in names), pa.array(n.astype(np.int64)), *lists], names=[*names, "n", "terms", "times"])


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, digest, term, times): the distinct terms of every distinct query."""
    rows = items.select(F.col(id_col).alias("item"), F.md5(F.col(text_col).cast("binary")).alias("digest"), F.col(text_col).cast("string").alias("text")).dropDuplicates(["item", "digest"])
    kind = rows.schema["item"].dataType.simpleString()
    counted = rows.mapInArrow(lambda batches: _counted(batches, None), f"item {kind}, digest string, n long, terms array<bigint>, times array<bigint>")
    return counted.select("item", "digest", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("item", "digest", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))


def bitmap(terms: DataFrame) -> np.ndarray:
    """The places of the terms' hashes in a bitmap of 2^24 bits."""
    place = F.shiftrightunsigned("term", 64 - _PLACES)
    cells = terms.select((place / _CELL).cast("int").alias("cell"), (place % _CELL).alias("bit")).groupBy("cell").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    out = np.zeros(1 << (_PLACES - 3), np.uint8)
    for cell, bits in cells.collect():  # at most 512 rows of 4 KB
        out[cell * _CELL // 8 : cell * _CELL // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


# the tree


@dataclass
class Tree:
    """A shard: ``zeros`` and ``impact`` hold, for each level and one below the last, ranks of zero bits and impacts in the level's order, flat."""

    terms: np.ndarray
    starts: np.ndarray
    levels: int
    size: int
    zeros: np.ndarray
    split: np.ndarray
    impact: np.ndarray


def grown(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int) -> Tree:
    """The dual-sorted tree of a shard's postings; ``doc`` numbers the documents."""
    order = np.lexsort((doc, -impact, term))
    term, doc, impact = term[order], doc[order], impact[order]
    terms, starts = np.unique(term, return_index=True)
    levels, size = max(int(documents - 1).bit_length(), 1), len(doc)
    zeros, split, impacts = np.zeros((levels, size + 1), np.int32), np.zeros(levels, np.int32), np.zeros((levels + 1, size + 1), np.int32)
    for level in range(levels):
        impacts[level, :size] = impact
        one = (doc >> (levels - 1 - level)) & 1 == 1
        np.cumsum(~one, out=zeros[level, 1:])
        split[level] = zeros[level, size]
        to = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        doc, impact = doc[to], impact[to]
    impacts[levels, :size] = impact
    return Tree(terms, np.append(starts, size), levels, size, zeros.reshape(-1), split, impacts.reshape(-1))


def best(tree: Tree, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document numbers, scores) of the k best documents with a score above 0, best first and equal ones by number; and how many nodes were expanded."""
    at = np.searchsorted(tree.terms, terms)
    there = at < len(tree.terms)
    there[there] = tree.terms[at[there]] == terms[there]
    there &= weights > 0
    at, weights = at[there], weights[there]
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(at):
        return found, scores, 0
    lo, hi = tree.starts[at][None].astype(np.int64), tree.starts[at + 1][None].astype(np.int64)
    level, number, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64) << 62
    row, expanded = tree.size + 1, 0
    while len(bound):
        some = np.argpartition(-bound, AT_ONCE)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[some] = False
        expanded += len(some)
        shift = (level[some] * row)[:, None]
        lo0, hi0 = tree.zeros[lo[some] + shift], tree.zeros[hi[some] + shift]
        ones = tree.split[level[some]][:, None]
        child_lo = np.concatenate([lo0, ones + lo[some] - lo0]).astype(np.int64)
        child_hi = np.concatenate([hi0, ones + hi[some] - hi0]).astype(np.int64)
        deep = np.concatenate([level[some], level[some]]) + 1
        first = np.concatenate([number[some], number[some] + (np.int64(1) << (tree.levels - deep[: len(some)]))])
        top = np.where(child_lo < child_hi, tree.impact[child_lo + (deep * row)[:, None]], 0) @ weights
        leaf = (deep == tree.levels) & (top > 0)
        if leaf.any():
            found, scores = np.append(found, first[leaf]), np.append(scores, top[leaf])
            keep = np.lexsort((found, -scores))[:k]
            found, scores = found[keep], scores[keep]
        inner = (deep < tree.levels) & (top > 0)
        lo, hi = np.concatenate([lo[rest], child_lo[inner]]), np.concatenate([hi[rest], child_hi[inner]])
        level, number, bound = np.append(level[rest], deep[inner]), np.append(number[rest], first[inner]), np.append(bound[rest], top[inner])
        if len(found) == k:  # a node may still win by its score, or by a smaller number at the same score
            may = (bound > scores[-1]) | (bound == scores[-1]) & (number < found[-1])
            if not may.all():
                lo, hi, level, number, bound = lo[may], hi[may], level[may], number[may], bound[may]
    return found, scores, expanded


# search


def impacts(times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A posting's share in a score before the term's weight."""
    m = 100 - 25 + (25 * n * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD) -> DataFrame:
    """(item, rank, id, score): each query's k best documents, fewer where fewer score above 0."""
    with scratch(docs.sparkSession) as keep:
        return keep(_top(docs, items, k, id_col, text_col, item_col, item_text, shard), "top-documents")


def _top(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, item_col: str, item_text: str, shard: int) -> DataFrame:
    asked = written(query_terms(items, item_col, item_text), "query-terms")
    wanted = bitmap(asked)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("deal"))
    counted = written(rows.mapInArrow(lambda batches: _counted(batches, wanted), f"id {kind}, deal long, n long, terms array<bigint>, times array<bigint>"), "counted")
    stats = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total"), F.sum(F.size("terms")).alias("postings")).first()
    documents, total = stats["documents"], stats["total"] or 1
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = asked.join(df, "term").withColumn("weight", weight * F.col("times")).groupBy("item", "digest").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    shards = max(-(-(stats["postings"] or 0) // shard), 1)
    queries = weighted.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "item", "digest", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    dealt = counted.where(F.size("terms") > 0).select(F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("int").alias("shard"), "id", "n", "terms", "times")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            order = pc.array_sort_indices(left["id"].combine_chunks(), null_placement="at_end").to_numpy()
            number = np.empty(left.num_rows, np.int64)
            number[order] = np.arange(left.num_rows)
            sizes = left["terms"].combine_chunks().value_lengths().to_numpy()
            term, times = (left[c].combine_chunks().flatten().to_numpy() for c in ("terms", "times"))
            asked_for = np.unique(right["terms"].combine_chunks().flatten().to_numpy())
            place = np.minimum(np.searchsorted(asked_for, term), len(asked_for) - 1)
            hit = asked_for[place] == term
            impact = impacts(times, np.repeat(left["n"].to_numpy(), sizes), documents, total)
            tree = grown(term[hit], np.repeat(number, sizes)[hit], impact[hit], left.num_rows)
            terms, weights = right["terms"].combine_chunks(), right["weights"].combine_chunks()
            at = np.append(0, np.cumsum(terms.value_lengths().to_numpy()))
            terms, weights = terms.flatten().to_numpy(), weights.flatten().to_numpy()
            for i in range(right.num_rows):
                found, scores, _ = best(tree, terms[at[i] : at[i + 1]], weights[at[i] : at[i + 1]], k)
                if len(found):
                    out.append((np.full(len(found), i), order[found], scores))
        row, doc, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table([right["shard"].take(pa.array(row)), right["item"].take(pa.array(row)), right["digest"].take(pa.array(row)), left["id"].take(pa.array(doc)), pa.array(score)], names=["shard", "item", "digest", "id", "score"])

    found = dealt.groupBy("shard").cogroup(queries.groupBy("shard")).applyInArrow(search, f"shard int, item {item_kind}, digest string, id {kind}, score long")
    by = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    groups = max(int(shards**0.5), 1)  # so that no query's shards meet in one partition at once
    some = Window.partitionBy("item", "digest", F.pmod("shard", F.lit(groups))).orderBy(*by)
    every = Window.partitionBy("item", "digest").orderBy(*by)
    first = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    return first.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """Registered query: the 20 best documents for every benchmark item."""
    found = top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int"), F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH folded AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded),
tf AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
terms AS (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL),
parts AS (SELECT item_id, r, doc_id, times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS part
  FROM terms JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (r), corpus),
scored AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
