from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import packing as P
from lodestone.llm import text as K
from lodestone.llm import tokens as T

from . import helpers


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_vocabulary())


def strings():
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", " \n", "'s", "'", "''", "'ll", " 's", "1", "23", "é", "ß", "!", "...", " $", " ", "　", "漢", "<|endoftext|>", "'t", "'ve", "x'y", "\r\n", "½", "²", "’", "​", "\x1c", "A", "🙂"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(library, plain):
    library.encode_special_tokens = plain
    own = T.Encoder(T.default_vocabulary(), plain)
    batch = pa.record_batch([pa.array(strings())], names=["t"])
    for part, raw, offs in K.chunks(iter([batch]), "t", 20_000):
        ids, at = own.encode(raw, offs)
        for i, text in enumerate(part.column(0).to_pylist()):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = False


def test_library_path_gives_the_same(monkeypatch):
    fast, slow = T.Encoder(T.default_vocabulary()), T.Encoder(T.default_vocabulary())
    slow.merge = None
    raw = np.frombuffer(" the Überraschung of 12 things\n\nand 'more'".encode(), np.uint8)
    assert fast.merge is not None
    assert fast.encode(raw, np.array([0, len(raw)]))[0].tolist() == slow.encode(raw, np.array([0, len(raw)]))[0].tolist()


def test_separator_scan_stitches_blocks(spark, library):
    rows = [(i, t) for i, t in enumerate([*strings()[:300], None, "", "word " * 5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from lodestone.llm.state import fresh_path, written

    where = fresh_path(spark, "test-files")
    manifest = written(T.write_files(df, where), "test-manifest")
    library.encode_special_tokens = True
    expected = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    library.encode_special_tokens = False
    for block in (7, 64, 1 << 20):
        counts = T.scan_files(spark, where, manifest, block_tokens=block)
        got = {r.id: r.tokens - 1 for r in manifest.join(counts, ["file", "ordinal"]).collect()}
        assert got == expected


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing opens, piece by piece."""
    gaps, opened = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            gap = gaps.pop(i)
        else:
            gap, opened = capacity, opened + 1
        if gap > x:
            bisect.insort(gaps, gap - x)
    return opened


def check_plan(steps, lengths, capacity):
    seqs, ranks = {}, {}
    for n, lo, hi, first, place in steps:
        ranks.setdefault(n, []).append((lo, hi))
        for k in range(hi - lo):
            seqs.setdefault(first + k, []).append((place, n))
    for s in seqs.values():
        end = 0
        for place, n in sorted(s):
            assert place == end
            end += n
        assert end <= capacity
    for n, spans in ranks.items():
        end = 0
        for lo, hi in sorted(spans):
            assert lo == end < hi
            end = hi
        assert end == lengths.count(n)
    assert ranks.keys() == set(lengths)
    return len(seqs)


def lengths_of(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    return capacity, [min(capacity, max(1, int(rng.expovariate(rng.choice([1, 3, 12]) / capacity)))) for _ in range(rng.choice([1, 50, 3000]))]


@pytest.mark.parametrize("seed", range(16))
def test_one_sweep_is_best_fit_decreasing(seed):
    capacity, lengths = lengths_of(seed)
    found = P.sweep([(n, 0, lengths.count(n)) for n in set(lengths)], [], capacity, 0)
    assert not found.left and check_plan(found.placed, lengths, capacity) == best_fit(lengths, capacity)


@pytest.mark.parametrize("seed", [3, 5, 8, 9])
def test_rounds_of_sweeps_are_valid_and_as_good(spark, seed):
    capacity, lengths = lengths_of(seed)
    used = check_plan(P.plan(spark, {n: lengths.count(n) for n in set(lengths)}, capacity), lengths, capacity)
    assert -(-sum(lengths) // capacity) <= used <= best_fit(lengths, capacity) + 1
    assert P.plan(spark, {}, capacity) == []


def test_large_plans_are_joined_by_shuffle(spark, monkeypatch):
    """Without a broadcast, with few ranks to a key and small ranges; one row a thousand times."""
    monkeypatch.setattr(P, "BROADCAST_PLAN", 0)
    monkeypatch.setattr(P, "RANKS_A_KEY", 16)
    lengths = [5] * 1000 + [7, 3, 10, 9, 1] * 40
    pieces = spark.createDataFrame([(1, 0, 0, 5, 5)] * 1000 + [(i, 0, 0, n, n) for i, n in enumerate(lengths[1000:])], "id long, piece int, start long, length long, crc long")
    real = P.ranked
    monkeypatch.setattr(P, "ranked", lambda p: real(p, 100))
    seqs = {}
    for r in P.pack(pieces, 10).collect():
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(n for s in seqs.values() for _, n in s) == sorted(lengths) and len(seqs) == best_fit(lengths, 10)
    for s in seqs.values():
        assert [p for p, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 10


def test_registered_query(spark, library):
    """Every column of the contract, over the whole table, in as few sequences as best-fit decreasing."""
    path = "/root/testdata/sf0.001"
    out = P.op4(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = out.withColumnsRenamed({"doc_id": "id", "ids_crc32": "crc"}).collect()
    check_packed(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}, library, 1024)
    assert len({r.sequence_id for r in rows}) <= best_fit([r.length for r in rows], 1024)


def test_token_count_query(spark, library):
    path = "/root/testdata/sf0.001"
    out = T.op3(spark, path)
    library.encode_special_tokens = True
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    library.encode_special_tokens = False
    assert out.columns == ["doc_id", "n_tokens"] and dict(map(tuple, out.collect())) == want


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_token_counts(spark, library, clash):
    """Null ids and texts, repeated rows, clashing columns and an empty table, with values."""
    from lodestone.llm.state import fresh_path, written

    for df in (helpers.awkward(spark, clash), helpers.empty(spark)):
        where = fresh_path(spark, "awkward-files")
        manifest = written(T.write_files(df, where), "awkward-manifest")
        got = sorted((str(r.id), r.tokens - 1) for r in manifest.join(T.scan_files(spark, where, manifest), ["file", "ordinal"]).collect())
        assert got == sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())


def check_packed(rows, texts, library, capacity):
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.id, []).append((r.piece, r.start, r.length, r.crc))
    for s in seqs.values():
        end = 0
        for place, n in sorted(s):
            assert place == end
            end += n
        assert end <= capacity
    for k, pieces in docs.items():
        end = 0
        for i, (piece, start, n, crc) in enumerate(sorted(pieces)):
            assert piece == i and start == end and (i == 0 or n == capacity)
            assert crc == zlib.crc32(np.array(ids[k][start : start + n], "<u4").tobytes())
            end += n
        assert end == len(ids[k])
    assert docs.keys() == ids.keys()


def test_documents_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate([*strings()[:200], None, "", "word " * 700])]
    packed = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 64)
    check_packed(packed.collect(), dict(rows), library, 64)


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_documents(spark, clash):
    df = helpers.awkward(spark, clash)
    packed = P.pack_documents(df, 1024)
    assert packed.where("piece = 0").count() == df.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert packed.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
    assert P.pack_documents(helpers.empty(spark), 1024).count() == 0
