"""Byte-level BPE ids in bulk, flat token files, and a separator scan that counts their tokens.

``encode`` splits a whole chunk of text into pre-tokens with array operations (the published pattern: contractions, an
optional space before letters, numbers or other signs, white space), looks each distinct pre-token up in a worker-wide table of
ids, and merges bytes only of pre-tokens never seen before (by the ranks in the ``tokenizers`` file; where a probe shows that they do
not reproduce the library, the library itself does it). Texts with characters outside the
checked ranges, or with the special token's string, go through the library whole, so ids always equal its own.

Token files are flat little-endian ids, each document ended by the end-of-document id, without any index.
``scan_files`` cuts them in blocks of equal size, finds the separators of each block in one vectorised search, and joins
boundaries by a prefix scan over block summaries. Files lie in the shared folder.

Nulls: a null text is empty, a null id is carried along. Repeated rows are documents of their own. An empty table gives no files and
no rows. Ties do not arise. Very long texts are a chunk of their own, in memory whole. Other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as K
from .state import fresh_path, scratch, written

END_OF_DOCUMENT = 50_256  # the vocabulary's end token: ordinary text, encoded as such, never gives it
CACHE_PIECES = 600_000  # about 25 MB for each worker
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = range(5)
_CHECKED = 0x2100


def _classes() -> np.ndarray:
    out = np.full(_CHECKED + 1, _OTHER, np.uint8)
    for c in range(_CHECKED):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = _LETTER
        elif kind[0] == "N":
            out[c] = _NUMBER
        if kind == "Cn" or 0x0530 <= c < 0x2000 or 0x2060 <= c:
            out[c] = _UNSURE  # scripts whose tables differ between library versions
    # White_Space of the Unicode database
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = _SPACE
    out[_CHECKED] = _UNSURE
    return out


_CLASS = _classes()
_P32 = K._powers(0x9E3779B97F4A7C15, 1 << 16)
_I32 = K._powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), 1 << 16)


def _byte_signs() -> str:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class Encoder:
    """Ids of many texts at once; the table of known pre-tokens lives as long as the worker."""

    def __init__(self, path: str, plain: bool = False):
        """``plain``: the special tokens' strings in a text are ordinary text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merge = self._by_ranks()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # of each key: its entry in begin
        self.ids = np.zeros(0, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.begin = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.ids.dtype) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the documents of a chunk."""
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        count = np.concatenate([[0], np.cumsum(K.code_points(raw))])
        at = count[offs]
        kind = _CLASS[np.minimum(points, _CHECKED)]
        slow = K.per_document(kind == _UNSURE, at) > 0
        body = raw.tobytes()
        for s in self.special:
            s = s.encode()
            found = body.find(s)
            while found >= 0:
                slow[np.searchsorted(offs, found, "right") - 1] = True
                found = body.find(s, found + 1)
        starts, ends = _pieces(points, kind, at)
        inside = np.searchsorted(starts, at)  # first piece of each document
        keys = _keys(points, starts, ends)
        if slow.any():
            fast = ~np.repeat(slow, np.diff(inside))
            starts, ends, keys = starts[fast], ends[fast], keys[fast]
            inside = np.concatenate([[0], np.cumsum(np.where(slow, 0, np.diff(inside)))])
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        slots = self._slots(unique, points, starts[first], ends[first])[back]
        lengths = self.begin[slots + 1] - self.begin[slots]
        out_offs = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.begin[slots] - out_offs[:-1], lengths) + np.arange(out_offs[-1])]
        doc_offs = out_offs[inside]
        if slow.any():
            parts = [ids[doc_offs[d] : doc_offs[d + 1]] for d in range(len(offs) - 1)]
            which = np.flatnonzero(slow)
            for d, own in zip(which, self.whole([raw[offs[d] : offs[d + 1]].tobytes().decode() for d in which]), strict=True):
                parts[d] = own
            ids = np.concatenate(parts)
            doc_offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, doc_offs

    def _slots(self, unique: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.keys) > CACHE_PIECES:
            self._clear()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[new], ends[new]
            sizes = b - a
            begin = np.cumsum(sizes) - sizes
            text = points[np.repeat(a - begin, sizes) + np.arange(int(sizes.sum()))].tobytes().decode("utf-32-le")
            fresh = self._encode_pieces([text[i:j] for i, j in zip(begin.tolist(), (begin + sizes).tolist(), strict=True)])
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            base = len(self.begin) - 1
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(fresh), self.ids.dtype, int(sizes.sum()))])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.keys = np.insert(self.keys, place[new], unique[new])
            self.slot = np.insert(self.slot, place[new], base + np.arange(len(new)))
            place = np.searchsorted(self.keys, unique)
        return self.slot[place]

    def _by_ranks(self):
        """Byte merges by rank, if the ids of the file are in the order of its merges; else None."""
        import tiktoken

        signs = {c: b for b, c in enumerate(_byte_signs())}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        if any(c not in signs for t in vocabulary if t not in special for c in t):
            return None
        ranks = {bytes(signs[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        if len({len(t) == 1 for t in ranks}) != 2 or sum(len(t) == 1 for t in ranks) != 256:
            return None
        merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        probe = [" the", "\n\n", "Überraschung", " antidisestablishmentarianism", " 31415926535", "!!!???", " ñandú", "'s", " ©®", "zzzzzzzzqqqq"]
        return merge if all(merge(p.encode()) == e.ids for p, e in zip(probe, self.library.encode_batch(probe, add_special_tokens=False), strict=True)) else None

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        if self.merge:
            merge = self.merge
            return [merge(p.encode()) for p in pieces]
        return [e.ids for e in self.library.encode_batch(pieces, add_special_tokens=False)]


def _pieces(points: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of all documents, in order."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    border[1:n] = kind[1:] != kind[:-1]
    border[offs] = True
    begin = np.flatnonzero(border)[:-1]
    end = np.append(begin[1:], n)
    what = kind[begin]
    at_end = np.zeros(n + 1, bool)
    at_end[offs] = True
    white = what == _SPACE
    followed = white & ~at_end[end]  # white space before something else of its document
    cut = followed & (end - begin > 1)
    last_blank = followed & (points[end - 1] == 0x20)
    starts = begin.copy()
    # a last blank goes to what follows; another last white character is a piece of its own
    takes = np.zeros(len(begin), bool)
    takes[1:] = last_blank[:-1]
    starts[takes] -= 1
    gone = last_blank & ~cut
    extra = end[cut & ~last_blank] - 1
    # contractions: a lone apostrophe, no blank before it, and letters of the list after it
    lone = np.flatnonzero((what == _OTHER) & (end - begin == 1) & (points[begin] == 0x27) & ~takes & ~at_end[end])
    keep = ~gone
    more = []
    for i in lone.tolist():
        if what[i + 1] != _LETTER:
            continue
        tail = points[end[i] : min(end[i] + 2, end[i + 1])].tobytes().decode("utf-32-le")
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            keep[i + 1] = False  # the letters join the apostrophe; what is left of them starts anew
            if end[i + 1] > end[i] + size:
                more.append(end[i] + size)
    starts = np.concatenate([starts[keep], extra, np.array(more, np.int64)])
    starts.sort()
    return starts, np.append(starts[1:], n)


def _keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces, in windows of the power table."""
    out = np.empty(len(starts), np.uint64)
    at, most = 0, len(_P32) - 1
    spread = points.astype(np.uint64)
    spread += np.uint64(0x632BE59BD9B4E019)
    spread *= np.uint64(0xD1342543DE82EF95)
    spread ^= spread >> np.uint64(29)
    while at < len(starts):
        base = int(starts[at])
        end = int(np.searchsorted(ends, base + most, "right"))
        if end <= at:
            out[at] = int.from_bytes(hashlib.blake2b(points[base : ends[at]].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        part = spread[base : ends[end - 1]]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * _P32[: len(part)])])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = K.mix64((sums[e] - sums[s]) * _I32[s] + (e - s).astype(np.uint64))
        at = end
    return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]


def default_vocabulary() -> str:
    """The public vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# flat token files


def write_files(docs: DataFrame, directory: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """Writes one flat file for each input partition under ``directory`` (a URI all workers reach); returns the manifest
    (file, ordinal, id): which document is the ordinal-th of a file, by which counts find their documents.

    Must be evaluated once (the manifest is written by the caller): a task that runs again writes a new file, and only
    files named in the manifest are read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(directory)
        filesystem.create_dir(base, recursive=True)
        name, ordinal, stream = f"{uuid.uuid4().hex}.tokens", 0, None
        own = encoder(vocabulary or default_vocabulary(), plain=True)
        for batch, raw, offs in K.chunks(batches, "__text"):
            if stream is None:
                stream = filesystem.open_output_stream(f"{base}/{name}")
            ids, at = own.encode(raw, offs)
            flat = np.insert(ids.astype(dtype), at[1:], end)
            stream.write(flat.tobytes())
            yield pa.record_batch([pa.array([name] * batch.num_rows), pa.array(np.arange(ordinal, ordinal + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "id"])
            ordinal += batch.num_rows
        if stream is not None:
            stream.close()

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"file string, ordinal long, id {kind}")


def scan_files(spark: SparkSession, directory: str, files: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """(file, ordinal, tokens): length of every document of the flat files named in ``files`` (column file), separator included."""
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            names, blocks = [], []
            for name in batch.column(0).to_pylist():
                size = filesystem.get_file_info(f"{base}/{name}").size
                n = max(1, -(-size // (block_tokens * width)))
                names += [name] * n
                blocks += range(n)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(blocks, pa.int64())], names=["file", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(f"{base}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block_tokens * width, block * block_tokens * width), dtype)
                found = np.flatnonzero(ids == end)
                gaps = np.diff(found)
                # the first document may begin in an earlier block, the tail goes on in the next one
                head, tail = (int(found[0]) + 1, len(ids) - int(found[-1]) - 1) if len(found) else (0, len(ids))
                lengths = np.concatenate([[head], gaps]) if len(found) else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array([name]), pa.array([block]), pa.array([len(found)]), pa.array([tail]), pa.array([lengths.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n", "tail", "lengths"])

    blocks = files.select("file").distinct().mapInArrow(cut, "file string, block long").repartition("file", "block")
    found = written(blocks.mapInArrow(search, "file string, block long, n long, tail long, lengths array<long>"), "token-blocks")
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # prefix scan over summaries: documents before the block, and tokens since the last separator before it
    summary = found.select("file", "block", "n", "tail")
    ordinal = F.coalesce(F.sum("n").over(so_far), F.lit(0))
    run_no = F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(so_far), F.lit(0))
    carried = summary.withColumn("before", ordinal).withColumn("run", run_no)
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("tail").over(since), F.lit(0))
    last_tail = F.last(F.when(F.col("n") > 0, F.col("tail")), True).over(so_far)
    carried = carried.withColumn("carry", F.coalesce(last_tail, F.lit(0)) + opened).select("file", "block", "before", "carry")
    lengths = found.join(carried, ["file", "block"]).select("file", "before", "carry", F.posexplode("lengths").alias("k", "length"))
    tokens = F.when(F.col("k") == 0, F.col("length") + F.col("carry")).otherwise(F.col("length"))
    return lengths.select("file", (F.col("before") + F.col("k")).alias("ordinal"), tokens.cast("long").alias("tokens"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: documents become flat token files, the separator scan counts each document's tokens (without its end id)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        directory = fresh_path(spark, "token-files")
        manifest = written(write_files(docs, directory), "token-manifest")
        counts = scan_files(spark, directory, manifest)
        return keep(manifest.join(counts, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), (F.col("tokens") - 1).alias("n_tokens")), "token-counts")
