"""Secret scans: one combined deterministic automaton reads every byte once, and gives the spans.

All rules are compiled into one minimal automaton (``automata``). Lanes, cut where no rule can have a match under way, run through it
in lockstep; in lanes that reach its final state the rules' own automata, over the same byte classes, give the spans' starts and ends
(leftmost, longest, not overlapping for each kind; length limits are states). As no match crosses a lane's border, whole-text and
lane results agree. The transition arrays (some hundred KB, fixed by the rules) travel in the closure; a scan has no shuffle.

Nulls: a null text is empty and has no span; a null id is carried along. Repeated rows each give a row, ties do not arise. An empty
table gives an empty result. Very long texts are read whole, lane by lane; one without any border is a single lane, walked byte by
byte. Other columns never meet the result's own columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automata as A
from . import text as K

_DIGIT = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _DIGIT + _UPPER + _UPPER.lower()
_VALUE = _ALNUM + b"+/_.=-"

BASE = ("assign", "access", "hex")


def _rules() -> list[A.Rule]:
    """The kinds in order. A rule's length limit counts inside its automaton: ``passes`` is the part of ``match`` that is long enough.
    ``search`` only has to fire in every lane with a passing match: of the added kinds' tails the first bytes do, which keeps the
    product of their counters small."""
    quote = A.repeat(A.chars(b"\"'"), 0, 1)
    blanks = A.repeat(A.chars(b" "), 0, None)
    word = lambda s: A.lit(s, any_case=True)
    some = lambda allowed, least: A.repeat(A.chars(allowed), least, None)
    key = A.alt(word("password"), word("passwd"), word("secret"), word("token"), A.seq(word("api"), A.repeat(A.lit("_"), 0, 1), word("key")))
    given = A.seq(key, quote, blanks, A.chars(b":="), blanks, quote)
    name = some(_ALNUM + b"._-", 1)
    url = A.seq(A.lit("://"), name, A.lit(":"))
    login = A.seq(url, name, A.lit("@"))
    block = A.seq(A.lit("-----BEGIN "), A.repeat(A.chars(_UPPER + b" "), 0, None), A.lit("PRIVATE KEY-----"))

    def tail(kind: str, front: A.Pattern, allowed: bytes, least: int, seen: int) -> A.Rule:
        """``front``, then bytes of ``allowed``: one or more match, ``least`` pass."""
        return A.Rule(kind, A.seq(front, A.repeat(A.chars(allowed), seen, seen)), A.seq(front, some(allowed, 1)), A.seq(front, some(allowed, least)))

    return [
        tail("assign", given, _VALUE, 6, 6),
        tail("access", A.lit("AKIA"), _UPPER + _DIGIT, 16, 16),
        tail("hex", A.seq(), b"0123456789abcdef", 24, 24),
        A.Rule("private_key", A.lit("-----BEGIN "), block, block),
        tail("code_host", A.seq(A.lit("gh"), A.chars(b"pousr"), A.lit("_")), _ALNUM, 36, 2),
        tail("chat_host", A.seq(A.lit("xox"), A.chars(b"abprs"), A.lit("-")), _ALNUM + b"-", 10, 1),
        tail("payment", A.seq(A.chars(b"rs"), A.lit("k_live_")), _ALNUM, 16, 1),
        A.Rule("login_url", url, login, login),
    ]


@functools.cache
def automaton() -> A.Automaton:
    return A.compile_rules(_rules())


def find(auto: A.Automaton, raw: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each document with hits: sorted (start, rule, end) in bytes from the document's start."""
    starts, ends = A.lanes(auto, raw, offs)
    hit = np.flatnonzero(A.scan(auto, raw, starts, ends)) if len(starts) else []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for lane in hit:
        a, b = int(starts[lane]), int(ends[lane])
        doc = int(np.searchsorted(offs, a, "right")) - 1
        shift, symbols = a - int(offs[doc]), auto.klass[raw[a:b]]
        for i, rule in enumerate(auto.rules):
            for s, e in A.spans(auto, rule, symbols):
                found.setdefault(doc, []).append((s + shift, i, e + shift))
    return {doc: sorted(spans) for doc, spans in found.items()}


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and ``spans`` (kind, start, end; code points, end exclusive)."""
    auto = automaton()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            found, spans = find(auto, raw, offs), [[]] * batch.num_rows
            for doc, hits in found.items():
                points = np.concatenate([[0], np.cumsum(K.code_points(raw[offs[doc] : offs[doc + 1]]))])
                spans[doc] = [{"kind": auto.rules[i].name, "start": int(points[s]), "end": int(points[e])} for s, i, e in hits]
            yield pa.record_batch([batch.column(0), pa.array(spans, _SPAN_TYPE)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return out.mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS}")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: bytes = b"[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark`` (overlapping spans: one mark); nulls stay."""
    auto = automaton()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, text_col):
            found = find(auto, raw, offs)
            if found:
                column = batch.column(at)
                texts = column.to_pylist()
                for doc, hits in found.items():
                    body, parts, last = raw[offs[doc] : offs[doc + 1]].tobytes(), [], 0
                    for s, _, e in hits:
                        if s >= last:
                            parts += [body[last:s], mark]
                        last = max(last, e)
                    texts[doc] = b"".join([*parts, body[last:]]).decode()
                arrays = [batch.column(i) if i != at else pa.array(texts, column.type) for i in range(batch.num_columns)]
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: secrets of every document, with counts and a digest of the base kinds."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
