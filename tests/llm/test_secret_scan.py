from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import automata as A
from lodestone.llm import secret_scan as S
from lodestone.llm import text as K

from . import helpers

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    return sorted((m.start(), i, m.end()) for i, (_, r, g, least) in enumerate(BASE) for m in r.finditer(text or "") if len(m[g]) >= least)


def texts():
    rng = random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "\n", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "deadbeef", "é", "漢", ",", "|", "x", "ghp_", "-----BEGIN RSA PRIVATE KEY-----", "postgres://u:pw1@h", "\t"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    return [*out, "", "a" * 5000 + " token=" + "z" * 700 + "," + "0" * 100, "0123456789abcdef" * 400, None]


def test_base_spans_equal_plain_expressions(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in S.BASE] for r in S.scan_secrets(df).collect()}
    assert got == {i: [(BASE[k][0], a, b) for a, k, b in brute(t)] for i, t in enumerate(texts())}


def test_more_kinds_are_found():
    text = b"x ghp_" + b"A1" * 20 + b" and xoxb-1234567890-ab\nrk_live_abcdefgh12345678 postgres://me:pw@host -----BEGIN PRIVATE KEY-----"
    raw = np.frombuffer(text, np.uint8)
    found = S.find(S.automaton(), raw, np.array([0, len(raw)]))[0]
    assert [S.automaton().rules[i].name for _, i, _ in found] == ["code_host", "chat_host", "payment", "login_url", "private_key"]


#: The added kinds as plain expressions, with their least lengths.
MORE = [
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0), ("code_host", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40), ("chat_host", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 15),
    ("payment", re.compile(r"[rs]k_live_[A-Za-z0-9]+"), 0, 24), ("login_url", re.compile(r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"), 0, 0),
]


def whole(pattern):
    return A.Rule("x", pattern, pattern, pattern)


def test_spans_of_all_kinds_equal_plain_expressions():
    rng = random.Random(8)
    parts = ["ghp_", "xoxb-", "rk_live_", "A1b2", "C3d4" * 9, "://me", ":pw", "@host", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "PRIVATE KEY", "token", "secret: ", "=", " ", "abc123", "0" * 24, "é", "\n", "AKIA", "-", "x" * 16]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)] + ["secret: token :abcdefg", "token=a secret=bcdefgh", "password passwd:''abcdef"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = S.find(S.automaton(), raw, np.array([0, len(raw)])).get(0, []) if len(raw) else []
        points = np.concatenate([[0], np.cumsum(K.code_points(raw))])
        want = sorted((m.start(), i, m.end()) for i, (_, r, g, least) in enumerate(BASE + MORE) for m in r.finditer(text) if len(m[g]) >= least)
        assert [(points[s], i, points[e]) for s, i, e in got] == want, text


def test_automaton_is_minimal_and_agrees_with_expressions():
    auto = A.compile_rules([whole(A.seq(A.lit("ab"), A.repeat(A.chars(b"c"), 2, 3), A.lit("d"))), whole(A.alt(A.lit("xyz"), A.lit("xz")))])
    expression = re.compile(rb"abcc{1,2}d|xyz|xz")
    rng = random.Random(2)
    for _ in range(500):
        text = bytes(rng.choice(b"abcdxyz ") for _ in range(rng.randint(1, 30)))
        raw = np.frombuffer(text, np.uint8)
        hit = A.scan(auto, raw, np.array([0]), np.array([len(raw)]))[0]
        assert hit == bool(expression.search(text))
        found = sorted(x for r in auto.rules for x in A.spans(auto, r, auto.klass[raw]))
        assert found == [m.span() for m in expression.finditer(text)]
    small = A.compile_rules([whole(A.alt(A.lit("cat"), A.lit("bat"), A.lit("rat")))])
    assert small.states == 4  # nothing, first letter, "a", found


def test_compiling_is_quick():
    import time

    start = time.perf_counter()
    auto = S.automaton.__wrapped__()
    assert time.perf_counter() - start < 5 and auto.states < 2000


def test_registered_query(spark):
    """Every column of the contract, over the whole table."""
    import hashlib

    path = "/root/testdata/sf0.01"
    out = S.op1(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    want = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        found = brute(r.text)
        base = ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in found)
        want[r.doc_id] = (*(sum(i == k for _, i, _ in found) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), base)
    got = {r.doc_id: r for r in out.collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == {k: v[:4] for k, v in want.items()}
    for k, r in got.items():
        assert ",".join(x for x in r.spans.split(",") if x.split(":")[0] in S.BASE) == want[k][4]
    assert sum(len(v[4]) > 0 for v in want.values()) > 3


def test_lanes_never_cut_a_match():
    raw = np.frombuffer(b" password = " * 500, np.uint8)
    starts, ends = A.lanes(S.automaton(), raw, np.array([0, len(raw)]), 64)
    assert not any(raw[a - 9 : a].tobytes().endswith((b"password", b"password ", b"= ")) for a in starts[1:])
    words = np.frombuffer(b"plain words without any mark " * 500, np.uint8)
    starts, ends = A.lanes(S.automaton(), words, np.array([0, len(words)]), 64)
    assert len(starts) > 150 and ends[-1] == len(words)


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_documents(spark, clash):
    df = helpers.awkward(spark, clash)
    assert S.scan_secrets(df).count() == df.count()
    kept = S.redact_secrets(df)
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert S.scan_secrets(helpers.empty(spark)).count() == 0 and S.redact_secrets(helpers.empty(spark)).count() == 0


def test_redaction_joins_overlapping_spans(spark):
    df = spark.createDataFrame([("k token=0123456789abcdef01234567, ok",)], "text string")
    assert S.redact_secrets(df).first().text == "k [SECRET], ok"


def test_chunks_cover_slices():
    batch = pa.record_batch([pa.array(["ab", None, "cdé", "", "f"])], names=["t"]).slice(1, 4)
    got = [raw[offs[i] : offs[i + 1]].tobytes().decode() for _, raw, offs in K.chunks(iter([batch]), "t", 2) for i in range(len(offs) - 1)]
    assert got == ["", "cdé", "", "f"]
