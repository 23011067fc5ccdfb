from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from lodestone.llm import quality_model as M
from lodestone.llm import quality_rules as Q
from lodestone.llm import toxicity as T
from lodestone.llm import text as K

from . import helpers


def brute_counts(text):
    text = text or ""
    w = helpers.WORD.findall(text)
    with_word = [x for x in text.split("\n") if helpers.WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(with_word) - len(set(with_word)), len(covered), failed


def made():
    rng = random.Random(3)
    parts = ["a", "b c d", "the end.", "\n", "\n\n", " ", "é", "| x |", "#", "\x1f", "\x0b", "ü 漢", "a b a b a b a b a b a b a b"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [None, "", "\n", "x " * 3000]


def test_base_counts_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(made())), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.apply_rules(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(made())}


def verdict(spark, text):
    return Q.apply_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_line_rules(spark):
    clean = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) + "." for i in range(4))
    assert verdict(spark, clean).kept and verdict(spark, clean).cleaned == clean
    noisy = "home | about | news | login | help\n" + clean + "\nAll rights reserved."
    r = verdict(spark, noisy)
    assert r.kept and r.lost_lines == 2 and r.cleaned == clean + "\n"
    menu = "\n".join(" | ".join(f"item{i}{j}" for j in range(8)) for i in range(6)) + "\n" + clean.split("\n")[0]
    assert not verdict(spark, menu).base_failed and not verdict(spark, menu).kept
    items = "\n".join(f"thing number {i} of list" for i in range(9))
    assert not verdict(spark, items).kept


def test_clean_labelled_documents_are_kept(spark):
    path = "/root/testdata/sf0.01"
    out = Q.op5(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    good, bad = out.where("quality = 1 and not base_failed"), out.where("quality = 0 and not base_failed")
    assert good.where("kept").count() == good.count()
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_discriminant_solves_gaussians():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (4000, 3)), rng.normal([2, 0, 0], [1, 3, 1], (4000, 3))])
    y = np.repeat([0, 1], 4000)
    n, sums, cross = np.array([4000, 4000]), np.array([x[y == c].sum(0) for c in (0, 1)]), np.array([x[y == c].T @ x[y == c] for c in (0, 1)])
    assert ((M.solve(n, sums, cross).score(x) >= 0.5) == y).mean() > 0.88
    assert M.solve(np.array([0, 3]), sums, cross).score(x[:2]).tolist() == [1, 1]
    assert M.solve(np.array([0, 0]), sums, cross).score(x[:2]).tolist() == [0.5, 0.5]


@pytest.mark.parametrize(("query", "label", "least"), [(M.op10, "quality", 0.97), (T.op6, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    path = "/root/testdata/sf0.01"
    out = query(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert out.count() == docs.count()
    held = out.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in held]) >= least
    assert all(0 <= r.score <= 1 for r in held)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(7)
    weights = {"idiot": 1.0, "trash": 1.0, "scum": 1.0, "wort*": 0.5, "loser": 1.0}
    m = T.build_matcher(weights)
    words = ["".join(rng.choice("idiotrashlsecumwé1") for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    words += ["idiot", "idot", "idiiot", "jdiot", "worthy", "wor", "tras", "lozer", "scu", "scam", "xtrash", "trashxx"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    low, starts, ends, _, _ = T.code_words(raw, np.array([0, len(raw)]))
    got = {int(w): (m.terms[m.found[s] - 1], int(m.fuzzy[s])) for w, s in zip(*m.match(low, starts, ends), strict=True)}
    for i, w in enumerate(words):
        near = sorted((distance(w, t), t) for t in ("idiot", "trash", "loser") if distance(w, t) <= 1)
        if w.startswith("wort"):
            assert got[i] == ("wort*", 0)
        elif w == "scum":
            assert got[i] == ("scum", 0)
        elif near:
            assert got[i][1] == near[0][0]
        else:
            assert i not in got


def score(texts, **ordinary):
    m = T.build_matcher({"moron": 1.0, "idiot": 1.0}, lexicon=T.Lexicon(), ordinary=frozenset(ordinary.get("ordinary", ())))
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    total, _, n = T.evidence(m, raw, offs)
    return total, T.score_of(m, total, n)


def test_context_separates_quotation_from_abuse():
    total, s = score(["you are a moron now.", "it was a moron now.", 'he said "moron" once.', "a m0ron came.", "nothing here.", ""])
    assert total[0] > total[1] > total[3] > total[2] > total[4] == total[5] == 0
    assert s[0] > 0.7 and s[1] > 0.7 and s[2] < 0.7 and s[4] < 0.1 and s[5] < 0.1
    assert score(["a moran came."], ordinary=["moran"])[0][0] == 0


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_documents(spark, clash):
    df = helpers.awkward(spark, clash)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (3, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    n = df.count()
    assert Q.apply_rules(df).count() == n and Q.apply_rules(helpers.empty(spark)).count() == 0
    from lodestone.llm import labelled
    from pyspark.sql import functions as F

    for lab in (labels, labels.limit(0)):
        m = T.fitted(spark, df, lab)
        assert T.score_documents(df, m).count() == n and T.score_documents(helpers.empty(spark), m).count() == 0
        assert T.keep_clean(df, m).columns == df.columns and T.keep_clean(df, m).count() == n
        rows = labelled.sample(df, lab, "quality", F.lit(True), 100, "doc_id", "text")
        model = M.fit_model(rows)
        assert M.score_documents(df, model).count() == n and M.score_documents(helpers.empty(spark), model).count() == 0


def test_words_of_long_buffers_hash_alike():
    text = ("alpha beta gamma " * 20_000).encode()
    raw = np.frombuffer(text, np.uint8)
    starts, ends, _ = K.words(raw, np.array([0, len(raw)]))
    assert len(np.unique(K.span_hashes(raw, starts, ends))) == 3
    both = np.frombuffer(b"Abc abc", np.uint8)
    s, e, _ = K.words(both, np.array([0, 7]))
    assert len(np.unique(K.span_hashes(both, s, e))) == 2 and len(np.unique(K.span_hashes(both, s, e, lower=True))) == 1


def plain_evidence(weights, text):
    """Evidence of one text from the definition alone, by edit distances and string search."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    trimmed = []
    for a, b in words:
        solid = [i for i in range(a, b) if text[i].isalnum()]
        if solid:
            trimmed.append((solid[0], solid[-1] + 1))
    low, total, hits = text.lower(), 0.0, 0
    for i, (a, b) in enumerate(trimmed):
        near = sorted((distance(low[a:b], t), t) for t in weights)
        edits, term = near[0] if near else (9, "")
        if edits > (1 if len(term) >= 5 else 0):
            continue
        at = range(max(0, i - 6), min(len(trimmed), i + 7))
        around = {low[x:y] for j, (x, y) in enumerate(trimmed) if j in at and j != i and y - x <= 12}
        left, right = text[max(0, trimmed[at[0]][0] - 2) : a], text[b : trimmed[at[-1]][1] + 2]
        marks = all(any(q in side for q in T.QUOTES if q != "'") for side in (left, right))
        factor = 1.3 if around & T.SECOND_PERSON else 0.3 if marks or around & T.REPORTING else 1.0
        hits += 1
        total += weights[term] * (0.7 if edits else 1.0) * factor
    return total, hits, len(trimmed)


def test_evidence_equals_plain_python():
    weights = {"moron": 1.0, "idiot": 0.5, "scum": 0.25}
    rng, m = random.Random(12), T.build_matcher(weights)
    parts = ["moron", "Moron,", "idjot", "idiott", "scum", "scun", "you", "said", "wrote", '"', "“moron”", "'idiot'", "plain", "words", "of", "text", "a", "...", "é", "moron.", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    total, hits, n = T.evidence(m, raw, np.cumsum([0] + [len(t.encode()) for t in texts]))
    for i, t in enumerate(texts):
        want = plain_evidence(weights, t)
        assert (hits[i], n[i]) == want[1:] and total[i] == pytest.approx(want[0]), t


def plain_statistics(text):
    """The classifier's statistics from their definitions."""
    words = helpers.WORD.findall(text)
    n, body = len(words), max(1, len(re.sub("[\x20\x09-\x0d]", "", text)))
    lines = [x for x in text.split("\n") if x]
    share = lambda allowed: sum(c in allowed for c in text) / (body + 100)
    letters = sum(c.isascii() and c.isalpha() for c in text) + sum(0xC3 <= b <= 0xF4 for b in text.encode()) + 100
    windows = [tuple(words[i : i + 4]) for i in range(n - 3)]
    ends = lambda x: x[-1] in ".!?:;\"')]" if x[-1].isascii() else not x[-1].isalnum()
    size = lambda w: len(w.encode())
    root, log = np.sqrt, np.log
    return [
        log(1 + n), log((body + 100) / (n + 20)), root(share("#*$%&|<>")), root(sum("A" <= c <= "Z" for c in text) / letters), root(share("0123456789")), root(share("!")), root(share(".,;:?!\"'()-")), root((len(windows) - len(set(windows))) / (n + 20)),
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n + 20)), log(len(set(words)) + 20) - 0.85 * log(n + 20), root((len(lines) - len(set(lines))) / (len(lines) + 4)), root(sum(not ends(x) for x in lines) / (len(lines) + 4)),
        log(1 + n / (len(lines) + 4)), root(sum(size(w) >= 14 for w in words) / (n + 20)), root(sum(size(w) <= 2 for w in words) / (n + 20)),
    ]


def test_statistics_equal_plain_python():
    texts = [t for t in made() if t is not None][:400] + ["One two three. Four!\nOne two three. Four!\n\n1234 UPPER lower extraordinarily-long-word é” 漢"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = M.statistics(raw, np.cumsum([0] + [len(t.encode()) for t in texts]))
    assert got.shape[1] == len(M.STATISTICS)
    for row, t in zip(got, texts, strict=True):
        assert row == pytest.approx(plain_statistics(t), abs=1e-9), t


def test_sample_is_bounded_in_rows(spark):
    from lodestone.llm import labelled
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", F.lit(True), 10, "doc_id", "text").collect()
    assert len(rows) == 3 and sum(r["__label"] for r in rows) == 1


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_documents_have_their_values(spark, clash):
    """Nulls, empty and very long texts, repeated rows: what each gives."""
    df = helpers.awkward(spark, clash)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.base_failed, r.cleaned is None) for r in Q.apply_rules(df).collect())
    want = sorted((str(r[0]), *(brute_counts(r[1])[:2]), brute_counts(r[1])[5], r[1] is None) for r in helpers.AWKWARD)
    assert got == want
    m = T.build_matcher({"long7": 1.0})
    scores = {(str(r.doc_id), r.hits): r.score for r in T.score_documents(df, m).collect()}
    assert scores["3", 0] == scores["4", 0] == scores["5", 0] and max(h for d, h in scores if d == "10") > 40 and all(0 <= s <= 1 for s in scores.values())
    flat = M.Model(None, None, None, 0.25)
    assert {r.score for r in M.score_documents(df, flat).collect()} == {0.25}


def hit_words(m, words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    low, starts, ends, _, _ = T.code_words(raw, np.array([0, len(raw)]))
    return {words[w]: int(m.fuzzy[s]) for w, s in zip(*m.match(low, starts, ends), strict=True)}


def test_a_stem_does_not_replace_its_words(spark):
    toxic = [f"what an idiot number{i}" for i in range(60)] + ["all are idiots here", "some idiott came"]
    clean = [f"plain words of text {i}" for i in range(200)]
    m = T.learn(spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "__text string, __label int"))
    assert "idiot" in m.terms and any(t.endswith("*") and "idiot".startswith(t[:-1]) for t in m.terms)
    assert hit_words(m, ["idiot", "idiots", "idjot", "jdiot", "iddiot", "idolt", "plain"]) == {"idiot": 0, "idiots": 0, "idjot": 1, "jdiot": 1, "iddiot": 1}


def test_terms_of_every_script_are_found():
    m = T.build_matcher({"멍청이바보": 1.0, "ばか*": 1.0, "🤡🤡🤡": 1.0, "笨蛋": 1.0, "idiot": 1.0})
    assert hit_words(m, ["멍청이바보", "멍청이바", "멍청이한보", "ばかやろう", "🤡🤡🤡", "笨蛋", "笨人", "漢字", "idi漢t"]) == {
        "멍청이바보": 0, "멍청이바": 1, "멍청이한보": 1, "ばかやろう": 0, "🤡🤡🤡": 0, "笨蛋": 0, "idi漢t": 1,
    }


def test_the_curve_counts_every_row(spark, monkeypatch):
    total, n, y, times = np.array([0.0, 0.9, 0.0]), np.array([5.0, 9.0, 40.0]), np.array([0.0, 1.0, 1.0]), np.array([2500.0, 40.0, 300.0])
    again = [np.repeat(a, times.astype(int)) for a in (total, n, y)]
    assert np.allclose(T.fit_curve(total, n, y, times), T.fit_curve(*again, np.ones(len(again[0]))), atol=1e-4)
    seen = []
    real = T.fit_curve
    monkeypatch.setattr(T, "fit_curve", lambda *a: seen.append(a) or real(*a))
    rows = [("plain and short", 0)] * 3000 + [(f"you idiot number{i}", 1) for i in range(30)]
    T.learn(spark.createDataFrame(rows, "__text string, __label int"))
    assert seen[0][3].sum() == 3030
