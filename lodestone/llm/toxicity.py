"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learned from labelled training rows: words and word stems whose document frequency is
tied to the label (log-likelihood ratio and purity over both classes). Its trie, intersected with the
automaton of words within ``max_edits`` edits, becomes one deterministic automaton by subset
construction; all words of a batch run through its transition array in lockstep. Misspellings that
also occur in clean training texts are ordinary words and are left out. Each hit weighs by its term's
log odds, less when misspelt, and by a window of words around it: quotation marks or reporting verbs
without a second person lower it, a second person raises it. The score is a logistic function of the
summed evidence, its density and the text's length, fitted on the same rows with a pull to ``PRIOR``.

Bounds: at most ``Lexicon.most`` labelled ids of each class and ``Lexicon.terms`` terms besides the words
under its stems, ``4 * Lexicon.terms`` in all; never held-out rows. A stem adds to its words: each word that
tells enough by itself is searched with its misspellings, whether or not a stem of it is a term. Scoring is
one pass over whole texts without a shuffle. Nulls: a null text is empty, a null id is carried along with a
null ``held_out``. Repeated rows are scored alike; an empty table gives none; without labels the lexicon is
empty and all scores are the same low one. Ties between terms are broken by length and spelling. Very long texts are a chunk of their
own, in memory whole. Other columns, of whatever name, are not read (``keep_clean`` returns them).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from . import text as K
from .state import scratch, written

#: Words that report speech, and second persons.
REPORTING = {"said", "says", "called", "wrote", "quoted", "quote", "term", "word", "phrase", "dit", "sagte", "dijo", "zitat", "citation", "cita"}
SECOND_PERSON = {"you", "your", "you're", "youre", "ur", "du", "dich", "dein", "tu", "te", "toi", "ton", "eres"}
QUOTES = "\"'“”‘’«»„"
#: Coefficients without data: constant, evidence in pure hits, density, log of the length.
PRIOR = (-4.0, 4.0, 1.0, 0.0)
PURE = 7.0  # log odds of a term as good as never seen in clean texts


@dataclass(frozen=True)
class Lexicon:
    most: int = 10_000
    terms: int = 2_000
    least: int = 4
    likelihood: float = 20.0
    impurity: float = 0.15
    stems: tuple[int, int] = (4, 8)
    max_edits: int = 1
    fuzzy_length: int = 5
    fuzzy_weight: float = 0.7
    window: int = 6
    quoted: float = 0.3
    addressed: float = 1.3


_TOP = 0x3000
_LOWERED = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(_TOP)], np.uint32)
_ALNUM = np.array([chr(i).isalnum() for i in range(_TOP)] + [True])
_BLANK = np.array([chr(i).isspace() for i in range(_TOP)] + [False])
_BLANK[_TOP - 1] = False


def code_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of a chunk, starts and ends of its words without outer punctuation, each
    document's first word, and the documents' offsets in code points."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    count = np.concatenate([[0], np.cumsum(K.code_points(raw))])
    offs = count[offs]
    low = np.minimum(points, _TOP)
    starts, ends = K.runs(~_BLANK[low], offs)
    solid = np.flatnonzero(_ALNUM[low])  # trim: to the first and past the last alphanumeric of each word
    if len(solid) and len(starts):
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        good = (a < len(solid)) & (b >= a)
        starts, ends = solid[np.minimum(a, len(solid) - 1)][good], solid[b][good] + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    lowered = np.where(points < _TOP, _LOWERED[np.minimum(points, _TOP - 1)], points)
    return lowered, starts, ends, np.searchsorted(starts, offs), offs


def spell(lowered: np.ndarray, a: int, b: int) -> str:
    return lowered[a:b].astype("<u4").tobytes().decode("utf-32-le")


@dataclass(frozen=True)
class Matcher:
    """``table[state, symbol]``; state 0 is dead, 1 the start; ``found[state]``: term number + 1, ``fuzzy[state]`` its edits."""

    table: np.ndarray
    symbol: np.ndarray
    far: np.ndarray  # the lexicon's letters from ``_TOP`` on, sorted, and their symbols
    far_symbol: np.ndarray
    found: np.ndarray
    fuzzy: np.ndarray
    final: np.ndarray
    terms: tuple[str, ...]
    weights: np.ndarray
    curve: tuple[float, ...]
    ordinary: frozenset
    lexicon: Lexicon

    def match(self, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, states): the words that end in, or pass through, an accepting state."""
        symbols = self.symbol[np.minimum(lowered, _TOP)]
        if len(self.far):
            high = np.flatnonzero(lowered >= _TOP)
            at = np.minimum(np.searchsorted(self.far, lowered[high]), len(self.far) - 1)
            symbols[high] = np.where(self.far[at] == lowered[high], self.far_symbol[at], symbols[high])
        live, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        got_word, got_state = [], []
        depth = 0
        while len(live):
            state = self.table[state, symbols[starts[live] + depth]]
            depth += 1
            done = self.final[state] | (starts[live] + depth >= ends[live])
            hit = done & (self.found[state] > 0)
            got_word.append(live[hit])
            got_state.append(state[hit])
            stay = ~done & (state > 0)
            live, state = live[stay], state[stay]
        if not got_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        words, states = np.concatenate(got_word), np.concatenate(got_state)
        order = np.argsort(words, kind="stable")
        return words[order], states[order]


def build_matcher(weights: dict[str, float], curve: tuple[float, ...] = PRIOR, ordinary: frozenset = frozenset(), lexicon: Lexicon = Lexicon()) -> Matcher:
    """The lexicon trie (a term ending in ``*`` is a stem) intersected with Levenshtein automata of its longer words."""
    terms = sorted(weights)
    child: list[dict[str, int]] = [{}, {}]  # node 0: all terms as they are; node 1: terms that may be misspelt
    word: list[int] = [0, 0]
    stem: list[int] = [0, 0]

    def add(root: int, text: str, number: int, is_stem: bool) -> None:
        at = root
        for c in text:
            if c not in child[at]:
                child[at][c] = len(child)
                child.append({})
                word.append(0)
                stem.append(0)
            at = child[at][c]
        (stem if is_stem else word)[at] = number

    for i, t in enumerate(terms):
        add(0, t.rstrip("*"), i + 1, t.endswith("*"))
        if not t.endswith("*") and len(t) >= lexicon.fuzzy_length and lexicon.max_edits:
            add(1, t, i + 1, False)

    letters = sorted({c for kids in child for c in kids})
    symbol = np.zeros(_TOP + 1, np.int32)
    for i, c in enumerate(letters):
        if ord(c) < _TOP:
            symbol[ord(c)] = i + 1
    far = [c for c in letters if ord(c) >= _TOP]
    symbol_of = {c: i + 1 for i, c in enumerate(letters)}
    most = lexicon.max_edits

    def closed(items: set[tuple[int, int]]) -> frozenset:
        """Adds deletions, and leaves only the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = sorted(items, key=lambda x: x[1])
        while todo:
            node, edits = todo.pop()
            if best.get(node, 99) <= edits:
                continue
            best[node] = edits
            if edits < most and node in fuzzy_nodes:
                todo += [(k, edits + 1) for k in child[node].values()]
        return frozenset(best.items())

    fuzzy_nodes, todo = set(), [1]
    while todo:
        node = todo.pop()
        fuzzy_nodes.add(node)
        todo += child[node].values()

    def step(here: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, edits in here:
            if c in child[node]:
                out.add((child[node][c], edits))
            if edits < most and node in fuzzy_nodes:
                out.add((node, edits + 1))
                out |= {(k, edits + 1) for k in child[node].values()}
        return closed(out)

    start = closed({(0, 0), (1, 0)})
    index, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
    found, fuzzy, final = [], [], []
    at = 0
    while at < len(order):
        here = order[at]
        at += 1
        through = [stem[n] for n, e in here if stem[n] and e == 0]
        ended = sorted((e, word[n]) for n, e in here if word[n])
        final.append(bool(through))
        found.append(through[0] if through else ended[0][1] if ended else 0)
        fuzzy.append(0 if through or not ended else ended[0][0])
        row = np.zeros(len(letters) + 1, np.int32)
        for c in [None, *sorted({c for n, _ in here for c in child[n]})] if not through else []:  # all others act as no letter of the lexicon
            to = step(here, c)
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row[symbol_of[c] if c else slice(None)] = index[to]
        table.append(row)
    return Matcher(np.array(table, np.int32), symbol, np.array([ord(c) for c in far], np.uint32), np.array([symbol_of[c] for c in far], np.int32), np.array(found), np.array(fuzzy), np.array(final), tuple(terms), np.array([0.0] + [weights[t] for t in terms]), curve, ordinary, lexicon)


def _context(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: int, lo: int, hi: int, bounds: tuple[int, int], lexicon: Lexicon) -> float:
    """Factor of a hit from the words around it and the marks at its sides."""
    a, b = max(lo, word - lexicon.window), min(hi, word + lexicon.window + 1)
    around = {spell(lowered, int(starts[i]), int(ends[i])) for i in range(a, b) if i != word and ends[i] - starts[i] <= 12}
    left = spell(lowered, max(bounds[0], int(starts[a]) - 2), int(starts[word]))
    right = spell(lowered, int(ends[word]), min(bounds[1], int(ends[b - 1]) + 2))
    if around & SECOND_PERSON:
        return lexicon.addressed
    marks = any(q in left for q in QUOTES if q != "'") and any(q in right for q in QUOTES if q != "'")
    return lexicon.quoted if marks or around & REPORTING else 1.0


def evidence(m: Matcher, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence in pure hits, number of hits, number of words) of each document of a chunk."""
    lowered, starts, ends, first, bounds = code_words(raw, offs)
    total, hits = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
    if len(m.terms):
        words, states = m.match(lowered, starts, ends)
        docs = np.searchsorted(first, words, "right") - 1
        for word, state, doc in zip(words.tolist(), states.tolist(), docs.tolist(), strict=True):
            weight = m.weights[m.found[state]]
            if m.fuzzy[state]:
                if spell(lowered, int(starts[word]), int(ends[word])) in m.ordinary:
                    continue
                weight *= m.lexicon.fuzzy_weight
            hits[doc] += 1
            total[doc] += weight * _context(lowered, starts, ends, word, int(first[doc]), int(first[doc + 1]), (int(bounds[doc]), int(bounds[doc + 1])), m.lexicon)
    return total, hits, np.diff(first)


def _terms_of(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.minimum(total, 10), np.log1p(100 * total / (n_words + 30)), np.log1p(n_words) * (total > 0)])


def score_of(m: Matcher, total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(_terms_of(total, n_words) @ np.array(m.curve), -500, 500))), 9)


def fit_curve(total: np.ndarray, n_words: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, ...]:
    """Logistic coefficients by damped Newton steps, with a quadratic pull of weight 1 to ``PRIOR``; each row counts ``times``."""
    x, prior = _terms_of(total, n_words), np.array(PRIOR)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(times @ (np.logaddexp(0, z) - y * z) + ((b - prior) ** 2).sum() / 2)

    beta, now = prior.copy(), loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.eye(len(beta)), x.T @ (times * (p - y)) + beta - prior)
        size = 1.0
        while size > 1e-10 and loss(beta - size * step) > now:
            size /= 2
        beta, before, now = beta - size * step, now, loss(beta - size * step)
        if before - now <= 1e-9 * max(1.0, now):
            break
    return tuple(np.round(beta, 9).tolist())


def learn(rows: DataFrame, lexicon: Lexicon = Lexicon()) -> Matcher:
    """Learns the lexicon from (__text, __label) rows: a bounded sample, so its counts are bounded too."""
    lo, hi = lexicon.stems

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            lowered, starts, ends, first, _ = code_words(raw, offs)
            text = lowered.astype("<u4").tobytes().decode("utf-32-le")
            counts: tuple[Counter, Counter] = (Counter({"": 0}), Counter({"": 0}))
            for doc, label in enumerate(batch.column(1).to_pylist()):
                a, b = first[doc], first[doc + 1]
                found = {text[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True) if 2 < e - s <= 40}
                stems = {w[:n] + "*" for w in found for n in range(lo, min(hi, len(w) - 1) + 1)}
                counts[label].update(found | stems)
                counts[label][""] += 1
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    counted = written(rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    whole = counted.where("term = ''").first()
    if not whole or not whole.pos or not whole.neg:
        return build_matcher({}, PRIOR, frozenset(), lexicon)
    n_pos, n_neg = whole.pos, whole.neg
    share = (F.col("pos") + F.col("neg")) / F.lit(float(n_pos + n_neg))
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (part(F.col("pos"), share * n_pos) + part(F.col("neg"), share * n_neg))
    rates = (F.col("neg") / n_neg) / (F.col("pos") / n_pos)
    best = counted.where((F.col("term") != "") & (F.col("pos") >= lexicon.least)).withColumn("ratio", ratio).where((F.col("ratio") >= lexicon.likelihood) & (rates <= lexicon.impurity))
    picked = {r.term: (r.pos, r.neg, r.ratio) for r in best.orderBy(F.desc("ratio"), "term").limit(4 * lexicon.terms).collect()}  # bounded by the parameter

    def weight(t: str) -> float:
        pos, neg, _ = picked[t]
        return round((max(0.0, min(PURE, math.log(pos / n_pos / ((neg + 0.5) / n_neg)))) / PURE) ** 1.5, 6)  # above 1: many weak hits are no strong one

    kept: dict[str, float] = {}
    words: dict[str, str] = {}  # words under a kept stem, which stay open to misspelling, and that stem
    for t in sorted(picked, key=lambda t: (-picked[t][2], t.endswith("*"), -len(t), t)):
        body = t.rstrip("*")
        over = next((body[:n] + "*" for n in range(lo, len(body) + 1) if body[:n] + "*" in kept), None)
        if over and not t.endswith("*"):
            words[t] = over
        if over or t.endswith("*") and any(x.startswith(body) for x in kept):
            continue  # of nested terms, the one that tells most about the label
        kept[t] = weight(t)
    kept = {t: w for t, w in list(kept.items())[: lexicon.terms] if w > 0}
    kept |= {t: w for t, stem in words.items() if stem in kept and (w := weight(t)) > 0}

    rough = build_matcher(kept, PRIOR, frozenset(), lexicon)
    near = frozenset()
    if rough.fuzzy.any():

        def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, raw, offs in K.chunks(batches, "term"):
                lowered, starts, ends, _, _ = code_words(raw, offs)
                words, states = rough.match(lowered, starts, ends)
                yield pa.record_batch([pa.array([spell(lowered, int(starts[w]), int(ends[w])) for w, s in zip(words, states, strict=True) if rough.fuzzy[s]], pa.string())], names=["term"])

        near = frozenset(r.term for r in counted.where("neg > 0 and term != '' and term not like '%*'").select("term").mapInArrow(ordinary, "term string").distinct().collect())  # near a lexicon of bounded size, from a bounded sample
    rough = build_matcher(kept, PRIOR, near, lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            total, _, n_words = evidence(rough, raw, offs)
            yield pa.record_batch([pa.array(total), pa.array(n_words), batch.column(1)], names=["total", "n_words", "label"])

    x = rows.mapInArrow(measured, "total double, n_words long, label int").groupBy("total", "n_words", "label").count().collect()  # of the bounded sample
    return build_matcher(kept, fit_curve(*np.array([tuple(r) for r in sorted(x)], float).T), near, lexicon)


def score_documents(docs: DataFrame, matcher: Matcher, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` and ``hits`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, "__text"):
            total, hits, n_words = evidence(matcher, raw, offs)
            yield pa.record_batch([batch.column(0), pa.array(score_of(matcher, total, n_words)), pa.array(hits)], names=[id_col, "score", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, score double, hits long")


def keep_clean(docs: DataFrame, matcher: Matcher, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in K.chunks(batches, text_col):
            total, _, n_words = evidence(matcher, raw, offs)
            yield batch.filter(pa.array(score_of(matcher, total, n_words) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fitted(spark, docs: DataFrame, labels: DataFrame, lexicon: Lexicon = Lexicon()) -> Matcher:
    """Learns from the training rows of the contract: crc32 of the id modulo 3 is not 1."""
    with scratch(spark):
        rows = written(labelled.sample(docs, labels, "toxic", labelled.remainder(F.col("__id"), 3) != 1, lexicon.most, "doc_id", "text"), "labelled")
        return learn(rows, lexicon)


def op6(spark, sf_dir: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Contract query: toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, fitted(spark, docs, labels, lexicon))
    return scored.select("doc_id", (labelled.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "hits")
