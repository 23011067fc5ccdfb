"""Deterministic automata as transition arrays, and a scanner that runs them over many texts in lockstep.

``Pattern`` objects are small regular expressions over bytes (built by ``lit``, ``chars``, ``seq``, ``alt`` and ``repeat``). Each
rule becomes deterministic by subset construction and minimal by partition refinement, once for searching (a match may start
anywhere) and once anchored. ``compile_rules`` joins the search automata of all rules in one: the pairs, triples, ... of their states
that can be reached, found by array operations, then minimised. ``scan`` reads each byte once: lanes of the buffer that
start where no match can be under way advance together, one table lookup for each byte. ``spans`` takes the starts and ends of a
rule's matches, leftmost and longest, from its anchored transition array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class Pattern:
    """Thompson fragment builder: ``build(nfa, into)`` adds states that lead to ``into`` and returns the entry."""

    def __init__(self, build):
        self.build = build


@dataclass
class _Nfa:
    eps: list[list[int]] = field(default_factory=list)
    step: list[tuple[frozenset, int] | None] = field(default_factory=list)

    finals: frozenset = frozenset()
    closures: dict[int, frozenset] = field(default_factory=dict)

    def new(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def closure(self, s: int) -> frozenset:
        """The states with a byte to read, or final ones, that ``s`` reaches without reading."""
        if s not in self.closures:
            seen, todo = {s}, [s]
            while todo:
                for t in self.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closures[s] = frozenset(t for t in seen if self.step[t] or t in self.finals)
        return self.closures[s]


def chars(allowed: bytes) -> Pattern:
    """One byte out of ``allowed``."""
    found = frozenset(allowed)

    def build(nfa: _Nfa, into: int) -> int:
        s = nfa.new()
        nfa.step[s] = (found, into)
        return s

    return Pattern(build)


def seq(*parts: Pattern) -> Pattern:
    def build(nfa: _Nfa, into: int) -> int:
        for p in reversed(parts):
            into = p.build(nfa, into)
        return into

    return Pattern(build)


def alt(*parts: Pattern) -> Pattern:
    def build(nfa: _Nfa, into: int) -> int:
        s = nfa.new()
        nfa.eps[s] = [p.build(nfa, into) for p in parts]
        return s

    return Pattern(build)


def repeat(part: Pattern, least: int, most: int | None) -> Pattern:
    """``least`` to ``most`` times; without ``most``, any number above."""

    def build(nfa: _Nfa, into: int) -> int:
        if most is None:
            loop = nfa.new()
            nfa.eps[loop] = [into, part.build(nfa, loop)]
            into = loop
        else:
            for _ in range(most - least):
                s = nfa.new()
                nfa.eps[s] = [into, part.build(nfa, into)]
                into = s
        for _ in range(least):
            into = part.build(nfa, into)
        return into

    return Pattern(build)


def lit(text: str, any_case: bool = False) -> Pattern:
    return seq(*(chars({c.lower().encode()[0], c.upper().encode()[0]} if any_case else c.encode()) for c in text))


@dataclass(frozen=True)
class Rule:
    """``search`` finds that a match is under way; ``match`` is the whole match, ``passes`` the part of its language that counts."""

    name: str
    search: Pattern
    match: Pattern
    passes: Pattern


@dataclass(frozen=True)
class Anchored:
    """A rule's own automaton: ``table[state * width + class]``; state 0 is dead, 1 the start."""

    name: str
    table: list[int]
    matched: list[bool]
    passes: list[bool]
    first: np.ndarray  # of each class: can begin a match


@dataclass(frozen=True)
class Automaton:
    """``table[state * width + klass[byte]]`` is the next state times ``width``; state ``accept`` is final.

    ``apart[a * width + b]``: after bytes of the classes a and b no match of any rule is under way."""

    table: np.ndarray
    klass: np.ndarray
    width: int
    accept: int
    apart: np.ndarray
    rules: tuple[Anchored, ...]
    states: int
    raw_states: int


def _subsets(nfa: _Nfa, start: frozenset, finals: frozenset, of_set: dict, width: int, anywhere: bool) -> tuple[np.ndarray, list[frozenset]]:
    """(transitions, NFA states of each state), state 0 dead; with ``anywhere``, matches begin at every byte and final states stay."""
    index, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
    for here in order:
        if anywhere and here & finals:
            table.append([len(table)] * width)
            continue
        to: list[set] = [set(start) if anywhere and here else set() for _ in range(width)]
        for s in here:
            if nfa.step[s]:
                allowed, into = nfa.step[s]
                reach = nfa.closure(into)
                for k in of_set[allowed]:
                    to[k] |= reach
        row = []
        for x in map(frozenset, to):
            if x not in index:
                index[x] = len(order)
                order.append(x)
            row.append(index[x])
        table.append(row)
    return np.array(table), order


def _minimal(delta: np.ndarray, kind: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Class of each state: states stay together while their kinds are equal and all their successors are together.

    A round compares rows by a 64-bit hash; a collision would only join states of one kind, and the result is checked in full."""
    part = np.unique(kind, return_inverse=True)[1]
    salt = rng.integers(1, 1 << 63, delta.shape[1] + 1, np.uint64) | np.uint64(1)
    while True:
        rows = part.astype(np.uint64) * salt[0]
        for k in range(delta.shape[1]):
            rows = (rows ^ (rows >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part[delta[:, k]].astype(np.uint64) * salt[k + 1]
        finer = np.unique(np.column_stack([part.astype(np.uint64), rows]).view([("p", np.uint64), ("r", np.uint64)]).reshape(-1), return_inverse=True)[1]
        if finer.max() == part.max():
            break
        part = finer
    lead = np.unique(part, return_index=True)[1]
    if (part[delta] != part[delta[lead]][part]).any():
        return _minimal(delta, kind, rng)
    return part


def compile_rules(rules: list[Rule]) -> Automaton:
    """One automaton that reaches ``accept`` where any rule's search pattern ends, and each rule's anchored one."""
    rng = np.random.default_rng(1)
    nfa = _Nfa()
    ends: list[tuple[int, int, int]] = []
    entries: list[tuple[int, int, int]] = []
    for rule in rules:
        here = nfa.new(), nfa.new(), nfa.new()
        ends.append(here)
        entries.append(tuple(p.build(nfa, e) for p, e in zip((rule.search, rule.match, rule.passes), here, strict=True)))
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    sign = np.zeros((256, len(sets)), bool)
    for j, x in enumerate(sets):
        sign[list(x), j] = True
    rows, klass = np.unique(sign, axis=0, return_inverse=True)
    width, klass = len(rows), klass.reshape(-1).astype(np.uint8)
    of_set = {x: np.flatnonzero(rows[:, j]).tolist() for j, x in enumerate(sets)}
    nfa.finals = frozenset(e for here in ends for e in here)

    anchored, searches = [], []
    for rule, (search, match, passes), here in zip(rules, entries, ends, strict=True):
        delta, order = _subsets(nfa, nfa.closure(search), frozenset(here[:1]), of_set, width, True)
        final = np.array([bool(x & {here[0]}) for x in order])
        searches.append(_renumbered(delta, final.astype(int), rng, start=1))
        delta, order = _subsets(nfa, nfa.closure(match) | nfa.closure(passes), frozenset(), of_set, width, False)
        kind = np.array([(here[1] in x) + 2 * (here[2] in x) + 4 * (not x) for x in order])
        small, kinds = _renumbered(delta, kind, rng, start=1, dead=0)
        anchored.append(Anchored(rule.name, small.reshape(-1).tolist(), (kinds & 1 > 0).tolist(), (kinds & 2 > 0).tolist(), small[1] != 0))

    # reachable combinations of the search states, one number each; any final one is the same state
    scale = np.cumprod([1, *(len(d) for d, _ in searches)])[:-1]
    start = int((np.array([1 if len(d) > 1 else 0 for d, _ in searches]) * scale).sum())
    known, rows_of, edge = np.array([start]), [], np.array([start])
    while len(edge):
        to, done = np.zeros((len(edge), width), np.int64), np.zeros((len(edge), width), bool)
        for (delta, final), step in zip(searches, scale, strict=True):
            state = delta[edge // step % len(delta)]
            to += state * step
            done |= final[state] > 0
        to[done] = -1
        rows_of.append((edge, to))
        edge = np.setdiff1d(to, np.append(known, -1))
        known = np.union1d(known, edge)
    codes = np.concatenate([e for e, _ in rows_of])
    place = np.argsort(codes)
    delta = np.searchsorted(codes[place], np.concatenate([t for _, t in rows_of])[place])
    final = len(codes)
    delta = np.vstack([np.where(np.concatenate([t for _, t in rows_of])[place] < 0, final, delta), np.full(width, final)])
    kind = np.append(np.zeros(final, int), 1)
    small, kinds = _renumbered(delta, kind, rng, start=int(np.searchsorted(codes[place], start)), first=0)
    return Automaton((small * width).astype(np.int32).reshape(-1), klass, width, int(np.flatnonzero(kinds)[0]), _apart(anchored, width), tuple(anchored), len(small), final + 1)


def _renumbered(delta: np.ndarray, kind: np.ndarray, rng: np.random.Generator, start: int, dead: int | None = None, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, kind) of the minimal automaton; the start is state ``first``, the dead state, if any, state 0."""
    part = _minimal(delta, kind, rng)
    lead = np.unique(part, return_index=True)[1]
    rank = np.full(len(lead), 2)
    rank[part[start]] = first
    if dead is not None:
        rank[part[dead]] = 0
    elif first == 1:  # search automata are never dead: their start is state 1 behind an unused state 0
        rank[part[0]] = 0 if part[0] != part[start] else 1
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[part[delta[lead]]][order], kind[lead][order]


def _apart(rules: list[Anchored], width: int) -> np.ndarray:
    """Of each pair of classes: whatever was under way before, nothing is after them."""
    live = np.zeros((width, width), bool)
    for rule in rules:
        table = np.array(rule.table).reshape(-1, width)
        live |= (table[table] != 0).any(axis=0)  # state, first class, second class
        live |= rule.first[None, :]
    return ~live.reshape(-1)


def lanes(auto: Automaton, raw: np.ndarray, offs: np.ndarray, length: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Cuts documents into lanes of about ``length`` bytes, only after two bytes that no match goes on over."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = auto.klass[raw].astype(np.int32)
    cuts = np.flatnonzero(auto.apart[kinds[:-1] * auto.width + kinds[1:]]) + 2
    docs = offs[:-1][np.diff(offs) > 0]
    if len(cuts):
        k = np.searchsorted(cuts, np.arange(length, len(raw), length))
        docs = np.concatenate([docs, cuts[np.unique(k[k < len(cuts)])]])
    starts = np.unique(docs)
    starts = starts[starts < len(raw)]
    return starts, np.append(starts[1:], len(raw))


def spans(auto: Automaton, rule: Anchored, symbols: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the rule's matches that pass: leftmost, longest, not overlapping; those that fail use up their bytes as well."""
    out, done, table, width, kinds = [], 0, rule.table, auto.width, symbols.tolist()
    for at in np.flatnonzero(rule.first[symbols]).tolist():
        if at < done:
            continue
        state, end, passes = 1, -1, False
        for i in range(at, len(kinds)):
            state = table[state * width + kinds[i]]
            if not state:
                break
            if rule.matched[state]:
                end, passes = i + 1, rule.passes[state]
        if end >= 0:
            done = end
            if passes:
                out.append((at, end))
    return out


def scan(auto: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 64) -> np.ndarray:
    """Whether each lane reaches the final state; every byte is looked up once."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    begin, size = starts[order], size[order]
    symbols = auto.klass[raw]
    state = np.zeros(len(order), np.int32)
    longest = int(size[0]) if len(size) else 0
    for at in range(0, longest, block):
        live = int(np.searchsorted(-size, -at, "left"))  # lanes longer than at
        if live < 8:  # a few very long lanes: bounds the cost of narrow steps
            for lane in range(live):
                state[lane] = _walk(auto, symbols[begin[lane] + at : begin[lane] + size[lane]], int(state[lane]))
            break
        deep = min(block, longest - at)
        where = begin[:live, None] + np.arange(at, at + deep)
        np.minimum(where, len(raw) - 1, out=where)
        part = symbols[where].T
        for j in range(deep):
            n = live if j == 0 else int(np.searchsorted(-size[:live], -(at + j), "left"))
            if not n:
                break
            state[:n] = auto.table[state[:n] + part[j, :n]]
    out = np.empty(len(order), bool)
    out[order] = state == auto.accept * auto.width
    return out


def _walk(auto: Automaton, symbols: np.ndarray, state: int) -> int:
    final = auto.accept * auto.width
    for at in range(0, len(symbols), 65536):
        table = _lists(auto)
        for c in symbols[at : at + 65536].tolist():
            state = table[state + c]
            if state == final:
                return state
    return state


_LISTS: dict[int, list[int]] = {}


def _lists(auto: Automaton) -> list[int]:
    if id(auto) not in _LISTS:
        _LISTS.clear()
        _LISTS[id(auto)] = auto.table.tolist()
    return _LISTS[id(auto)]
