"""Runs of words that texts share with a set of quotes: a suffix automaton over all quotes, by which a text is read once.

A state stands for runs of words that end at the same places of the quotes; its link leads to the longest run at its end that ends at more
places. Reading a text keeps the longest run of any quote that ends at the word just read; afterwards each state that was reached, and those its links
lead to, tell which quotes have such a run, and how long it is.
"""

from __future__ import annotations

from collections.abc import Iterable


class RunFinder:
    """Longest common runs of whole words, of ``least`` words and more, of any text with every one of ``quotes`` (lists of words)."""

    def __init__(self, quotes: list[list[str]], least: int = 1):
        self.least, self.follow, self.link, self.length, self.owners = max(least, 1), [{}], [-1], [0], [[]]
        for number, words in enumerate(quotes):
            state, path = 0, []
            for word in words:
                state = self._after(state, word)
                path.append(state)
            self._own(number, path)

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.length.append(length)
        self.follow.append(follow)
        self.link.append(link)
        self.owners.append([])
        return len(self.length) - 1

    def _split(self, above: int, word: str) -> int:
        """The state of exactly the run of ``above`` and ``word``: the one that follows, or a copy of it for the shorter runs."""
        below = self.follow[above][word]
        if self.length[below] == self.length[above] + 1:
            return below
        copy = self._new(self.length[above] + 1, dict(self.follow[below]), self.link[below])
        self.owners[copy] = list(self.owners[below])
        self.link[below] = copy
        while above >= 0 and self.follow[above].get(word) == below:
            self.follow[above][word] = copy
            above = self.link[above]
        return copy

    def _after(self, state: int, word: str) -> int:
        """The state once ``word`` follows: quotes share what they have in common."""
        if word in self.follow[state]:
            return self._split(state, word)
        made = self._new(self.length[state] + 1, {}, 0)
        while state >= 0 and word not in self.follow[state]:
            self.follow[state][word] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, word)
        return made

    def _own(self, number: int, path: Iterable[int]) -> None:
        for state in path:
            while state > 0 and not (self.owners[state] and self.owners[state][-1] == number):
                self.owners[state].append(number)
                state = self.link[state]

    def runs(self, words: Iterable[str]) -> dict[int, int]:
        """{quote number: words of the longest run that the text shares with it}."""
        follow, link, length, least = self.follow, self.link, self.length, self.least
        reached: dict[int, int] = {}
        state = run = 0
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                run = length[state]
            after = follow[state].get(word)
            if after is None:
                continue
            state, run = after, run + 1
            if run >= least and reached.get(state, 0) < run:
                reached[state] = run
        found: dict[int, int] = {}
        whole: set[int] = set()  # states whose longest run the text has: so have those their links lead to
        for state, run in reached.items():
            while state > 0 and run >= least and state not in whole:
                if run == length[state]:
                    whole.add(state)
                for number in self.owners[state]:
                    if found.get(number, 0) < run:
                        found[number] = run
                state = link[state]
                run = length[state]
        return found
