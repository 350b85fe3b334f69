"""A suffix automaton over words that counts occurrences."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """All substrings of several sequences, with the number of places where each occurs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        self.added: list[tuple[Sequence[Hashable], int]] = []

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.length) - 1

    def _split(self, p: int, word: Hashable, q: int) -> int:
        """A copy of q for the shorter strings that p reaches by `word`."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: Hashable) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            right = self.length[p] + 1 == self.length[q]
            self.link[new] = q if right else self._split(p, word, q)
        return new

    def add(self, sequence: Sequence[Hashable], places: int = 1) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)
        self.added.append((sequence, places))

    def count(self) -> None:
        """Count the places of every prefix and pass them to its suffixes; once, after all adds,
        since states are split until then."""
        for sequence, places in self.added:
            state = 0
            for word in sequence:
                state = self.next[state][word]
                self.places[state] += places
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def repeated(self, sequence: Sequence[Hashable]) -> list[int]:
        """Matching statistics: per position, the length of the longest string that ends there and
        occurs in two places or more."""
        out, state, matched = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            # The current string itself may occur once only; its suffixes occur more often.
            while state and self.places[state] < 2:
                state = self.link[state]
                matched = self.length[state]
            out.append(matched)
        return out
