"""Generalised suffix automata: every substring of a set of sequences is a path from the first state."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """next: transitions by state; link: suffix links; length: the longest substring of a state."""

    def __init__(self, sequences: Iterable[Sequence[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for s in sequences:
            self.add(s)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the substrings that reach it from p and its suffixes."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Sequence[int]) -> None:
        at = 0
        for c in sequence:
            q = self.next[at].get(c)
            if q is not None:  # an earlier sequence has this prefix
                at = q if self.length[q] == self.length[at] + 1 else self._split(at, c, q)
                continue
            new, p = self._state(self.length[at] + 1, {}, 0), at
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            at = new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The state and longest matching length after one more symbol of a stream."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)

    def suffix(self, state: int, length: int) -> int:
        """The state of the suffix of this length of a match that ends in state."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, sequence: Sequence[int]) -> int:
        """The state of a substring."""
        at = 0
        for c in sequence:
            at = self.next[at][c]
        return at
