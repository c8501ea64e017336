"""Probabilistic automata inferred from strings by merging states of a prefix tree.

The tree of all prefixes counts how often each was passed and where strings
ended.  States are then merged, from the root outwards, where two states'
frequencies of ends, symbols and classes of symbols, and those of all states
they lead to in common, differ no more than Hoeffding's bound allows.  What is left is a deterministic
automaton with loops, whose smoothed frequencies score any string.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Fixed alphabet of credentials; the symbol after the last ends a string.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
END = len(ALPHABET)
#: Rare symbols of one class may together be frequent, so their sums are compared as well.
CLASS = {c: "9" if c.isdigit() else "f" if c in "abcdef" else "z" if c.islower() else "Z" if c.isupper() else c for c in ALPHABET}
#: Strings to this length are scored in columns of many, longer ones singly.
LONG = 256


class PrefixTree:
    """States with their visits, ends, and edges ``symbol -> state`` with counts."""

    def __init__(self, strings: Iterable[str]):
        self.visits, self.ends, self.next, self.passed = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.visits)
                    for column, empty in ((self.visits, 0), (self.ends, 0), (self.next, {}), (self.passed, {})):
                        column.append(empty.copy() if empty == {} else empty)
                self.passed[at][c] = self.passed[at].get(c, 0) + 1
                self.visits[to] += 1
                at = to
            self.ends[at] += 1

    def differ(self, a: int, b: int, x: int, y: int, bound: float) -> bool:
        """Are x of a's visits and y of b's further apart than chance allows?"""
        n, m = self.visits[a], self.visits[b]
        return abs(x / n - y / m) > bound * (n**-0.5 + m**-0.5)

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """``b`` is the root of a part that is still a tree, so the walk ends."""
        front = [(a, b)]
        while front:
            a, b = front.pop()
            if self.differ(a, b, self.ends[a], self.ends[b], bound):
                return False
            p, q = self.passed[a], self.passed[b]
            of_p, of_q = {}, {}
            for c in p.keys() | q.keys():
                x, y, kind = p.get(c, 0), q.get(c, 0), CLASS[c]
                if self.differ(a, b, x, y, bound):
                    return False
                of_p[kind], of_q[kind] = of_p.get(kind, 0) + x, of_q.get(kind, 0) + y
            if any(self.differ(a, b, x, of_q[kind], bound) for kind, x in of_p.items()):
                return False
            for c in self.next[b]:
                if c in self.next[a]:
                    front.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> list[tuple[int, str]]:
        """Add the tree below ``b`` to ``a``; returns the edges that moved as they were."""
        moved, front = [], [(a, b)]
        while front:
            a, b = front.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, to in self.next[b].items():
                self.passed[a][c] = self.passed[a].get(c, 0) + self.passed[b][c]
                if c in self.next[a]:
                    front.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to
                    moved.append((a, c))
        return moved

    def merge(self, alpha: float) -> list[int]:
        """Merge until no state outside the kept ones is left; returns the kept ones.

        The candidate with most visits is next, of several the first that was
        reached; it joins the first kept state that it is compatible with.
        """
        bound = float(np.sqrt(0.5 * np.log(2 / alpha)))
        kept, member, waiting, turn = [0], {0}, [], 0

        def reach(state: int, c: str) -> None:
            nonlocal turn
            turn += 1
            heapq.heappush(waiting, (-self.visits[self.next[state][c]], turn, state, c))

        for c in sorted(self.next[0]):
            reach(0, c)
        while waiting:
            _, _, parent, c = heapq.heappop(waiting)
            state = self.next[parent][c]
            if state in member:
                continue
            into = next((k for k in kept if self.compatible(k, state, bound)), None)
            if into is None:
                kept.append(state)
                member.add(state)
                edges = [(state, x) for x in sorted(self.next[state])]
            else:
                self.next[parent][c] = into
                edges = [(a, x) for a, x in self.fold(into, state) if a in member]
            for a, x in edges:
                reach(a, x)
        return kept


@dataclass
class Automaton:
    """``log`` has a row per state with the symbols' and the end's log-probability."""

    log: np.ndarray  # states, END + 1
    next: np.ndarray  # states, END

    def likelihood(self, codes: np.ndarray) -> float:
        state, total = 0, 0.0
        for c in codes.tolist():
            total += self.log[state, c]
            state = self.next[state, c]
        return float(total + self.log[state, END])

    def likelihoods(self, strings: list[str]) -> np.ndarray:
        """The log-probability of each string, ends included."""
        out = np.zeros(len(strings))
        codes = [CODE[np.frombuffer(s.encode("ascii"), np.uint8)] for s in strings]
        order = sorted((i for i, c in enumerate(codes) if len(c) <= LONG), key=lambda i: -len(codes[i]))
        for i, c in enumerate(codes):
            if len(c) > LONG:
                out[i] = self.likelihood(c)
        if not order:
            return out
        lengths = np.array([len(codes[i]) for i in order])
        width = int(lengths[0])
        table = np.zeros((len(order), width), np.int64)
        for row, i in enumerate(order):
            table[row, : len(codes[i])] = codes[i]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        for at in range(width):
            n = int(np.searchsorted(-lengths, -at, "left"))  # strings longer than ``at`` come first
            total[:n] += self.log[state[:n], table[:n, at]]
            state[:n] = self.next[state[:n], table[:n, at]]
        out[order] = total + self.log[state, END]
        return out


def infer(strings: Iterable[str], alpha: float = 0.05, smooth: float = 1.0) -> Automaton:
    """The automaton of different strings over :data:`ALPHABET`.

    Every state spreads ``smooth`` visits over all symbols and the end; a
    symbol that was never seen in a state leads back to the first one.
    """
    tree = PrefixTree(strings)
    kept = tree.merge(alpha)
    place = {s: i for i, s in enumerate(kept)}
    log, to = np.zeros((len(kept), END + 1)), np.zeros((len(kept), END), np.int64)
    for i, s in enumerate(kept):
        log[i, END] = tree.ends[s]
        for c, n in tree.passed[s].items():
            log[i, CODE[ord(c)]] = n
            to[i, CODE[ord(c)]] = place[tree.next[s][c]]
        log[i] = np.log((log[i] + smooth / (END + 1)) / (tree.visits[s] + smooth))
    return Automaton(log, to)
