"""Byte-pair merging seen as a lattice: which token may follow which, and small caches.

A sequence of tokens is what the merges give exactly when every neighbouring pair is. So one
pass from left to right, which keeps the last token of every prefix, finds the merges of all
prefixes at once.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

# Entries of one generation of a cache of a Python worker.
CACHE_ENTRIES = 100_000
PAIR_ENTRIES = 300_000


class Recent(dict):
    """A memo of bounded size: what was not used for a whole generation is dropped."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: Hashable):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Pairs:
    """``Neighbours`` of tokens whose merges are in tables: ``joined[a << 24 | b]``, and the halves by token.

    ``memo`` holds the pairs last asked for, by ``left << 24 | right``.
    """

    def __init__(self, joined: dict[int, int], halves: list):
        self.joined, self.halves = joined, halves
        self.memo = Recent(self._check, PAIR_ENTRIES)

    def _check(self, key: int) -> bool:
        joined, halves = self.joined.get, self.halves
        left, right = key >> 24, key & 0xFFFFFF
        before = 1 << 62
        while True:
            both = joined(left << 24 | right)
            if both is not None and both < before:
                return False
            a, b = halves[left], halves[right]
            if a is None:
                if b is None:
                    return True
                before, right = right + 1, b[0]
            elif b is None or left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]


def merge(parts: list, rank: Callable) -> list:
    """Join the neighbouring pair of the lowest rank, leftmost first, until none has a rank."""
    parts = list(parts)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank(parts[i], parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Neighbours:
    """Whether the merges leave token ``left`` and token ``right`` alone side by side.

    ``joined(a, b)`` is the token two tokens merge to, if any; ``halves(t)`` the two tokens it
    is made of, or None for a basic symbol. Tokens are numbered in the order of their merges.
    The merges undo the boundary only if, on the way up both edges, some pair across it merges
    before the next larger part of either side exists.
    """

    def __init__(self, joined: Callable, halves: Callable):
        self.joined, self.halves = joined, halves
        self.memo = Recent(self._check, CACHE_ENTRIES // 2)

    def _check(self, key: int) -> bool:
        left, right = key >> 24, key & 0xFFFFFF
        before = 1 << 62  # merges numbered from here on come too late
        while True:
            both = self.joined(left, right)
            if both is not None and both < before:
                return False
            # Take back the later of the two merges; at equal rank the left one comes first.
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]
