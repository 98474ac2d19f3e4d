"""Disjoint sets, for what one task holds."""

from __future__ import annotations


class UnionFind:
    """Sets of hashable items, with paths halved on the way."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        """Whether the two were in different sets."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b
