"""Signature trees over sets of hashes, and their dual traversal.

A leaf holds a few sets that are alike in size; each node holds the OR of its sets' bitmaps,
the range of their sizes, and how many elements share a bit with another one at most. Two
nodes can hold a linked pair only if the bits they share, plus that slack, reach the overlap
that their sizes ask for; otherwise the traversal leaves the pair of nodes. Pairs that are
left are compared exactly. Pairs already joined need no comparison.
"""

from __future__ import annotations

import numpy as np

BITS = 2048
LEAF, FAN = 4, 4


class Forest:
    """Union-find over positions, towards the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Node:
    __slots__ = ("bits", "low", "high", "slack", "parts", "rows")

    def __init__(self, bits, low, high, slack, parts, rows):
        self.bits, self.low, self.high, self.slack, self.parts, self.rows = bits, low, high, slack, parts, rows


def bitmap(elements: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, np.uint8)
    out[(elements & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def build(rows: list[int], sets: list[np.ndarray], maps: np.ndarray) -> Node | None:
    """A tree over some rows, in order of size, then of smallest element."""
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (len(sets[r]), int(sets[r][0])))
    level = []
    for at in range(0, len(rows), LEAF):
        own = rows[at : at + LEAF]
        sizes = [len(sets[r]) for r in own]
        slack = max(len(sets[r]) - int(np.bitwise_count(maps[r]).sum()) for r in own)
        level.append(Node(np.bitwise_or.reduce(maps[own]), min(sizes), max(sizes), slack, [], own))
    while len(level) > 1:
        level = [_over(level[at : at + FAN]) for at in range(0, len(level), FAN)]
    return level[0]


def _over(parts: list[Node]) -> Node:
    bits = np.bitwise_or.reduce(np.stack([p.bits for p in parts]))
    return Node(bits, min(p.low for p in parts), max(p.high for p in parts), max(p.slack for p in parts), parts, [r for p in parts for r in p.rows])


def needed(a: int, b: int, percent: int) -> int:
    """Smallest overlap at which sets of these sizes reach the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def traverse(left: Node | None, right: Node | None, sets: list[np.ndarray], maps: np.ndarray, percent: int, forest: Forest) -> None:
    """Join all rows of ``left`` and ``right`` that are linked."""
    open_pairs = [(left, right)] if left is not None and right is not None else []
    while open_pairs:
        x, y = open_pairs.pop()
        if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
            continue
        most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
        if min(most, x.high, y.high) < needed(x.low, y.low, percent):
            continue
        roots = {forest.root(r) for r in x.rows}
        if len(roots) == 1 and {forest.root(r) for r in y.rows} == roots:
            continue
        if x.parts or y.parts:
            if x is y:
                open_pairs += [(p, q) for i, p in enumerate(x.parts) for q in x.parts[i:]]
            elif x.parts and (not y.parts or len(x.rows) >= len(y.rows)):
                open_pairs += [(p, y) for p in x.parts]
            else:
                open_pairs += [(x, q) for q in y.parts]
            continue
        for i in x.rows:
            for j in y.rows:
                if i == j or x is y and j < i or forest.root(i) == forest.root(j):
                    continue
                least = needed(len(sets[i]), len(sets[j]), percent)
                if min(len(sets[i]), len(sets[j])) < least:
                    continue
                shared = int(np.bitwise_count(maps[i] & maps[j]).sum())
                slack = min(len(sets[i]) - int(np.bitwise_count(maps[i]).sum()), len(sets[j]) - int(np.bitwise_count(maps[j]).sum()))
                if shared + slack >= least and overlap(sets[i], sets[j]) >= least:
                    forest.join(i, j)
