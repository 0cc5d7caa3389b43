"""Recursive graph bisection: an order of documents in which documents that share terms stand close together.

Each part is cut into halves, and documents are swapped between its halves as long as that lowers the
cost of coding the gaps of all terms' posting lists (d * log2(n / (d + 1)) for a term in d of n documents of a half).
All parts of a level are worked on at once, with numpy.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 5


def add_cost(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What one more document with the term costs a half of n documents, d of which hold it."""
    return (d + 1) * np.log2(n / (d + 2)) - d * np.log2(n / (d + 1))


def _degrees(side: np.ndarray, part: np.ndarray, doc: np.ndarray, term: np.ndarray, parts: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per posting its (part, term) key, and per key the documents of the left and of the right half."""
    key = part[doc] * terms + term
    right = np.bincount(key[side[doc]], minlength=parts * terms)
    return key, np.bincount(key, minlength=parts * terms) - right, right


def bisect(doc: np.ndarray, term: np.ndarray, docs: int, terms: int, levels: int, rounds: int = ROUNDS) -> np.ndarray:
    """The part (below 2 ** levels) of each document; parts of a level differ by one in size.

    ``doc`` and ``term`` are the postings, sorted by document, which are numbered from 0.
    """
    part = np.zeros(docs, dtype=np.int64)
    first = np.searchsorted(doc, np.arange(docs))
    some = np.bincount(doc, minlength=docs) > 0
    for level in range(levels):
        parts = 1 << level
        order = np.argsort(part, kind="stable")
        starts = np.searchsorted(part[order], np.arange(parts + 1))
        rank = np.empty(docs, dtype=np.int64)
        rank[order] = np.arange(docs) - starts[part[order]]
        size = np.diff(starts)
        side = rank >= (size[part] + 1) // 2
        n_left, n_right = ((size + 1) // 2).clip(1).astype(float), (size // 2).clip(1).astype(float)
        for _ in range(rounds):
            key, left, right = _degrees(side, part, doc, term, parts, terms)
            of, right_side = key // terms, side[doc]
            here, there = np.where(right_side, right[key], left[key]), np.where(right_side, left[key], right[key])
            n_here, n_there = np.where(right_side, n_right[of], n_left[of]), np.where(right_side, n_left[of], n_right[of])
            gain = add_cost(n_here, here - 1.0) - add_cost(n_there, there.astype(float))
            total = np.zeros(docs)
            if len(gain):
                total[some] = np.add.reduceat(gain, first[some])
            # the k-th best of the left half and the k-th best of the right one change places while both gain together
            by_gain = np.lexsort((-total, side, part))
            half = part[by_gain] * 2 + side[by_gain]
            begins = np.searchsorted(half, np.arange(2 * parts + 1))
            place = np.arange(docs) - begins[half]
            partner = begins[half ^ 1] + place
            has = partner < begins[(half ^ 1) + 1]
            both = np.where(has, total[by_gain] + total[by_gain[np.where(has, partner, 0)]], -1.0)
            moved = by_gain[both > 1e-9]
            if not len(moved):
                break
            side[moved] = ~side[moved]
        part = part * 2 + side
    return part


def preferences(part: np.ndarray, doc: np.ndarray, term: np.ndarray, terms: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """For each inner node of the tree (root 1, children 2k and 2k + 1) how much a term draws a document to the right, and
    the pull at which a document goes there: the median of the node's own documents as they are routed, so that nodes split evenly."""
    out = np.zeros((1 << levels, terms), dtype=np.float32)
    for level in range(levels):
        below = part >> (levels - level - 1)
        size = np.bincount(below, minlength=2 << level).clip(1).astype(float)
        degree = np.bincount(below[doc] * terms + term, minlength=(2 << level) * terms).reshape(-1, terms).astype(float)
        cost = add_cost(size[:, None], degree)
        out[1 << level : 2 << level] = cost[0::2] - cost[1::2]
    limit = np.zeros(1 << levels, dtype=np.float32)
    node = np.ones(len(part), dtype=np.int64)
    for level in range(levels):
        pull = np.zeros(len(part))
        np.add.at(pull, doc, out[node[doc], term])
        for k in range(1 << level, 2 << level):
            own = node == k
            limit[k] = np.median(pull[own]) if own.any() else 0.0
        node = 2 * node + (pull > limit[node])
    return out, limit


def route(prefers: np.ndarray, limit: np.ndarray, rows: list[int], levels: int) -> int:
    """The part that a document with these terms goes to."""
    node = 1
    for _ in range(levels):
        node = 2 * node + int(prefers[node, rows].sum() > limit[node])
    return node - (1 << levels)
