"""A Gray-order hierarchical index over 64-bit fingerprints, and components of links in one task."""

from __future__ import annotations

import numpy as np


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Index over the fingerprints of several buckets, rows sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, fanout: int = 16):
        order = np.lexsort((gray_rank(fp), bucket))
        self.order, self.fp = order, fp[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child
        ones, zeros, owner = self.fp, ~self.fp, np.unique(bucket[order], return_inverse=True)[1]
        while True:
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            inside = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
            first = np.flatnonzero(inside % fanout == 0)
            ones, zeros, owner = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first), owner[first]
            self.levels.append((ones | zeros, ones, np.append(first, len(inside))))
            if len(starts) == len(first):
                break
        self.root = np.unique(bucket[order], return_inverse=True)[1]

    def pairs(self, rows: np.ndarray, radius: int, both_ways: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Positions (q, p) within the radius, q among ``rows``, p < q in index order unless
        ``both_ways``."""
        q, node = rows, self.root[rows]
        diff, known = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint64)
        for mask, pattern, first in reversed(self.levels):
            diff = diff + np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node] & ~known)
            on = diff <= radius
            q, node, diff = q[on], node[on], diff[on]
            count = first[node + 1] - first[node]
            child = np.repeat(first[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            known = np.repeat(mask[node], count)
            q, node, diff = np.repeat(q, count), child, np.repeat(diff, count)
            if first is self.levels[0][2]:
                on = (node != q) if both_ways else (node < q)
                q, node, diff, known = q[on], node[on], diff[on], known[on]
        on = diff + np.bitwise_count((self.fp[q] ^ self.fp[node]) & ~known) <= radius
        return q[on], node[on]


def spanning(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest vertex of each vertex's component, given links a-b and earlier labels."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        on = la != lb
        if not on.any():
            break
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
