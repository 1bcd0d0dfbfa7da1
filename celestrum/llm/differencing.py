"""Karmarkar-Karp multiway differencing.

A partial partition is `ways` sums, some of them zero. The two with the largest
spread (largest sum less smallest) are combined in opposite order, largest on
smallest, until one is left.
"""

from __future__ import annotations

import heapq

import numpy as np


def difference(sizes, ways: int) -> np.ndarray:
    """Part (0 .. ways - 1) of each size; parts are ordered by falling sum, ties by the order of combination.

    Items of size 0 are dealt like others. No sizes: an empty array.
    """
    nodes = [(np.array([s], dtype=np.int64), np.array([k])) for k, s in enumerate(sizes)]
    parent, sums, roots = combine(nodes, ways, len(nodes))
    if not len(parent):
        return np.zeros(0, dtype=np.int64)
    part = np.full(len(parent), -1, dtype=np.int64)
    part[roots] = np.arange(len(roots))
    out = np.empty(len(parent), dtype=np.int64)
    for k in range(len(parent)):
        r = k
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        out[k] = part[r]
    return out


def combine(nodes: list[tuple[np.ndarray, np.ndarray]], ways: int, n_slots: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """nodes: (sums, slots), at most `ways` of each, slots being numbers below n_slots that no other node has.

    Returns the slots' union-find parents, and the last node's sums (falling) and slots.
    """
    parent = list(range(n_slots))
    heap: list = []
    for k, (sums, slots) in enumerate(nodes):
        order = np.argsort(-sums, kind="stable")
        sums, slots = sums[order].tolist(), slots[order].tolist()
        heap.append((-(sums[0] - (sums[-1] if len(sums) == ways else 0)), k, sums, slots))
    heapq.heapify(heap)
    tick = len(nodes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # Only parts that hold something are listed; the rest are zero. Part k of one meets part ways - 1 - k of the other.
        if len(a) < len(b):
            a, x, b, y = b, y, a, x
        free = ways - len(a)
        pairs = list(zip(a, x, strict=True))
        for k, (size, slot) in enumerate(zip(b, y, strict=True)):
            if k < free:
                pairs.append((size, slot))
            else:
                at = ways - 1 - k
                parent[slot] = pairs[at][1]
                pairs[at] = (pairs[at][0] + size, pairs[at][1])
        pairs.sort(key=lambda p: -p[0])
        sums, slots = [p[0] for p in pairs], [p[1] for p in pairs]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == ways else 0)), tick, sums, slots))
        tick += 1
    if not heap:
        return parent, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return parent, np.array(heap[0][2], dtype=np.int64), np.array(heap[0][3], dtype=np.int64)
