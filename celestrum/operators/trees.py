"""What is within an angle of each point of a tile: balanced trees of points, numpy only.

Points of a tile are ordered so that every node of a balanced tree is a run of
them: an array of positions is the whole tree. Two nodes are wholly within an
angle, wholly beyond it, or divided; leaves that are neither are multiplied out.
So the work is that of the pairs near the angle, not of all pairs within it, and
its memory is that of the tile and of the nodes in hand.
"""

from __future__ import annotations

import math

import numpy as np

from celestrum.functions.coords import TOLERANCE

#: Points of a leaf at most, pairs of nodes in hand, points multiplied with a leaf at once.
LEAF, NODES, WIDE = 64, 1 << 16, 4096
#: Radians by which nodes must be clear of the angle to be counted by totals.
CLEAR = 1e-7
#: Dot products that differ by less may be equal once the angle is rounded.
NEAR = 1e-10


def _depth(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(n / leaf))) if n > leaf else 0


def _halved(cuts: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(cuts) - 1, np.int64)
    out[0::2], out[1::2] = cuts, (cuts[:-1] + cuts[1:]) // 2
    return out


def order(at: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order in which rows (positions, and other coordinates) are a tree: each node is halved along its widest axis."""
    n = len(at)
    index, cuts, rows = np.arange(n), np.array([0, n]), np.arange(n)
    for _ in range(_depth(n, leaf)):
        now = at[index]
        low, high = (f.reduceat(now, cuts[:-1], axis=0) for f in (np.minimum, np.maximum))
        axis = np.argmax(high - low, axis=1)
        node = np.repeat(np.arange(len(axis)), np.diff(cuts))
        along = axis[node]
        place = (now[rows, along] - low[node, along]) / np.maximum(high - low, 1e-300)[node, along]
        index = index[np.argsort(node + 0.5 * place)]
        cuts = _halved(cuts)
    return index


def _unit(sums: np.ndarray, instead: np.ndarray) -> np.ndarray:
    size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, sums / np.maximum(size, 1e-9), instead)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Radians, good for near and opposite directions."""
    return 2.0 * np.arctan2(np.sqrt(((a - b) ** 2).sum(axis=-1)), np.sqrt(((a + b) ** 2).sum(axis=-1)))


class Tree:
    """Positions in tree order, multiplicities and weights (None: all 1). Nodes k have children 2 k + 1 and 2 k + 2."""

    def __init__(self, v: np.ndarray, many: np.ndarray | None = None, weight: np.ndarray | None = None, leaf: int = LEAF):
        n = len(v)
        self.v, self.many, self.weight = v, many, weight
        self.depth = _depth(n, leaf)
        cuts = np.array([0, n])
        for _ in range(self.depth):
            cuts = _halved(cuts)
        self.low, self.high, self.first = cuts[:-1], cuts[1:], (1 << self.depth) - 1
        self.own = (1.0 if many is None else many) * (1.0 if weight is None else weight) * np.ones(n)
        counts = np.diff(cuts).astype(np.float64) if many is None else np.add.reduceat(many.astype(np.float64), self.low)
        weights, sums, some = np.add.reduceat(self.own, self.low), np.add.reduceat(v, self.low, axis=0), v[self.low]
        centre = _unit(sums, some)
        radius = np.maximum.reduceat(angle(v, np.repeat(centre, np.diff(cuts), axis=0)), self.low)
        levels = [(centre, radius, counts, weights)]
        for _ in range(self.depth):
            sums, some, counts, weights = sums[0::2] + sums[1::2], some[0::2], counts[0::2] + counts[1::2], weights[0::2] + weights[1::2]
            up = _unit(sums, some)
            reach = angle(centre, np.repeat(up, 2, axis=0)) + radius
            centre, radius = up, np.maximum(reach[0::2], reach[1::2])
            levels.append((centre, radius, counts, weights))
        self.centre, self.radius, self.count, self.total = (np.concatenate([level[k] for level in reversed(levels)]) for k in range(4))
        self._leaves = None

    @property
    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, multiplicities and products with weights by leaf, filled up to a multiple of eight with what is near nothing."""
        if self._leaves is None:
            sizes = self.high - self.low
            wide = -(-int(sizes.max()) // 8) * 8
            at = self.low[:, None] + np.arange(wide)
            held = at < self.high[:, None]
            at = np.where(held, at, 0)
            v = np.where(held[:, :, None], self.v[at], np.nan)
            many = held.astype(np.float64) if self.many is None else np.where(held, self.many[at], 0.0)
            self._leaves = v, many, np.where(held, self.own[at], 0.0)
        return self._leaves

    def spans(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest value of each node."""
        out = []
        for f in (np.minimum, np.maximum):
            levels = [f.reduceat(values, self.low)]
            for _ in range(self.depth):
                levels.append(f(levels[-1][0::2], levels[-1][1::2]))
            out.append(np.concatenate(levels[::-1]))
        return out[0], out[1]

    def down(self, nodes: np.ndarray) -> np.ndarray:
        """Each point's sum of its nodes' values."""
        level = nodes[:1]
        for k in range(self.depth):
            begin = (2 << k) - 1
            level = np.repeat(level, 2) + nodes[begin : begin + (2 << k)]
        return np.repeat(level, self.high - self.low)


def cosines(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a dot product must exceed to be within angles (radians; pi or more: everything), and the angles where that is."""
    c = np.where(theta >= math.pi, -2.0, np.cos(np.minimum(theta, math.pi)) + TOLERANCE)
    at = np.where(c < -1.0, np.inf, np.where(c > 1.0, -np.inf, 2.0 * np.arcsin(np.sqrt(np.clip((1.0 - c) / 2.0, 0.0, 1.0)))))
    return c, at


def within(a: Tree, b: Tree, c: np.ndarray, at: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """For each point of a: how many points of b have a dot product above c with it, and their weight. at: the angles of c."""
    low, high = a.spans(at)
    counts, weights = np.zeros(len(a.radius)), np.zeros(len(a.radius))
    found, sums = np.zeros(len(a.v)), np.zeros(len(a.v)) if weighted else None
    stack, left, held = [(np.zeros(1, np.int64), np.zeros(1, np.int64))], [], 0
    while stack:
        i, j = stack.pop()
        if len(i) > NODES:
            stack += [(i[k : k + NODES], j[k : k + NODES]) for k in range(0, len(i), NODES)]
            continue
        distance, reach = angle(a.centre[i], b.centre[j]), a.radius[i] + b.radius[j] + CLEAR
        whole = distance + reach < low[i]
        if whole.any():
            k, q = i[whole], j[whole]
            counts += np.bincount(k, b.count[q], len(counts))
            if weighted:
                weights += np.bincount(k, b.total[q], len(weights))
        cut = ~whole & (distance - reach < high[i])
        i, j = i[cut], j[cut]
        leaf_a, leaf_b = i >= a.first, j >= b.first
        both = leaf_a & leaf_b
        if both.any():
            left.append((i[both] - a.first, j[both] - b.first))
            held += len(left[-1][0])
            if held > 4 * NODES:
                _multiplied(a, b, c, left, found, sums)
                left, held = [], 0
        rest = ~both
        i, j, leaf_a, leaf_b = i[rest], j[rest], leaf_a[rest], leaf_b[rest]
        if len(i):
            divide = ~leaf_a & (leaf_b | (a.radius[i] >= b.radius[j]))
            ia, ja, ib, jb = i[divide], j[divide], i[~divide], j[~divide]
            stack.append((np.concatenate([2 * ia + 1, 2 * ia + 2, ib, ib]), np.concatenate([ja, ja, 2 * jb + 1, 2 * jb + 2])))
    if left:
        _multiplied(a, b, c, left, found, sums)
    return found + a.down(counts), sums + a.down(weights) if weighted else None


def _multiplied(a: Tree, b: Tree, c: np.ndarray, pairs: list, found: np.ndarray, sums: np.ndarray | None) -> None:
    """Adds what pairs of leaves have, each leaf of a with all of its leaves of b."""
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    v, many, own = b.leaves
    most = max(1, WIDE // v.shape[1])
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
        low, high = int(a.low[i[begin]]), int(a.high[i[begin]])
        mine, least = a.v[low:high], c[low:high, None]
        for k in range(begin, end, most):
            q = j[k : min(end, k + most)]
            near = mine @ v[q].reshape(-1, 3).T > least
            if b.many is None:
                found[low:high] += np.bitwise_count(near.view(np.uint64)).sum(axis=1)
            elif sums is None:
                found[low:high] += near @ many[q].ravel()
            else:
                both = near.astype(np.float64) @ np.stack([many[q].ravel(), own[q].ravel()], axis=1)
                found[low:high] += both[:, 0]
                sums[low:high] += both[:, 1]
                continue
            if sums is not None:
                sums[low:high] += near @ own[q].ravel()


def nearest(a: Tree, b: Tree, k: int, farthest: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of points of a and of b: each point's k nearest within an angle (radians; its end is in), and what may be as near as the last."""
    least = -2.0 if farthest >= math.pi else math.cos(farthest) - TOLERANCE
    v, _, _ = b.leaves
    sizes, one, two = b.high - b.low, [], []
    number = b.low[:, None] + np.arange(v.shape[1])
    ends = b.centre[b.first :], b.radius[b.first :]
    for leaf in range(len(a.low)):
        low, high = int(a.low[leaf]), int(a.high[leaf])
        distance = angle(a.centre[a.first + leaf], ends[0])
        reach = a.radius[a.first + leaf] + ends[1] + CLEAR
        # All points of the leaf have k points within this.
        upto = np.sort(distance + reach) if k > 1 else None
        if k == 1:
            bound = float((distance + reach).min())
        else:
            by = np.argsort(distance + reach)
            full = np.searchsorted(np.cumsum(sizes[by]), k)
            bound = float(upto[full]) if full < len(by) else math.inf
        some = np.flatnonzero(distance - reach <= min(bound, farthest + CLEAR))
        if not len(some):
            continue
        dot = a.v[low:high] @ v[some].reshape(-1, 3).T
        dot[~(dot >= least)] = -np.inf
        edge = np.partition(dot, -k, axis=1)[:, -k] if dot.shape[1] >= k else np.full(high - low, -np.inf)
        i, j = np.nonzero((dot >= edge[:, None] - NEAR) & (dot > -np.inf))
        one.append(low + i)
        two.append(number[some].ravel()[j])
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two)
