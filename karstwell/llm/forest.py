"""A forest of random-projection trees for angular search.

Each tree splits a bounded sample of unit vectors by hyperplanes midway between
two of its vectors. A search keeps one priority queue for all trees: it always
opens the branch whose worst margin on the way is best, wherever that is.
"""

from __future__ import annotations

import heapq

import numpy as np


class Forest:
    """Trees as flat arrays, so that it pickles small: a node is a plane and two children, or a leaf (-1 - leaf)."""

    def __init__(self, sample: np.ndarray, *, trees: int, leaf: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        planes: list[np.ndarray] = []
        bias: list[float] = []
        self.child: list[list[int]] = []
        self.roots: list[int] = []
        self.leaves = 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, leaf, rng, planes, bias))
        self.planes = np.array(planes).reshape(len(planes), sample.shape[1])
        self.bias = np.array(bias)
        self.children = np.array(self.child, np.int64).reshape(len(self.child), 2)
        #: In how many dimensions the sample spreads (the participation ratio of its variances).
        self.spread = 1.0
        if len(sample) > 1:
            around = sample - sample.mean(axis=0)
            cov = around.T @ around
            self.spread = max(1.0, float(np.trace(cov) ** 2 / max(1e-300, (cov * cov).sum())))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray, leaf: int, rng, planes: list, bias: list) -> int:
        if len(points) <= leaf:
            return self._leaf()
        for _ in range(5):
            a, b = points[rng.integers(len(points), size=2)]
            normal = a - b
            size = np.linalg.norm(normal)
            if size < 1e-12:
                continue
            normal = normal / size
            along = points @ normal
            middle = float(np.median(along))
            right = along > middle
            if 0.1 < right.mean() < 0.9:
                node = len(planes)
                planes.append(normal)
                bias.append(middle)
                self.child.append([0, 0])
                self.child[node] = [self._grow(points[~right], leaf, rng, planes, bias), self._grow(points[right], leaf, rng, planes, bias)]
                return node
        return self._leaf()

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(self.roots), len(points)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root)
            while len(open_ := np.flatnonzero(at >= 0)):
                node = at[open_]
                right = np.einsum("ij,ij->i", points[open_], self.planes[node]) > self.bias[node]
                at[open_] = self.children[node, right.astype(np.int64)]
            out[t] = -1 - at
        return out

    def search(self, point: np.ndarray, sizes: np.ndarray, least: int, reach: float) -> list[int]:
        """Leaves in the order of the shared queue: all within ``reach``, and so many that one tree's hold ``least`` rows.

        ``sizes``: rows of each leaf. Leaves of one tree share no rows.
        """
        margins = (self.planes @ point - self.bias).tolist()
        queue = [(0.0, root, tree) for tree, root in enumerate(self.roots)]
        found, child, held = [], self.child, [0.0] * len(self.roots)
        while queue and (queue[0][0] <= reach or max(held) < least):
            worst, node, tree = heapq.heappop(queue)
            while node >= 0:
                side = margins[node] > 0
                heapq.heappush(queue, (max(worst, abs(margins[node])), child[node][not side], tree))
                node = child[node][side]
            found.append(-1 - node)
            held[tree] += sizes[-1 - node]
        return found
