"""Randomised kd-trees searched together for approximate nearest neighbours."""

from __future__ import annotations

import numpy as np

TREES, CHECKS = 5, 50
# A tree is cut at the mean of one of so many dimensions of largest variance.
DIMENSIONS = 5
LEAF = 4


class KdForest:
    """Trees over the same points; only the choice of dimensions differs.

    Nodes of all trees lie in one set of arrays. A node has a dimension and a cut, or
    is a leaf of at most ``LEAF`` points (more only where they are all equal).
    """

    def __init__(self, points: np.ndarray, trees: int = TREES, seed: int = 7):
        self.points = points
        draw = np.random.default_rng(seed)
        self.dims, self.cuts, self.children, self.leaves = [], [], [], []
        self.depth = 0
        self.roots = [self._grow(draw) for _ in range(trees)]
        width = max((len(leaf) for leaf in self.leaves if leaf is not None), default=1)
        self.members = np.full((len(self.leaves), width), -1)
        for node, leaf in enumerate(self.leaves):
            if leaf is not None:
                self.members[node, : len(leaf)] = leaf
        self.dims, self.cuts = np.array(self.dims), np.array(self.cuts)
        self.children = np.array(self.children).reshape(-1, 2)

    def _node(self) -> int:
        self.dims.append(-1)
        self.cuts.append(0.0)
        self.children.append((0, 0))
        self.leaves.append(None)
        return len(self.dims) - 1

    def _grow(self, draw) -> int:
        root = self._node()
        open_ = [(root, np.arange(len(self.points)), 1)]
        while open_:
            node, members, depth = open_.pop()
            self.depth = max(self.depth, depth)
            own = self.points[members]
            spread = own.var(axis=0)
            if len(members) <= LEAF or not spread.max() > 0:
                self.leaves[node] = members
                continue
            widest = np.argsort(-spread, kind="stable")[:DIMENSIONS]
            dim = int(draw.choice(widest[spread[widest] > 0]))
            cut = own[:, dim].mean()
            left = own[:, dim] < cut
            if not left.any() or left.all():
                # The mean of nearly equal values may round to one of them.
                left = own[:, dim] < np.median(own[:, dim])
            if not left.any() or left.all():
                self.leaves[node] = members
                continue
            below, above = self._node(), self._node()
            self.dims[node], self.cuts[node], self.children[node] = dim, cut, (below, above)
            open_ += [(below, members[left], depth + 1), (above, members[~left], depth + 1)]
        return root

    def search(self, queries: np.ndarray, k: int, checks: int = CHECKS) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and distances of up to ``k`` near points of each query, nearest first.

        All trees share one queue of branches by their bound. A query stops when it
        has compared ``checks`` points, or no branch can hold a nearer one. Missing
        neighbours are -1 at an infinite distance; ties go to the smaller index.
        """
        n, k = len(queries), min(k, len(self.points))
        best_at, best = np.full((n, k), -1), np.full((n, k), np.inf)
        if not n or not k:
            return best_at, best
        seen = np.zeros((n, len(self.points) + 1), bool)
        bounds = np.full((n, len(self.roots)), np.inf)
        bounds[:] = 0
        nodes = np.tile(np.array(self.roots), (n, 1))
        compared = np.zeros(n, int)
        rows = np.arange(n)
        while True:
            place = bounds[rows].argmin(axis=1)
            bound = bounds[rows, place]
            going = (bound < best[rows, -1]) & (compared[rows] < checks)
            rows, place, bound = rows[going], place[going], bound[going]
            if not len(rows):
                break
            node = nodes[rows, place]
            bounds[rows, place] = np.inf
            pushed_bounds, pushed_nodes = [], []
            while True:
                dim = self.dims[node]
                inner = dim >= 0
                if not inner.any():
                    break
                gap = queries[rows, np.maximum(dim, 0)] - self.cuts[node]
                above = (gap >= 0).astype(int)
                pushed_bounds.append(np.where(inner, bound + gap**2, np.inf))
                pushed_nodes.append(self.children[node, 1 - above])
                node = np.where(inner, self.children[node, above], node)
            if pushed_bounds:
                more = np.full((n, len(pushed_bounds)), np.inf)
                names = np.zeros((n, len(pushed_bounds)), int)
                more[rows], names[rows] = np.stack(pushed_bounds, 1), np.stack(pushed_nodes, 1)
                bounds, nodes = np.concatenate([bounds, more], 1), np.concatenate([nodes, names], 1)
            members = self.members[node]
            new = (members >= 0) & ~seen[rows[:, None], members]
            seen[rows[:, None], members] = True
            far = ((self.points[members] - queries[rows][:, None, :]) ** 2).sum(axis=2)
            at = np.concatenate([best_at[rows], np.where(new, members, -1)], 1)
            far = np.concatenate([best[rows], np.where(new, far, np.inf)], 1)
            order = np.lexsort((at, far), axis=1)[:, :k]
            best_at[rows], best[rows] = np.take_along_axis(at, order, 1), np.take_along_axis(far, order, 1)
            compared[rows] += new.sum(axis=1)
        return np.where(np.isinf(best), -1, best_at), np.sqrt(best)
