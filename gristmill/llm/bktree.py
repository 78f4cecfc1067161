"""BK-trees of many shards at once, in flat arrays.

A node's children are keyed by their integer Hamming distance to it. A point goes down from the root of
its shard, to the child under its distance at each node, and where there is none it becomes that child.
A query follows only the edges that differ from its own distance to a node by no more than the radius.
All points of all shards descend side by side, a level in each step.
"""

from __future__ import annotations

import numpy as np

#: Distances 0 to 64 under a node.
EDGES = 65
#: Pairs of query and node that one step looks at; more of them wait.
STEP = 1 << 19


class Forest:
    """Trees of 64-bit points. shard: a number for each point, equal points of one shard being given once."""

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        self.points = points
        self.shards, root, place = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = root
        at = root[place]
        todo = np.flatnonzero(at != np.arange(len(points)))
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):
            slot = at[todo] * EDGES + np.bitwise_count(points[todo] ^ points[at[todo]])
            taken, first, back = np.unique(slot, return_index=True, return_inverse=True)
            keys.append(taken)
            kids.append(todo[first])
            at[todo] = todo[first][back]
            todo = np.delete(todo, first)
        keys, kids = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(keys)
        #: Parent * EDGES + distance of each edge, in order, and the child that it leads to.
        self.keys, self.kids = keys[order], kids[order]
        self.followed = 0

    def root_of(self, shard: np.ndarray) -> np.ndarray:
        """Root of each shard, -1 for a shard without points."""
        if not len(self.shards):
            return np.full(len(shard), -1)
        at = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        return np.where(self.shards[at] == shard, self.roots[at], -1)

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """(query number, node) in parts: all nodes of a query's tree that are within radius. roots: where each query starts, -1 for nowhere."""
        start = np.flatnonzero(roots >= 0)
        todo = [(start, roots[start])]
        while todo:
            asked, node = todo.pop()
            if len(asked) > STEP:
                todo.append((asked[STEP:], node[STEP:]))
                asked, node = asked[:STEP], node[:STEP]
            apart = np.bitwise_count(queries[asked] ^ self.points[node]).astype(np.int64)
            near = apart <= radius
            if near.any():
                yield asked[near], node[near]
            lo = np.searchsorted(self.keys, node * EDGES + np.maximum(apart - radius, 0))
            hi = np.searchsorted(self.keys, node * EDGES + np.minimum(apart + radius, EDGES - 1), "right")
            many = hi - lo
            if total := int(many.sum()):
                self.followed += total
                edge = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                todo.append((np.repeat(asked, many), self.kids[edge]))


class Groups:
    """Union of numbers below n; every group is named by its smallest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.parent[a] != self.parent[b]  # the others are joined already
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def names(self) -> np.ndarray:
        """The smallest number of each number's group."""
        up = self.parent[self.parent]
        while (up != self.parent).any():
            self.parent, up = up, up[up]
        return self.parent
