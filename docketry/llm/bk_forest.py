"""BK-trees over 64-bit fingerprints, many trees in one set of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from docketry.llm.common import ragged

#: Pairs of query and node that are compared at once.
FRONTIER = 200_000


class Forest:
    """One tree for each group; a child is known to its parent by its Hamming distance.

    Built level by level with the result of inserting the rows in order: of all rows that reach a node at the
    same distance the first becomes the child, and the others go down to it.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        n = len(prints)
        self.prints = prints
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        _, first, number = np.unique(group, return_index=True, return_inverse=True)
        self.roots, self.tree = first, number
        at = first[number]
        waiting = np.flatnonzero(at != np.arange(n))
        at = at[waiting]
        while len(waiting):
            distance = np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
            key = at * 65 + distance
            _, first, slot = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]
            parent[child], edge[child] = at[first], distance[first]
            down = child[slot]
            left = down != waiting
            waiting, at = waiting[left], down[left]
        self.order = np.lexsort((edge, parent))
        key = parent[self.order] * 65 + edge[self.order]
        self.keys = key
        self.parents = parent[self.order]

    def within(self, query: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of all pairs at ``radius`` or less; ``tree`` numbers the tree each query searches.

        Only edges from distance - radius to distance + radius are followed.
        """
        for start in range(0, len(query), FRONTIER // 8):
            stack = [(np.arange(start, min(start + FRONTIER // 8, len(query))), self.roots[tree[start:start + FRONTIER // 8]])]
            while stack:
                asked, node = stack.pop()
                if len(asked) > FRONTIER:
                    half = len(asked) // 2
                    stack += [(asked[:half], node[:half]), (asked[half:], node[half:])]
                    continue
                distance = np.bitwise_count(query[asked] ^ self.prints[node]).astype(np.int64)
                near = distance <= radius
                yield asked[near], node[near], distance[near]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0), side="left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), side="right")
                more = high - low
                if more.any():
                    stack.append((np.repeat(asked, more), self.order[ragged(low, more)]))


class Joined:
    """Sets of ``n`` items, joined by pairs; of all pairs, nearer ones first, those that join two sets are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        for d in np.unique(distance):
            at = distance == d
            self._join(a[at], b[at])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            # the greater of two labels hooks to the lesser; one pair for each label that hooks, so there is no circle
            hooks, first = np.unique(np.maximum(la, lb), return_index=True)
            self.label[hooks] = np.minimum(la, lb)[first]
            self.kept.append((a[first], b[first]))
            while not np.array_equal(self.label, hop := self.label[self.label]):
                self.label = hop

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.kept, strict=True))
