"""Heaviest connected choice of nodes and edges below one root: an exact search with bounds of a Lagrangian dual.

A choice is a tree: one node is its root, every other one has one edge into it
from a chosen node.  That an edge's start is chosen, that there is one root,
and a size if one is asked for, are priced.  What is left is the heaviest
branching, in which each node comes by an edge, as a root, or not at all; it is
found exactly, so cycles never enter the bound.  Any prices give an upper bound.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Price steps at the root of the search and in its nodes.
ROOT_STEPS, NODE_STEPS = 300, 25
SMALL = 1e-9


def branching(w: np.ndarray) -> np.ndarray:
    """The heaviest spanning tree below node 0 by w[start, end]: the start of each node's edge; -inf is no edge. Cycles of best edges are contracted."""
    n = len(w)
    into = w.argmax(0)
    into[0] = 0
    seen = np.zeros(n, int)
    cycle = None
    for start in range(1, n):
        x, walk = start, start
        while x and not seen[x]:
            seen[x], x = walk, into[x]
        if x and seen[x] == walk:
            cycle = [x]
            while into[cycle[-1]] != x:
                cycle.append(into[cycle[-1]])
            break
    if cycle is None:
        return into
    inside = np.zeros(n, bool)
    inside[cycle] = True
    rest, cycle = np.flatnonzero(~inside), np.array(cycle)
    enter = w[np.ix_(rest, cycle)] - w[into[cycle], cycle]
    leave = w[np.ix_(cycle, rest)]
    small = np.full((len(rest) + 1, len(rest) + 1), -np.inf)
    small[:-1, :-1] = w[np.ix_(rest, rest)]
    small[:-1, -1], small[-1, :-1] = enter.max(1), leave.max(0)
    np.fill_diagonal(small, -np.inf)
    got, out = branching(small), into.copy()
    out[rest] = np.where(got[:-1] == len(rest), cycle[leave.argmax(0)], rest[np.minimum(got[:-1], len(rest) - 1)])
    out[0] = 0
    out[cycle[enter[got[-1]].argmax()]] = rest[got[-1]]
    return out


@dataclass
class Part:
    """Part of the search: which nodes are in (1), out (-1) or open (0), and the prices that its bound starts from."""

    state: np.ndarray
    start: np.ndarray  # price that an edge's start is chosen
    root: float
    each: float


class Search:
    def __init__(self, node: np.ndarray, edge: np.ndarray, root: np.ndarray, size: int | None):
        """node weights, edge[start, end] weights with -inf where there is none, and which nodes can be the root."""
        self.node, self.edge, self.root, self.size, self.n = node, edge, root, size, len(node)
        self.has = np.isfinite(edge)
        self.best: tuple[float, list[int], list[tuple[int, int]]] = (0.0, [], []) if not size else (float("-inf"), [], [])

    def weights(self, p: Part) -> np.ndarray:
        """Of all edges and, from the first row, of being a root or not at all (0)."""
        gain = self.node + np.where(self.has, p.start, 0.0).sum(1) - p.each
        w = np.full((self.n + 1, self.n + 1), -np.inf)
        w[1:, 1:] = np.where(self.has, self.edge + gain[None] - p.start, -np.inf)
        w[0, 1:] = np.where(self.root, gain - p.root, -np.inf)
        out, in_ = p.state < 0, p.state > 0
        w[1:, 1:][out], w[1:, 1:][:, out], w[0, 1:][out] = -np.inf, -np.inf, 0.0
        none = ~out & ~in_ & (w[0, 1:] < 0)
        w[0, 1:][none] = 0.0
        self._rooted = np.concatenate([[False], self.root & ~out & ~none & (w[0, 1:] > -np.inf)])
        return w

    def bound(self, p: Part, steps: int) -> tuple[float, Part, np.ndarray]:
        """(upper bound, the part with better prices, how often each node was chosen)."""
        high, kept, often, scale, still = np.inf, p, np.zeros(self.n), 1.0, 0
        for _ in range(steps):
            w = self.weights(p)
            rooted = self._rooted
            came = branching(w)
            ends = np.arange(1, self.n + 1)
            value = w[came[1:], ends]
            if not np.isfinite(value).all():
                return -np.inf, p, often  # a node that has to be chosen can't be reached
            now = float(value.sum()) + p.root + p.each * (self.size or 0)
            by_edge, as_root = came[1:] > 0, (came[1:] == 0) & rooted[1:]
            chosen = by_edge | as_root
            often = 0.9 * often + 0.1 * chosen
            self._try(came, as_root)
            if now < high - 1e-9:
                high, kept, still = now, p, 0
            else:
                still += 1
                if still >= 10:
                    scale, still, p = scale / 2, 0, kept
                    if scale < 1e-3:
                        break
                    continue
            if high <= self.best[0] + SMALL:
                break
            used = np.zeros_like(self.has)
            used[came[1:][by_edge] - 1, ends[by_edge] - 1] = True
            slope = np.where(self.has, chosen[:, None].astype(float) - used, 0.0)
            slope[(p.start <= 0) & (slope > 0)] = 0
            roots = 1.0 - as_root.sum()
            roots = 0.0 if p.root <= 0 and roots > 0 else roots
            count = float((self.size or 0) - chosen.sum()) if self.size else 0.0
            length = float((slope * slope).sum() + roots * roots + count * count)
            if length < 1e-12:
                break
            step = scale * (now - max(self.best[0], now - max(1.0, abs(now)))) / length
            p = Part(p.state, np.maximum(0.0, p.start - step * slope), max(0.0, p.root - step * roots), p.each - step * count)
        return high, kept, often

    def _try(self, came: np.ndarray, as_root: np.ndarray) -> None:
        """The trees below the roots of a branching, cut where a subtree weighs less than nothing."""
        if self.size and not as_root.any():
            return
        below: dict[int, list[int]] = {}
        for x in range(self.n):
            if came[x + 1] > 0:
                below.setdefault(int(came[x + 1]) - 1, []).append(x)

        for r in np.flatnonzero(as_root).tolist():
            order, walk = [], [r]
            while walk:
                x = walk.pop()
                order.append(x)
                walk += below.get(x, [])
            if self.size:
                if len(order) == self.size:
                    self._offer(order, [(int(came[x + 1]) - 1, x) for x in order if x != r])
                continue
            total = dict.fromkeys(order, 0.0)
            for x in reversed(order):
                total[x] += self.node[x]
                if x != r:
                    a = int(came[x + 1]) - 1
                    total[a] += max(0.0, total[x] + self.edge[a, x])
            kept, walk = [], [r]
            while walk:
                x = walk.pop()
                kept.append(x)
                walk += [y for y in below.get(x, []) if total[y] + self.edge[x, y] > 0]
            self._offer(kept, [(int(came[x + 1]) - 1, x) for x in kept if x != r])

    def _offer(self, nodes: list[int], edges: list[tuple[int, int]]) -> None:
        weight = float(self.node[nodes].sum() + sum(self.edge[e] for e in edges))
        if weight > self.best[0] + SMALL:
            self.best = weight, sorted(nodes), sorted(edges)

    def run(self, start: tuple | None = None) -> tuple[float, list[int], list[tuple[int, int]]]:
        if start and start[0] > self.best[0]:
            self.best = start
        first = Part(np.zeros(self.n, int), np.zeros((self.n, self.n)), 0.0, 0.0)
        queue, turn = [(-np.inf, 0, first)], 0
        while queue:
            above, _, p = heapq.heappop(queue)
            if -above <= self.best[0] + SMALL:
                break
            high, p, often = self.bound(p, NODE_STEPS if turn else ROOT_STEPS)
            high = min(high, -above)
            if high <= self.best[0] + SMALL:
                continue
            undecided = np.flatnonzero(p.state == 0)
            if not len(undecided):
                self._settle(p)
                continue
            x = undecided[np.abs(often[undecided] - 0.5).argmin()]
            for s in (1, -1):
                state = p.state.copy()
                state[x] = s
                if self.size and ((state > 0).sum() > self.size or (state >= 0).sum() < self.size):
                    continue
                turn += 1
                heapq.heappush(queue, (-high, turn, Part(state, p.start, p.root, p.each)))
        return self.best

    def _settle(self, p: Part) -> None:
        """All nodes are decided: the heaviest tree over those that are in, from each root."""
        inside = np.flatnonzero(p.state > 0)
        if not len(inside) or self.size and len(inside) != self.size:
            return
        for r in inside[self.root[inside]]:
            w = np.full((len(inside) + 1, len(inside) + 1), -np.inf)
            w[1:, 1:] = self.edge[np.ix_(inside, inside)]
            w[0, 1 + np.searchsorted(inside, r)] = 0.0
            w[1:, 1 + np.searchsorted(inside, r)] = -np.inf
            w[0, 1:][w[0, 1:] < 0] = -1e18  # no other root
            came = branching(w)[1:]
            value = w[came, np.arange(1, len(inside) + 1)]
            if np.isfinite(value).all() and value.min() > -1e17:
                self._offer(inside.tolist(), [(int(inside[a - 1]), int(x)) for a, x in zip(came, inside) if a])
