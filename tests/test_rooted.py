import itertools
import time

import numpy as np
import pytest

from condensa.operators import graph, rooted


def draw(seed, n, share=0.4):
    rng = np.random.default_rng(seed)
    node = {i: float(rng.integers(-6, 7)) for i in range(n)}
    edges = {(a, b): float(rng.integers(-5, 5)) for a in range(n) for b in range(n) if a != b and rng.random() < share}
    return node, edges, {int(x) for x in rng.choice(n, max(1, n // 3), replace=False)}


@pytest.mark.parametrize("seed", range(40))
def test_branchings_are_the_heaviest(seed):
    """Against every choice of one edge into each node."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 6))
    w = np.where(rng.random((n, n)) < 0.8, rng.normal(size=(n, n)), -np.inf)
    w[0, 1:] = rng.normal(size=n - 1) - 1
    np.fill_diagonal(w, -np.inf)
    best = -np.inf
    for came in itertools.product(range(n), repeat=n - 1):
        reach, grew = {0}, True
        while grew:
            more = {b + 1 for b, a in enumerate(came) if a in reach} - reach
            reach, grew = reach | more, bool(more)
        if len(reach) == n:
            best = max(best, sum(w[a, b + 1] for b, a in enumerate(came)))
    got = rooted.branching(w)
    assert sum(w[got[b], b] for b in range(1, n)) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(16))
def test_choices_are_those_of_all_subsets(seed):
    n = 6 + seed % 7
    node, edges, roots = draw(seed, n)
    size = 3 if seed % 4 == 3 else None
    best = 0.0 if not size else float("-inf")
    for k in range(1, n + 1) if not size else [size]:
        for sub in itertools.combinations(range(n), k):
            if tree := graph.arborescence(frozenset(sub), edges, roots):
                best = max(best, tree[0] + sum(node[x] for x in sub))
    weight, nodes, used = graph.select_subgraph(node, edges, roots, size)
    assert weight == pytest.approx(best)
    if nodes:
        assert weight == pytest.approx(sum(node[x] for x in nodes) + sum(edges[e] for e in used))
        root = set(nodes) - {b for _, b in used}
        assert len(used) == len(nodes) - 1 and len(root) == 1 and root <= roots and {a for a, _ in used} <= set(nodes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sixty_nodes_are_exact_in_a_minute(seed):
    """Weights below 0 but for a few nodes, which cheap edges join: the choice has to pay for what lies between."""
    rng = np.random.default_rng(seed)
    node = {i: float(np.round(rng.uniform(4, 9) if rng.random() < 0.25 else -rng.uniform(0.5, 4), 2)) for i in range(60)}
    edges = {(a, b): -float(np.round(rng.uniform(0.1, 2), 2)) for a in range(60) for b in range(60) if a != b and rng.random() < 0.08}
    began = time.time()
    weight, nodes, used = graph.select_subgraph(node, edges, set(range(0, 60, 4)))
    assert time.time() - began < 60
    assert weight == pytest.approx(sum(node[x] for x in nodes) + sum(edges[e] for e in used)) and len(used) == len(nodes) - 1
    print(f"{weight:.2f} with {len(nodes)} nodes in {time.time() - began:.1f} s")
