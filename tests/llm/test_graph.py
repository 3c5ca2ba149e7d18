"""Components against a plain search, and rounds on long chains."""

import random

from condensa.llm.graph import components
from condensa.llm.scratch import Scratch


def _found(spark, edges, monkeypatch=None):
    names, keep = [], Scratch.keep
    if monkeypatch:
        monkeypatch.setattr(Scratch, "keep", lambda self, df, name, **k: names.append(name) or keep(self, df, name, **k))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "graph"), "c").collect()}
    return got, names


def _plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [] if x in out else [x]
        while todo:
            if (y := todo.pop()) not in out:
                out[y] = x
                todo += near[y]
    return out


def test_a_descending_chain_takes_few_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)]
    got, names = _found(spark, edges, monkeypatch)
    assert got == dict.fromkeys(range(41), 0)
    assert len(names) <= 10


def test_components_are_those_of_a_plain_search(spark):
    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(-100, 100), rng.randrange(-100, 100)) for _ in range(90)) if a != b]
    edges += [(1000, x) for x in range(1001, 1020)] + edges[:5]
    assert _found(spark, edges)[0] == _plain(edges)
