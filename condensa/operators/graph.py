"""Connected graph selection: nodes and edges of the largest weight, reachable from a root, at most one edge into a node."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.operators import rooted


def arborescence(nodes: frozenset[int], edges: dict[tuple[int, int], float], roots: set[int]) -> tuple[float, list[tuple[int, int]]] | None:
    """The heaviest set of edges that reaches all nodes from one root, one edge into each other node; None if none does."""

    def best(vertices: set, arcs: dict, root):
        into = {}
        for (a, b), (w, _) in sorted(arcs.items(), key=str):
            if b != root and a != b and (b not in into or w > arcs[into[b]][0]):
                into[b] = (a, b)
        if set(into) != vertices - {root}:
            return None
        for start in sorted(vertices, key=str):  # a cycle of best edges is contracted
            seen, x = [], start
            while x in into and x not in seen:
                seen.append(x)
                x = into[x][0]
            if x in seen:
                cycle = seen[seen.index(x) :]
                break
        else:
            return [arcs[e][1] for e in into.values()]
        c, inside = ("c", *map(str, cycle)), set(cycle)
        new: dict = {}
        leave = {}
        for (a, b), (w, orig) in arcs.items():
            if a in inside and b in inside:
                continue
            key, weight = (c if a in inside else a, c if b in inside else b), w - arcs[into[b]][0] if b in inside else w
            if key not in new or weight > new[key][0]:
                new[key] = weight, orig
                if b in inside:
                    leave[orig] = b
        sub = best((vertices - inside) | {c}, new, root)
        if sub is None:
            return None
        entry = next(leave[o] for o in sub if o in leave and new.get(next((k for k, v in new.items() if v[1] == o), None), (0, None))[1] == o)
        return sub + [arcs[into[x]][1] for x in cycle if x != entry]

    found = None
    for root in sorted(nodes & roots):
        arcs = {(a, b): (w, (a, b)) for (a, b), w in edges.items() if a in nodes and b in nodes}
        if len(nodes) == 1:
            return 0.0, []
        got = best(set(nodes), arcs, root)
        if got is not None:
            weight = sum(edges[e] for e in got)
            if found is None or weight > found[0] + 1e-12:
                found = weight, sorted(got)
    return found


def _grown(node_weight: dict[int, float], edges: dict[tuple[int, int], float], roots: set[int], size: int | None) -> tuple[float, list[int], list[tuple[int, int]]] | None:
    """The best of trees that grow from each root by the heaviest edge with its node, while that gains or up to the size."""
    best = None
    for root in sorted(roots & set(node_weight)):
        weight, picked, used = node_weight[root], {root}, []
        while size is None or len(picked) < size:
            step = max(((w + node_weight[b], (-a, -b)) for (a, b), w in edges.items() if a in picked and b in node_weight and b not in picked), default=None)
            if step is None or size is None and step[0] <= 0:
                break
            a, b = -step[1][0], -step[1][1]
            weight, used = weight + step[0], [*used, (a, b)]
            picked.add(b)
        if (best is None or weight > best[0]) and (size is None or len(picked) == size):
            best = weight, sorted(picked), sorted(used)
    return best


def select_subgraph(node_weight: dict[int, float], edges: dict[tuple[int, int], float], roots: set[int], size: int | None = None) -> tuple[float, list[int], list[tuple[int, int]]]:
    """(weight, nodes, edges): the heaviest choice; nothing at 0 is a choice unless a size is asked for."""
    names = sorted(node_weight)
    at = {x: i for i, x in enumerate(names)}
    edge = np.full((len(names), len(names)), -np.inf)
    for (a, b), w in edges.items():
        if a in at and b in at and a != b:
            edge[at[a], at[b]] = w
    search = rooted.Search(np.array([node_weight[x] for x in names], float), edge, np.array([x in roots for x in names], bool), size)
    grown = _grown(node_weight, edges, roots, size)
    start = (grown[0], [at[x] for x in grown[1]], [(at[a], at[b]) for a, b in grown[2]]) if grown else None
    weight, picked, used = search.run(start) if names else ((0.0, [], []) if not size else (float("-inf"), [], []))
    return weight, [names[i] for i in picked], [(names[a], names[b]) for a, b in used]


def select_graphs(nodes: DataFrame, edges: DataFrame, size: int | None = None) -> DataFrame:
    """(g, node, picked) from nodes(g, node, weight, root) and edges(g, src, dst, weight); a graph is one task's unit."""
    rows = nodes.select("g", F.col("node").alias("a"), F.lit(None).cast("int").alias("b"), "weight", "root").unionByName(edges.select("g", F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"), "weight", F.lit(False).alias("root")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf[pdf["b"].isna()]
        e = pdf[pdf["b"].notna()]
        _, picked, _ = select_subgraph(dict(zip(n["a"], n["weight"])), {(int(a), int(b)): w for a, b, w in zip(e["a"], e["b"], e["weight"])}, set(n[n["root"]]["a"]), size)
        return pd.DataFrame({"g": n["g"], "node": n["a"], "picked": n["a"].isin(picked)})

    kind = dict(nodes.dtypes)["g"]
    return rows.groupBy("g").applyInPandas(run, f"g {kind}, node int, picked boolean")


def node_features(nodes: DataFrame) -> DataFrame:
    """(g, id, feature): nodes(g, id, concept, sources array<struct<line_num, start_idx, end_idx>>), and, if they have them, depth and entity.

    Names are opaque keys.  span/avg tests the longest span.
    """
    freq = F.size("sources")
    first = F.array_min(F.transform("sources", lambda s: s["line_num"]))
    spans = F.transform("sources", lambda s: s["end_idx"] - s["start_idx"])
    preds = [("bias", F.lit(True)), *((f"freq/{k}", freq > k) for k in (0, 1, 2, 5, 10)), *((f"position/{k}", first <= k) for k in (5, 6, 7, 10, 15)), *((f"span/avg/{k}", F.array_max(spans) > k) for k in (1, 2, 3, 4, 5))]
    if "depth" in nodes.columns:
        preds += [(f"depth/{k}", F.col("depth") <= k) for k in (1, 2, 3, 4, 5)]
    if "entity" in nodes.columns:
        preds += [("entity/collapsed", F.col("entity"))]
    held = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in preds), F.concat(F.lit("concept/"), "concept")))
    return nodes.select("g", "id", F.explode(held).alias("feature"))


def edge_features(edges: DataFrame) -> DataFrame:
    """(g, src, dst, feature): edges(g, src, dst, sources array<struct<relation, line_num>>)."""
    freq = F.size("sources")
    names = F.filter(F.transform("sources", lambda s: s["relation"]), lambda r: r.isNotNull())
    first = F.array_min(F.transform("sources", lambda s: s["line_num"]))
    preds = [("bias", F.lit(True)), ("null", F.size(names) == 0), *((f"freq/{k}", freq > k) for k in (0, 1, 2, 5, 10)), *((f"nonnull_freq/{k}", F.size(names) > k) for k in (0, 1, 2, 5, 10)), *((f"position/{k}", first <= k) for k in (5, 6, 7, 10, 15))]
    held = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in preds)))
    return edges.select("g", "src", "dst", F.explode(F.concat(held, F.transform(F.array_distinct(names), lambda r: F.concat(F.lit("relation/"), r)))).alias("feature"))


def with_tag(features: DataFrame, tag: str) -> DataFrame:
    return features.withColumn("feature", F.concat(F.lit(f"{tag}/"), "feature"))


def decode(nodes: DataFrame, edges: DataFrame, weights: DataFrame, gold: DataFrame | None = None, cost: float = 1.0, size: int | None = None) -> DataFrame:
    """(g, node, picked) of graphs whose weights are learned: nodes(g, node, root, feature), edges(g, src, dst, feature), weights(feature, w).

    With gold(g, node), as in training, nodes that the gold choice lacks weigh
    `cost` more and its own `cost` less, so that the decoder errs on the worst side.
    """
    w = weights.select("feature", "w")
    n = nodes.join(w, "feature", "left").groupBy("g", "node").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("weight"), F.max("root").alias("root"))
    e = edges.join(w, "feature", "left").groupBy("g", "src", "dst").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("weight"))
    if gold is not None:
        told = n.join(gold.select("g", "node").distinct().withColumn("good", F.lit(True)), ["g", "node"], "left")
        n = told.withColumn("weight", F.col("weight") + F.when(F.col("good"), -cost).otherwise(cost)).drop("good")
    return select_graphs(n.select("g", "node", "weight", "root"), e, size)


def chosen_features(picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, feature, n): how often the chosen nodes have each feature."""
    return nodes.join(picked.where("picked").select("g", "node"), ["g", "node"]).groupBy("g", "feature").agg(F.count("*").alias("n"))


def choice_score(nodes: DataFrame, weights: DataFrame, choice: DataFrame) -> DataFrame:
    """(g, score): the summed weights of a choice's features, as of the gold one."""
    held = nodes.join(choice.select("g", "node").distinct(), ["g", "node"]).join(weights, "feature")
    return held.groupBy("g").agg(F.sum("w").alias("score"))


def conjoined_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, src, dst, feature): each edge with the pairs of its ends' features."""
    a = nodes.select("g", F.col("id").alias("src"), F.col("feature").alias("one"))
    b = nodes.select("g", F.col("id").alias("dst"), F.col("feature").alias("two"))
    pair = F.concat_ws("&", "one", "two").alias("feature")
    return edges.select("g", "src", "dst").join(a, ["g", "src"]).join(b, ["g", "dst"]).select("g", "src", "dst", pair)
