"""Approximate nearest neighbours by a hierarchical k-means tree.

1. Rows of one vector become one entry with its smallest ids, as no answer can
   need more of them: copies never meet in one task as rows.
2. The tree is fitted on a bounded sample: k-means splits a node's vectors
   into branches until a leaf is small.  Every entry goes down to a leaf.
3. Calibration: for a bounded sample of the queries the true neighbours are
   found by brute force.  Visits are widened, leaf by leaf in the order of the
   search, until the share of true neighbours in the leaves seen reaches the
   target; that many leaves are visited for all queries.
4. A query goes down the tree best bin first: a priority queue holds the
   branches not taken, and the nearest one is opened next, until enough
   leaves are reached.  Queries meet the entries of a leaf in parts of
   bounded size, and the best of all leaves are ranked.

The tree is at most SAMPLE_VALUES numbers; neither entries nor queries are
collected.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.scratch import Scratch

#: Components of the sample that the tree is fitted on (65,536 vectors of 64), and of the vectors of one part of a leaf.
SAMPLE_VALUES, PART_VALUES = 1 << 22, 1 << 19
#: Entries that a leaf is to hold, as long as leaves are no more than MOST_LEAVES (small tables have smaller ones); branches of a node; k-means rounds.
LEAF, MOST_LEAVES, BRANCHES, ROUNDS = 1024, 4096, 16, 8
#: Queries whose true neighbours are found by brute force, and the share of these that the leaves seen have to hold.
CALIBRATE, TARGET = 256, 0.96
#: Queries of one part, and vectors compared with at once.
QUERY_PART, ROWS = 4096, 1024


@dataclass
class Tree:
    """Nodes in the order they were made: centres of the children and their numbers; a leaf has its number."""

    size: int
    centres: list[np.ndarray | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector goes down to, nearest centre by nearest centre."""
        out = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if self.centres[node] is None:
                out[rows] = self.leaf[node]
                continue
            near = _distances(vectors[rows], self.centres[node]).argmin(1)
            stack += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first search: the branch not yet taken whose centre is nearest is opened next."""
        found, queue = [], [(0.0, 0)]
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if self.centres[node] is None:
                found.append(self.leaf[node])
                continue
            for far, child in zip(_distances(query[None], self.centres[node])[0].tolist(), self.children[node]):
                heapq.heappush(queue, (far, child))
        return found


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squares of x, which choose the same centre; for unit vectors also in the same order from node to node."""
    return (centres * centres).sum(1)[None] - 2 * (x @ centres.T)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centres, the centre of each vector), without empty centres."""
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    near = np.zeros(len(x), int)
    for _ in range(ROUNDS):
        near = np.concatenate([_distances(x[i : i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)])
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])[count > 0]
        centres = np.add.reduceat(x[order], starts, axis=0) / count[count > 0][:, None]
    near = np.concatenate([_distances(x[i : i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)])
    used = np.unique(near)
    return centres[used], np.searchsorted(used, near)


def grow(sample: np.ndarray, leaves: int, seed: int = 0) -> Tree:
    """A tree over unit vectors with about so many leaves; nodes of equal vectors aren't split."""
    tree, rng = Tree(sample.shape[1]), np.random.default_rng(seed)
    small = max(1.0, len(sample) / max(leaves, 1))
    stack = [(-1, np.arange(len(sample)))]
    while stack:
        parent, rows = stack.pop()
        node = len(tree.centres)
        if parent >= 0:
            tree.children[parent].append(node)
        tree.centres.append(None)
        tree.children.append([])
        tree.leaf.append(-1)
        k = min(BRANCHES, math.ceil(len(rows) / small))
        if k > 1:
            centres, near = _k_means(sample[rows], k, rng)
            if len(centres) > 1:
                tree.centres[node] = centres
                # children are numbered when popped: the last pushed first
                stack += [(node, rows[near == i]) for i in range(len(centres) - 1, -1, -1)]
                continue
        tree.leaf[node] = tree.leaves
        tree.leaves += 1
    return tree


def unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in doubles, scaled by powers of two so that no square leaves the range and filled with zeros; their norms)."""
    offsets = np.asarray(column.offsets, np.int64)
    values = np.asarray(column.values, np.float64)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    out = np.zeros((len(length), size))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], length)] = values
    _, exponent = np.frexp(np.abs(out).max(1, initial=0))
    out = np.ldexp(out, -exponent[:, None])
    return out, np.sqrt((out * out).sum(1))


def _leaf_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            x, norm = unit(batch.column("vector"), tree.size)
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(x / norm[:, None])), *batch.columns], names=["leaf", *batch.schema.names])

    return run


def _visit(shared, most: int):
    """A row for each query and leaf it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, norm = unit(part.column("vector"), tree.size)
                seen = [tree.visits(q, most) for q in x / norm[:, None]]
                which = np.repeat(np.arange(part.num_rows), [len(s) for s in seen])
                taken = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*seen, []]).astype(np.int32)), *taken.columns], names=["leaf", *taken.schema.names])

    return run


def cosines(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Of rows a[i] and b[i], summed in one order wherever the pair is met."""
    return (a * b).sum(1) / (a_norm * b_norm)


def nearest(q: tuple[np.ndarray, np.ndarray], own: np.ndarray, x: tuple[np.ndarray, np.ndarray], only: np.ndarray, only_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, cosine) of the k entries of x nearest to each query, and those as near as the k-th.

    own: the queries' ids; an entry that has no other id (only, only_id) is no candidate.
    """
    found = []
    for at in range(0, len(own), ROWS):
        part = slice(at, at + ROWS)
        near = (q[0][part] / q[1][part, None]) @ (x[0] / x[1][:, None]).T
        near[(own[part, None] == only_id[None]) & only[None]] = -np.inf
        m = min(k, near.shape[1])
        low = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
        i, j = np.nonzero((near >= low[:, None] - 1e-12) & (near > -np.inf))
        found.append((i + at, j))
    i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    return i, j, cosines(q[0][i], q[1][i], x[0][j], x[1][j])


def _single(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(whether an entry has a single id, its first id)."""
    offsets = np.asarray(ids.offsets, np.int64)
    return np.diff(offsets) == 1, np.asarray(ids.values.field("vec_id"), np.int64)[offsets[:-1]]


FOUND = "query long, own long, vec_id long, n int, score double"


def _search(size: int, k: int):
    """The ids of the k nearest entries of one part of a leaf to the queries that visit it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        if left.num_rows and right.num_rows:
            q, x = (unit(t.column("vector").combine_chunks(), size) for t in (left, right))
            ids, own = right.column("ids").combine_chunks(), np.asarray(left.column("own"), np.int64)
            i, j, score = nearest(q, own, x, *_single(ids), k)
            offsets = np.asarray(ids.offsets, np.int64)
            many = np.diff(offsets)[j]
            at = np.repeat(offsets[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i, score = np.repeat(i, many), np.repeat(score, many)
            vec_id, n = (np.asarray(ids.values.field(c), np.int64)[at] for c in ("vec_id", "n"))
            other = vec_id != own[i]
            columns = [c[other] for c in (np.asarray(left.column("query"), np.int64)[i], own[i], vec_id, n, score)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "own", "vec_id", "n", "score"])

    return run


def _brute(shared, k: int):
    """The k nearest entries of a partition to the queries of the calibration, with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, q, own = shared.value
        best = [[] for _ in own]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                leaf = np.asarray(part.column("leaf"))
                i, j, score = nearest(q, own, unit(part.column("vector"), size), *_single(part.column("ids")), k)
                for a, b, s in zip(i.tolist(), leaf[j].tolist(), score.tolist()):
                    (heapq.heappush if len(best[a]) < k else heapq.heappushpop)(best[a], (s, b))
        rows = [(a, s, b) for a, heap in enumerate(best) for s, b in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32())], names=["q", "score", "leaf"])

    return run


def calibrated(orders: list[list[int]], true: list[tuple[int, int]], target: float) -> int:
    """The least number of leaves, in the order each query visits them, that hold the target's share of (query, leaf of a true neighbour)."""
    place = [{leaf: i for i, leaf in enumerate(order)} for order in orders]
    ranks = sorted(place[q][leaf] for q, leaf in true)
    return ranks[max(0, math.ceil(target * len(ranks)) - 1)] + 1 if ranks else 1


_GOOD = "vec_id IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0) AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = TARGET, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of vectors(vec_id, vector) that are found, by cosine.

    Ties go to the smaller vec_id.  Rows with the query's own vec_id are no
    candidates.  A vector that is null, empty, zero or holds a null or
    non-finite component, and a row without vec_id, take no part; the shorter
    of two vectors counts as filled up with zeros.  Repeated candidate rows
    each take a rank; equal repeated query rows are answered once, different
    vectors of one query id each by itself.  Where fewer than k rows are in the leaves
    seen, all leaves are searched, so fewer candidates than k give them all;
    no queries or no vectors give no rows.  Other columns are ignored.  The
    result is the same in each run over the same rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "neighbours")
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(_GOOD)
    once = clean(vectors).groupBy("vector", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    # a query's own id is one of them at most, so k + 1 ids hold every answer
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = once.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = scratch.keep(few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")), "entries")
    asked = scratch.keep(clean(queries).distinct().select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("own"), "vector"), "asked")
    n, widest = entries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(widest, asked.agg(F.max(F.size("vector"))).first()[0])

    tree = grow(_sample(entries, n, max(256, SAMPLE_VALUES // size), size), min(MOST_LEAVES, math.ceil(max(n / LEAF, math.sqrt(n) / 2))))
    shared = spark.sparkContext.broadcast(tree)
    ids = "ids array<struct<vec_id:bigint,n:int>>"
    index = scratch.keep(entries.mapInArrow(_leaf_of(shared), f"leaf int, vector array<double>, {ids}"), "index")
    scratch.drop("entries")
    visits = _calibrate(index, asked, tree, size, k, target)

    routed = asked.mapInArrow(_visit(shared, visits), "leaf int, query long, own long, vector array<double>")
    found = _meet(scratch, routed, index, size, k, "found")
    # a query whose leaves hold fewer than k rows goes to all
    seen = found.groupBy("query").agg(F.sum("n").alias("rows")) if visits < tree.leaves else None
    if seen is not None:
        short = asked.join(seen, "query", "left").where(F.coalesce("rows", F.lit(0)) < k).select("query", "own", "vector")
        if not short.isEmpty():
            all_leaves = short.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(tree.leaves - 1)))).select("leaf", "query", "own", "vector")
            more = _meet(scratch, all_leaves, index, size, k, "more")
            found = found.join(short.select("query"), "query", "left_anti").unionByName(more)
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select(F.col("own").alias("query_id"), "rank", "vec_id", "score")


def _sample(entries: DataFrame, n: int, most: int, size: int) -> np.ndarray:
    """About so many unit vectors at most, those of the least hashes, in the order of these."""
    keyed = entries.select(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)).alias("h"), "vector")
    rows = (keyed if n <= most else keyed.where(F.col("h") < int((1 << 40) * most / n))).toArrow()
    x, norm = unit(rows.column("vector").combine_chunks(), size)
    return (x / norm[:, None])[np.lexsort((*x.T[:2], np.asarray(rows.column("h"))))]


def _calibrate(index: DataFrame, asked: DataFrame, tree: Tree, size: int, k: int, target: float) -> int:
    """How many leaves to visit, from the true neighbours of CALIBRATE queries."""
    spark = index.sparkSession
    rows = asked.orderBy(F.xxhash64("own", "vector"), "own").limit(CALIBRATE).toArrow()
    q, own = unit(rows.column("vector").combine_chunks(), size), np.asarray(rows.column("own"), np.int64)
    best = index.mapInArrow(_brute(spark.sparkContext.broadcast((size, q, own)), k), "q int, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    true = [(r.q, r.leaf) for r in best.withColumn("place", place).where(F.col("place") <= k).select("q", "leaf").collect()]
    return calibrated([tree.visits(x, tree.leaves) for x in q[0] / q[1][:, None]], true, target)


def _meet(scratch: Scratch, routed: DataFrame, index: DataFrame, size: int, k: int, name: str) -> DataFrame:
    """(query, own, vec_id, n, score) of the nearest entries in the leaves that queries are routed to.

    Entries of a leaf are dealt into parts and queries too, so that a leaf of
    any size is many small groups; each part of entries meets each of queries.
    """
    routed = scratch.keep(routed, f"{name}-routed")
    per_part = max(64, PART_VALUES // size)
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    asks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("q_parts"))
    counts = F.broadcast(sizes.join(asks, "leaf"))  # a row a leaf
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(counts, "leaf").withColumn("part", every("parts")).withColumn("q_part", piece("query", "q_parts")).select("leaf", "part", "q_part", "query", "own", "vector")
    right = index.join(counts, "leaf").withColumn("q_part", every("q_parts")).withColumn("part", piece("vector", "parts")).select("leaf", "part", "q_part", "vector", "ids")
    key = ["leaf", "part", "q_part"]
    met = scratch.keep(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(size, k), FOUND), name)
    scratch.drop(f"{name}-routed")
    return met
