"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score is the sum of partial scores over m blocks of dimensions, so
each block is a score list in the threshold algorithm's sense.
1. Every partition gathers its k best entries of each list and keeps the k best
   totals among them; the k-th best total over all partitions is a lower bound
   t of the k-th best score.
2. t is broadcast.  An entry whose partial scores are all below t / m has a
   total below t, so only entries with a partial of at least t / m, the same
   cutoff for each list, are sufficient and collected.
3. Their totals are resolved exactly, those below t are dropped, and the rest
   is ranked.
Queries go through in blocks of bounded size; blocks are read from a table, so
neither their number nor the candidates reach the driver at once.

This runs on 64-bit integers.  Vectors so large that a score could leave them
(beyond 2**31 over the square root of the dimensions, scaled) are told apart:
every pair with one of them is scored in Python's integers, and both results
are ranked together, by exact scores.  A score beyond 64 bits is told as the
largest or least of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.scratch import Scratch

#: Queries broadcast at once, and candidates scored at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 1024
_LOW = -np.iinfo(np.int64).max  # can be negated


def scaled(column: pa.Array, scale: float, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) as a matrix, zero-filled on the right; which rows are valid): those of narrow vectors, or of wide ones as Python integers."""
    valid = np.asarray(pc.is_valid(column))
    column = column.filter(pa.array(valid))
    rows = np.flatnonzero(valid)
    offsets = np.asarray(column.offsets, np.int64)
    values = np.asarray(pc.cast(column.values, pa.float64()).to_numpy(zero_copy_only=False))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    out = np.zeros((len(rows), int(size.max(initial=0))))
    at = np.repeat(np.arange(len(rows)), size)
    out[at, np.arange(len(values)) - np.repeat(offsets[:-1], size)] = values
    finite = np.isfinite(out).all(1)
    out = out[finite]
    narrow = (np.abs(out).max(1, initial=0) * abs(scale) * np.sqrt(np.maximum(size[finite], 1))) < 2.0**31
    if not wide:
        return np.floor(scale * out[narrow]), rows[finite][narrow]
    exact = [[math.floor(Fraction(scale) * Fraction(x)) for x in v] for v in out[~narrow].tolist()]
    return np.array(exact, object).reshape(len(exact), out.shape[1]), rows[finite][~narrow]


def _width(m: np.ndarray, d: int) -> np.ndarray:
    return m[:, :d] if m.shape[1] >= d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


def _score(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where every sum is exact, else in 64-bit integers; wide ones as they are."""
    if q.dtype == object or v.dtype == object:
        return q @ v.T
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1) < 2.0**53:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


class Block:
    """Queries of one block: ids, matrix and the number of lists."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, lists: int, scale: float):
        self.ids, self.matrix, self.k, self.scale = ids, matrix, k, scale
        self.cuts = np.linspace(0, matrix.shape[1], min(lists, max(1, matrix.shape[1])) + 1).astype(int)

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """(candidate ids, partial scores of each list, whether query and candidate differ)."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                m, rows = scaled(part.column("vector"), self.scale)
                ids = np.asarray(part.column("vec_id"), np.int64)[rows]
                m = _width(m, self.matrix.shape[1])
                if len(ids):
                    yield ids, [_score(self.matrix[:, a:b], m[:, a:b]) for a, b in zip(self.cuts[:-1], self.cuts[1:])], self.ids[:, None] != ids[None, :]


def _gather(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        k, best = block.k, np.full((len(block.ids), block.k), _LOW)
        for ids, parts, other in block.parts(batches):
            total = np.where(other, sum(parts), _LOW)
            keep = min(k, len(ids))
            seen = np.concatenate([np.argpartition(np.where(other, -p, np.iinfo(np.int64).max), keep - 1, axis=1)[:, :keep] for p in parts], 1)
            seen.sort(1)
            got = np.take_along_axis(total, seen, 1)
            got[:, 1:][seen[:, 1:] == seen[:, :-1]] = _LOW  # an entry counts once
            best = -np.sort(-np.concatenate([best, got], 1), 1)[:, :k]
        q, r = np.nonzero(best > _LOW)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, r])], names=["q", "total"])

    return run


def _collect(shared, cutoff) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low = shared.value, cutoff.value
        for ids, parts, other in block.parts(batches):
            share = low[:, None] / len(parts)
            enough = np.zeros(other.shape, bool)
            for p in parts:
                enough |= p >= share
            q, c = np.nonzero(enough & other)
            total = sum(p[q, c] for p in parts)
            keep = total >= low[q]
            yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int32)), pa.array(ids[c[keep]]), pa.array(total[keep])], names=["q", "vec_id", "score"])

    return run


def _key(score: int) -> bytes:
    """Bytes in the order of whole numbers: sign, length of the magnitude, magnitude; the last two turned over below 0."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    told = len(raw).to_bytes(4, "big") + raw
    return b"\x01" + told if score >= 0 else b"\x00" + bytes(255 - x for x in told)


def _exact(shared) -> object:
    """The k best of a partition's pairs that have a wide vector on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, narrow, wide_ids, wide, k, scale = shared.value
        best: dict[int, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                theirs = np.asarray(part.column("vec_id"), np.int64)
                for is_wide in (False, True):
                    m, rows = scaled(part.column("vector"), scale, is_wide)
                    for names, q in ((ids, narrow), (wide_ids, wide)):
                        if not len(rows) or not len(names) or (q is narrow and not is_wide):
                            continue
                        d = max(m.shape[1], q.shape[1])
                        whole = [np.array([[int(x) for x in v] for v in y.tolist()], object).reshape(len(y), y.shape[1]) for y in (q, m)]
                        score = _width(whole[0], d) @ _width(whole[1], d).T
                        for i, name in enumerate(names.tolist()):
                            heap = best.setdefault(name, [])
                            for other, s in zip(theirs[rows].tolist(), score[i]):
                                if other != name:
                                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (int(s), -other, 0))
        rows = [(q, -v, s) for q, heap in best.items() for s, v, _ in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([max(-(1 << 63), min((1 << 63) - 1, r[2])) for r in rows], pa.int64()), pa.array([_key(r[2]) for r in rows], pa.binary())],
            names=["query_id", "vec_id", "score", "key"],
        )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, scale: float = 256.0, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors(vec_id, vector).

    Score: inner product of floor(scale * x).  Ties go to the smaller vec_id.
    Rows with the query's own vec_id are no candidates.  A vector that is null
    or holds a null or non-finite component, and a row without vec_id, take no
    part; the shorter of two vectors counts as filled up with zeros.  Repeated
    candidate rows each take a rank; equal repeated query rows are answered
    once.  Fewer candidates than k give fewer ranks; no queries, no rows.  All
    finite vectors take part, however large; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    table = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).distinct()
    n = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = scratch.keep(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).repartition(F.col("block")), "queries")
    large = F.expr(f"array_max(transform(vector, x -> abs(x))) * {abs(scale)}D * sqrt(size(vector)) >= 2147483648D AND NOT exists(vector, x -> x IS NULL OR x <> x OR abs(x) = double('infinity'))")
    any_wide = not table.where(large).limit(1).unionByName(asked.select("vec_id", "vector").where(large).limit(1)).isEmpty()
    results = []
    for b in range(n):
        rows = asked.where(F.col("block") == b).orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        vector, names = rows.column("vector").combine_chunks(), np.asarray(rows.column("vec_id"), np.int64)
        matrix, good = scaled(vector, scale)
        found = []
        if len(good):
            found.append(_narrow(spark, table, Block(names[good], matrix, k, lists, scale)))
        if any_wide:
            wide, which = scaled(vector, scale, True)
            shared = spark.sparkContext.broadcast((names[good], matrix, names[which], wide, k, scale))
            found.append(table.mapInArrow(_exact(shared), "query_id long, vec_id long, score long, key binary"))
            if len(found) > 1:
                found[0] = found[0].mapInArrow(_keyed, "query_id long, vec_id long, score long, key binary")
        if not found:
            continue
        whole = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        order = Window.partitionBy("query_id").orderBy(F.desc("key" if any_wide else "score"), "vec_id")
        top = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(scratch.keep(top, f"block{b}") if n > 1 else top)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if n == 1:
        return results[0]
    return spark.read.schema(results[0].schema).option("recursiveFileLookup", True).parquet(scratch.path("block*"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("key", pa.array([_key(x) for x in b.column("score").to_pylist()], pa.binary()))


def _narrow(spark, table: DataFrame, block: Block) -> DataFrame:
    """(query_id, vec_id, score) of a block's sufficient entries among narrow vectors, by the three phases."""
    shared = spark.sparkContext.broadcast(block)
    first = table.mapInArrow(_gather(shared), "q int, total long")
    low = np.full(len(block.ids), float("-inf"))
    ranked = first.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("total"), asc=False), 1, block.k).alias("best"))
    for r in ranked.where(F.size("best") == block.k).select("q", F.element_at("best", block.k).alias("low")).collect():
        low[r.q] = r.low
    found = table.mapInArrow(_collect(shared, spark.sparkContext.broadcast(low)), "q int, vec_id long, score long")
    ids = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids)], "q int, query_id long")
    return found.join(F.broadcast(ids), "q").select("query_id", "vec_id", "score")
