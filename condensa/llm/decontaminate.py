"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark goes through in blocks of bounded size.  A block's word n-grams,
and pairs of words next to each other or with one between, are counted over all
documents first; an item's seeds are those that few documents hold (RARE_SHARE
of them or RARE_DOCS at most; of n-grams also those no commoner than the item's
median one).  A second pass joins passages to items through seeds in the tasks
that read the documents, so no text is shuffled.  A passage with one n-gram of
an item or two different pairs is aligned with it word by word: the pairs find
copies that an edit every few words leaves no n-gram of.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from condensa.llm import blocks
from condensa.llm.scratch import Scratch

U64 = np.uint64
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 4 << 20
RARE_SHARE, RARE_DOCS = 1e-4, 50
MATCH, MISMATCH, GAP = 2, -1, -1
_TABLE_BITS = 20
MATCHES = "item_id long, score double, begin_word long, end_word long, passage string"


class Items(NamedTuple):
    """Items of a block, and their seeds in the order of the seeds' hashes."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray  # uint64, sorted, distinct
    first: np.ndarray  # offsets into item and place by seed
    item: np.ndarray
    place: np.ndarray  # times the number of shapes, plus the seed's shape
    table: np.ndarray  # whether a seed has these leading bits


#: Shapes of seeds: 0 is a run of n words, or all of an item that is shorter; the others are pairs so many words apart.
APART = (1, 2)
SHAPES = 1 + len(APART)


def shaped(w: blocks.Words, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, first word) of the seeds of each shape, all texts together."""
    grams, _, first = blocks.shingles(w.hash, w.rows, n)
    yield grams, first
    end = np.repeat(w.rows[1:], np.diff(w.rows))
    for apart in APART:
        first = np.flatnonzero(np.arange(len(w.hash)) + apart < end)
        yield blocks.mix(w.hash[first] * U64(2 * apart + 1) + blocks.mix(w.hash[first + apart] + U64(apart))), first


def part_seeds(w: blocks.Words, lengths: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, first word) of runs as long as the items that are too short for an n-gram."""
    for size in sorted(lengths):
        grams, _, first = blocks.shingles(w.hash, w.rows, size)
        yield blocks.mix(grams + U64(size)), first


def build_items(rows: list[Row], n: int) -> Items:
    w = blocks.words(pa.array([r["text"] for r in rows], pa.string()))
    sizes = np.diff(w.rows)
    found = []
    for shape, (grams, first) in enumerate(shaped(w, n)):
        item = np.searchsorted(w.rows, first, "right") - 1
        long = sizes[item] >= n
        found.append((grams[long], item[long], (first - w.rows[item])[long] * SHAPES + shape))
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):  # all of a short item is its only seed
        own = w._replace(hash=w.hash[w.rows[i] : w.rows[i + 1]], rows=np.array([0, sizes[i]]))
        grams, _ = next(part_seeds(own, {int(sizes[i])}))
        found.append((grams, np.array([i]), np.array([0])))
    grams, item, place = (np.concatenate(x) for x in zip(*found))
    return _index([r["item_id"] for r in rows], [w.hash[a:b] for a, b in zip(w.rows[:-1], w.rows[1:])], grams, item, place)


def _index(ids: list, words: list, grams: np.ndarray, item: np.ndarray, place: np.ndarray) -> Items:
    order = np.argsort(grams, kind="stable")
    grams, item, place = grams[order], item[order], place[order]
    seeds, first = np.unique(grams, return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(seeds >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return Items(ids, words, seeds, np.append(first, len(grams)), item, place, table)


def rare_only(items: Items, df: np.ndarray, n_docs: int) -> Items:
    """The items with only their rare seeds."""
    by_use = np.repeat(df, np.diff(items.first))
    limit = np.zeros(len(items.ids))
    runs = np.flatnonzero(items.place % SHAPES == 0)
    order = runs[np.lexsort((by_use[runs], items.item[runs]))]
    sizes = np.bincount(items.item[runs], minlength=len(items.ids))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # the only seed of a short item has to be rare
    some = (sizes > 0) & (np.array([len(x) for x in items.words]) > 2)
    limit[some] = by_use[order][(starts + (sizes - 1) // 2)[some]]
    limit = np.where(items.place % SHAPES == 0, limit[items.item], 0)
    keep = by_use <= np.maximum(limit, max(RARE_SHARE * n_docs, RARE_DOCS))
    return _index(items.ids, items.words, np.repeat(items.seeds, np.diff(items.first))[keep], items.item[keep], items.place[keep])


def seed_hits(items: Items, w: blocks.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, seed) of every seed in the texts."""
    found = []
    short = {len(x) for x in items.words if 0 < len(x) < n}
    for grams, first in itertools.chain(shaped(w, n), part_seeds(w, short)):
        maybe = np.flatnonzero(items.table[(grams >> U64(64 - _TABLE_BITS)).astype(np.int64)])
        if len(maybe) and len(items.seeds):
            spot = np.minimum(np.searchsorted(items.seeds, grams[maybe]), len(items.seeds) - 1)
            hit = items.seeds[spot] == grams[maybe]
            found.append((first[maybe[hit]], spot[hit]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    first, spot = (np.concatenate(x) for x in zip(*found))
    return np.searchsorted(w.rows, first, "right") - 1, first, spot


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(score, end) of the best local alignment, linear gaps; the first end among equals."""
    steps = np.arange(len(words)) * -GAP
    prev, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for x in item:
        row = np.maximum(prev[:-1] + np.where(words == x, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        prev[1:] = row
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax()) + 1
    return best, end


def aligned_span(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """(share of the item's perfect score, begin, end) of the best local alignment."""
    score, end = align(item, words)
    if not score:
        return 0.0, 0, 0
    _, back = align(item[::-1], words[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def leaks(items: Items, texts: pa.Array, n: int, threshold: float) -> Iterator[tuple[int, int, float, int, int, str]]:
    """(text, item, score, begin word, end word, passage) of each text's best passage for an item."""
    w = blocks.words(texts)
    text, at, seed = seed_hits(items, w, n)
    if not len(text):
        return
    uses = np.diff(items.first)[seed]
    text, at = np.repeat(text, uses), np.repeat(at, uses)
    entry = np.repeat(items.first[seed], uses) + np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
    item, place = items.item[entry], items.place[entry]
    start = at - place // SHAPES
    order = np.lexsort((start, item, text))
    text, item, start, place = text[order], item[order], start[order], place[order]
    size = np.array([len(x) for x in items.words])
    slack = size // 2 + 2
    lo = np.maximum(start - slack[item], w.rows[text])
    hi = np.minimum(start + size[item] + slack[item], w.rows[text + 1])
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(text)) - 1
    # one run of words, or two different pairs
    passage = np.cumsum(new) - 1
    pairs = np.unique(passage[place % SHAPES > 0] * (1 << 32) + place[place % SHAPES > 0]) >> 32
    enough = (np.bincount(pairs, minlength=len(begins)) > 1) | (np.bincount(passage[place % SHAPES == 0], minlength=len(begins)) > 0)
    begins, ends = begins[enough], ends[enough]
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(begins, ends):
        score, x, y = aligned_span(items.words[item[a]], w.hash[lo[a] : hi[b]])
        key = int(text[a]), int(item[a])
        if score >= threshold and score > best.get(key, (0.0,))[0]:
            best[key] = score, int(lo[a]) + x, int(lo[a]) + y
    for (t, i), (score, x, y) in best.items():
        yield t, i, score, x - int(w.rows[t]), y - int(w.rows[t]), w.data[w.start[x] : w.end[y - 1]].tobytes().decode("utf-8", "replace")


def _frequencies(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        df, docs = np.zeros(len(items.seeds), np.int64), 0
        for whole in batches:
            docs += whole.num_rows
            for batch in blocks.slices(whole, "text"):
                text, _, seed = seed_hits(items, blocks.words(batch.column("text")), n)
                df += np.bincount(np.unique(text * len(df) + seed) % max(1, len(df)), minlength=len(df)) if len(text) else 0
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(df[hit], docs))], names=["seed", "n"])

    return run


def _blocks_of(benchmark: DataFrame) -> Iterator[list[Row]]:
    """The benchmark's items in blocks of about BLOCK_CHARS, each read on its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = max(1, math.ceil((items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) / BLOCK_CHARS))
    for b in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()


def seeded_blocks(docs: DataFrame, benchmark: DataFrame, n: int) -> Iterator:
    """Broadcasts of the benchmark's blocks with rare seeds, counted over all documents: one after the other."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for rows in _blocks_of(benchmark):
        items = build_items(rows, n)
        all_seeds = spark.sparkContext.broadcast(items)
        counts = texts.mapInArrow(_frequencies(all_seeds, n), "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
        all_seeds.unpersist()
        df, docs_n = np.zeros(len(items.seeds), np.int64), 0
        for r in counts:
            if r.seed < 0:
                docs_n = r.n
            else:
                df[r.seed] = r.n
        yield spark.sparkContext.broadcast(rare_only(items, df, docs_n))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, begin_word, end_word, passage) for documents that hold a benchmark item.

    score: the best alignment's share of what the whole item would score; at
    least the threshold.  The span counts words of the document, the passage is
    its lower-cased text.  An item of fewer than n words is found where all of it
    stands, if that is rare; items without a word match nothing, and so do null
    and empty texts.  Of passages of one document that score
    alike for an item the first is told.  Each repeated document or item row
    gives rows of its own; null ids stay null; other columns are ignored.  Texts
    of any length are searched whole.  Of a benchmark of several blocks only one
    is held at a time: its matches are written before the next one's.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _by_block(texts, benchmark, n, lambda shared: texts.mapInArrow(_matches(shared, n, threshold), f"doc_id long, {MATCHES}"))


def _by_block(docs: DataFrame, benchmark: DataFrame, n: int, find: Callable) -> DataFrame:
    """What is found with each block; all but the last block's rows are written, and its broadcast is let go."""
    scratch, out, last = Scratch(docs.sparkSession, "leaks"), None, None
    for i, shared in enumerate(seeded_blocks(docs, benchmark, n)):
        if last is not None:
            done = scratch.keep(find(last), f"block{i}")
            out = done if out is None else out.unionByName(done)
            last.unpersist()
        last = shared
    return find(last) if out is None else out.unionByName(find(last))


def _matches(shared, n: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                got = [*zip(*leaks(items, batch.column("text"), n, threshold))] or [()] * 6
                ids = batch.column("doc_id").take(pa.array(got[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items.ids[i] for i in got[1]], pa.int64()), pa.array(got[2], pa.float64()), pa.array(got[3], pa.int64()), pa.array(got[4], pa.int64()), pa.array(got[5], pa.string())],
                    names=["doc_id", "item_id", "score", "begin_word", "end_word", "passage"],
                )

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item; null and empty texts stay."""
    blocks_ = [*itertools.islice(_blocks_of(benchmark), 2)]
    if len(blocks_) < 2:
        shared = next(seeded_blocks(docs, benchmark, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in blocks.slices(whole, "text"):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[m[0] for m in leaks(shared.value, batch.column("text"), n, threshold)]] = False
                    yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    # with more than one block, hashes of the texts that hold an item are gathered block by block
    look = F.xxhash64(F.col("text").cast("string"))
    texts = docs.select(look.alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = _by_block(texts, benchmark, n, lambda shared: texts.mapInArrow(_matches(shared, n, threshold), f"doc_id long, {MATCHES}").select("doc_id"))
    told = docs.select(F.struct("*").alias("doc"), F.when(F.col("text").isNotNull(), look).alias("look"))
    return told.join(gone.distinct(), F.col("look") == F.col("doc_id"), "left_anti").select("doc.*")
