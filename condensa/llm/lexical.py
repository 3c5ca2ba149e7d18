"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document is a whole number, known once the statistics of
the corpus are.  The index of a block of documents holds, for each term and
each bit of the impacts, a bitmap over the documents.  A query adds its terms'
bitmaps slice by slice with carries, as an adder does, so a word operation
scores 64 documents; the k best are found from the most significant slice
down, keeping the documents with the bit as long as at least k have it.

1. One pass over the texts counts documents, terms and the document
   frequencies of the terms that are asked for.
2. Another indexes the texts, block by block of its partition, and answers all
   queries of a block of queries on it.  Only the k best of each partition and
   query leave the task.

Documents don't meet in a shuffle, and a task holds one block of documents at
a time, so common terms and documents need no care of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.scratch import Scratch

#: Documents of a block: that many bits a bitmap has.
BLOCK = 1024
#: Terms indexed at once within a block of documents; queries with more are added up chunk by chunk.
CHUNK = 4096
#: Characters of query texts, and queries, that are broadcast at once.
QUERY_CHARS, QUERIES = 4_000_000, 1024
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Free parameters of the impacts.
SATURATION, LENGTH_SHARE = 8, 75

_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
# A-Z become a-z; what is neither a letter, a digit nor beyond ASCII becomes a space
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of it; pieces end between terms."""
    at = 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            gap = _GAP.search(text, to)
            to = gap.start() if gap else len(text)
        yield text[at:to].translate(_PLAIN).split()
        at = to


def counted(text: bytes, known: dict[bytes, int]) -> tuple[int, Counter]:
    """(number of terms, occurrences of the known ones by number)."""
    n, found = 0, Counter()
    for piece in terms(text):
        n += len(piece)
        found.update(map(known.get, piece))
    found.pop(None, None)
    return n, found


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _count(shared):
    """Partial sums of a partition: (number of a term, documents); -1 is for all documents, -2 for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value, Counter()
        for batch in batches:
            for text in _texts(batch):
                n, found = counted(text, known)
                df.update(found.keys())
                df[-1] += n > 0
                df[-2] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(df.keys()), pa.int32()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])

    return run


class Queries:
    """Items of one block of queries as lists of (term, how far its slices are shifted).

    A term that an item repeats is added once for each bit of its count, by so
    many slices further up.
    """

    def __init__(self, items: list[list[bytes]]):
        self.known: dict[bytes, int] = {}
        counts = [Counter(x) for x in items]
        for c in counts:
            for t in c:
                self.known.setdefault(t, len(self.known))
        self.wanted = [[(self.known[t], k) for t, k in c.items()] for c in counts]
        self.weight = np.zeros(len(self.known), np.int64)

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.known))], np.int64)

    def steps(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each chunk of terms: (shift, the terms that the items add in one step, by place in the chunk; past its end: none)."""
        out = []
        for low in range(0, len(self.known), CHUNK):
            size = min(CHUNK, len(self.known) - low)
            by_shift: dict[int, list[list[int]]] = {}
            for i, item in enumerate(self.wanted):
                for t, k in item:
                    if low <= t < low + size and self.weight[t] > 0:
                        for bit in range(k.bit_length()):
                            if k >> bit & 1:
                                by_shift.setdefault(bit, [[] for _ in self.wanted])[i].append(t - low)
            steps = []
            for shift, lists in sorted(by_shift.items()):
                for step in range(max(map(len, lists))):
                    steps.append((shift, np.array([x[step] if step < len(x) else size for x in lists])))
            out.append(steps)
        return out


def slices_of(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, size: int, words: int) -> np.ndarray:
    """Bitmaps [bit, term, word] of the impacts' bits, with an empty term past the last; a term has a document once."""
    bits = int(impact.max(initial=0)).bit_length()
    out = np.zeros((bits, size + 1, words), np.uint64)
    if not bits:
        return out
    key = term * words + (doc >> 6)
    order = np.argsort(key, kind="stable")
    key, impact, mark = key[order], impact[order], np.uint64(1) << (doc[order] & 63).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    flat = out.reshape(bits, -1)
    for b in range(bits):
        flat[b, key[starts]] = np.bitwise_or.reduceat(np.where(impact >> b & 1, mark, np.uint64(0)), starts)
    return out


def add(total: np.ndarray, index: np.ndarray, which: np.ndarray, shift: int) -> None:
    """Add to each query's slices those of one term, carrying upwards: total[bit, query, word] += index[bit, which] << shift."""
    carry = None
    for b in range(shift, len(total)):
        own = total[b]
        if b - shift < len(index):
            more = index[b - shift, which]
            half = own ^ more
            if carry is None:
                total[b], carry = half, own & more
            else:
                total[b], carry = half ^ carry, (own & more) | (carry & half)
        else:
            if carry is None or not carry.any():
                return
            total[b], carry = own ^ carry, own & carry


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (sure, tied) of each query: the documents above the k-th score, and those that have it, from the top slice down.

    Documents without a bit in any slice are in neither.
    """
    open_ = np.bitwise_or.reduce(total, 0)
    sure = np.zeros_like(open_)
    need = np.full(open_.shape[0], k)
    for b in range(len(total) - 1, -1, -1):
        have = open_ & total[b]
        count = np.bitwise_count(have).sum(1, dtype=np.int64)
        enough = (count >= need)[:, None]
        sure |= np.where(enough, np.uint64(0), have)
        open_ = np.where(enough, have, open_ & ~total[b])
        need = np.where(enough[:, 0], need, need - count)
    return sure, open_


def _bits(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, document) of the set bits, in order."""
    return np.nonzero(np.unpackbits(np.ascontiguousarray(bitmap).view(np.uint8).reshape(len(bitmap), -1), axis=1, bitorder="little"))


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, documents, all_terms = shared.value
        top = Top(k)
        if all_terms:
            steps = queries.steps()
            for block in _blocks(batches, queries.known, documents, all_terms):
                top.take(*_answer(block, queries, steps, k))
        for at in range(0, len(top.query), 65_536):
            part = slice(at, at + 65_536)
            ids = pa.array(top.doc[part], mask=top.null[part])
            yield pa.RecordBatch.from_arrays([pa.array(top.query[part].astype(np.int32)), ids, pa.array(top.score[part])], names=["q", "doc_id", "score"])

    return run


class Top:
    """The k best of what a partition has seen of each query; ties to the smaller id, rows without id last."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.doc, self.score, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        query, doc, score, null = (np.concatenate(x) for x in ((self.query, query), (self.doc, doc), (self.score, score), (self.null, null)))
        order = np.lexsort((doc, null, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        keep = order[np.arange(len(query)) - first < self.k]
        self.query, self.doc, self.score, self.null = np.sort(query[np.arange(len(query)) - first < self.k]), doc[keep], score[keep], null[keep]


def _blocks(batches, known, documents: int, all_terms: int) -> Iterator[tuple]:
    """(ids, null ids, terms, documents, factors) of BLOCK documents, which are numbered in the order of their ids."""
    held: list[tuple] = []

    def block():
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))
        ids, null = np.array([x[0] or 0 for x in held], np.int64), np.array([x[0] is None for x in held])
        size = np.array([len(x[1]) for x in held])
        term = np.concatenate([x[1] for x in held])
        tf, m = np.concatenate([x[2] for x in held]), np.repeat(np.array([x[3] for x in held], np.int64), size)
        return ids, null, term, np.repeat(np.arange(len(held)), size), (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), _texts(batch)):
            n, found = counted(text, known)
            if found:
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // all_terms
                held.append((key, np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)), m))
            if len(held) == BLOCK:
                yield block()
                held = []
    if held:
        yield block()


def _answer(block: tuple, queries: Queries, steps: list, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score, null id) of the k best of a block for each query."""
    ids, null, term, doc, factor = block
    impact = queries.weight[term] * factor
    words = -(-len(ids) // 64)
    # no query's sum is over that of its terms' greatest impacts
    most = np.zeros(len(queries.weight), np.int64)
    np.maximum.at(most, term, impact)
    high = max((sum(int(most[t]) * n for t, n in item) for item in queries.wanted), default=0)
    total = np.zeros((high.bit_length(), len(queries.wanted), words), np.uint64)
    for c, chunk in enumerate(steps):
        low = c * CHUNK
        size = min(CHUNK, len(queries.weight) - low)
        mine = (term >= low) & (term < low + size) & (impact > 0)
        index = slices_of(term[mine] - low, doc[mine], impact[mine], size, words)
        for shift, which in chunk:
            add(total, index, which, shift)
    sure, tied = best(total, k)
    q, d = _bits(sure)
    room = k - np.bincount(q, minlength=len(total[0]) if len(total) else len(queries.wanted))
    tq, td = _bits(tied)
    early = np.arange(len(tq)) - np.searchsorted(tq, tq) < room[tq]  # lower numbers are smaller ids
    q, d = np.concatenate([q, tq[early]]), np.concatenate([d, td[early]])
    score = np.zeros(len(q), np.int64)
    for b in range(len(total)):
        score += (total[b, q, d >> 6] >> (d & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
    return q, ids[d], score, null[d]


def search(docs: DataFrame, items: DataFrame, k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that match each item of items(item_id, text) best.

    docs(doc_id, text).  Terms are runs of ASCII letters, digits and characters
    beyond ASCII, only A-Z lower-cased.  A document's score is the sum over the
    item's terms, repeats included, of weight times factor, in whole numbers;
    documents of score 0 are left out.  Equal scores go to the smaller doc_id.

    A null text has no terms.  A document without doc_id counts and ranks after
    its equals; repeated documents count and rank each.  An item without id is
    answered under null; equal items are answered once, different texts of one
    item_id each by itself.  Empty tables give no rows.  Other columns are
    ignored, whatever their names.  Texts are searched whole.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    # numbered by partition, then read block by block
    asked = scratch.keep(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    found = []
    for i, bounds in enumerate(_bounds(asked)):
        rows = asked.where(F.col("q").between(*bounds)).orderBy("q").collect()
        queries = Queries([[t for piece in terms(r.text.encode()) for t in piece] for r in rows])
        counts = {r.term: r.n for r in texts.select("text").mapInArrow(_count(spark.sparkContext.broadcast(queries.known)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, all_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        queries.weigh(documents, counts)
        best_ = texts.mapInArrow(_search(spark.sparkContext.broadcast((queries, documents, all_terms)), k), "q int, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ids = asked.where(F.col("q").between(*bounds)).select(F.col("q").alias("number"), "item_id")
        names = spark.createDataFrame([(n, r.q) for n, r in enumerate(rows)], "q int, number long")
        top = best_.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "q").join(F.broadcast(ids), "number").select("item_id", "rank", "doc_id", "score")
        found.append((i, top))
    kind = items.schema["item_id"].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if len(found) == 1:
        return found[0][1]
    out = None
    for i, top in found:
        kept = scratch.keep(top, f"found{i}")
        out = kept if out is None else out.unionByName(kept)
    return out


def _bounds(asked: DataFrame) -> list[tuple[int, int]]:
    """First and last number of each block of queries; only numbers and lengths come to the driver."""
    out, first, last, chars, n = [], None, None, 0, 0
    for r in asked.select("q", F.length("text").alias("size")).orderBy("q").toLocalIterator():
        first, last, chars, n = r.q if first is None else first, r.q, chars + r.size, n + 1
        if chars >= QUERY_CHARS or n == QUERIES:
            out.append((first, last))
            first, chars, n = None, 0, 0
    return out + ([(first, last)] if first is not None else [])
