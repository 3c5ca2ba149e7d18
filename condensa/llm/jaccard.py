"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Texts with equal n-gram sets form one class from the start, so exact copies
cost one row in a partially aggregated group, whatever their number.  Classes
that share a band hash are tied to the least class of that bucket (a star, not
all pairs); the components of these stars are the candidate clusters.  Each
class is then sent once to its cluster, cut into blocks by a hash where the
cluster is large, and every pair of classes inside a cluster is verified on
the n-gram sets by counting shared n-grams in numpy.  Only counts and spanning
edges leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm import blocks, bloom
from condensa.llm.graph import components
from condensa.llm.scratch import Scratch

U64 = np.uint64
#: Classes and n-grams that a block of a cluster holds, in expectation.
BLOCK_CLASSES, BLOCK_NGRAMS = 512, 1 << 20


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance candidates, that
    find a pair at the threshold with the wanted probability using `most` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def set_keys(uniq: np.ndarray, at: np.ndarray) -> pa.Array:
    """128-bit keys of n-gram sets, from two independent sums over their members."""
    a, b = (blocks.row_sums(blocks.mix(uniq ^ U64(s)), at) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return blocks.keys128(blocks.mix(a), blocks.mix(b ^ np.diff(at).astype(U64)))


def _signatures(n: int, bands: int, rows: int, more: list[str]):
    rng = np.random.default_rng(11)
    mult = rng.integers(0, 1 << 63, bands * rows, dtype=U64) * U64(2) + U64(1)
    flip = rng.integers(0, 1 << 64, bands * rows, dtype=U64)
    salt = rng.integers(0, 1 << 64, bands, dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                w = blocks.words(batch.column("text"))
                grams, at, _ = blocks.shingles(w.hash, w.rows, n)
                uniq, uat = blocks.unique_per_row(grams, at)
                full = np.diff(uat) > 0
                kept = [*more, "doc_id", "look"]
                count, key = np.diff(uat)[full], set_keys(uniq, uat).filter(pa.array(full))
                starts = uat[:-1][full]
                out = np.empty((len(starts), bands), U64)
                if len(starts):
                    buf = np.empty(len(uniq), U64)
                    for b in range(bands):
                        acc = np.full(len(starts), salt[b])
                        for k in range(b * rows, b * rows + rows):
                            np.bitwise_xor(uniq, flip[k], out=buf)
                            np.multiply(buf, mult[k], out=buf)
                            acc = blocks.mix(acc * U64(31) + np.minimum.reduceat(buf, starts))
                        out[:, b] = acc
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).filter(pa.array(full)) for c in kept), key, pa.array(count), blocks.lists(out.ravel(), np.arange(len(starts) + 1) * bands)], names=[*kept, "cid", "n", "bands"]
                )

    return run


def _sets(n: int, wanted):
    """The n-gram sets of those texts that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks.slices(whole.filter(pa.array(bloom.hits(wanted, np.asarray(whole.column("key"), np.int64)))), "text"):
                w = blocks.words(batch.column("text"))
                grams, at, _ = blocks.shingles(w.hash, w.rows, n)
                uniq, uat = blocks.unique_per_row(grams, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("look"), blocks.lists(uniq, uat)], names=["doc_id", "look", "grams"])

    return run


def shared_counts(values: np.ndarray, rows: np.ndarray, width: int = 8192) -> np.ndarray:
    """How many values each two rows share; each row's values are distinct."""
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))
    _, code, freq = np.unique(values, return_inverse=True, return_counts=True)
    keep = freq[code] > 1
    rank = np.cumsum(freq > 1) - 1
    code, owner = rank[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((n, min(width, int(code[b - 1]) - lo + 1)), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        out += m @ m.T
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float):
    def group(key: tuple, pdf: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        first = pdf.append_column("row", pa.array(np.arange(pdf.num_rows))).group_by("cid").aggregate([("row", "min")])
        pdf = pdf.take(first.column("row_min"))  # repeated rows of a representative
        cid, copies = pdf.column("cid").to_pylist(), np.asarray(pdf.column("copies"), np.int64)
        part = np.asarray(pdf.column("part"), np.int64)
        grams = pdf.column("grams").combine_chunks()
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        rows = np.asarray(grams.offsets, np.int64)
        size = np.diff(rows).astype(np.float32)
        share = shared_counts(np.asarray(grams.values, np.int64)[rows[0] : rows[-1]], rows - rows[0])
        link = share >= np.float32(threshold - 1e-6) * (size[:, None] + size[None, :] - share)
        np.fill_diagonal(link, False)
        if not same:
            link &= part[:, None] != part[None, :]
        links = link @ copies
        hit = np.flatnonzero(links > 0)
        root = _roots(link)
        return pa.table({"cid": pa.array([cid[i] for i in hit], pa.binary()), "links": pa.array(links[hit]), "to": pa.array([cid[root[i]] for i in hit], pa.binary())})

    return group


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, class_id, links) for every row of docs(doc_id, text, ...).

    links: how many other rows have an n-gram Jaccard of at least the threshold,
    copies included; class_id: the least doc_id reachable over such links.
    A text of fewer than n words counts as one shorter n-gram.  Null texts and
    texts without a word link with nothing and are a class of their own.
    Repeated rows are copies of each other; a null doc_id takes part and stays
    null in the result, and is never a class_id unless its whole class has none.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    told = _groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, threshold, recall, scratch, [])
    return told.select("doc_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "links")


def _groups(docs: DataFrame, n: int, threshold: float, recall: float, scratch: Scratch, more: list[str]) -> DataFrame:
    """(doc_id, *more, group, class_id, links) for each row; group is null for texts without a word."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).withColumn("look", F.xxhash64("text"))
    sig = scratch.keep(texts.mapInArrow(_signatures(n, bands, rows, more), "".join(f"{c} long, " for c in more) + "doc_id long, look long, cid binary, n long, bands array<long>"), "sig")
    classes = scratch.keep(sig.groupBy("cid").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "look")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("cid", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("cid").alias("a"), F.count("*").alias("k")).where("k > 1").select("band", "a")
    edges = banded.join(least, "band").select("a", F.col("cid").alias("b")).where("a <> b")
    near = components(edges, scratch, "near")
    member = near.withColumnRenamed("node", "cid").join(classes.select("cid", "rep", "copies", "n"), "cid")
    parts = member.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_NGRAMS)).cast("int").alias("parts"))
    wanted = scratch.keep(member.join(parts, "root"), "wanted")
    # only the representatives' n-gram sets are shuffled: a Bloom filter holds the other texts back
    filtered = bloom.build(wanted.select(F.xxhash64("rep.doc_id", "rep.look").alias("key")), "key", wanted.count())
    sets = texts.withColumn("key", F.xxhash64("doc_id", "look")).mapInArrow(_sets(n, filtered), "doc_id long, look long, grams array<long>")
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    spread = (
        sets.alias("t")
        .join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.rep.doc_id")) & (F.col("t.look") == F.col("w.rep.look")))
        .select("root", "cid", "copies", "parts", "grams", part.alias("part"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("other", "parts")
    )
    pairs = scratch.keep(spread.groupBy("root", "lo", "hi").applyInArrow(_verify(threshold), "cid binary, links long, to binary"), "pairs")
    scratch.drop("wanted")
    final = components(pairs.select(F.col("cid").alias("a"), F.col("to").alias("b")).where("a <> b"), scratch, "final")
    names = final.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid")
    least_id = names.groupBy("root").agg(F.min("rep.doc_id").alias("class_id"))
    links = pairs.groupBy("cid").agg(F.sum("links").alias("links"))
    told = names.join(least_id, "root").join(links, "cid", "left").select("cid", "root", "class_id", "links")
    info = scratch.keep(
        classes.select("cid", "rep", "copies")
        .join(told, "cid", "left")
        .select("cid", F.coalesce("root", "cid").alias("group"), F.coalesce("class_id", "rep.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")),
        "info",
    )
    found = sig.select("doc_id", "cid", *more).join(info, "cid").select("doc_id", *more, "group", "class_id", "links")
    empty = texts.where(F.col("text").isNull() | ~F.col("text").rlike("[0-9A-Za-z_\\x{80}-\\x{10FFFF}]")).select("doc_id", *more, F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(empty)


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, with one left of each group of near duplicates: that with the least doc_id.

    Of rows that share the least doc_id one stays, by a hash of all columns.  A
    row without a word is in no group and stays.  A null doc_id comes last.
    Columns may have any name.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    row = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), row.alias("row"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))
    told = scratch.keep(_groups(keyed, n, threshold, 0.999, scratch, ["row"]), "told").where("group IS NOT NULL")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")
    best = told.groupBy("group").agg(F.min(order).alias("best"))
    gone = told.join(best, "group").where(order != F.col("best")).select(F.col("doc_id").alias("other"), F.col("row").alias("key")).distinct()
    same = F.col("id").eqNullSafe(F.col("other")) & (F.col("row") == F.col("key"))
    left = whole.join(gone, same, "left_anti")
    twice = scratch.keep(told.groupBy("group", "doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("other"), F.col("row").alias("key")).distinct(), "twice")
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["row", "id"]))
    return left.select("doc.*")
