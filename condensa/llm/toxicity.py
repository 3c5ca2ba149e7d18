"""Toxicity by class-conditional Kneser-Ney character models.

5-grams of characters are counted over all documents, and apart from that over
a bounded sample of labelled ones by class.  A class's probability of a
character after four others is its discounted count, and backs off to one
shared interpolated Kneser-Ney model of orders 4 to 1, whose continuation
counts come from all documents: an expression that neither class knows well
scores alike in both.  A document's log-likelihoods under both models are
compared by length-normalised means, of the whole text and of its most toxic
window, and a logistic curve fitted on labelled rows that the models have not
seen turns the two differences into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm import blocks, langid
from condensa.llm.scratch import Scratch

ORDER, BITS, DISCOUNT = 5, 12, 0.75
#: Characters of a window; labelled rows learned from.
WINDOW, SAMPLE_ROWS = 48, 20_000
#: The broadcast table has 8 buckets for each distinct 5-gram of the corpus, within these powers of 2.
LEAST_BITS, MOST_BITS = 16, 24
#: Of 5 parts of the sample, those that fit the curve.
CURVE_PARTS = 1
_MASK = (1 << BITS) - 1


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the 5-gram that ends at each place as a 60-bit number, offsets of the texts)."""
    points, at = langid.codes(texts)
    code = np.where(points < 1 << (BITS - 1), points, (1 << (BITS - 1)) + (points * np.uint32(2654435761) >> np.uint32(33 - BITS))).astype(np.int64)
    out = np.zeros(max(0, len(code) - ORDER + 1), np.int64)
    for i in range(ORDER):
        out = (out << BITS) | code[i : len(code) - ORDER + 1 + i] if len(out) else out
    inside = np.ones(len(out), bool)
    for i in range(1, ORDER):
        cuts = at[1:-1] - i
        inside[cuts[(cuts >= 0) & (cuts < len(out))]] = False
    return out[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, len(inside))]


class _Counts:
    """Running counts of numbers, compacted now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.parts.append(np.unique(values, return_counts=True))
            self.held += len(self.parts[-1][0])
            if self.held > 1 << 21:
                self.parts = [self.total()]
                self.held = len(self.parts[0][0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        values, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return values[first], np.add.reduceat(counts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, kind, n): kind 0 over all texts, 1 and 2 over those of class 0 and 1."""
    counts = [_Counts() for _ in range(3)]
    for whole in batches:
        for batch in blocks.slices(whole, "text"):
            grams, at = packed(batch.column("text"))
            tag = np.asarray(batch.column("tag").fill_null(-1), np.int64)
            counts[0].add(grams)
            if (tag >= 0).any():
                own = np.repeat(tag, np.diff(at))
                for c in (0, 1):
                    counts[c + 1].add(grams[own == c])
    for kind, c in enumerate(counts):
        values, n = c.total()
        for a in range(0, len(values), 1 << 18):
            part = values[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), kind, np.int32)), pa.array(n[a : a + (1 << 18)])], names=["gram", "kind", "n"])


def shared_model(grams: DataFrame) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probabilities of the last character of each distinct 4-gram after the others."""
    level = grams.select("gram")
    levels = []
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("gram")).agg(F.count("*").alias("cc"))
        levels.append(level)
    p = None
    for k, level in enumerate(reversed(levels), 1):
        by = Window.partitionBy(F.shiftright("gram", BITS))
        level = level.select("gram", "cc", F.sum("cc").over(by).alias("all"), F.count("*").over(by).alias("kinds"))
        if p is None:
            p = level.select("gram", ((F.col("cc") + 1) / (F.col("all") + F.col("kinds"))).alias("p"))
        else:
            low = p.withColumnRenamed("gram", "low").withColumnRenamed("p", "below")
            level = level.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)))
            p = level.join(low, "low").select("gram", ((F.greatest(F.col("cc") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("all")).alias("p"))
    return p


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, n, ratio): ln of the class models' probabilities, toxic over ordinary, for every gram of the corpus."""
    by = Window.partitionBy(F.shiftright("gram", BITS))
    seen = grams.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (ORDER - 1))) - 1)))
    for c in ("ordinary", "toxic"):
        seen = seen.withColumn(f"all_{c}", F.sum(c).over(by)).withColumn(f"kinds_{c}", F.sum((F.col(c) > 0).cast("long")).over(by))
    seen = seen.where("all_ordinary + all_toxic > 0").join(shared_model(grams).select(F.col("gram").alias("low"), "p"), "low")

    def own(c: str) -> F.Column:
        return F.when(F.col(f"all_{c}") > 0, (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{c}") * F.col("p")) / F.col(f"all_{c}")).otherwise(F.col("p"))

    return seen.select("gram", "n", F.ln(own("toxic") / own("ordinary")).alias("ratio"))


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def differences(table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """By text: mean log ratio a character over all of it, and over the window where it is largest."""
    grams, at = packed(texts)
    run = np.zeros(len(grams) + 1)
    np.cumsum(table[_bucket(grams, len(table))], out=run[1:])
    size = np.diff(at)
    out = np.zeros((len(size), 2))
    some = size > 0
    out[some, 0] = (run[at[1:]] - run[at[:-1]])[some] / size[some]
    out[some, 1] = out[some, 0]
    long = np.flatnonzero(size > WINDOW)
    if len(long):
        means = np.full(len(grams) + 1, -np.inf)
        means[: len(grams) - WINDOW + 1] = (run[WINDOW:] - run[:-WINDOW]) / WINDOW
        edges = np.stack([at[long], at[long + 1] - WINDOW + 1], 1).ravel()
        out[long, 1] = np.maximum.reduceat(means, edges)[::2]
    return out


def _score(shared, curve: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                x = differences(shared.value, batch.column("text"))
                kept = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
                if curve is None:
                    kept += [("whole", pa.array(x[:, 0])), ("window", pa.array(x[:, 1]))]
                else:
                    kept.append(("score", pa.array(1 / (1 + np.exp(-np.clip(x @ curve[1:] + curve[0], -40, 40))))))
                yield pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method, with an intercept and slopes of at least 0."""
    if not len(y) or y.min() == y.max():
        return np.array([-2.0, 0.0, 0.0] if not len(y) or not y.max() else [2.0, 0.0, 0.0])
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], np.maximum(w[1:] / scale, 0)])


def _part(column: str, salt: int, n: int) -> F.Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, most_rows: int = SAMPLE_ROWS) -> tuple[object, np.ndarray]:
    """(broadcast table of log ratios by hashed 5-gram, curve) from docs(doc_id, text) and labels(doc_id, toxic).

    Character counts cover all of docs.  At most about most_rows labelled rows,
    picked by a hash of doc_id, are learned from; a fifth of these fits the
    curve.  A document with several labels is toxic if one says so.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("tag"))
    share = min(1.0, most_rows / max(1, labels.count()))
    sample = labels.where(_part("doc_id", 1, 1_000_000) < int(share * 1_000_000)) if share < 1 else labels
    sample = scratch.keep(sample.withColumn("part", _part("doc_id", 2, 5)), "labels")  # bounded, so it is broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tagged = texts.join(F.broadcast(sample.where(F.col("part") >= CURVE_PARTS).select("doc_id", "tag")), "doc_id", "left").select("text", "tag")
    counted = tagged.mapInArrow(_count, "gram long, kind int, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "ordinary"), (2, "toxic")))
    )
    grams = scratch.keep(counted, "grams")
    buckets = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * grams.count()).bit_length()))
    ratio = log_ratios(grams).mapInArrow(_buckets(buckets), "bucket int, n long, ratio double").groupBy("bucket").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("ratio")).where("abs(ratio) > 0.01")
    got = ratio.toArrow()  # no more rows than buckets
    table = np.zeros(buckets, np.float32)
    if got.num_rows:
        table[np.asarray(got.column("bucket"))] = np.asarray(got.column("ratio"))
    shared = spark.sparkContext.broadcast(table)
    held = texts.join(F.broadcast(sample.where(F.col("part") < CURVE_PARTS).select("doc_id", "tag")), "doc_id")
    rows = held.select("tag", "text").mapInArrow(_score(shared, None), "tag int, whole double, window double").toArrow()
    x = np.column_stack([np.asarray(rows.column("whole")), np.asarray(rows.column("window"))]) if rows.num_rows else np.zeros((0, 2))
    return shared, fit_curve(x, np.asarray(rows.column("tag"), np.float64) if rows.num_rows else np.zeros(0))


def _buckets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _bucket(np.asarray(batch.column("gram"), np.int64), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("n"), batch.column("ratio")], names=["bucket", "n", "ratio"])

    return run


def score(texts: DataFrame, model: tuple[object, np.ndarray]) -> DataFrame:
    """texts' columns but `text`, with score, the estimated probability of label 1.

    Null texts and texts of fewer than five characters have no log ratio and get
    the curve's value at 0.  Without labelled rows of both classes every text
    gets the same score.  Whole texts of any length count; repeated rows are
    scored each; a column that is called score is replaced.
    """
    texts = texts.drop("score")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"]
    return texts.mapInArrow(_score(*model), ", ".join([*kept, "score double"]))
