"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of other characters than letters becomes one
space, and its n-grams of 1 to 3 characters are hashed into buckets.  Training
sums bucket counts by language on the executors; the log-probability matrix,
whose size languages x buckets bound, is broadcast; scoring gathers its rows
for a whole batch of texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm import blocks

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: Languages of one matrix; rows that each language may give in any case.
LANGS, LEAST_ROWS = 256, 50
#: Cells of a gathered piece of the matrix.
PIECE = 1 << 22
_LETTER: list[np.ndarray] = []


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray  # float64 by language
    matrix: np.ndarray  # float32, buckets + 1 rows; the last is 0


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, others than letters as single spaces, and the texts' offsets; each text begins with a space."""
    data, offsets = blocks.utf8(texts)
    ahead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
    at = ahead[offsets]
    raw = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.insert(raw, at[:-1], 32)
    at = at + np.arange(len(at))
    at[-1] = len(points)
    points = np.where(letters()[points], points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[at[:-1]] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def grams(points: np.ndarray, at: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place; `buckets` where the text ends first."""
    out = np.full(len(points), buckets, np.int64)
    if len(points) < n:
        return out
    acc = np.full(len(points) - n + 1, n, np.uint64)
    for i in range(n):
        acc = (acc ^ points[i : len(points) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(points))
    inside = left >= n
    out[: len(acc)][inside[: len(acc)]] = (acc % np.uint64(buckets)).astype(np.int64)[inside[: len(acc)]]
    return out


def _count(buckets: int):
    def told(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for tag, sums in total.items():
            hit = np.flatnonzero(sums[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(sums[hit])], names=["tag", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                points, at = codes(batch.column("text"))
                tags = np.asarray(batch.column("tag").to_pylist(), object)
                for tag in set(tags):
                    mine = np.repeat(tags == tag, np.diff(at))
                    sums = total.setdefault(tag, np.zeros(buckets + 1, np.int64))
                    for n in ORDERS:
                        sums += np.bincount(grams(points, at, n, buckets)[mine], minlength=buckets + 1)
            if len(total) > LANGS:
                yield from told(total)
                total = {}
        yield from told(total)

    return run


def fit(labelled: DataFrame, most_rows: int = 20_000, buckets: int = BUCKETS) -> list[Model]:
    """Models of the languages in labelled(key, text, tag), rows without tag or text aside: one for each LANGS of them.

    About most_rows rows are learned from at most, picked by a hash of the key:
    every language has an equal share of them, one of LEAST_ROWS at least, and
    gives all its rows if it has fewer.  Priors count all rows.
    """
    rows = labelled.where("tag IS NOT NULL AND text IS NOT NULL").select("key", "text", "tag")
    count = {r["tag"]: r["count"] for r in rows.groupBy("tag").count().collect()}
    langs, total = sorted(count), max(1, sum(count.values()))
    quota = max(LEAST_ROWS, most_rows // max(1, len(langs)))
    share = labelled.sparkSession.createDataFrame([(x, int(min(1.0, quota / count[x]) * 1_000_000)) for x in langs], "tag string, share long")
    sample = rows.join(F.broadcast(share), "tag").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("share"))
    sums = sample.select("key", "text", "tag").mapInArrow(_count(buckets), "tag string, bucket int, n long").groupBy("tag", "bucket").agg(F.sum("n").alias("n"))
    models = []
    for at in range(0, len(langs), LANGS):
        some = langs[at : at + LANGS]
        n, index = np.zeros((buckets, len(some))), {x: i for i, x in enumerate(some)}
        got = sums.where(F.col("tag").isin(some)).toArrow()
        if got.num_rows:
            n[np.asarray(got.column("bucket")), [index[x] for x in got.column("tag").to_pylist()]] = np.asarray(got.column("n"))
        matrix = np.zeros((buckets + 1, len(some)), np.float32)
        matrix[:buckets] = np.log((n + 0.5) / (n.sum(0) + 0.5 * buckets))
        models.append(Model(some, np.log(np.array([count[x] for x in some]) / total), matrix))
    return models


def log_likelihoods(model: Model, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By text and language, the log-probabilities of all its n-grams."""
    out = np.zeros((len(at) - 1, len(model.langs)))
    buckets, step = len(model.matrix) - 1, max(1, PIECE // max(1, len(model.langs)))
    for a in range(0, len(points), step):
        end = min(len(points), a + step)
        mine = np.searchsorted(at, np.arange(a, end), "right") - 1
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        for n in ORDERS:
            part = points[a : end + n - 1]
            which = grams(part, np.clip(at - a, 0, len(part)), n, buckets)[: end - a]
            out[mine[first]] += np.add.reduceat(model.matrix[which], first, axis=0, dtype=np.float64)
    return out


def classify(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether it has no letter, best language's number, its log-probability with the text's, that of all languages summed) of each text."""
    points, at = codes(texts)
    ll = log_likelihoods(model, points, at) + model.prior
    best = ll.max(1)
    return np.add.reduceat(points != 32, at[:-1]) == 0, ll.argmax(1), best, best + np.log(np.exp(ll - best[:, None]).sum(1))


def _classified(docs: DataFrame, models: list[Model]) -> DataFrame:
    """(doc, text, lang, best, all): each model's languages in a pass of their own, so that a worker holds one matrix a pass.

    doc has the other columns of docs by number, whatever they are called.
    """
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    low = F.lit(float("-inf"))
    out = docs.select(F.struct(F.lit(0).alias("c"), *others).alias("doc"), F.col("text").cast("string").alias("text"), F.lit("und").alias("lang"), low.alias("best"), low.alias("all"))
    for model in models:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in blocks.slices(whole, "text"):
                    blank, which, best, every = classify(shared.value, batch.column("text"))
                    was, summed = np.asarray(batch.column("best")), np.asarray(batch.column("all"))
                    won = (best > was) & ~blank
                    named = pa.array(shared.value.langs, pa.string()).take(pa.array(which))
                    lang = pc.if_else(pa.array(won), named, batch.column("lang"))
                    columns = [batch.column("doc"), batch.column("text"), lang, pa.array(np.where(won, best, was)), pa.array(np.where(blank, summed, np.logaddexp(summed, every)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "text", "lang", "best", "all"])

        out = out.mapInArrow(run, out.schema)
    return out


_SCORE = "CASE WHEN lang = 'und' THEN 0D ELSE least(1D, exp(best - all)) END"


def predict(texts: DataFrame, models: list[Model]) -> DataFrame:
    """texts' columns but `text`, with lang_pred and score, the posterior probability.

    Null texts, texts without a letter, and all texts if the model has no
    language, get `und` with score 0.  Ties go to the first language by name.
    Whole texts of any length count; repeated rows are told each.  Columns that
    are called lang_pred or score are replaced.
    """
    kept = [F.col(f"doc.c{i}").alias(c) for i, c in enumerate(texts.columns) if c not in ("text", "lang_pred", "score")]
    return _classified(texts, models).select(*kept, F.col("lang").alias("lang_pred"), F.expr(_SCORE).alias("score"))


def keep_recognised(docs: DataFrame, models: list[Model], least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a predicted language with at least that score."""
    kept = [F.col("text") if c == "text" else F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _classified(docs, models).where((F.col("lang") != "und") & (F.expr(_SCORE) >= least)).select(*kept)
