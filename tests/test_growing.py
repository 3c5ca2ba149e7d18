import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensa.operators import centrality, rouge, solver, stats
from condensa.streaming.corpus import GrowingCorpus

TEXTS = ["a b b", "b c", None, "", "a <tag x> c", "d", "a b c d", "e"]


def state(corpus):
    return corpus.documents(), {r.term: r.df for r in corpus.frequencies().collect()}


def test_batches_add_up_in_any_order_and_again(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = len(TEXTS), {r.term: r.df for r in stats.document_frequencies(df).collect()}
    corpus = GrowingCorpus(spark, f"file://{tmp_path}/c")
    assert state(corpus) == (0, {})
    for batch in (2, 0, 1, 1, 2):
        corpus.add(df.where(f"doc_id % 3 = {batch}"), batch)
    assert state(corpus) == want
    corpus.compact()
    corpus.compact()
    assert state(GrowingCorpus(spark, f"file://{tmp_path}/c")) == want
    corpus.add(df.where("doc_id % 3 = 1"), 1)  # what a compacted table holds may come again
    assert state(corpus) == want
    corpus.add(df, 3)
    corpus.compact()
    assert state(corpus) == (2 * want[0], {t: 2 * n for t, n in want[1].items()})
    half = corpus._complete("batches")[3].removeprefix("file:")
    (tmp_path / "c/batches/batch=000000000004").mkdir()  # a batch that was lost while it was written
    assert state(corpus)[0] == 2 * want[0] and half.endswith("3")


def test_a_stream_counts_each_file_once(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string")
    df.repartition(3, "doc_id").write.parquet(f"{tmp_path}/in")
    corpus = GrowingCorpus(spark, f"file://{tmp_path}/c")
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        corpus.follow(stream(), f"{tmp_path}/progress").awaitTermination()
        assert state(corpus) == (3 * len(TEXTS), {r.term: r.df for r in stats.document_frequencies(df).collect()})
    got = {(r.doc_id, r.term): r.tfidf for r in corpus.keywords(df).collect()}
    assert got == {(r.doc_id, r.term): r.tfidf for r in stats.keywords(df, stats.document_frequencies(df), df.count()).collect()}


def test_jackknife_against_leaving_each_out(spark):
    rng = np.random.default_rng(1)
    refs = [(f"k{i % 4}", i, " ".join(rng.choice(list("abcdef"), int(rng.integers(0, 9))))) for i in range(9)] + [("k0", 50, None)]
    systems = [(i, f"k{i % 5}", " ".join(rng.choice(list("abcdef"), int(rng.integers(0, 9))))) for i in range(15)]
    s, r = spark.createDataFrame(systems, "system_id long, ref_key string, text string"), spark.createDataFrame(refs, "ref_key string, ref_id long, text string")
    pairs = {}
    for x in rouge.pair_scores(s, r).collect():
        pairs.setdefault((x.system_id, x.metric), []).append((x.r, x.p, x.f))
    got = {(x.system_id, x.metric): (x.r, x.p, x.f) for x in rouge.rouge(s, r, combine="jackknife").collect()}
    assert got.keys() == pairs.keys() and len(got) > 20
    for k, rows in pairs.items():
        for part in range(3):
            v = [row[part] for row in rows]
            want = v[0] if len(v) == 1 else np.mean([max(v[:i] + v[i + 1 :]) for i in range(len(v))])
            assert got[k][part] == pytest.approx(want)


def test_intervals_cover_the_mean(spark):
    """Close to the normal interval, the same in each run, other for another seed."""
    x = np.random.default_rng(2).normal(0.4, 0.1, 400)
    df = spark.createDataFrame([("g", i, float(v), float(v), float(v)) for i, v in enumerate(x)] + [("h", 1, 0.5, 0.5, 0.5)], "g string, system_id long, r double, p double, f double")
    rows = {(r.g, r.part): r for r in rouge.intervals(df, ["g"], 600).collect()}
    r, half = rows["g", "f"], 1.96 * x.std() / 20
    assert r.mean == pytest.approx(x.mean()) and r.low == pytest.approx(x.mean() - half, abs=0.25 * half) and r.high == pytest.approx(x.mean() + half, abs=0.25 * half) and r.systems == 400
    assert (rows["h", "f"].low, rows["h", "f"].high) == (0.5, 0.5)
    assert {(k, v.low) for k, v in rows.items()} == {((r.g, r.part), r.low) for r in rouge.intervals(df.repartition(7), ["g"], 600).collect()}
    assert rouge.intervals(df.limit(0), ["g"]).count() == 0


def vectors(texts):
    words = [t.lower().split() for t in texts]
    df = {w: sum(w in x for x in words) for x in words for w in x}
    out = []
    for x in words:
        v = {w: x.count(w) * math.log(len(texts) / df[w]) for w in set(x) if df[w] < len(texts)}
        size = math.sqrt(sum(a * a for a in v.values()))
        out.append({w: a / size for w, a in v.items()})
    return out


def test_ranks_are_those_of_the_power_iteration(spark):
    rng = np.random.default_rng(3)
    by_group = {g: sorted({" ".join(rng.choice([f"w{i}" for i in range(14)] + ["the"], int(rng.integers(1, 8)), p=[0.06] * 14 + [0.16])) for _ in range(25)}) for g in "xy"} | {"z": ["alone"]}
    units = spark.createDataFrame([(g, i, t) for g, ts in by_group.items() for i, t in enumerate(ts)], "g string, id long, text string")
    weights = centrality.term_weights(units, ["g"])
    pairs = centrality.similar(weights, ["g"], 0.3)
    got = {(r.g, r.a, r.b): r.cosine for r in pairs.collect()}
    want, ranks = {}, {}
    for g, ts in by_group.items():
        v = vectors(ts)
        for a, b in itertools.combinations(range(len(ts)), 2):
            c = sum(x * v[b].get(w, 0) for w, x in v[a].items())
            if c >= 0.3 - 1e-9:
                want[g, a, b] = c
        n = len(ts)
        m = np.zeros((n, n))
        for (gg, a, b) in want:
            if gg == g:
                m[a, b] = m[b, a] = 1
        step = np.where(m.sum(1, keepdims=True) > 0, m / np.maximum(m.sum(1, keepdims=True), 1), 1 / n)
        r = np.full(n, 1 / n)
        for _ in range(200):
            r = 0.15 / n + 0.85 * r @ step
        ranks |= {(g, i): x for i, x in enumerate(r)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 30
    told = centrality.lexrank(units, pairs, ["g"], tol=1e-7)
    mine = {(r.g, r.id): r.rank for r in told.collect()}
    assert mine.keys() == ranks.keys() and max(abs(mine[k] - ranks[k]) for k in ranks) < 1e-6
    picks = {}
    for r in centrality.mmr(told, pairs, ["g"], 4).collect():
        picks.setdefault(r.g, {})[r.turn] = r.id
    for g, ts in by_group.items():
        top, chosen = max(x for (gg, _), x in ranks.items() if gg == g), []
        near = lambda i: max((want.get((g, min(i, j), max(i, j)), 0) for j in chosen), default=0)  # noqa: B023, E731
        for _ in range(min(4, len(ts))):
            chosen.append(min((i for i in range(len(ts)) if i not in chosen), key=lambda i: (-round(0.7 * ranks[g, i] / top - 0.3 * near(i), 6), i)))  # noqa: B023
        assert [picks[g][t] for t in sorted(picks[g])] == chosen
    empty = units.limit(0)
    assert centrality.lexrank(empty, centrality.similar(centrality.term_weights(empty, ["g"]), ["g"], 0.3), ["g"]).count() == 0


def test_sweeps_equal_separate_solutions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(4):
        theta = rng.integers(1, 9, 9)
        for p in range(12):
            cost = int(rng.integers(1, 7))
            rows += [(g, f"p{p}", cost, f"c{c}", 1.0, float(theta[c])) for c in np.flatnonzero(rng.random(9) < 0.4)]
    problems = spark.createDataFrame(rows, "g int, phrase string, cost int, concept string, value double, theta double")
    students = spark.createDataFrame([(g, f"p{p}", p % 5) for g in range(4) for p in range(12)], "g int, phrase string, student int")
    got = solver.sweep(problems, ["g"], [9, 3, 6], [0.5, 0.8], students).collect()
    assert len(got) == 4 * 3 * 2 and all(r.value == pytest.approx(r.bound) for r in got)
    for share, budget in itertools.product((0.5, 0.8), (3, 6, 9)):
        alone = {r.g: r.value for r in solver.summarize(problems, ["g"], budget, students=students, share=share).collect()}
        assert all(r.value == pytest.approx(alone.get(r.g, 0.0)) for r in got if (r.share, r.budget) == (share, budget))
    for g, share in itertools.product(range(4), (0.5, 0.8)):
        values = [r.value for r in sorted(got, key=lambda r: r.budget) if r.g == g and r.share == share]
        assert values == sorted(values)
    assert solver.sweep(problems.where(F.col("g") < 0), ["g"], [3]).count() == 0
