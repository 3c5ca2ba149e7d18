import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions.stem import stem
from condensa.operators import concepts as C
from condensa.operators import graph, learn, match, matrix, parse, report, rouge, solver, stats

DOCS = [(1, "de", "s0", "the cat sat on the mat. the cat ran!"), (2, "de", "s0", "The  cat sat"), (3, "en", "s1", ""), (4, "en", "s1", None), (5, "en", "s0", "of the and of"), (6, "de", "s1", "\tcat sat on\n a mat ")]


def docs(spark):
    return spark.createDataFrame([(i, lang, s, x) for i, lang, s, x in DOCS], "doc_id long, lang string, source string, text string")


def words(x):
    return (x or "").lower().split()


def brute_grams(x, n, stop=True):
    w = words(x)
    out = [w[i : i + n] for i in range(len(w) - n + 1)]
    return [" ".join(g) for g in out if not stop or not all(v in T.STOP_WORDS for v in g)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_gram_rows_against_lists(spark, n):
    for distinct, stop in itertools.product((False, True), (None, T.STOP_WORDS)):
        got = sorted(tuple(r) for r in T.gram_rows(docs(spark), ["doc_id"], n=n, distinct=distinct, stop=stop).collect())
        want = []
        for i, _, _, x in DOCS:
            g = brute_grams(x, n, stop is not None)
            want += [(i, v) for v in (set(g) if distinct else g)]
        assert got == sorted(want)


def test_weights_and_incidence(spark):
    resp = C.responses(docs(spark))
    got = {(r.lecture, r.prompt, r.concept): r.theta for r in C.theta_tf(resp).collect()}
    want = {}
    for _, lang, s, x in DOCS:
        for g in brute_grams(x, 2):
            want[s, lang, g] = want.get((s, lang, g), 0) + 1
    assert got == want
    units = C.phrases(resp, "sentence")
    only = spark.createDataFrame([("cat sat",)], "concept string")
    assert {r.concept for r in C.incidence(units, whitelist=only).collect()} == {"cat sat"}
    stems = C.incidence(spark.createDataFrame([("running cats run",)], "phrase string"), stemmed=True).collect()
    assert {r.concept for r in stems} == {f"{stem('running')} {stem('cats')}", f"{stem('cats')} {stem('run')}"}
    known = C.counted_phrases(units.select(*C.GROUP, "phrase"), units)
    assert known.agg(F.sum("freq")).first()[0] == units.agg(F.sum("freq")).first()[0]
    with pytest.raises(Exception, match="no count of"):
        C.counted_phrases(units.select(*C.GROUP, F.lit("other").alias("phrase")), units).collect()
    assert C.theta_tf(resp.limit(0)).collect() == []


def test_selected_features(spark):
    rows = spark.createDataFrame([("a", "b", "c", f, 1.0) for f in ("tf_rank<5", "tf_rank<10", "ngram=2", "position_3", "one", "ave_sen_length_rank>1")], "lecture string, prompt string, concept string, feature string, value double")
    assert sorted(r.feature for r in C.select_features(rows, ["tf_rank", "position", "one"]).collect()) == ["one", "position_3", "tf_rank<10", "tf_rank<5"]


def problems(rng, groups, phrases=6, concepts=5):
    rows = []
    for g in range(groups):
        theta = rng.integers(1, 6, concepts)
        for p in range(phrases):
            cost = int(rng.integers(1, 6))
            for c in np.flatnonzero(rng.random(concepts) < 0.5):
                rows.append((g, f"p{p}", cost, f"c{c}", 1.0, float(theta[c])))
    return rows


def best_value(rows, budget):
    names = sorted({r[1] for r in rows})
    cost = {r[1]: r[2] for r in rows}
    held = {p: {r[3] for r in rows if r[1] == p} for p in names}
    theta = {r[3]: r[5] for r in rows}
    return max(sum(theta[c] for c in set().union(*(held[p] for p in sub))) for k in range(len(names) + 1) for sub in itertools.combinations(names, k) if sum(cost[p] for p in sub) <= budget)


def test_summaries_are_the_optimum(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(solver, "DENSEST", 2)  # the mark comes from few phrases
    rows = problems(rng, 12)
    df = spark.createDataFrame(rows, "g int, phrase string, cost int, concept string, value double, theta double")
    got = solver.summarize(df, ["g"], 8).collect()
    for g in range(12):
        mine = [r for r in rows if r[0] == g]
        values = {(r.value, r.bound) for r in got if r.g == g}
        assert len(values) == 1
        value, bound = values.pop()
        assert value == pytest.approx(best_value(mine, 8)) == pytest.approx(bound)
    assert solver.summarize(df.limit(0), ["g"], 8).collect() == []


def test_random_summary_fits_and_wastes_no_room(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"p{i}", int(rng.integers(1, 9))) for g in range(4) for i in range(30)]
    got = solver.random_summary(spark.createDataFrame(rows, "g int, phrase string, cost int"), ["g"], 12)
    cost = {(g, p): c for g, p, c in rows}
    for g in range(4):
        want, left = [], 12
        for p in sorted((p for q, p, _ in rows if q == g), key=lambda p: (solver.seeded_key("0", p), p)):
            if cost[g, p] <= left:
                want.append(p)
                left -= cost[g, p]
        assert [r.phrase for r in got.where(F.col("g") == g).collect()] == want


def test_greedy_oracle_raises_rouge(spark):
    phrases = ["a b c", "c d e", "x y", "a b", "d e f g"]
    refs = spark.createDataFrame([("t", 1, "a b c d e"), ("t", 2, "d e f")], "g string, ref_id int, text string")
    units = spark.createDataFrame([("t", p, len(p.split())) for p in phrases], "g string, phrase string, cost int")
    got = solver.greedy_oracle(units, refs, ["g"], 7).orderBy("turn").collect()

    def f(chosen):
        have = [g for p in chosen for g in brute_grams(p, 2, False)]
        out = []
        for ref in ("a b c d e", "d e f"):
            want = brute_grams(ref, 2, False)
            hit = sum(min(have.count(g), want.count(g)) for g in set(want))
            r, p = hit / len(want), hit / len(have) if have else 0
            out.append(2 * r * p / (r + p) if r + p else 0)
        return sum(out) / 2

    chosen = []
    for r in got:
        able = [p for p in phrases if p not in chosen and sum(len(q.split()) for q in [*chosen, p]) <= 7]
        assert r.f == pytest.approx(max(f([*chosen, p]) for p in able))
        chosen.append(r.phrase)
        assert r.f == pytest.approx(f(chosen))
    assert len(chosen) >= 2


def test_overlap_free_top_and_soft_counts(spark):
    rows = [("g", i, p, w, p.split()) for i, (p, w) in enumerate([("a b", 5.0), ("b c", 4.0), ("d", 3.0), ("a b", 2.0), ("e f", 1.0)])]
    df = spark.createDataFrame(rows, "g string, at int, phrase string, weight double, stems array<string>")
    assert [r.phrase for r in solver.overlap_free_top(df, ["g"], 3).orderBy("rnk").collect()] == ["a b", "d", "e f"]
    # a b: 1; b c shares one stem: a b 2, b c 1; d: 1; a b again: two stems with itself, one with b c, both ways
    assert {r.phrase: r.n for r in solver.soft_counts(df, ["g"]).collect()} == {"a b": 5.0, "b c": 2.0, "d": 1.0, "e f": 1.0}


def test_perceptrons(spark):
    feats = [(f"l{g}", f"c{i}", f, 1.0) for g in range(4) for i in range(12) for f in (["good"] if i < 4 else ["bad"]) + [f"noise{i % 3}"]]
    f = spark.createDataFrame(feats, "lecture string, concept string, feature string, value double")
    labels = f.where("feature = 'good'").select("lecture", "concept").distinct()
    w = {(r.fold, r.feature): r.w for r in learn.perceptron(f, labels, "lecture", chosen=4).collect()}
    assert all(w[f"l{g}", "good"] > w.get((f"l{g}", "bad"), 0) for g in range(4))
    cells = f.where("feature in ('good', 'bad')").select("lecture", F.col("concept").alias("phrase"), F.lit(1).alias("cost"), "concept", F.lit(1.0).alias("value"))
    decoded = {(r.fold, r.feature): r.w for r in learn.perceptron(f, labels, "lecture", problems=cells, budget=4, rounds=2).collect()}
    assert all(decoded[f"l{g}", "good"] > 0 for g in range(4))
    history = learn.weight_history(f, labels, "lecture", rounds=2, chosen=4)
    assert {r.feature for r in learn.resume(history, 0).collect()} <= {r.feature for r in learn.resume(history, 9).collect()}
    rows = f.groupBy("lecture", "concept").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("vector"), F.max((F.col("feature") == "good").cast("int")).alias("g")).withColumn("good", F.col("g") == 1)
    got = {(r.lecture, r.feature): r.w for r in learn.plain_perceptron(rows, "lecture", ["concept"]).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lecture, r.concept)):
        y = 1.0 if r.good else -1.0
        if y * sum(want.get((r.lecture, k), 0) * v for k, v in r.vector.items()) <= 0:
            for k, v in r.vector.items():
                want[r.lecture, k] = want.get((r.lecture, k), 0) + y * v
    assert got == want


def test_perceptron_crosses_folds_with_few_concepts(spark, monkeypatch):
    made, kept = {}, learn.kept
    monkeypatch.setattr(learn, "kept", lambda df, name: made.setdefault(name, []).append(kept(df, name)) or made[name][-1])
    feats = [(f"l{g}", f"c{i}", "good" if i % 3 else "bad", 1.0) for g in range(3) for i in range(200)]
    f = spark.createDataFrame(feats, "lecture string, concept string, feature string, value double")
    labels = f.where("feature = 'good'").select("lecture", "concept")
    learn.perceptron(f, labels, "lecture", rounds=2, chosen=5).collect()
    assert [t.count() for t in made["able"]] == [3 * 2 * 5] * 2
    assert {r["count"] for r in made["picked"][1].groupBy("fold", "lecture").count().collect()} == {5}


def test_subcommon_matches_are_complete(spark):
    rng = np.random.default_rng(5)
    a, b = (sorted({"".join(rng.choice(list("abcd"), int(rng.integers(1, 9)))) for _ in range(60)}) for _ in range(2))
    left, right = (spark.createDataFrame([(0, x) for x in v], f"k int, {c} string") for v, c in ((a, "a"), (b, "b")))
    want = {(x, y) for x in a for y in b if match.lcs_length(x, y) >= 0.8 * len(y) - 1e-9}
    assert {(r.a, r.b) for r in match.lcs_matches(left, right, "k", 0.8).collect()} == want


@pytest.mark.parametrize("seed", range(20))
def test_graphs_against_all_subsets(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 8))
    node = {i: float(x) for i, x in enumerate(rng.integers(-4, 5, n))}
    edges = {(i, j): float(rng.integers(-3, 4)) for i in range(n) for j in range(n) if i != j and rng.random() < 0.6}
    roots = set(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
    size = int(rng.integers(1, n + 1)) if seed % 3 == 0 else None
    best = float("-inf") if size else 0.0
    for k in [size] if size else range(1, n + 1):
        for sub in itertools.combinations(range(n), k):
            if tree := graph.arborescence(frozenset(sub), edges, roots):
                best = max(best, tree[0] + sum(node[x] for x in sub))
    got = graph.select_subgraph(node, edges, roots, size)
    assert got[0] == pytest.approx(best) or best == float("-inf")


def test_a_graph_of_24_nodes(spark):
    rng = np.random.default_rng(2)
    node = {i: float(x) for i, x in enumerate(rng.integers(-4, 5, 24))}
    edges = {(i, j): float(rng.integers(-3, 2)) for i in range(24) for j in range(24) if i != j and abs(i - j) < 4}
    weight, nodes, used = graph.select_subgraph(node, edges, {0, 12})
    assert weight == pytest.approx(sum(node[x] for x in nodes) + sum(edges[e] for e in used)) and len(used) == len(nodes) - 1


def test_k_medoids_beat_single_starts(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T

    def error(rows):
        return sum(d[r.id, r.medoid] for r in rows)

    many, one = (matrix.k_medoids(df, "id", "v", 5, restarts=k).collect() for k in (40, 1))
    assert len({r.medoid for r in many}) == 5 and error(many) <= error(one) + 1e-9
    assert error(many) <= matrix.pam(d, 5, restarts=40)[1] * 1.1
    owners = {r.id: r.medoid for r in many}
    assert all(d[i, m] <= min(d[i, k] for k in set(owners.values())) + 1e-9 for i, m in owners.items())
    assert matrix.k_medoids(df.limit(0), "id", "v", 3).collect() == []


def test_clusters_of_groups(spark):
    pairs = spark.createDataFrame([("g", a, b, 5.0 if a[0] == b[0] else None) for a, b in itertools.combinations(["a1", "a2", "a3", "b1", "b2"], 2)], "g string, a string, b string, similarity double")
    got = {r.item: r.medoid for r in matrix.cluster_groups(pairs, ["g"], ratio=2).collect()}
    assert {got[x][0] for x in ("a1", "a2", "a3")} == {"a"} and {got[x][0] for x in ("b1", "b2")} == {"b"}


def test_a_missing_similarity_is_no_distance_on_the_linear_scale(spark):
    """As in linear_distance: null counts as the same, so the pair shares a cluster; on the other scale it doesn't."""
    rows = [("g", "a", "b", None), ("g", "a", "c", 0.1), ("g", "b", "c", 0.1), ("g", "a", "d", 0.1), ("g", "b", "d", 0.1), ("g", "c", "d", 0.9)]
    pairs = spark.createDataFrame(rows, "g string, a string, b string, similarity double")
    got = {r.item: r.medoid for r in matrix.cluster_groups(pairs, ["g"], ratio=2, linear=True).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_completion(spark):
    cells = pd.DataFrame([("g", f"c{i}", j, float((i + 1) * (j + 1)) / 20) for i in range(4) for j in range(5) if (i, j) != (2, 3)], columns=["g", "concept", "pos", "value"])
    got = {(r.concept, r.pos): r.value for r in matrix.completed_cells(spark.createDataFrame(cells, "g string, concept string, pos int, value double"), ["g"], 0.01, most=200, tol=1e-9).collect()}
    assert len(got) == 20 and got["c2", 3] == pytest.approx(0.6, abs=0.05)
    assert all(got[c, p] == v for _, c, p, v in cells.itertuples(index=False))
    listed = spark.createDataFrame([("g", 0, "x"), ("g", 1, "y"), ("g", 2, "x")], "g string, pos int, phrase string")
    done = spark.createDataFrame([("g", "a", p, v) for p, v in ((0, 0.5), (1, 0.1), (2, 0.9))], "g string, concept string, pos int, value double")
    asked = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", "z")], "g string, phrase string")
    assert [tuple(r) for r in report.completed_incidence(asked, listed, done, ["g"], 0.2).collect()] == [("g", "x", "a", 0.5)]


def test_k_medoids_with_empty_partitions(spark):
    df = spark.range(12).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    want = {(r.id, r.medoid) for r in matrix.k_medoids(df.coalesce(1), "id", "v", 3, restarts=5).collect()}
    got = matrix.k_medoids(df.repartition(30), "id", "v", 3, restarts=5).collect()
    assert len(want) == 12 and {(r.id, r.medoid) for r in got} == want


def test_lexicon_is_joined_not_scanned(spark):
    docs = spark.createDataFrame([(1, "The cat the DOG"), (2, ""), (3, None), (1, "xyz"), (4, "dog dog")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("the",), ("dog",), ("dog",)], "word string")
    told = stats.lexicon_overlap(docs, lexicon)
    got = sorted(((r.doc_id, r.shared, r.outside) for r in told.collect()), key=repr)
    assert got == [(1, 0, 1.0), (1, 3, 0.25), (2, 0, None), (3, None, None), (4, 2, 0.0)]
    assert "array_contains" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_rouge_leaves_units_out_before_counting(spark):
    """Units that no reference of the key has aren't counted or shuffled."""
    asked = spark.createDataFrame([("k", "ROUGE-1", "b")], "ref_key string, metric string, unit string")
    texts = spark.createDataFrame([(1, "k", "a b b c"), (2, "other", "b")], "system_id long, ref_key string, text string")
    got = rouge.unit_rows(texts, ["system_id", "ref_key"], ["1"], asked).collect()
    assert [(r.system_id, r.unit, r.n) for r in got] == [(1, "b", 2)]
    refs = spark.createDataFrame([("k", 5, "b d"), ("k", 6, "c")], "ref_key string, ref_id long, text string")
    plan = rouge.rouge(texts, refs, ["1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_rouge_against_counts(spark):
    systems = spark.createDataFrame([(1, "t", "a b c d"), (2, "t", ""), (3, "u", "a b")], "system_id long, ref_key string, text string")
    refs = spark.createDataFrame([("t", 1, "a b x d"), ("t", 2, "b c d")], "ref_key string, ref_id long, text string")
    got = {(r.system_id, r.metric): r for r in rouge.rouge(systems, refs, ["1", "2", "su4"]).collect()}
    assert set(k for k, _ in got) == {1, 2}

    def su4(t):
        w = t.split()
        return w + [f"{w[i]} {w[j]}" for i in range(len(w)) for j in range(i + 1, min(len(w), i + 6))]

    for metric, units in (("ROUGE-1", lambda t: brute_grams(t, 1, False)), ("ROUGE-2", lambda t: brute_grams(t, 2, False)), ("ROUGE-SU4", su4)):
        mine, r, p = units("a b c d"), [], []
        for ref in ("a b x d", "b c d"):
            want = units(ref)
            hit = sum(min(mine.count(u), want.count(u)) for u in set(want))
            r.append(hit / len(want))
            p.append(hit / len(mine))
        assert got[1, metric].r == pytest.approx(sum(r) / 2) and got[1, metric].p == pytest.approx(sum(p) / 2)
        assert got[2, metric].f == 0


def test_exports_and_checks(spark):
    refs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "topic string, model int")
    assert report.exact_models(refs.where("topic = 'a'"), "topic", 2).count() == 2
    with pytest.raises(Exception, match="not 2 references"):
        report.exact_models(refs, "topic", 2).collect()
    known = spark.createDataFrame([("g", "b", 7)], "g string, concept string, id int")
    more = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "g string, concept string")
    assert {(r.g, r.concept): r.id for r in report.numbered_concepts(more, ["g"], known).collect()} == {("g", "b"): 7, ("g", "a"): 8, ("h", "c"): 1}
    assert report.rank_cap(1.5) == 500 and report.rank_cap(1.0) == 2000
    assert report.swept(more, report.parameter_grid(spark, x=[1, 2, 3])).count() == 9
    stop = stats.derived_stop_words(stats.document_frequencies(docs(spark)), 6, 0.4)
    assert {r.term for r in stop.collect()} == {"cat", "sat", "the"}


def test_parsed_sentences(spark):
    rows = [("", "", 0, i, w, p, c, t) for i, (w, p, c, t) in enumerate([("I", "PRP", "S-NP", "(S(NP*)"), ("saw", "VBD", "O", "(VP*"), ("a", "DT", "B-NP", "(NP(NP*"), ("big", "JJ", "I-NP", "*"), ("dog", "NN", "E-NP", "*)"), ("of", "IN", "O", "(PP*"), ("mine", "PRP", "S-NP", "(NP*))))"), ("!", ".", "O", "*)")])]
    t = spark.createDataFrame(rows, "lecture string, prompt string, sent_id int, tok_id int, token string, pos string, chk string, psg string")
    assert [(r.phrase, r.tags) for r in parse.paired_phrases(t).collect()] == [("I", "PRP"), ("a big dog of mine", "DT JJ NN IN PRP")]
    assert [r.phrase for r in parse.candidates(t, "sentence_filter").collect()] == ["saw a big dog of mine !"]
    assert sorted(r.value for r in parse.phrase_lines(t).collect()) == ["a/DT big/JJ dog/NN of/IN mine/PRP ./.", "i/PRP ./."]
    counts = spark.createDataFrame([("x", 3)], "sentence string, n int")
    assert parse.counted_sentences(spark.createDataFrame([("x",), ("y",)], "sentence string"), counts).count() == 4


def test_phrases_by_number_give_the_summaries_by_name(spark):
    rows = problems(np.random.default_rng(5), 4)
    number = {p: i for i, p in enumerate(sorted({r[1] for r in rows}))}
    schema = "g int, phrase {}, cost int, concept string, value double, theta double"
    by_name = spark.createDataFrame([*rows, (9, "long", 99, "c", 1.0, 1.0)], schema.format("string"))
    by_number = spark.createDataFrame([*((g, number[p], *rest) for g, p, *rest in rows), (9, 0, 99, "c", 1.0, 1.0)], schema.format("long"))
    told = lambda got: sorted((r.g, number.get(r.phrase, r.phrase), round(r.value, 9)) for r in got.collect())
    assert told(solver.summarize(by_number, ["g"], 8)) == told(solver.summarize(by_name, ["g"], 8)) != []
    swept = [sorted((r.g, r.budget, round(r.value, 9), [number.get(p, p) for p in r.phrases]) for r in solver.sweep(x, ["g"], [5, 8]).collect()) for x in (by_name, by_number)]
    assert swept[0] == swept[1]
    assert [r[1:] for r in swept[0] if r[0] == 9] == [(5.0, 0.0, []), (8.0, 0.0, [])]  # no phrase of the group fits


@pytest.mark.parametrize("text", ["", "  ", "one", " One two ", "a  b\tc\n\nd a b", "x y z $1 \\2 the of", None])
def test_bigram_pieces_are_the_pairs_and_the_last_token(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(T.bigram_pieces(F.col("text")).alias("p"), T.tokens(F.col("text")).alias("t")).first()
    assert got.p == (None if text is None else [f"{a} {b}" for a, b in zip(got.t, got.t[1:])] + (got.t[-1:] or [""]))


def test_some_bigrams_score_as_among_all(spark):
    docs = spark.createDataFrame([("s", "red car blue car red car red house"), ("u", "red car"), (None, "red car red house")], "source string, text string")
    every = {(r.source, r.bigram): (r.n, round(r.llr, 9)) for r in stats.collocations(docs, "source").collect()}
    assert set(every) == {("s", x) for x in ("red car", "car blue", "blue car", "car red", "red house")} | {("u", "red car")}
    pairs = stats.bigram_counts(docs, "source")
    some = {(r.source, r.bigram): (r.n, round(r.llr, 9)) for r in stats.likelihood_ratios(pairs.where("n >= 2"), pairs, "source").collect()}
    assert some == {k: v for k, v in every.items() if v[0] >= 2} and ("s", "red car") in some
