import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions import vectors as V
from condensa.functions.stem import stem
from condensa.operators import concepts, graph, match, matrix, parse, rouge, solver, stats


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


def test_porter_vectors():
    want = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "disabled": "disabl", "matting": "mat", "mating": "mate", "meeting": "meet", "milling": "mill", "messing": "mess", "meetings": "meet", "relational": "relat", "probate": "probat", "controlling": "control", "happy": "happi", "sky": "sky", "is": "is"}
    assert {w: stem(w) for w in want} == want


def test_lcs():
    assert match.lcs_length("ABABC", "BABCA") == 4

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0))
        return row[-1]

    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in "ab")
        assert match.lcs_length(a, b) == plain(a, b)


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[0.0, 0.0]) == 1
    assert one(spark, V.angle(a, b), a=[1.0, 0.0, 0.0], b=[0.0, 1.0, 0.0]) == pytest.approx(math.pi / 2)
    assert one(spark, V.angle(a, b), a=[1.0, 0.0], b=[-1.0, 0.0]) == pytest.approx(math.pi)
    with pytest.raises(Exception, match="beyond the end"):
        one(spark, V.bin_index(F.col("v"), 0.0, 9.0, 5), v=10)


def test_trimmed_parts_keep_digits(spark, tmp_path):
    """A trim over an array must not take the place in it for the characters to strip."""
    lines = [f"{i}1.2 word {i}" for i in range(25)]
    assert one(spark, T.sentences(F.col("t")), t="\n".join(f" {x} " for x in lines)) == lines
    (tmp_path / "p").write_text("0word0\tNN1\t2B-NP2 \tO\t-\t(S*)\n")
    row = parse.read_parses(spark, str(tmp_path)).first()
    assert (row.token, row.pos, row.chk) == ("0word0", "NN1", "2B-NP2")


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.ngrams(T.tokens(t), 2), t="How  to solve") == ["how to", "to solve"]
    assert one(spark, T.ngrams(T.tokens(t), 3), t="a b") == []
    assert one(spark, T.drop_stop_ngrams(T.ngrams(T.tokens(t), 2)), t="of the cat") == ["the cat"]
    assert one(spark, T.skip_bigrams(T.tokens(t), 1), t="a b c d") == ["a b", "a c", "b c", "b d", "c d"]
    assert one(spark, T.normalize_reference(t), t="1) more examples [3]") == "more examples"
    assert one(spark, T.reference_weight(t), t="1) more examples [3]") == 3 and one(spark, T.reference_weight(t), t="none") == 1
    assert [one(spark, T.is_malformed(t), t=x) for x in ("the", "12", ", so", "the cat")] == [True, True, True, False]
    assert one(spark, T.paragraphs(t), t="<p>a <b>b</b></p><pre>x</pre><P>yes</P><p class='x'>c\n d</p>") == ["a b", "yes", "c d"]


def test_tokenize_longest():
    phrases = ["a", "a b", "a b c", "c d", "d"]
    assert match.tokenize_longest("A B C D".split(), phrases) == ["A B C", "D"]


def test_matches_in_spark(spark):
    docs = spark.createDataFrame([(1, "A B C D")], "doc_id long, text string")
    phrases = spark.createDataFrame([(p,) for p in ["a", "a b", "a b c", "c d", "d"]], "phrase string")
    assert {r.phrase for r in match.all_matches(docs, phrases).collect()} == {"a", "a b", "a b c", "c d", "d"}
    assert sorted((r.pos, r.phrase) for r in match.longest_matches(docs, phrases).collect()) == [(0, "a b c"), (3, "d")]


@pytest.mark.parametrize("seed", range(15))
def test_solver_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = 9, 7
    cells = []
    for _ in range(n):
        i = rng.choice(m, rng.integers(1, 4), replace=False)
        cells.append((i, rng.choice([0.5, 1.0, 1.0, 1.2 if seed % 3 == 0 else 1.0], len(i))))
    rows, concepts, values = np.cumsum([0, *(len(i) for i, _ in cells)]), np.concatenate([i for i, _ in cells]), np.concatenate([v for _, v in cells])
    p = solver.Problem(rng.integers(1, 6, n).astype(float), rows, concepts, values, rng.integers(1, 9, m).astype(float), 9.0)
    ok = p.usable()
    best = max(p.value(s) for k in range(n + 1) for s in itertools.combinations(np.flatnonzero(ok), k) if p.cost[list(s)].sum() <= p.budget)
    chosen, value, bound = solver.solve(p)
    assert value == pytest.approx(best) and bound == pytest.approx(best)
    assert p.cost[chosen].sum() <= p.budget and p.value(chosen) == pytest.approx(value)
    assert value >= p.value(solver.greedy(p)) - 1e-9


def test_solver_in_spark(spark):
    rows = [("g", "p1", 2, "a", 1.0, 3.0), ("g", "p1", 2, "b", 1.0, 2.0), ("g", "p2", 2, "b", 1.0, 2.0), ("g", "p3", 3, "c", 1.0, 4.0), ("g", "p4", 9, "a", 1.0, 3.0)]
    got = solver.summarize(spark.createDataFrame(rows, "g string, phrase string, cost int, concept string, value double, theta double"), ["g"], 5).collect()
    assert {r.phrase for r in got} == {"p1", "p3"} and got[0].value == 9.0


def test_a_group_may_choose_nothing(spark):
    rows = [("g", "p1", 2, "a", 1.0, -1.0), ("h", "p1", 2, "a", 1.0, 1.0)]
    got = solver.summarize(spark.createDataFrame(rows, "g string, phrase string, cost int, concept string, value double, theta double"), ["g"], 5).collect()
    assert [(r.g, r.phrase) for r in got] == [("h", "p1")]


def test_graph():
    w, nodes, edges = graph.select_subgraph({1: 1.0, 2: -0.5, 3: 2.0, 4: -3.0}, {(1, 2): 0.2, (2, 3): 0.5, (3, 1): 1.0, (4, 3): 9.0}, {1})
    assert (nodes, edges) == ([1, 2, 3], [(1, 2), (2, 3)]) and w == pytest.approx(3.2)


def test_pam_is_a_partition():
    d = np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0]], float)
    owner, error = matrix.pam(d, 2)
    assert error == 1 and owner[0] == owner[1] != owner[2]


def test_soft_impute_keeps_known_cells(spark):
    rng = np.random.default_rng(0)
    full = np.outer(rng.random(12) + 0.5, rng.random(6) + 0.5)
    seen = np.where(rng.random(full.shape) < 0.7, full, np.nan)
    df = spark.createDataFrame([(i, "g", [float(x) for x in r]) for i, r in enumerate(seen)], "k long, g string, v array<double>")
    got = np.array([r.completed for r in matrix.soft_impute(df, "k", "g", "v", 0.3, most=7, tol=0).orderBy("k").collect()])
    known = ~np.isnan(seen)
    assert np.allclose(got[known], seen[known])
    z = np.where(known, seen, 0)
    for _ in range(7):  # the plain algorithm
        u, d, v = np.linalg.svd(z, full_matrices=False)
        z = np.where(known, seen, u * np.maximum(d - 0.3, 0) @ v)
    assert np.allclose(got, z)


def test_lsa_rebuilds_low_rank(spark):
    x = np.outer(np.arange(1, 6), [1.0, 2.0, 3.0])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>")
    rows, s, v = matrix.lsa(df, "k", "v", 1)
    u = np.array([r.factor for r in rows.orderBy("k").collect()])
    assert np.allclose(u * s @ v.T, x)


def test_rouge(spark):
    systems = spark.createDataFrame([(1, "k", "the cat sat"), (2, "none", "x")], "system_id long, ref_key string, text string")
    refs = spark.createDataFrame([("k", 1, "the cat ran"), ("k", 2, "dogs")], "ref_key string, ref_id long, text string")
    got = {r.metric: r for r in rouge.rouge(systems, refs, ["1"], "max").collect()}
    assert got["ROUGE-1"].r == pytest.approx(2 / 3) and got["ROUGE-1"].f == pytest.approx(2 / 3)


def test_parse(spark, tmp_path):
    (tmp_path / "x.txt").write_text("the\tDT\tB-NP\tO\t-\t(S(NP*\nred\tJJ\tI-NP\tO\t-\t*\ncat\tNN\tE-NP\tO\t-\t*)\nsat\tVBD\tS-VP\tO\tsat\t(VP*))\n\nI\tPRP\tS-NP\tO\t-\t(S(NP*))\n")
    tokens = parse.read_parses(spark, str(tmp_path)).cache()
    assert sorted(r.phrase for r in parse.chunks(tokens).collect()) == ["I", "the red cat"]
    assert sorted(r.phrase for r in parse.syntactic_phrases(tokens).collect()) == ["I", "the red cat"]
    assert [(r.noun, r.adjective) for r in parse.adjective_noun_pairs(tokens).collect()] == [("cat", "red")]
    assert "the/DT red/JJ cat/NN sat/VBD ./." in {r.value for r in parse.opinosis_lines(tokens).collect()}


def test_group_similarity_has_a_zero_vector(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [0.0, 0.0])], "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: round(r.theta, 9) for r in stats.group_similarity(df).collect()} == {1: 2.0, 2: 2.0, 3: 3.0}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert concepts.top(concepts.theta_distinct(concepts.responses(docs)), 3).collect() == []


def test_a_cosine_with_known_norms_is_the_cosine(spark):
    from pyspark.sql import functions as F

    from condensa.functions.vectors import cosine, cosine_of, norm

    df = spark.createDataFrame([([1.0, 2.0], [3.0, -0.1]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    known = df.withColumns({"m": norm(F.col("a")), "n": norm(F.col("b"))}).select(cosine(F.col("a"), F.col("b")), cosine_of(F.col("a"), F.col("m"), F.col("b"), F.col("n")))
    assert all(x == y for x, y in known.collect()) and known.count() == 3
