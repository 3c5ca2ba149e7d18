"""Queries that left rows out, and steps that were mended, on small inputs."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from condensa.operators import concepts as C
from condensa.operators import lowrank
from condensa.plans import catalogue, evaluation  # noqa: F401 - registers its queries


def test_side_by_side_has_every_document_sentence_and_language(spark, tmp_path):
    rows = [(7, "s", "fr", "Un. Deux"), (17, "s", "fr", "Trois"), (4, "s", "es", "Uno"), (10, "s", "de", "Eins? Zwei"), (23, None, "en", "One"), (24, "s", "en", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: r for r in catalogue.QUERIES["side_by_side"](spark, str(tmp_path)).collect()}
    assert got["s"].asDict() == {"source": "s", "de:0": "Eins?;Zwei", "de:1": "", "en:0": "", "en:1": "", "es:0": "Uno", "es:1": "", "fr:0": "", "fr:1": "Un.;Deux;Trois"}
    assert got[None]["en:1"] == "One"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(catalogue.ORACLES["side_by_side"])
    columns = [d[0] for d in told.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.values()))) == sorted(map(repr, told.fetchall()))


def _shuffled(df, column):
    """Exchanges of the plan that carry a column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and column in x]


def test_stemmed_incidence_shuffles_units_only(spark):
    rows = [("l", "p", "the cats running. the cats running"), ("l", "p", "of the"), ("l", "p", "Cat runs cat runs cat"), ("l", "q", "word"), (None, "q", "dogs barked"), ("l", "p", None)]
    units = C.phrases(spark.createDataFrame(rows, "lecture string, prompt string, text string").withColumn("student", F.lit(1)), "sentence").select(*C.GROUP, "phrase")
    found = C.incidence(units, stemmed=True)
    assert not _shuffled(found, "concept") and len(_shuffled(found, "phrase")) == 1 and not _shuffled(found, "word__")
    assert {(r.lecture, r.phrase, r.concept, r.occ) for r in found.collect()} == {
        ("l", "the cats running.", "the cat", 1), ("l", "the cats running.", "cat running.", 1), ("l", "the cats running", "the cat", 1), ("l", "the cats running", "cat run", 1),
        ("l", "Cat runs cat runs cat", "cat run", 2), ("l", "Cat runs cat runs cat", "run cat", 2), (None, "dogs barked", "dog bark", 1),
    }
    twice = C.incidence(units.unionByName(units), stemmed=True, n=1, stop=None).where("phrase = 'Cat runs cat runs cat'")
    assert {(r.concept, r.occ) for r in twice.collect()} == {("cat", 6), ("run", 4)}


def test_prompt_similarity_counts_repeats_and_copies(spark):
    rows = [("l", "p", 1, "a1 b1 a1 c1"), ("l", "p", 1, "a1 b1 a1 c1"), (None, "p", None, "a1 b1 x1"), ("l", "q", 2, "a1 b1"), ("l", "r", 3, "a1 b1")]
    resp = spark.createDataFrame(rows, "lecture string, prompt string, student long, text string")
    prompts = spark.createDataFrame([("p", ["a1", "c1"]), ("q", ["z1"])], "prompt string, words array<string>")
    found = C.prompt_similarity_features(resp, prompts)
    assert "array_contains" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.lecture, r.prompt, r.concept, r.feature) for r in found.where("feature IN ('prompt_sim=0', 'prompt_sim<=1', 'prompt_sim>2')").collect()} == {
        ("l", "p", "a1 b1", "prompt_sim>2"), ("l", "p", "b1 a1", "prompt_sim>2"), ("l", "p", "a1 c1", "prompt_sim>2"), (None, "p", "a1 b1", "prompt_sim<=1"), (None, "p", "b1 x1", "prompt_sim<=1"),
        ("l", "q", "a1 b1", "prompt_sim=0"), ("l", "q", "a1 b1", "prompt_sim<=1"),
    }


def _cells(spark, x):
    return spark.createDataFrame([(int(i), f"c{j:03}", float(x[i, j])) for i, j in np.argwhere(x != 0)], "r long, c string, v double")


def test_columns_of_the_same_cells_are_worked_on_once(spark, monkeypatch):
    sizes = []
    rng = np.random.default_rng(5)
    few = rng.integers(0, 3, size=(9, 6)).astype(float)
    x = few[:, rng.integers(0, 6, 40)]
    times = lowrank.Sparse.times

    def seen(self, side, *rest):
        sizes.append(self.size["j"])
        return times(self, side, *rest)

    monkeypatch.setattr(lowrank.Sparse, "times", seen)
    left, s, right = lowrank.truncated_svd(_cells(spark, x), "r", "c", "v", 4)
    assert max(sizes) <= 6
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:4])
    u = {r.r: r.factor for r in left.collect()}
    v = {r.c: r.factor for r in right.collect()}
    dense = lambda f, keys: np.array([f.get(k, [0.0] * 4) for k in keys])
    u, v = dense(u, range(9)), dense(v, [f"c{j:03}" for j in range(40)])
    assert np.allclose(u.T @ x @ v, np.diag(s)) and np.allclose(v.T @ v, np.eye(4)) and ((v**3).sum(0) > -1e-9).all()


def test_completion_has_the_ranks_that_its_penalty_leaves(spark, tmp_path):
    """Texts with nothing in common: each is a direction of its own, beyond the eight of before."""
    rows = [(i, "s", "en", " ".join(f"w{i}x{k}" for k in range(12))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["soft_impute_concepts"](spark, str(tmp_path)).collect()
    assert len(got) == 132 and {len(r.factor) for r in got} == {12}
