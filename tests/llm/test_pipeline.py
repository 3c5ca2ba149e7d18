import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import brute_groups, brute_lines, prose


@pytest.fixture
def sf(spark, tmp_path):
    item = prose(77, 40)
    rows = [(i, prose(i % 9, 60) + ("" if i % 3 else f" extra{i}") + f"\n{prose(1000 + i, 20)}", "en", f"s{i % 2}") for i in range(24)]
    rows += [(50, prose(50, 80) + " " + item, "en", "s0"), (51, "123 ?!", "en", "s1"), (52, None, "en", "s1"), (53, "", None, None)]
    spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = []
    for i, (name, stage) in enumerate(P.STAGES):
        path = f"{sf}/stage{i}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert i == 4 or docs.columns == columns, name
        out.append({r.doc_id: r for r in docs.collect()})
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(out[0]) == set(source) - {51, 52, 53}
    gone = brute_lines([(d, r.text) for d, r in out[0].items()])
    cut = {d: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(d, ())) for d, r in out[0].items()}
    assert {d: r.text for d, r in out[1].items()} == {d: t for d, t in cut.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in out[1].values())
    rows = sorted((d, r.text) for d, r in out[1].items())
    _, label = brute_groups(rows)
    least = {}
    for (d, _), x in zip(rows, label):
        least.setdefault(x, d)
    assert set(out[2]) == set(least.values())
    assert set(out[3]) == set(out[2]) - {50}
    assert set(out[4]) <= set(out[3]) and all(0 < r.taken <= 3 * r.size for r in out[4].values())
    assert sorted(map(tuple, P.run(spark, sf).collect()), key=str) == sorted(map(tuple, out[4].values()), key=str)


@pytest.mark.parametrize("which", range(5))
def test_stages_on_odd_tables(spark, sf, which):
    """Null and repeated ids, repeated rows, no rows; columns of the operators' own names keep what they hold."""
    _, stage = P.STAGES[which]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"_lines": F.lit("mine"), "_removed": F.lit("own"), "item_id": F.lit("x"), "look": F.lit("y")})
    a, b = prose(500, 40), prose(501, 40)
    more = [(None, a, "en", "s0"), (None, b, "en", "s0"), (7, a + " more", "en", "s0"), (900, b, "en", None), (901, None, "en", "s1"), (901, None, "en", "s1")]
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in more], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.unionByName(rows, allowMissingColumns=True)
    got = stage(spark, odd, sf)
    told = [r.asDict() for r in got.collect()]
    if which < 4:
        assert got.columns == odd.columns
        known = {r.doc_id: r for r in docs.collect()}
        assert all(r["_lines"] == "mine" and r["_removed"] == "own" and r["look"] == "y" for r in told if r["doc_id"] in known and r["_lines"] is not None)
        assert sum(r["_lines"] == "mine" for r in told) > 5
    texts = [r.get("text") for r in told]
    if which == 0:
        assert None not in texts and "" not in texts
    if which == 1:
        assert texts.count(None) == 3 and texts.count(b) == 1
    if which == 2:
        assert texts.count(None) == 3 and texts.count(a) + texts.count(a + " more") == 1 and texts.count(b) == 1 and {r["doc_id"] for r in told if r["text"] in (b, a + " more")} == {900, 7}
    if which == 3:
        assert len(told) == odd.count() - 1
    empty = stage(spark, odd.limit(0), sf)
    assert empty.count() == 0 and empty.columns == got.columns
