import hashlib
import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condensa.llm import fim, lexical, neighbours

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


# ---- fill-in-the-middle --------------------------------------------------
def woven(key, text):
    """Brute force: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def mixed(rng, n):
    parts = ["a", "über", "日本", "\t", "\n\n", " ", "  x", "<P", ">", "<", "S>", " ", " ", "\x1c", "\x85", "M", "end.\r\n"]
    return "".join(rng.choice(parts, n))


def test_fill_in_middle_against_the_expression(spark):
    rng = np.random.default_rng(1)
    texts = [mixed(rng, int(rng.integers(0, 40))) for _ in range(400)] + ["", None, " ", "\n\n", "x", "x ", " x", "a <M> b", "<P", "<", "\x0b\x0c"]
    texts += ["word " * 60_000, mixed(rng, 30_000)] * 4
    docs = [(i if i % 97 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n", "form", "output", "key", "h1")})
    rows = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    told = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows), key=repr)
    assert told == sorted(((k, *woven(k, t), t or "") for k, t in docs), key=repr)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    empty = fim.fill_in_middle(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_pieces_of_a_long_text_give_the_same_cuts(monkeypatch, size):
    """Texts longer than a slice go through in pieces; a mark over the edge of two is seen."""
    rng = np.random.default_rng(size)
    texts = [mixed(rng, int(rng.integers(0, 60))) for _ in range(60)] + ["abcd<P>ef", "<S>", "ab<M>", ""]
    draws = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts), *(pa.array([int(d[8 * j : 8 * j + 8], 16) for d in draws]) for j in range(4))], names=["key", "text", "h1", "h2", "h3", "h4"]
    )
    monkeypatch.setattr(fim, "SLICE", size)
    for part in (batch, batch.slice(7)):
        rows = [tuple(r.values()) for b in fim._transform(50, 80)(iter([part])) for r in b.to_pylist()]
        assert rows == [(k, *woven(k, texts[k])) for k in part.column("key").to_pylist()]


# ---- ranked lexical search -----------------------------------------------
def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k=10):
    """Brute force: (item_id, rank, doc_id, score)."""
    held = [(d, Counter(t), len(t)) for d, x in docs for t in [terms_of(x)]]
    n_all, l_all = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, n in held:
            score = 0
            for t in terms_of(text) if n else []:
                if c[t]:
                    m = 100 - 75 + (75 * n * n_all) // l_all
                    score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "Of", "É", "naïve", "日本", "x1", "Zz", *(f"w{i}" for i in range(words))]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ,".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=share / share.sum())) for _ in range(n)]


def test_search_against_brute_force(spark):
    texts = corpus(2, 3000)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (9001, None), (9002, ""), (9003, "..."), (17, texts[17])]
    docs += [(10_000 + i, texts[1]) for i in range(60)] + [(20_000, " ".join(texts) * 4)]
    items = [(i, t) for i, t in enumerate(corpus(3, 30))] + [(0, "the the THE of w1"), (1, None), (2, ""), (3, "unknown words"), (None, "zz x1"), (4, "the " * 300), (4, "the " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("mine") for c in ("key", "q", "score", "item_id", "rank")})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumns({c: F.lit("mine") for c in ("q", "doc_id")})
    got = sorted((tuple(r) for r in lexical.search(df, asked).collect()), key=repr)
    assert got == ranked(docs, [i for i in items if i[1] is not None])
    assert len(got) > 200
    for a, b in ((df.limit(0), asked), (df, asked.limit(0)), (df.where("doc_id = 9003"), asked)):
        out = lexical.search(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("block,chunk,piece", [(1, 1, 1), (64, 3, 7), (65, 4096, 1 << 20), (200, 10, 16)])
def test_blocks_chunks_and_pieces_change_nothing(monkeypatch, block, chunk, piece):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("PIECE", piece)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = list(enumerate(corpus(4, 150))), list(enumerate(corpus(5, 12)))
    want = ranked(docs, items)
    queries = lexical.Queries([[t for p in lexical.terms(x.encode()) for t in p] for _, x in items])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["key", "text"])
    counts = Counter()
    for b in lexical._count(SimpleNamespace(value=queries.known))(iter([batch.slice(0, 70), batch.slice(70)])):
        for r in b.to_pylist():
            counts[r["term"]] += r["n"]
    documents, all_terms = counts.pop(-1), counts.pop(-2)
    queries.weigh(documents, counts)
    rows = [r for b in lexical._search(SimpleNamespace(value=(queries, documents, all_terms)), 10)(iter([batch])) for r in b.to_pylist()]
    got = []
    for q, (item, _) in enumerate(items):
        mine = sorted(((-r["score"], r["doc_id"]) for r in rows if r["q"] == q))
        got += [(item, i + 1, d, -s) for i, (s, d) in enumerate(mine)]
    assert sorted(got, key=repr) == want


def test_slices_add_like_numbers():
    rng = np.random.default_rng(6)
    impact = rng.integers(0, 1 << 40, (5, 130)) * (rng.random((5, 130)) < 0.6)
    term, doc = np.nonzero(impact)
    index = lexical.slices_of(term, doc, impact[term, doc], 5, 3)
    total = np.zeros((50, 2, 3), np.uint64)
    for which, shift in (([0, 1], 0), ([2, 5], 0), ([3, 3], 2), ([0, 4], 1)):
        lexical.add(total, index, np.array(which), shift)
    value = [sum(((total[b, q, d >> 6] >> np.uint64(d & 63)) & np.uint64(1)).item() << b for b in range(50)) for q in range(2) for d in range(130)]
    assert value == [*(impact[0] + impact[2] + 4 * impact[3] + 2 * impact[0]), *(impact[1] + 4 * impact[3] + 2 * impact[4])]


# ---- nearest neighbours --------------------------------------------------
def brute(rows, queries, k=5):
    """(query, vec_id, score) by cosine; ties to the smaller id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    size = max(len(v) for _, v in good)
    pad = lambda v: np.pad(v, (0, size - len(v)))
    out = {}
    for q, v in good:
        if q in queries:
            scores = sorted((-round(float(pad(v) @ pad(x) / (np.linalg.norm(v) * np.linalg.norm(x))), 12), i) for i, x in good if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(spark, rows, by, **more):
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumns({c: F.lit("mine") for c in ("leaf", "query", "own", "ids")})
    out = {}
    for r in neighbours.approximate_neighbours(df, df.where(f"vec_id % {by} = 0"), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12), r.rank))
    assert all([x[2] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[:2] for x in v] for q, v in out.items()}


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_neighbours_reach_the_recall(spark, spread):
    """Clustered and structureless vectors: 0.9 of the true neighbours at least, every score exact, and the same again."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 6000)] * (1 - spread) + spread * rng.normal(size=(6000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, unit = found(spark, rows, 40), x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q, near in got.items():
        cos = unit @ unit[q]
        assert all(abs(cos[i] - s) < 1e-9 for i, s in near) and q not in [i for i, _ in near] and [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        cos[q] = -2
        hits += len({i for i, _ in near} & set(np.argsort(-cos)[:5].tolist()))
    print(f"recall {hits / (5 * len(got)):.3f}")
    assert len(got) == 150 and all(len(v) == 5 for v in got.values()) and hits >= 0.9 * 5 * len(got)
    if spread == 1.0:
        assert found(spark, rows[::-1], 40) == got


def test_neighbours_of_copies_and_odd_vectors(spark):
    """Ties go to the smaller ids, copies among them; what is no vector takes no part."""
    rng = np.random.default_rng(8)
    one = rng.normal(size=8).tolist()
    rows = [(i, one) for i in range(0, 90, 3)] + [(i, [2 * x for x in one]) for i in range(1, 60, 3)] + [(200 + i, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(6, one), (6, one), (300, None), (310, []), (320, [0.0] * 8), (330, [float("nan")] * 8), (340, [1.0, None]), (350, [float("inf"), 1.0]), (None, one), (360, [1e300, -1e300, 3.0]), (370, [5e-324, 0.0])]
    got, want = found(spark, rows, 10), brute([r for r in rows if r[0] not in (360, 370)], set(range(0, 400, 10)))
    exact = {q: v for q, v in got.items() if q not in (360, 370)}
    assert exact.keys() == want.keys() and {300, 310, 320, 330, 340, 350}.isdisjoint(got)
    for q in (0, 10, 30, 60):
        assert [i for i, _ in exact[q]] == [i for i, _ in want[q]]
    assert all(len(v) == 5 and all(math.isfinite(s) for _, s in v) for v in got.values())
    assert found(spark, rows[:3], 3) == {0: [(3, 1.0), (6, 1.0)], 3: [(0, 1.0), (6, 1.0)], 6: [(0, 1.0), (3, 1.0)]}
    assert found(spark, [(0, one)], 10) == {} and found(spark, rows[:0], 10) == {} and found(spark, [(1, one)], 10) == {}


def test_tree_visits_every_leaf_best_bin_first():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = neighbours.grow(x, 40)
    leaf = tree.assign(x)
    assert tree.leaves >= 30 and set(leaf.tolist()) <= set(range(tree.leaves))
    orders = [tree.visits(v, tree.leaves) for v in x[:50]]
    assert all(sorted(o) == list(range(tree.leaves)) for o in orders)
    assert np.mean([o.index(i) for o, i in zip(orders, leaf)]) < 2
    assert neighbours.calibrated([[2, 0, 1]], [(0, 2), (0, 2), (0, 0), (0, 1)], 0.75) == 2 and neighbours.calibrated([], [], 0.9) == 1
    assert neighbours.grow(np.ones((500, 3)), 50).leaves == 1
