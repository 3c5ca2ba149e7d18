import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condensa.llm import blocks, decontaminate, jaccard, langid, linedup, mixing, tokencount, topk, toxicity, warc
from condensa.llm.scratch import Scratch

WORD = re.compile("[0-9a-z_\u0080-\U0010ffff]+")
TEXTS = ["", None, "One two", "ONE, two!", "é à b-c_d 9", "\n\na\n b", "x" * 5000, "日本 語", "..."]


def prose(seed, n, words=4000):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, words, n))


def test_words_are_those_of_the_expression():
    w = blocks.words(pa.array(TEXTS, pa.string()))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.rows[:-1], w.rows[1:])]
    assert got == [WORD.findall((t or "").lower()) for t in TEXTS]
    flat = [x for t in got for x in t]
    assert len(set(w.hash.tolist())) == len(set(flat)) and w.hash[0] == w.hash[2]


def test_long_data_is_hashed_in_pieces(monkeypatch):
    texts = [prose(4, 3000), "x" * 9000 + " y", "", "é" * 500]
    whole = blocks.words(pa.array(texts)).hash.tolist()
    monkeypatch.setattr(blocks, "SLICE_BYTES", 100)
    assert blocks.words(pa.array(texts)).hash.tolist() == whole


def test_decontamination_against_every_window(spark):
    """Only documents with a window that aligns at the threshold are found; all that keep a run of three words, and most of those edited to the limit."""
    rng = np.random.default_rng(12)
    items = [(i, prose(300 + i, int(rng.integers(12, 40)), 3000)) for i in range(12)]
    docs = []
    for d in range(60):
        words = items[d % 12][1].split()
        for _ in range(int(rng.integers(0, 12))):
            at, how = int(rng.integers(len(words))), rng.integers(3)
            words[at : at + 1] = [[], ["new"], [words[at], "more"]][how]
        docs.append((d, prose(900 + d, 60, 3000) + " " + " ".join(words) + " " + prose(1900 + d, 60, 3000)))
    want = set()
    for d, text in docs:
        w = blocks.words(pa.array([text])).hash
        for i, item in items:
            q = blocks.words(pa.array([item])).hash
            if decontaminate.align(q, w)[0] >= 0.5 * 2 * len(q):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    shared = {(d, i) for d, t in docs for i, q in items if set(zip(t.split(), t.split()[1:], t.split()[2:])) & set(zip(q.split(), q.split()[1:], q.split()[2:]))}
    print(f"recall {len(got) / len(want):.3f} of {len(want)}")
    assert want & shared <= got <= want and len(got) >= 0.9 * len(want) and len(want) > 40


def test_decontamination_where_seeds_are_common(spark):
    """Of 1,600 documents more than RARE_DOCS hold a phrase that items have too: its seeds are dropped, and copies edited to the limit are found by the others."""
    rng = np.random.default_rng(13)
    common = [prose(400 + i, 6, 2000) for i in range(4)]
    items = [(i, f"{prose(500 + i, 12, 2000)} {common[i % 4]} {prose(600 + i, 14, 2000)}") for i in range(20)] + [(100, "zebra quagga"), (101, "okapi"), (102, common[0].split()[0])]
    docs = [(d, f"{prose(5000 + d, 40, 2000)} {common[d % 4]} {prose(9000 + d, 40, 2000)}") for d in range(1000)]
    for d in range(1000, 1600):
        words = items[d % 20][1].split()
        for _ in range(int(rng.integers(4, 16))):
            at, how = int(rng.integers(len(words))), rng.integers(3)
            words[at : at + 1] = [[], [f"w{rng.integers(2000)}"], [words[at], f"w{rng.integers(2000)}"]][how]
        docs.append((d, f"{prose(5000 + d, 60, 2000)} {' '.join(words)} {prose(9000 + d, 60, 2000)}"))
    docs += [(2000, "a Zebra, quagga!"), (2001, "zebra or quagga"), (2002, "the okapi")]
    hashes = {d: blocks.words(pa.array([t])).hash for d, t in docs}
    items_of = {i: blocks.words(pa.array([t])).hash for i, t in items[:20]}
    want = {(d, i) for d, w in hashes.items() for i, q in items_of.items() if d >= 1000 and d < 2000 and d % 20 == i and decontaminate.align(q, w)[0] >= len(q)}
    rows = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    print(f"recall {len(got & want) / len(want):.3f} of {len(want)}")
    assert got - want == {(2000, 100), (2002, 101)} and len(got & want) >= 0.9 * len(want) and len(want) > 400
    assert all(d >= 1000 for d, _ in got)


def test_shingles():
    w = blocks.words(pa.array(["a b c", "a", "", "b c"], pa.string()))
    grams, at, first = blocks.shingles(w.hash, w.rows, 2)
    assert at.tolist() == [0, 2, 3, 3, 4] and first.tolist() == [0, 1, 3, 4] and grams[1] == grams[3]


def grams5(text):
    t = WORD.findall((text or "").lower())
    return {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else ({tuple(t)} if t else set())


def brute_groups(rows):
    sets = [grams5(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i, j in itertools.product(range(n), repeat=2):
            if link[i][j]:
                label[i] = label[j] = min(label[i], label[j])
    return [sum(x) for x in link], label


def near_rows():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = prose(g, int(rng.integers(3, 120))).split()
        for _ in range(int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[rng.integers(len(copy))] = f"edit{rng.integers(9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, "!!"), (5, rows[5][1]), (None, rows[7][1])]


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 2)  # clusters cut into blocks
    rows = near_rows()
    links, label = brute_groups(rows)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, links int")
    got = sorted(((r.doc_id, r.links, r.class_id) for r in jaccard.jaccard_join(docs).collect()), key=str)
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min([v for v in (least.get(x), d) if v is not None], default=None)
    assert got == sorted(((d, k, least[x]) for (d, _), k, x in zip(rows, links, label)), key=str)
    kept = jaccard.keep_one(docs.withColumn("_k", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("row", F.lit(3)).withColumn("key", F.lit(4)))
    assert kept.columns == [*docs.columns, "_k", "_id", "row", "key"] and kept.select("_k", "_id", "row", "key").distinct().collect() == [(1, 2, 3, 4)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v for v in least.values() if v is not None})
    assert jaccard.jaccard_join(docs.limit(0)).collect() == [] == jaccard.keep_one(docs.limit(0)).collect()


def test_bands_reach_the_recall():
    b, r = jaccard.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 128


def brute_lines(rows, t=0.8):
    lines = sorted((d is None, d or 0, i, frozenset(WORD.findall(x.lower()))) for d, text in rows if text is not None for i, x in enumerate(text.split("\n")))
    out = {}
    for k, (n, d, i, s) in enumerate(lines):
        if s and any(q and (a, b, c) < (n, d, i) and len(s & q) >= t * len(s | q) - 1e-9 for a, b, c, q in lines[:k]):
            out.setdefault(None if n else d, set()).add(i)
    return out


def test_line_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linedup, "TOKEN_BLOCK", 2)  # tokens split in parts
    monkeypatch.setattr(linedup, "FEW", 1)
    monkeypatch.setattr(linedup, "MORE", 2)  # several rounds
    rng = np.random.default_rng(8)
    pool = [prose(s, int(rng.integers(1, 25)), 60) for s in range(40)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            w = pool[rng.integers(40)].split()
            if rng.random() < 0.5:
                w[rng.integers(len(w))] = f"e{rng.integers(5)}"
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[3]), (3, rows[3][1])]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, line string")
    want = brute_lines(rows)
    assert {r.doc_id: set(r.lines) for r in linedup.later_matches(docs).collect()} == want
    got = linedup.dedup_lines(docs).collect()
    for r in got:
        source = dict(rows)[r.doc_id]
        keep = None if source is None else "\n".join(x for i, x in enumerate(source.split("\n")) if i not in want.get(r.doc_id, ()))
        assert r.text == keep and r.line == "x"
    assert len(got) == len(rows)
    assert linedup.dedup_lines(docs.limit(0)).collect() == []


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c, d, e = (prose(900 + s, 12, 5000) for s in range(5))
    rows = [(1, a), (None, f"{a}\n{b}"), (None, f"{c}\n{d}"), (None, f"{e}\n{d}"), (2, f"{a}\n{e} x"), (2, b)]
    got = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got if r.doc_id is not None) == sorted([a, f"{e} x", b])
    left = [r.text for r in got if r.doc_id is None]
    assert sorted(left) in (sorted(["", f"{c}\n{d}", ""]), sorted(["", c, d]))


def test_line_dedup_of_many_lines_long_texts_and_clashing_columns(spark):
    """A text of 60,000 lines, negative and huge ids, a cluster whose first candidates fail, and columns of the operator's own names."""
    rng = np.random.default_rng(4)
    many = "\n".join(f"{a} {b} common" for a, b in rng.integers(0, 900, (60000, 2)))
    stem = prose(71, 20).split()
    chain = []
    for k in range(40):  # each shares most words with its neighbours only
        chain.append(" ".join(stem[k % 5 :] + [f"c{k // 3}", f"c{k // 4}", f"d{k}"]))
    rows = [(2**62, many), (-(2**62), "\n".join(chain[::-1])), (7, "\n".join(chain)), (None, chain[3] + "\n" + "alone here now"), (8, "x" * 300000 + "\n" + "x" * 300000)]
    docs = spark.createDataFrame([(a, b, 1, 2, 3, 4, 5) for a, b in rows], "doc_id long, text string, _lines int, _removed int, look int, stays int, lines int")
    got = {r.doc_id: r for r in linedup.dedup_lines(docs).collect()}
    seen, want = {}, {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out = []
        for x in text.split("\n"):
            s = frozenset(WORD.findall(x))
            near = s in seen.setdefault(len(s), {}) or any(len(s & q) >= 0.8 * len(s | q) for n, sets in seen.items() if n > 3 and 0.8 * n <= len(s) <= n / 0.8 for q in sets)
            seen[len(s)][s] = 1
            if not near:
                out.append(x)
        want[d] = "\n".join(out)
    assert {d: r.text for d, r in got.items()} == want
    assert got[7].look == 3 and got[7].stays == 4 and got[7]._lines == 40 and got[2**62]._lines == 60000


def test_leaks(spark, monkeypatch):
    item, other = prose(1, 40), prose(2, 30)
    edited = item.split()
    edited[7:9], edited[20] = ["new"], "other"
    rows = [(1, prose(11, 200) + " " + item.upper() + " " + prose(12, 50)), (2, prose(13, 90) + " " + " ".join(edited)), (3, prose(14, 300)), (4, None), (5, ""), (6, " ".join(item.split()[:8]) + " " + prose(15, 90)), (None, other)]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(10, item), (11, other), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 11)}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)  # several blocks
    again = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert again == got
    clash = docs.withColumn("look", F.lit(1)).withColumn("doc", F.lit(2))
    left = decontaminate.remove_leaks(clash, bench)
    assert left.columns == clash.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "6"]
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.remove_leaks(docs, bench.limit(0)).count() == len(rows)
    assert got[1, 10].score == 1 and (got[1, 10].begin_word, got[1, 10].end_word) == (200, 240) and got[1, 10].passage == item
    assert 0.8 < got[2, 10].score < 1
    assert sorted(str(r.doc_id) for r in decontaminate.remove_leaks(docs, bench).collect()) == ["3", "4", "5", "6"]
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_alignment_against_the_plain_recurrence(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, 9), rng.integers(0, 5, 14)
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    assert decontaminate.align(a, b)[0] == h.max()


def test_language_id(spark):
    say = {"en": "the cat and the dog went with that man", "de": "der hund und die katze gingen mit dem mann", "fr": "le chat et le chien sont avec cette homme"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(say[k].split())), k) for i in range(90) for k in say]
    model = langid.fit(spark.createDataFrame(rows, "key long, text string, tag string"))
    texts = spark.createDataFrame([(1, "the dog with the man", 1), (2, "und der mann", 1), (3, None, 1), (4, " 12 ?", 1), (None, "le chien et le chat", 1)], "doc_id long, text string, score_ int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(texts, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", None: "fr"}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.keep_recognised(texts, model, 0.5).count() == 3
    clash = texts.withColumnsRenamed({"score_": "score"}).withColumn("lang_pred", F.lit("x")).withColumn("c0", F.lit(5))
    assert langid.predict(clash, model).columns == ["doc_id", "c0", "lang_pred", "score"] and langid.keep_recognised(clash, model, 0.5).columns == clash.columns
    empty = langid.fit(spark.createDataFrame([], "key long, text string, tag string"))
    assert {r.lang_pred for r in langid.predict(texts, empty).collect()} == {"und"}


def test_languages_beyond_one_matrix_and_a_language_of_few_rows(spark, monkeypatch):
    say = {f"l{k:02d}": " ".join("".join(chr(97 + (k * 7 + i * j) % 26) for i in range(2, 6)) for j in range(1, 12)) for k in range(9)}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(say[k].split())), k) for k in say for i in range(100 if k == "l08" else 400)]
    labelled = spark.createDataFrame(rows, "key long, text string, tag string")
    texts = spark.createDataFrame([(i, v) for i, v in enumerate(say.values())] + [(50, "")], "doc_id long, text string")
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(texts, langid.fit(labelled, 900)).collect()}
    monkeypatch.setattr(langid, "LANGS", 2)
    models = langid.fit(labelled, 900)
    assert len(models) == 5
    many = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(texts, models).collect()}
    assert one == many and [many[i][0] for i in range(9)] == list(say) and many[50] == ("und", 0)


def test_warc_round_trip(spark):
    long = "é" * 600
    rows = [(1, "http://a", long), (2, None, long), (3, "http://c\nx", "<p>WARC/1.1\r\n\r\n"), (4, "u", None), (5, "u", "same"), (6, "u", "same"), (None, "u", long)]
    path = Scratch(spark, "t").path("w")
    for compression in ("none", "gzip"):
        warc.write_warc(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), path, compression=compression)
        got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
        assert len(got) == 7
        for i, _, html in rows:
            r = got[f"<urn:x-page:{'null' if i is None else i}>"]
            assert r.payload_digest == "sha1:" + hashlib.sha1((html or "").encode()).hexdigest()
            assert r.http_length == len((html or "").encode())
            revisit = html == long and i != 2
            assert (r.record_type, r.refers_to) == (("revisit", "<urn:x-page:2>") if revisit else ("response", None))
            assert bytes(r.payload) == (b"" if revisit else (html or "").encode())
        some = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
        assert [r.payload for r in some.collect()] == [None, None]
    empty = Scratch(spark, "t").path("none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_targets_and_flow():
    t = mixing.targets({"a": 10, "b": 1, None: 100}, 111)
    assert t["b"] == 3 and sum(t.values()) == pytest.approx(111) and t[None] == pytest.approx(3 * (t["a"]))or t["a"] == 30
    flow = mixing.min_cost_flow([(10, [0]), (10, [0, 1])], [15, 20])
    assert sum(f.get(0, 0) for f in flow) == 15 and sum(f.get(1, 0) for f in flow) == 20
    assert all(sum(f.values()) <= 30 for f in flow)


def costs_of(flow, sizes, most=3):
    """(words, cost) of a flow: the r-th copy of a word costs r - 1."""
    words = [sum(f.values()) for f in flow]
    return sum(words), sum(sum(max(0, min(w - r * n, n)) * r for r in range(most)) for w, n in zip(words, sizes))


@pytest.mark.parametrize("seed", range(25))
def test_flow_with_overlapping_sources_against_all_flows(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 3, 3).tolist()
    members = [sorted(rng.choice(2, rng.integers(0, 3), replace=False).tolist()) for _ in sizes]
    quotas = rng.integers(0, 8, 2).tolist()
    options = [[f for f in itertools.product(*(range(3 * n + 1) if j in m else (0,) for j in range(2))) if sum(f) <= 3 * n] for n, m in zip(sizes, members)]
    best = max(((w, -c) for fs in itertools.product(*options) if all(sum(f[j] for f in fs) <= quotas[j] for j in range(2)) for w, c in [costs_of([dict(enumerate(f)) for f in fs], sizes)]))
    for solve in (mixing.min_cost_flow, mixing.route):
        flow = solve([*zip(sizes, members)], quotas)
        w, c = costs_of(flow, sizes)
        assert (w, -c) == best
        assert all(set(f) <= set(m) and sum(f.values()) <= 3 * n for f, m, n in zip(flow, members, sizes))
        assert all(sum(f.get(j, 0) for f in flow) <= quotas[j] for j in range(2))


def test_flow_of_many_patterns():
    rng = np.random.default_rng(1)
    patterns = [(int(n), sorted(rng.choice(60, int(k), replace=False).tolist())) for n, k in zip(rng.integers(1, 500, 3000), rng.integers(1, 4, 3000))]
    quotas = [int(x) for x in rng.integers(5000, 60000, 60)]
    flow = mixing.route(patterns, quotas)
    got = np.array([sum(f.get(j, 0) for f in flow) for j in range(60)])
    assert (got <= quotas).all() and all(sum(f.values()) <= 3 * n for f, (n, _) in zip(flow, patterns))
    free = [all(sum(flow[i].values()) == 3 * patterns[i][0] for i in range(3000) if j in patterns[i][1]) for j in range(60) if got[j] < quotas[j]]
    assert all(free)
    singles = mixing.route([(5, [j]) for j in range(60_000)], [7] * 60_000)
    assert all(f == {j: 7} for j, f in enumerate(singles))


def test_mix_of_overlapping_sources(spark):
    rows = [(i, prose(i, 5 + i % 20), [f"s{j}" for j in range(3) if (i >> j) & 1 or i % 5 == j] or None) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got, flows, sources = mixing.mix(docs, sources=F.col("sources"))
    per = {(r.pattern, r.source): r.words for r in flows.collect()}
    told = got.collect()
    for name, size, target, words in sources:
        assert words <= target + 0.5 and words == sum(w for (_, s), w in per.items() if s == name)
    taken = {}
    for r in told:
        assert r.taken <= 3 * r.size
        taken[r.pattern] = taken.get(r.pattern, 0) + r.taken
    assert {p: t for p, t in taken.items() if t} == {p: t for p in {p for p, _ in per} if (t := sum(w for (q, _), w in per.items() if q == p))}
    assert all(r.taken == 0 for r in told if r.pattern == "[]")


def test_mix(spark):
    rows = [(i, prose(i, 1 + i % 40), f"s{i % 3}" if i % 7 else None) for i in range(200)] + [(500, None, "s0"), (3, prose(3, 4), "s0"), (None, "a b", "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got, _, sources = mixing.mix(docs)
    first, again = ([tuple(r) for r in mixing.mix(docs)[0].orderBy("doc_id", "size", "taken").collect()] for _ in range(2))
    assert first == again and len(first) == len(rows)
    per = {r["pattern"]: r["t"] for r in got.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    for name, _, target, words in sources:
        assert abs(words - target) <= 0.5 and per["[null]" if name is None else f'["{name}"]'] == words
    assert got.where("taken > 3 * size").count() == 0
    assert mixing.mix(docs.limit(0))[0].collect() == []


def encoder():
    return tokencount.Encoder(tokencount.load_ranks(tokencount.VOCABULARY))


def brute_sections(text, begins, rule, lengths):
    """(tokens, crossing) of each section, byte by byte."""
    section = np.searchsorted(begins, np.arange(len(text.encode())), "right") - 1
    n, cross, at = [0] * len(begins), [0] * len(begins), 0
    for k in lengths:
        mine = section[at : at + k].tolist()
        where = {"first": mine[0], "last": mine[-1], "majority": max(sorted(set(mine)), key=mine.count)}[rule]
        n[where] += 1
        cross[where] += len(set(mine)) > 1
        at += k
    return n, cross


SECTION_TEXTS = ["Hello world\n\n\nfoo  \n bar", None, "", "日本\n語" * 9, "x", "again", "\n", " \n \t\n\n\n\n  a\n\nb", "-----\n-----\n" * 5]


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_tokens_against_brute_force(spark, rule):
    rows = [*enumerate(SECTION_TEXTS), (None, "x"), (1, "again")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, tokens int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.section, r.n_bytes, r.n_chars, r.tokens, r.crossing) for r in tokencount.section_tokens(docs, rule=rule).collect())
    e, want = encoder(), []
    for d, text in rows:
        if text:
            lines = text.splitlines(keepends=True) if text.count("\n") == len(text.splitlines()) - (not text.endswith("\n")) else None
            begins = np.cumsum([0, *(len(x.encode()) for x in lines)])[:-1]
            n, cross = brute_sections(text, begins, rule, e.lengths(text).tolist())
            want += [(d is None, d or 0, i, len(x.encode()), len(x), a, b) for i, (x, a, b) in enumerate(zip(lines, n, cross))]
    assert got == sorted(want)
    assert tokencount.section_tokens(docs.limit(0), rule=rule).collect() == []


def test_pieces_of_a_text_have_the_tokens_of_the_whole(monkeypatch):
    e = encoder()
    texts = ["a  b\n" * 50, "x" + " " * 40 + "y", " " * 30, "\t\n " * 30 + "z's  it's", "é\u2003\u2003" * 20 + "w", prose(3, 400), "one\x1c\x1ctwo " * 9]
    whole = [[len(e.plain.decode_single_token_bytes(t)) for t in e.plain.encode_ordinary(x)] for x in texts]
    monkeypatch.setattr(tokencount, "LONG_RUN", 7)
    monkeypatch.setattr(tokencount, "PIECE", 20)
    cut = encoder()
    assert [cut.lengths(x).tolist() for x in texts] == whole


def test_section_tokens_of_very_long_texts(spark):
    rows = [(1, "a" + " " * 3_000_000 + "b"), (2, "lorem ipsum dolor " * 1_200_000), (3, "x" * 1_000_000)]
    got = {r.doc_id: r for r in tokencount.section_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.n_bytes for d, r in got.items()} == {d: len(t) for d, t in rows}
    assert all(r.tokens > 0 for r in got.values())


def test_tokens_of_given_spans(spark):
    text = "Title: é one two\nBody of the text, and more."
    spans = [("title", 7, 16), ("body", 17, 25), ("late", 20, 30), ("none", 3, 3), ("end", 40, 999)]
    docs = spark.createDataFrame([(1, text, spans), (2, text, None), (3, None, spans)], "doc_id long, text string, fields array<struct<name:string,begin:int,end:int>>")
    got = tokencount.section_tokens(docs, spans="fields").orderBy("doc_id", "section").collect()
    assert [(r.name, r.begin_char, r.n_chars) for r in got if r.doc_id == 1] == [(None, 0, 7), ("title", 7, 9), (None, 16, 1), ("body", 17, 8), ("late", 25, 5), (None, 30, 10), ("end", 40, len(text) - 40)]
    assert [(r.name, r.n_chars) for r in got if r.doc_id == 2] == [(None, len(text))]
    total = len(encoder().lengths(text))
    assert sum(r.tokens for r in got if r.doc_id == 1) == sum(r.tokens for r in got if r.doc_id == 2) == total


def test_allocation_rules():
    ends, begins = np.array([3, 8, 9]), np.array([0, 4])  # the second token has one byte before the boundary
    assert [tokencount.allocate(ends, begins, 9, r)[0].tolist() for r in ("first", "last", "majority")] == [[2, 1], [1, 2], [1, 2]]


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    syl = ["ta", "ri", "mo", "ne", "ku", "sel", "vor"]
    docs, labels = [], []
    for i in range(1200):
        w = ["".join(rng.choice(syl, 3)) for _ in range(int(rng.integers(5, 60)))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.integers(len(w))] = "zxidiot"
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(9000, None), (9001, ""), (9002, "ab")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab.where("doc_id % 3 <> 1"), Scratch(spark, "t"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in range(1200) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 1203 and max(got[9000], got[9001], got[9002]) < 0.7
    none = toxicity.fit(d.limit(0), lab.limit(0), Scratch(spark, "t"))
    assert toxicity.score(d.limit(0), none).collect() == []


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 4]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 8), (350, [float("inf")] * 8), (400, [1.0] * 3), (None, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, vector array<float>, rank int")
    good = [(i, np.floor(256 * np.pad(np.array(v), (0, 8 - len(v))))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_top_k_of_wide_vectors_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** (20 * (i % 7 == 3) + 290 * (i == 44))]) for i in range(60)] + [(100, [1e18, 1.0]), (150, [-1e18, 2.0, 0.0, 0.0]), (161, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    exact = {i: [int((x * 256).__floor__()) if abs(x) < 1e300 else int(x) * 256 for x in v] + [0] * (4 - len(v)) for i, v in rows if all(np.isfinite(v))}
    want, low, high = [], -(1 << 63), (1 << 63) - 1
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:5]
        want += [(q, k + 1, i, min(high, max(low, -s))) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    keys = sorted([0, 1, -1, 255, 256, -256, -255, 10**40, -(10**40), 65535, -65536])
    assert sorted(keys, key=topk._key) == keys


def test_the_cutoff_leaves_most_entries_out(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(2000)], "vec_id long, vector array<float>")
    m = np.floor(256 * np.array([r.vector for r in df.where("vec_id % 100 = 0").orderBy("vec_id").collect()]))
    block = topk.Block(np.arange(0, 2000, 100), m, 5, 4, 256.0)
    share = type("B", (), {"value": block})
    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(2000), pa.int64()), "vector": pa.array([r.vector for r in df.orderBy("vec_id").collect()], pa.list_(pa.float32()))})
    out = next(topk._gather(share)(iter([batch]))).to_pydict()
    low = np.array([min(t for q, t in zip(out["q"], out["total"]) if q == k) for k in range(20)], float)
    kept = sum(b.num_rows for b in topk._collect(share, type("B", (), {"value": low}))(iter([batch])))
    assert 100 <= kept < 400


def test_crc_of_decimal_text(spark):
    assert spark.range(50).select(F.crc32(F.col("id").cast("string"))).collect() == [(zlib.crc32(str(i).encode()),) for i in range(50)]
