import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from condensa.operators import punkt

NAMES = ["Smith", "Jones", "Brown", "Miller", "Clark", "Lopez"]
VERBS = ["went home", "saw the doctor", "met the mayor", "bought bread", "sold his car", "read the paper"]


def corpus():
    """Invented reports with an abbreviation, dotted ones, initials and ordinals; words after true ends also occur in lower case."""
    out = []
    for i in range(240):
        a, b, v, w = NAMES[i % 6], NAMES[i * 5 % 6], VERBS[i % 6], VERBS[i * 7 % 6]
        out.append(f"Yesterday dr. {a} {v}. Then he {w} at 5 p.m. on the {1 + i % 28}. May. It was about {i % 9}.5 km away, the long way in May, and the road was long.")
        out.append(f"The company of prof. {b} and J. {a} {w}. They {v} again, etc., and then the dr. {b} {w}! Was it good? It was the best, then as yesterday.")
    return out


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    held, toks = punkt.tokens(df)
    return df, toks, punkt.train(toks)


def test_counts_are_those_of_plain_python(trained):
    _, toks, _ = trained
    want = Counter()
    for text in corpus():
        for w in text.split():
            body = re.sub("[,;:]+$", "", w)
            dotted = bool(re.search("[^.]\\.$", body))
            kind = (body[:-1] if dotted else body).lower()
            want[punkt.NUMBER if re.match(punkt.IS_NUMBER, kind) else kind, dotted] += 1
    got = {(r.type, r.dotted, r.plain) for r in punkt.type_counts(toks).collect()}
    assert got == {(t, want[t, True], want[t, False]) for t, _ in want}


def test_abbreviations_are_found_by_the_published_score(trained):
    _, toks, model = trained
    counts = {r.type: (r.dotted, r.plain) for r in punkt.type_counts(toks).collect()}
    dots, n = sum(d for d, _ in counts.values()), sum(d + p for d, p in counts.values())
    want = {}
    for t, (d, p) in counts.items():
        if d and re.search("[a-z]", t) and t != punkt.NUMBER:
            size, inside = len(t) - t.count("."), t.count(".")
            ll = -2 * (d * math.log(dots / n) + p * math.log(1 - dots / n) - d * math.log(0.99) - p * math.log(0.01))
            score = ll * math.exp(-size) * (inside + 1) * size**-p
            if score >= 0.3:
                want[t] = score
    got = {r.type: r.score for r in punkt.abbreviations(punkt.type_counts(toks)).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    assert {"dr", "p.m", "prof"} <= got.keys() and not {"home", "bread", "car", "paper", "long"} & got.keys()
    assert {r.type for r in model.abbreviations.collect()} == got.keys()


def test_sentences_of_abbreviations_initials_and_ordinals(trained, spark):
    df, _, model = trained
    texts = [
        (1, "Yesterday dr. Smith went home. Then he saw dr. Jones! Was it good? It was."),
        (2, "He met J. Brown and prof. Clark at 5 p.m. on the 3. May. They went home."),
        (3, 'He said: "I went home." Then he read.\nA new line  without end\n\n and etc., and more.'),
        (4, None), (5, ""), (6, " \n\t"), (7, "..."), (8, "one"), (None, "It was. It was."), (1, "Yesterday dr. Smith went home. Then he saw dr. Jones! Was it good? It was."),
    ]
    rows = punkt.sentences(spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("row", "line", "words", "key")}), model=model).collect()
    of = lambda d: [r.sentence for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: (r.line, r.sent))]
    first = ["Yesterday dr. Smith went home.", "Then he saw dr. Jones!", "Was it good?", "It was."]
    assert of(1) == sorted(first * 2, key=first.index)
    assert of(2) == ["He met J. Brown and prof. Clark at 5 p.m. on the 3. May.", "They went home."]
    assert of(3) == ['He said: "I went home."', "Then he read.", "A new line without end", "and etc., and more."]
    assert of(4) == of(5) == of(6) == [] and of(7) == ["..."] and of(8) == ["one"] and of(None) == ["It was.", "It was."]
    every = punkt.sentences(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.n for r in every if r.doc_id % 2 == 0} == {3} and {r.n for r in every if r.doc_id % 2} == {4}


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert punkt.sentences(empty).count() == 0
    alone = spark.createDataFrame([(1, "a. b."), (2, "c.")], "doc_id long, text string")
    assert punkt.sentences(alone).count() >= 2
