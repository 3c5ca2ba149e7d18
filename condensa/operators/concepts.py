"""Concept incidence, weights and features.

responses(lecture, prompt, student, text) are grouped by (lecture, prompt);
that pair is the distribution key throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions.stem import counted_stems
from condensa.functions.vectors import bin_index
from condensa.sources.place import kept

GROUP = ["lecture", "prompt"]


def responses(documents: DataFrame) -> DataFrame:
    """The documents table as responses: lecture = source, prompt = lang, student = doc_id."""
    return documents.select(F.col("source").alias("lecture"), F.col("lang").alias("prompt"), F.col("doc_id").alias("student"), "text")


def phrases(resp: DataFrame, unit: str = "text") -> DataFrame:
    """Distinct phrases of a group with how often they come: (lecture, prompt, phrase, freq)."""
    source = resp.select(*GROUP, F.col("text").alias("phrase")) if unit == "text" else resp.select(*GROUP, F.explode(T.sentences(F.col("text"))).alias("phrase"))
    return source.where("phrase IS NOT NULL").groupBy(*GROUP, "phrase").agg(F.count("*").alias("freq"))


def incidence(units: DataFrame, text: str = "phrase", n: int = 2, stop: list[str] | None = T.STOP_WORDS, malformed: bool = True, whitelist: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """units' other columns, concept, occ: how often each unit holds each concept.

    whitelist(concept): other concepts are left out.  stemmed: concepts of the
    words' stems, stop words go by their form.
    """
    kept = units if malformed else units.where(~T.is_malformed(F.col(text)))
    if stemmed:
        # units that are alike meet first, which distinct ones of a group do already, so their concepts need no shuffle
        once = kept.groupBy(*units.columns).agg(F.count("*").alias("times__"))
        rows = stemmed_grams(once, [*units.columns, "times__"], text, n, stop).withColumn("occ", F.col("occ") * F.col("times__")).drop("times__")
    else:
        rows = T.gram_rows(kept, units.columns, text, n, stop=stop)
    rows = rows if whitelist is None else rows.join(whitelist.select("concept").distinct(), "concept", "left_semi")
    return rows if stemmed else rows.groupBy(*units.columns, "concept").agg(F.count("*").alias("occ"))


def stemmed_grams(rows: DataFrame, keep: list[str], text: str = "text", n: int = 2, stop: list[str] | None = T.STOP_WORDS) -> DataFrame:
    """keep, concept, occ: each row's n-grams of stems and how often it has them; one of stop words only, by the words as written, is left out."""
    return rows.select(*keep, F.inline(counted_stems(n, stop)(T.tokens(F.col(text)))))


def counted_phrases(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases(by, phrase, ...) with `freq` of counts(by, phrase, freq); a phrase that has none fails the query."""
    by = [c for c in counts.columns if c != "freq"]
    told = phrases.join(counts, by, "left")
    return told.withColumn("freq", F.coalesce("freq", F.raise_error(F.concat(F.lit("no count of "), F.col("phrase"))).cast("bigint")))


def concept_mass(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, phrase, length): half the sum of a phrase's cells."""
    return cells.groupBy(*by, "phrase").agg((F.sum(value) / 2).alias("length"))


def theta_tf(resp: DataFrame, n: int = 2) -> DataFrame:
    """Occurrences times phrase frequency: each response counts its concepts with repeats."""
    return T.gram_rows(resp, GROUP, n=n).groupBy(*GROUP, "concept").agg(F.count("*").cast("double").alias("theta"))


def theta_distinct(resp: DataFrame, n: int = 2) -> DataFrame:
    """Phrase frequency summed over the distinct concepts of a phrase; no shuffle but the sum's."""
    return T.gram_rows(resp, GROUP, n=n, distinct=True).groupBy(*GROUP, "concept").agg(F.count("*").cast("double").alias("theta"))


def tfidf(resp: DataFrame, n: int = 2, default_idf: float = 1.5, by_prompt: bool = False) -> DataFrame:
    """Each group is a document: tf = share of its concepts, idf = ln((1 + N) / (1 + df)), over all groups or those of the prompt."""
    counts = kept(theta_tf(resp, n), "counts")  # read three times
    corpus = ["prompt"] if by_prompt else []
    per_group = counts.groupBy(*GROUP).agg(F.sum("theta").alias("all"))
    df = counts.groupBy(*corpus, "concept").agg(F.count("*").alias("df"))
    groups = per_group.groupBy(*corpus).agg(F.count("*").alias("n_groups"))
    joined = counts.join(per_group, GROUP).join(df, [*corpus, "concept"])
    joined = joined.join(groups, corpus) if corpus else joined.crossJoin(F.broadcast(groups))  # one row
    tf = F.col("theta") / F.col("all")
    idf = F.coalesce(F.ln((1.0 + F.col("n_groups")) / (1.0 + F.col("df"))), F.lit(default_idf))
    return joined.select(*GROUP, "concept", tf.alias("tf"), F.col("df").cast("long").alias("df"), (tf * idf).alias("tfidf"))


def ranked(weights: DataFrame, value: str = "theta", key: str = "concept", by: list[str] = GROUP) -> DataFrame:
    """Rank 1, 2, ... by value, largest first, ties by key."""
    return weights.withColumn("rnk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.col(key))))


def top(weights: DataFrame, k: int, value: str = "theta", key: str = "concept", by: list[str] = GROUP) -> DataFrame:
    return ranked(weights, value, key, by).where(F.col("rnk") <= k)


def rows_of_features(rows: DataFrame, features: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """A row for each feature whose predicate holds: keep, feature, value 1.0."""
    held = F.array(*(F.when(p, F.lit(name)) for name, p in features))  # nulls go on the rows, in generated code
    return rows.select(*keep, F.explode(held).alias("feature")).where("feature IS NOT NULL").withColumn("value", F.lit(1.0))


KEEP = [*GROUP, "concept"]


def tf_features(theta: DataFrame) -> DataFrame:
    """The names are opaque keys; the predicates count."""
    t = F.col("theta")
    return rows_of_features(theta, [("term_freq>=1", t > 1), ("term_freq>=2", t > 2), ("term_freq>=5", t > 5), ("term_freq<=2", t <= 2), ("term_freq<=5", t <= 5)], KEEP)


def rank_features(theta: DataFrame, name: str = "tf_rank", value: str = "theta") -> DataFrame:
    """Only the first ten of a group have a feature, so the ranking stops there."""
    rnk = F.col("rnk")
    return rows_of_features(top(theta, 10, value), [(f"{name}<5", rnk <= 5), (f"{name}<10", rnk <= 10)], KEEP)


def tfidf_features(weights: DataFrame) -> DataFrame:
    v = F.col("tfidf")
    limits = ("0.05", "0.02", "0.01")
    return rows_of_features(weights, [(f"tfidf>{x}", v > float(x)) for x in limits] + [(f"tfidf<={x}", v <= float(x)) for x in limits], KEEP)


def average_length(resp: DataFrame, n: int = 2) -> DataFrame:
    """(lecture, prompt, concept, ave): floor of the mean word count of the responses that hold the concept."""
    rows = T.gram_rows(resp, [*GROUP, F.size(T.tokens(F.col("text"))).alias("words")], n=n, distinct=True)
    return rows.groupBy(*KEEP).agg(F.floor(F.sum("words") / F.count("*")).alias("ave"))


def length_features(lengths: DataFrame) -> DataFrame:
    v, steps = F.col("ave"), (5, 10, 15, 20, 25, 30)
    return rows_of_features(lengths, [(f"ave_sen_length>{x}", v > x) for x in steps] + [(f"ave_sen_length<={x}", v <= x) for x in steps], KEEP)


def length_rank_features(lengths: DataFrame, k: int = 10) -> DataFrame:
    """rank<=j for j from the rank to k-1, and rank>j for j under the rank and k; ranks from 0."""
    i = F.col("rnk") - 1
    preds = [(f"ave_sen_length_rank<={j}", i <= j) for j in range(k)] + [(f"ave_sen_length_rank>{j}", i > j) for j in range(k)]
    return rows_of_features(ranked(lengths, "ave"), preds, KEEP)


def position_features(resp: DataFrame, n: int = 2, bins: int = 5) -> DataFrame:
    """Every bin in which a response's first occurrence of the concept falls, among all its n-grams."""
    toks = T.tokens(F.col("text"))
    once = resp.select(*GROUP, "student", (F.size(toks) - (n - 1)).alias("n"), (T.bigram_pieces(F.col("text")) if n == 2 else T.gram_array(toks, n)).alias("grams"))
    rows = once.select(*GROUP, "student", "n", F.posexplode("grams").alias("pos", "concept")).where("concept IS NOT NULL AND pos < n")
    rows = rows.groupBy(*GROUP, "student", "concept").agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
    rows = rows.where(~T.stop_only(F.col("concept"), n))
    at = bin_index(F.col("pos"), 0.0, F.col("n"), bins)
    return rows.select(*KEEP, F.concat(F.lit("position_"), at.cast("string")).alias("feature")).distinct().withColumn("value", F.lit(1.0))


def prompt_similarity_features(resp: DataFrame, prompts: DataFrame, n: int = 2) -> DataFrame:
    """Floor of the mean number of words that the responses with a concept share with their own prompt's text; prompts(prompt, words array)."""
    # texts are told by their keys and hash; those that are alike in all of it share as many words
    key = [*GROUP, "student", "hash__"]
    texts = resp.withColumn("hash__", F.xxhash64("text"))
    asked = prompts.select(F.col("prompt").alias("prompt__"), F.explode("words").alias("word__")).distinct().withColumn("hit__", F.lit(1))
    at = texts.select(*key, F.posexplode(T.tokens(F.col("text"))).alias("pos__", "w__"))
    counts = at.join(asked, (F.col("prompt") == F.col("prompt__")) & (F.col("w__") == F.col("word__")), "left").groupBy(*key).agg((F.count("hit__") / F.count_if(F.col("pos__") == 0)).cast("long").alias("shared"))
    counts = counts.select(*(F.col(c).alias(f"{c}_") for c in key), "shared")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    told = texts.join(prompts.select("prompt"), "prompt", "left_semi").join(counts, same)
    rows = T.gram_rows(told, [*GROUP, "shared"], n=n, distinct=True)
    v = F.col("ave")
    preds = [("prompt_sim=0", v == 0), *((f"prompt_sim<={x}", v <= x) for x in (1, 2, 3, 4, 10)), ("prompt_sim>10", v > 10), ("prompt_sim!=0", v != 0), *((f"prompt_sim>{x}", v > x) for x in (1, 2, 3, 4))]
    return rows_of_features(rows.groupBy(*KEEP).agg(F.floor(F.sum("shared") / F.count("*")).alias("ave")), preds, KEEP)


def tag_features(tags: DataFrame) -> DataFrame:
    """pos=, and for concepts of two words pos_first= and pos_second=, of tags(lecture, prompt, concept, tags)."""
    w = F.split("tags", " ")
    held = F.array_compact(F.array(F.concat(F.lit("pos="), "tags"), F.when(F.size(w) == 2, F.concat(F.lit("pos_first="), w[0])), F.when(F.size(w) == 2, F.concat(F.lit("pos_second="), F.get(w, F.lit(1))))))
    return tags.select(*KEEP, F.explode(held).alias("feature")).withColumn("value", F.lit(1.0))


def membership_features(concepts: DataFrame, listed: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """{name}_Yes for concepts that are listed(by, concept), {name}_No for others."""
    told = concepts.select(*KEEP).distinct().join(listed.select(*by, "concept").distinct().withColumn("hit", F.lit(True)), [*by, "concept"], "left")
    return told.select(*KEEP, F.when(F.col("hit"), f"{name}_Yes").otherwise(f"{name}_No").alias("feature"), F.lit(1.0).alias("value"))


def title_concepts(titles: DataFrame, keep: list[str], n: int = 2, stemmed: bool = False) -> DataFrame:
    """keep, concept: distinct n-grams of titles(keep, text)."""
    rows = stemmed_grams(titles, keep, n=n).drop("occ") if stemmed else T.gram_rows(titles, keep, n=n, distinct=True)
    return rows.distinct()


def constant_features(theta: DataFrame, raw: bool = False) -> DataFrame:
    """One feature a concept: 1, or its raw weight."""
    return theta.select(*KEEP, F.lit("tf" if raw else "one").alias("feature"), (F.col("theta") if raw else F.lit(1.0)).alias("value"))


def select_features(features: DataFrame, names: list[str]) -> DataFrame:
    """Features whose name, up to its first of = < > ! or _ and digits, is listed."""
    return features.where(F.regexp_extract("feature", "^(.*?)(?:[=<>!].*|_[0-9]+)?$", 1).isin(*names))


def word_features(theta: DataFrame, resp: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per concept: which of its two words are stop words, its length, and whether most of its words are unknown."""
    w = F.split("concept", " ")
    listed = theta.select(*KEEP, F.explode(w).alias("word")).join(vocabulary.select("word").distinct().withColumn("known", F.lit(1)), "word", "left")
    share = listed.groupBy(*KEEP).agg((1 - F.count("known") / F.count("*")).alias("unknown"))
    stop = [*T.STOP_WORDS, *T.PUNCTUATION]
    preds = [("stop_first=True", (F.size(w) == 2) & w[0].isin(*stop)), ("stop_second=True", (F.size(w) == 2) & F.get(w, F.lit(1)).isin(*stop)), ("ngram=1", F.size(w) == 1), ("ngram=2", F.size(w) == 2), ("word_ratio<=0.5", F.col("unknown") <= 0.5), ("word_ratio>0.5", F.col("unknown") > 0.5)]
    return rows_of_features(share, preds, KEEP)


def word_frequency_features(theta: DataFrame, resp: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Frequency of a concept's first and second word among the group's words; stems(word, stem): by their stems."""
    freq = theta_tf(resp, 1).withColumnsRenamed({"concept": "word", "theta": "freq"})
    w = F.split("concept", " ")
    rows = theta.select(*KEEP, w[0].alias("w1"), F.get(w, F.lit(1)).alias("w2"))
    if stems is not None:
        freq = freq.join(stems.select("word", "stem"), "word").groupBy(*GROUP, F.col("stem").alias("word")).agg(F.sum("freq").alias("freq"))
        for c in ("w1", "w2"):
            rows = rows.join(stems.select(F.col("word").alias(c), F.col("stem").alias(f"{c}s")), c, "left").drop(c).withColumnRenamed(f"{c}s", c)
    rows = rows.join(freq.withColumnsRenamed({"word": "w1", "freq": "f1"}), [*GROUP, "w1"], "left").join(freq.withColumnsRenamed({"word": "w2", "freq": "f2"}), [*GROUP, "w2"], "left")
    preds = []
    for name, c, ok in (("firstw", "f1", F.lit(True)), ("secondw", "f2", F.col("w2").isNotNull())):
        v = F.coalesce(c, F.lit(0.0))
        preds += [(f"freq_{name}>{x}", ok & (v > x)) for x in (1, 2, 5)] + [(f"freq_{name}<={x}", ok & (v <= x)) for x in (2, 5)]
    return rows_of_features(rows, preds, KEEP)


def merged_features(*sets: DataFrame) -> DataFrame:
    """One set of features; of equal keys the later set's value stays."""
    tagged = [s.select(*KEEP, "feature", "value", F.lit(i).alias("turn")) for i, s in enumerate(sets)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out.groupBy(*KEEP, "feature").agg(F.max_by("value", "turn").alias("value"))


def invert(inc: DataFrame, unit: str) -> DataFrame:
    """concept to the sorted units that hold it."""
    return inc.groupBy("concept").agg(F.array_sort(F.collect_set(unit)).alias("units"))


def key_ngrams(resp: DataFrame, low: int = 1, high: int = 3, by: str = "lecture") -> DataFrame:
    """n-grams that don't begin with a stop word, scored by n times their count."""
    toks = T.tokens(F.col("text"))
    grams = F.flatten(F.array(*(T.gram_array(toks, n) for n in range(low, high + 1))))
    rows = resp.select(by, F.explode(grams).alias("ngram")).where(F.col("ngram").isNotNull() & ~F.substring_index("ngram", " ", 1).isin(*T.STOP_WORDS))
    counts = rows.groupBy(by, "ngram").agg(F.count("*").alias("n"))
    return counts.select(by, "ngram", (F.col("n") * F.size(F.split("ngram", " "))).cast("long").alias("score"))


def unigram_summary(chosen: DataFrame, budget: int = 30, stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """The words of chosen(lecture, prompt, phrase, concept, value): each concept's value goes to all its words, and the heaviest
    words up to the budget stay; stop words neither stay nor count."""
    words = chosen.select(*GROUP, F.explode(F.split("concept", " ")).alias("word"), "value").where(~F.col("word").isin(*stop))
    mass = words.groupBy(*GROUP, "word").agg(F.sum("value").alias("mass"))
    return top(mass, budget, "mass", "word").select(*GROUP, "rnk", "word", "mass")


def phrase_students(resp: DataFrame, by: str = "lecture") -> DataFrame:
    """(lecture, phrase, n_students): sentences and how many students wrote them."""
    rows = resp.select(by, "student", F.explode(F.array_distinct(T.sentences(F.col("text")))).alias("phrase"))
    return rows.groupBy(by, "phrase").agg(F.count_distinct("student").alias("n_students"))


def well_formed_phrases(resp: DataFrame, by: str = "lecture") -> DataFrame:
    """(lecture, phrase, freq, n_words) without malformed sentences."""
    rows = resp.select(by, F.explode(T.sentences(F.col("text"))).alias("phrase")).where(~T.is_malformed(F.col("phrase")))
    return rows.groupBy(by, "phrase").agg(F.count("*").alias("freq")).withColumn("n_words", T.word_count(F.col("phrase")).cast("long"))


def reference_weights(references: DataFrame, by: list[str], phrase: str = "phrase", n: int = 2) -> DataFrame:
    """(by, concept, theta): in how many reference phrases a concept comes, each counted once a phrase."""
    held = T.gram_rows(references.select(*by, F.col(phrase).alias("text")), by, n=n, distinct=True)
    return held.groupBy(*by, "concept").agg(F.count("*").cast("double").alias("theta"))
