"""Corpus statistics and relational idioms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions.vectors import distance_from_similarity
from condensa.sources.place import kept


def length_distribution(rows: DataFrame, by: str, length: Column) -> DataFrame:
    """n, max, min, mean, median and population deviation of a length."""
    return rows.select(by, length.alias("x")).groupBy(by).agg(
        F.count("*").alias("n"), F.max("x").cast("long").alias("longest"), F.min("x").cast("long").alias("shortest"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_pop("x").alias("std")
    )


def sentence_statistics(docs: DataFrame, by: str = "lang") -> DataFrame:
    """Words per sentence."""
    return length_distribution(docs.select(by, F.explode(T.sentences(F.col("text"))).alias("s")), by, T.word_count(F.col("s")))


def wordpunct_counts(docs: DataFrame, by: str = "lang") -> DataFrame:
    """Tokens per document, words and punctuation apart."""
    return length_distribution(docs, by, F.size(T.wordpunct(F.col("text"))))


def length_histogram(docs: DataFrame, by: str = "lang") -> DataFrame:
    words = docs.select(by, F.explode(T.sentences(F.col("text"))).alias("s")).select(by, T.word_count(F.col("s")).cast("long").alias("words"))
    return words.groupBy(by, "words").agg(F.count("*").alias("n"))


def dataset_statistics(docs: DataFrame, by: str = "source") -> DataFrame:
    """Responses, sentences, words and distinct bigrams of each group."""
    toks = T.tokens(F.col("text"))
    sizes = docs.groupBy(by).agg(F.count("*").alias("responses"), F.sum(F.size(T.sentences(F.col("text")))).cast("long").alias("sentences"), F.sum(F.size(toks)).cast("long").alias("words"))
    grams = T.gram_rows(docs, [by], distinct=True, stop=None, name="g").groupBy(by).agg(F.count_distinct("g").alias("bigrams"))
    return sizes.join(grams, by, "left").withColumn("words_per_sentence", F.col("words") / F.col("sentences")).select(by, "responses", "sentences", "words", F.coalesce("bigrams", F.lit(0)).alias("bigrams"), "words_per_sentence")


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): corpus frequencies."""
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unknown_words(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Corpus words that the dictionary(word) lacks, with counts; counted before the anti-join."""
    return corpus_words(docs).join(dictionary.select("word").distinct(), "word", "left_anti")


def union_counts(*counts: DataFrame) -> DataFrame:
    """Counts by word, added up over several tables (word, n)."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("word").agg(F.sum("n").alias("n"))


def bag_of_words(docs: DataFrame) -> DataFrame:
    """(term, doc, n), the long form of the term by document matrix."""
    return docs.select(F.col("doc_id").alias("doc"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("n"))


def lexicon_overlap(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """docs' columns but the text, then shared, outside, share: how many tokens, repeats counted, lexicon(word) has, the share that it lacks, and shared over the number of tokens and 0.00001.

    Tokens meet the lexicon in a join, so a text costs its tokens and not tokens times words; counts are shuffled, texts aren't.
    """
    keep = [c for c in docs.columns if c != "text"]
    words = lexicon.select(F.col("word").alias("word__")).distinct().withColumn("hit__", F.lit(1))
    told = docs.select(*keep, F.monotonically_increasing_id().alias("row__"), T.tokens(F.col("text")).alias("words__"))
    rows = told.select(*keep, "row__", F.size("words__").alias("size__"), F.explode_outer("words__").alias("word__")).join(words, "word__", "left")
    counts = rows.groupBy("row__", *keep, "size__").agg(F.count("hit__").cast("int").alias("hits__"))
    size, known = F.col("size__"), F.col("size__") >= 0
    shared = F.when(known, F.col("hits__"))
    return counts.select(*keep, shared.alias("shared"), F.when(size > 0, 1 - F.col("hits__") / size).alias("outside"), (shared / (size + 1e-5)).alias("share"))


def binary(bag: DataFrame) -> DataFrame:
    return bag.select("term", "doc", F.least("n", F.lit(1)).cast("long").alias("value"))


def is_binary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.bool_and(F.col("value").isin(0, 1)).alias("binary"))


def df_weighted(bag: DataFrame) -> DataFrame:
    """Counts divided by the term's document frequency; joined, as a common term's window would be one task."""
    df = bag.groupBy("term").agg(F.count("*").alias("df"))
    return bag.join(df, "term").select("term", "doc", (F.col("n") / F.col("df")).alias("value"))


def sparsity_ratio(bag: DataFrame, docs: DataFrame, by: str, eps: float = 1.0) -> DataFrame:
    """Share of a group's term by document cells whose value is at least eps."""
    tagged = bag.join(docs.select(F.col("doc_id").alias("doc"), by), "doc")
    sums = tagged.groupBy(by).agg(F.sum((F.col("n") >= eps).cast("long")).alias("filled"), F.count_distinct("term").alias("terms"))
    return sums.join(docs.groupBy(by).agg(F.count("*").alias("docs")), by).select(by, (F.col("filled") / (F.col("terms") * F.col("docs"))).alias("ratio"))


def rare_share(theta: DataFrame, by: list[str], most: float = 2.0) -> DataFrame:
    """Share of concepts with a weight of at most `most`."""
    return theta.groupBy(*by).agg(F.avg((F.col("theta") <= most).cast("double")).alias("rare"))


def folds(lectures: DataFrame) -> DataFrame:
    """(fold, lecture, split): leave one lecture out; lectures(lecture) is a list of groups, not of rows."""
    names = lectures.select("lecture").distinct()
    return names.crossJoin(names.withColumnRenamed("lecture", "fold")).select("fold", "lecture", F.when(F.col("fold") == F.col("lecture"), "test").otherwise("train").alias("split"))


def normalized_weights(weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, mode, concept, w): 0 shift to 0, 1 min-max, 2 from mean and deviation to the largest, 3 sigmoid, 4 softmax against -w.

    Modes 1 and 2 leave weights as they are where their denominator is 0.
    """
    s = weights.groupBy(*by).agg(F.min("theta").alias("lo"), F.max("theta").alias("hi"), F.avg("theta").alias("mu"), F.stddev_pop("theta").alias("sd"))
    w, lo, hi = F.col("theta"), F.col("lo"), F.col("hi")
    base = F.col("mu") + F.col("sd")
    modes = [w - lo, F.when(hi - lo == 0, w).otherwise((w - lo) / (hi - lo)), F.when(hi - base == 0, w).otherwise((w - base) / (hi - base)), 1 / (1 + F.exp(-w)), 1 / (1 + F.exp(-2 * w))]
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("mode"), m.alias("w")) for i, m in enumerate(modes)))
    return weights.join(s, by).select(*by, "concept", F.explode(rows).alias("m")).select(*by, "m.mode", "concept", "m.w")


def group_similarity(vectors: DataFrame) -> DataFrame:
    """(vec_id, theta): 1 + sum of cosines to the others of the vector's label.

    sum of cosines = the unit vector times the label's sum of unit vectors, so
    no pair is made.  Zero vectors have cosine 1 with all.
    """
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.withColumn("size", size).withColumn("u", F.when(F.col("size") > 0, F.transform("e", lambda x: x / F.col("size"))).otherwise(F.array().cast("array<double>")))
    sums = (
        unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("all"))
    )
    counts = unit.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("size") == 0).cast("long")).alias("zeros"))
    joined = unit.join(sums, "label").join(counts, "label")
    total = F.aggregate(F.zip_with("u", F.transform("all", lambda s: s["x"]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    others = F.when(F.col("size") == 0, F.col("n") - 1).otherwise(total - 1 + F.col("zeros"))
    return joined.select("vec_id", "label", (1 + others).alias("theta"))


#: Vectors of a list and probes of a block, at most and about.
LIST, PROBES = 1024, 256


def similarity_pairs(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """(i, j, dist) between given probes and all vectors of the probe's label.

    Vectors of a label are packed in lists, probes in blocks; a list meets each
    block of its label once, and their cosines are added up dimension by
    dimension for all pairs at once.  The pairs themselves are the rows to
    return, so they grow with the probes times the vectors of a label.
    """
    label = dict(vectors.dtypes)["label"]
    v, p = (x.select("label", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("label IS NOT NULL AND vec_id IS NOT NULL") for x in (vectors, probes))
    lists = v.mapInArrow(_lists, f"label {label}, ids array<long>, vecs array<array<double>>")
    many = p.groupBy("label").agg(F.ceil(F.count("*") / PROBES).alias("many"))
    block = F.pmod(F.xxhash64("vec_id"), "many").alias("block")
    asked = p.join(many, "label").groupBy("label", block).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("p"))
    asked = asked.select("label", "block", F.col("p.vec_id").alias("probe_ids"), F.col("p.embedding").alias("probe_vecs"))
    met = lists.join(asked, "label").groupBy("label", "block", F.xxhash64("ids").alias("list"))
    pairs = met.applyInArrow(_cosines, "i long, j long, c double")
    return pairs.select("i", "j", distance_from_similarity(F.col("c")).alias("dist"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, vec_id, embedding) as lists of one label."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).sort_by("label").combine_chunks()
        code = pc.rank(t.column("label"), tiebreaker="min").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(code))
        cuts = np.concatenate([*(np.arange(a, b, LIST) for a, b in zip(begins, ends)), [len(code)]]).astype(np.int32)
        columns = [t.column(c).combine_chunks() for c in ("vec_id", "embedding")]
        yield pa.RecordBatch.from_arrays([t.column("label").combine_chunks().take(pa.array(cuts[:-1])), *(pa.ListArray.from_arrays(pa.array(cuts), c) for c in columns)], names=["label", "ids", "vecs"])


def _dense(vecs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors filled up with 0, their lengths, their norms); what is null becomes NaN, and a null vector has length -1."""
    size = np.asarray(pc.fill_null(pc.list_value_length(vecs), 0), np.int64)
    out = np.zeros((len(vecs), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = vecs.flatten().to_numpy(zero_copy_only=False)
    square = np.zeros(len(vecs))
    for x in out.T:
        square += x * x
    null = np.asarray(vecs.is_null())
    return out, np.where(null, -1, size), np.where(null, np.nan, np.sqrt(square))


def _cosines(t: pa.Table) -> pa.Table:
    """A list and a block of probes: the cosines of all pairs of different ids; 1 where a norm is 0, NaN where it is unknown."""
    found = []
    for k in range(t.num_rows):
        ids, vecs, probe_ids, probe_vecs = (t.column(c).combine_chunks()[k].values for c in ("ids", "vecs", "probe_ids", "probe_vecs"))
        (v, n, size), (p, m, length) = _dense(vecs), _dense(probe_vecs)
        dot = np.zeros((len(p), len(v)))
        for x, y in zip(p.T, v.T):
            dot += x[:, None] * y
        dot[m[:, None] != n] = np.nan
        norms = length[:, None] * size
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(norms == 0, 1.0, dot / norms)
        j, i = np.asarray(ids), np.asarray(probe_ids)
        keep = i[:, None] != j
        found.append((np.broadcast_to(i[:, None], keep.shape)[keep], np.broadcast_to(j, keep.shape)[keep], c[keep]))
    return pa.table({name: np.concatenate(x) for name, x in zip("ijc", zip(*found))})


def bigram_counts(docs: DataFrame, by: str) -> DataFrame:
    """(by, bigram, n), to be read several times."""
    return kept(T.gram_rows(docs, [by], stop=None, name="bigram").groupBy(by, "bigram").agg(F.count("*").alias("n")), "bigrams")


def collocations(docs: DataFrame, by: str) -> DataFrame:
    """(by, bigram, n, llr): log-likelihood ratio of each bigram against its words' independence."""
    pairs = bigram_counts(docs, by)
    return likelihood_ratios(pairs, pairs, by)


def likelihood_ratios(asked: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """(by, bigram, n, llr) of some of pairs(by, bigram, n) against the counts of all."""
    w1, w2 = F.substring_index("bigram", " ", 1), F.substring_index("bigram", " ", -1)
    one = pairs.groupBy(by, w1.alias("w1")).agg(F.sum("n").alias("n1"))
    two = pairs.groupBy(by, w2.alias("w2")).agg(F.sum("n").alias("n2"))
    total = pairs.groupBy(by).agg(F.sum("n").alias("total"))
    # the bigram is its words, so rows carry these alone
    x = asked.select(by, "n", w1.alias("w1"), w2.alias("w2")).join(one, [by, "w1"]).join(two, [by, "w2"]).join(total, by)

    def term(k: Column, e: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)

    n, n1, n2, all_ = (F.col(c).cast("double") for c in ("n", "n1", "n2", "total"))
    llr = 2 * (term(n, n1 * n2 / all_) + term(n1 - n, n1 * (all_ - n2) / all_) + term(n2 - n, (all_ - n1) * n2 / all_) + term(all_ - n1 - n2 + n, (all_ - n1) * (all_ - n2) / all_))
    return x.select(by, F.concat("w1", F.lit(" "), "w2").alias("bigram"), "n", llr.alias("llr"))


def found_counts(ngrams: DataFrame, vectors: DataFrame) -> DataFrame:
    """(n, found, k): how many n-grams have a word vector; ngrams(gram), vectors(word)."""
    hit = ngrams.select("gram").distinct().join(vectors.select(F.col("word").alias("gram")).distinct().withColumn("hit", F.lit(True)), "gram", "left")
    return hit.groupBy(F.size(F.split("gram", " ")).cast("long").alias("n"), F.coalesce("hit", F.lit(False)).alias("found")).agg(F.count("*").alias("k"))


def filter_table(rows: DataFrame, equal: dict[str, object] | None = None, unequal: dict[str, object] | None = None) -> DataFrame:
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    for c, v in (unequal or {}).items():
        rows = rows.where(F.col(c) != F.lit(v))
    return rows


def merge_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Side by side by a row key; the right table's clashing columns get a suffix."""
    renamed = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in left.columns and c != key})
    return left.join(renamed, key)


def cluster_ranking(members: DataFrame) -> DataFrame:
    """(by, cluster, students, best, rnk): members(by..., cluster, student, score) by distinct students, ties by the best score, then name; ranks count within by."""
    by = [c for c in members.columns if c not in ("cluster", "student", "score", "phrase")]
    per = members.groupBy(*by, "cluster").agg(F.count_distinct("student").alias("students"), F.max("score").alias("best"))
    return per.withColumn("rnk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("students"), F.desc("best"), "cluster")))


def cluster_report(members: DataFrame, k: int = 3) -> DataFrame:
    """(by, rnk, cluster, students, phrases): the ranked clusters with their best k phrases, by score and name, joined by `;`."""
    by = [c for c in members.columns if c not in ("cluster", "student", "score", "phrase")]
    best = members.groupBy(*by, "cluster", "phrase").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(*by, "cluster").orderBy(F.desc("score"), "phrase"))
    top = best.withColumn("i", place).where(F.col("i") <= k).groupBy(*by, "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "phrase"))).alias("p"))
    phrases = F.array_join(F.transform("p", lambda x: x["phrase"]), ";").alias("phrases")
    return cluster_ranking(members).join(top, [*by, "cluster"]).select(*by, "rnk", "cluster", "students", phrases)


def feature_split(features: DataFrame, reference: DataFrame) -> DataFrame:
    """How often each feature fires on concepts inside and outside the references."""
    tagged = features.join(reference.select("concept").distinct().withColumn("hit", F.lit(True)), "concept", "left")
    return tagged.groupBy("feature", F.coalesce("hit", F.lit(False)).alias("in_reference")).agg(F.count("*").alias("n"))


def document_frequencies(docs: DataFrame, terms: Column | None = None) -> DataFrame:
    """(term, df) over docs(text): in how many a term comes; terms are by default the words and tags of the text."""
    toks = T.tagged_tokens(F.col("text")) if terms is None else terms
    return docs.select(F.explode(F.array_distinct(toks)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def derived_stop_words(frequencies: DataFrame, documents: int, share: float = 0.01) -> DataFrame:
    """(term): terms that at least a share of the documents have."""
    return frequencies.where(F.col("df") >= share * documents).select("term")


def keywords(docs: DataFrame, frequencies: DataFrame, documents: int, stop: DataFrame | None = None, default_idf: float = 1.5) -> DataFrame:
    """(doc_id, term, tfidf): a term's share of the text times ln((1 + documents) / (1 + df)); terms of no corpus have the default, stop words 0."""
    toks = T.tagged_tokens(F.col("text"))
    once = docs.select("doc_id", toks.alias("toks")).select("doc_id", F.size("toks").alias("all"), "toks")
    rows = once.select("doc_id", "all", F.explode("toks").alias("term")).groupBy("doc_id", "term").agg((F.count("*") / F.max("all")).alias("tf"))
    told = rows.join(frequencies, "term", "left")
    idf = F.coalesce(F.ln((1.0 + documents) / (1.0 + F.col("df"))), F.lit(default_idf))
    if stop is not None:
        told = told.join(stop.select("term").distinct().withColumn("stops", F.lit(True)), "term", "left")
        idf = F.when(F.col("stops"), F.lit(0.0)).otherwise(idf)
    return told.select("doc_id", "term", (F.col("tf") * idf).alias("tfidf"))


def domain_collocations(docs: DataFrame, by: str, best: int = 15, least: int = 2) -> DataFrame:
    """(bigram, idf): bigrams among a text group's best by likelihood ratio, whose number of groups over their own is below the mean.

    Bigrams of words under three letters or stop words, and those of fewer than
    `least` occurrences in a group, don't count.
    """
    w1, w2 = F.substring_index("bigram", " ", 1), F.substring_index("bigram", " ", -1)
    ok = (F.length(w1) >= 3) & (F.length(w2) >= 3) & ~w1.isin(*T.STOP_WORDS) & ~w2.isin(*T.STOP_WORDS) & (F.col("n") >= least)
    pairs = bigram_counts(docs.where(F.col(by).isNotNull()), by)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("llr", 6)), "bigram"))
    # only bigrams that count are scored, against the counts of all
    top = kept(likelihood_ratios(pairs.where(ok), pairs, by).withColumn("place", place).where(F.col("place") <= best).select("bigram").distinct(), "top")
    groups = pairs.select(by).distinct().count()
    idf = pairs.join(top, "bigram", "left_semi").groupBy("bigram").agg((F.lit(groups) / F.count("*")).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    return idf.crossJoin(F.broadcast(mean)).where("idf < mean").select("bigram", "idf")  # one row
