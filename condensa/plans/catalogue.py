"""The registered queries over the driver tables, and the same in SQL for DuckDB.

Group = (source, lang) of documents, under the names lecture and prompt inside
the operators.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions.ship import ship
from condensa.functions.stem import stem_table
from condensa.functions.vectors import cluster_count
from condensa.operators import concepts as C
from condensa.operators import automaton, graph, learn, lowrank, match, matrix, parse, report, rouge, solver, stats
from condensa.sources.place import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (spark, read table) under its name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, lambda name: read(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def groups(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"lecture": "source", "prompt": "lang", "student": "doc_id"})


# ---- SQL building blocks -------------------------------------------------
STOP = "[" + ", ".join("'" + w + "'" for w in T.STOP_WORDS) + "]"
PUNCT = "[" + ", ".join("'" + (c if c != "'" else "''") + "'" for c in T.PUNCTUATION) + "]"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"


def grams(t: str, n: int) -> str:
    return f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i+{n - 1}], ' ')) ELSE [] END"


def nonstop(g: str) -> str:
    return f"list_filter({g}, lambda g: len(list_filter(string_split(g, ' '), lambda w: NOT list_contains({STOP}, w))) > 0)"


def sents(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.?!])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


DOCS = f"d AS (SELECT doc_id, source, lang, text, {toks('text')} AS t FROM documents)"
CONCEPTS = f"{DOCS}, g AS (SELECT *, {nonstop(grams('t', 2))} AS gs FROM d)"
TF = f"{CONCEPTS}, theta AS (SELECT source, lang, concept, CAST(count(*) AS DOUBLE) AS theta FROM (SELECT source, lang, unnest(gs) AS concept FROM g) GROUP BY ALL)"
DISTINCT = f"{CONCEPTS}, theta AS (SELECT source, lang, concept, CAST(count(*) AS DOUBLE) AS theta FROM (SELECT source, lang, unnest(list_distinct(gs)) AS concept FROM g) GROUP BY ALL)"


def features(rows: str, preds: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT source, lang, concept, '{n}' AS feature, 1.0::DOUBLE AS value FROM {rows} WHERE {p}" for n, p in preds)


# ---- concepts and weights ------------------------------------------------
@query(f"WITH {TF} SELECT * FROM theta")
def concept_theta_tf(spark, t):
    return groups(C.theta_tf(C.responses(t("documents"))))


@query(f"WITH {DISTINCT} SELECT * FROM theta")
def concept_theta_distinct(spark, t):
    return groups(C.theta_distinct(C.responses(t("documents"))))


@query(f"""WITH {TF}, a AS (SELECT source, lang, sum(theta) AS n FROM theta GROUP BY ALL), f AS (SELECT concept, count(*) AS df FROM theta GROUP BY concept)
SELECT theta.source, theta.lang, theta.concept, theta / n AS tf, df, theta / n * ln((1.0 + (SELECT count(*) FROM a)) / (1.0 + df)) AS tfidf
FROM theta JOIN a ON a.source = theta.source AND a.lang = theta.lang JOIN f ON f.concept = theta.concept""")
def concept_tfidf(spark, t):
    return groups(C.tfidf(C.responses(t("documents"))))


@query(f"WITH {DISTINCT}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY theta DESC, concept) AS INTEGER) AS rnk FROM theta) SELECT * FROM r WHERE rnk <= 10")
def top_concepts(spark, t):
    return groups(C.top(C.theta_distinct(C.responses(t("documents"))), 10))


TOP_PHRASES = f"""p AS (SELECT source, lang, s AS phrase, count(*) AS freq FROM (SELECT source, lang, unnest({sents('text')}) AS s FROM documents) GROUP BY ALL),
tp AS (SELECT source, lang, phrase FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY freq DESC, phrase) AS k FROM p) WHERE k <= 5)"""


def top_phrases(t) -> DataFrame:
    """The five commonest sentences of each group."""
    return C.top(C.phrases(C.responses(t("documents")), "sentence"), 5, "freq", "phrase").select(*C.GROUP, "phrase")


@query(f"""WITH {TOP_PHRASES}, c AS (SELECT source, lang, unnest({nonstop(grams(toks('phrase'), 2))}) AS concept FROM tp), w AS (SELECT source, lang, unnest(string_split(concept, ' ')) AS word FROM c),
m AS (SELECT source, lang, word, CAST(count(*) AS DOUBLE) AS mass FROM w WHERE NOT list_contains({STOP}, word) GROUP BY ALL)
SELECT * FROM (SELECT source, lang, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY mass DESC, word) AS INTEGER) AS rnk, word, mass FROM m) WHERE rnk <= 30""")
def unigram_prefix_summary(spark, t):
    cells = C.incidence(top_phrases(t)).withColumn("value", F.col("occ").cast("double"))
    return groups(C.unigram_summary(cells))


@query(f"""WITH {DOCS}, g AS (SELECT source, unnest(list_concat({grams('t', 1)}, {grams('t', 2)}, {grams('t', 3)})) AS ngram FROM d)
SELECT source, ngram, CAST(count(*) * len(string_split(ngram, ' ')) AS BIGINT) AS score FROM g WHERE NOT list_contains({STOP}, string_split(ngram, ' ')[1]) GROUP BY source, ngram""")
def key_ngrams_weighted(spark, t):
    return groups(C.key_ngrams(C.responses(t("documents"))))


MALFORMED = f"(({words('phrase')} = 1 AND (list_contains({STOP}, lower(phrase)) OR regexp_full_match(phrase, '[0-9]+'))) OR list_contains({PUNCT}, phrase[1]))"


@query(f"WITH s AS (SELECT source, unnest({sents('text')}) AS phrase FROM documents) SELECT source, phrase, count(*) AS freq, {words('phrase')} AS n_words FROM s WHERE NOT {MALFORMED} GROUP BY source, phrase")
def phrase_filter(spark, t):
    return groups(C.well_formed_phrases(C.responses(t("documents"))))


@query(f"SELECT source, phrase, count(DISTINCT doc_id) AS n_students FROM (SELECT source, doc_id, unnest({sents('text')}) AS phrase FROM documents) GROUP BY source, phrase")
def phrase_sources(spark, t):
    return groups(C.phrase_students(C.responses(t("documents"))))


# ---- features ------------------------------------------------------------
@query(f"WITH {TF} " + features("theta", [("term_freq>=1", "theta > 1"), ("term_freq>=2", "theta > 2"), ("term_freq>=5", "theta > 5"), ("term_freq<=2", "theta <= 2"), ("term_freq<=5", "theta <= 5")]))
def feature_tf(spark, t):
    return groups(C.tf_features(C.theta_tf(C.responses(t("documents")))))


@query(f"WITH {TF}, r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY theta DESC, concept) AS k FROM theta) " + features("r", [("tf_rank<5", "k <= 5"), ("tf_rank<10", "k <= 10")]))
def feature_rank(spark, t):
    return groups(C.rank_features(C.theta_tf(C.responses(t("documents")))))


_STEPS = (5, 10, 15, 20, 25, 30)
AVE = f"{CONCEPTS}, a AS (SELECT source, lang, concept, floor(sum(n) / count(*)) AS ave FROM (SELECT source, lang, len(t) AS n, unnest(list_distinct(gs)) AS concept FROM g) GROUP BY ALL)"


@query(f"WITH {AVE} " + features("a", [(f"ave_sen_length>{x}", f"ave > {x}") for x in _STEPS] + [(f"ave_sen_length<={x}", f"ave <= {x}") for x in _STEPS]))
def feature_avg_len(spark, t):
    return groups(C.length_features(C.average_length(C.responses(t("documents")))))


@query(f"""WITH {DOCS}, a AS (SELECT *, {grams('t', 2)} AS gs FROM d), e AS (SELECT source, lang, doc_id, len(gs) AS n, unnest(gs) AS concept, unnest(range(len(gs))) AS pos FROM a),
f AS (SELECT source, lang, doc_id, concept, min(pos) AS pos, any_value(n) AS n FROM e GROUP BY ALL)
SELECT DISTINCT source, lang, concept, 'position_' || CAST(CAST(floor(pos * 5 / n) AS BIGINT) AS VARCHAR) AS feature, 1.0::DOUBLE AS value FROM f WHERE len(list_filter(string_split(concept, ' '), lambda w: NOT list_contains({STOP}, w))) > 0""")
def feature_position(spark, t):
    return groups(C.position_features(C.responses(t("documents"))))


_SIM = [("=0", "= 0"), *((f"<={x}", f"<= {x}") for x in (1, 2, 3, 4, 10)), (">10", "> 10"), ("!=0", "<> 0"), *((f">{x}", f"> {x}") for x in (1, 2, 3, 4))]
LANGS = ["de", "en", "es", "fr"]


def prompts(t) -> DataFrame:
    """A prompt's words: those of the benchmark items of its turn, modulo the number of prompts."""
    names = F.array(*(F.lit(x) for x in LANGS))
    rows = t("benchmark").select(F.get(names, (F.col("item_id") % 4).cast("int")).alias("prompt"), F.explode(T.tokens(F.col("text"))).alias("w"))
    return rows.groupBy("prompt").agg(F.collect_set("w").alias("words"))


@query(f"WITH {CONCEPTS}, q AS (SELECT ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS lang, list(DISTINCT w) AS ws FROM (SELECT item_id, unnest({toks('text')}) AS w FROM benchmark) GROUP BY ALL), a AS (SELECT source, lang, concept, floor(sum(n) / count(*)) AS ave FROM (SELECT source, lang, len(list_filter(t, lambda w: list_contains(ws, w))) AS n, unnest(list_distinct(gs)) AS concept FROM g JOIN q USING (lang)) GROUP BY ALL) " + features("a", [(f"prompt_sim{n}", f"ave {p}") for n, p in _SIM]))
def feature_prompt_sim(spark, t):
    return groups(C.prompt_similarity_features(C.responses(t("documents")), prompts(t)))


@query(f"""WITH {TF}, f AS (SELECT source, lang, word, CAST(count(*) AS DOUBLE) AS f FROM (SELECT source, lang, unnest(list_filter(t, lambda w: NOT list_contains({STOP}, w))) AS word FROM d) GROUP BY ALL),
r AS (SELECT x.source, x.lang, x.concept, coalesce(a.f, 0) AS f1, coalesce(b.f, 0) AS f2 FROM (SELECT *, string_split(concept, ' ') AS w FROM theta) x
LEFT JOIN f a ON a.source = x.source AND a.lang = x.lang AND a.word = x.w[1] LEFT JOIN f b ON b.source = x.source AND b.lang = x.lang AND b.word = x.w[2]) """
+ features("r", [(f"freq_{n}{op}{x}", f"{c} {op} {x}") for n, c in (("firstw", "f1"), ("secondw", "f2")) for op, xs in ((">", (1, 2, 5)), ("<=", (2, 5))) for x in xs]))
def feature_word_freq(spark, t):
    resp = C.responses(t("documents"))
    return groups(C.word_frequency_features(C.theta_tf(resp), resp))


# ---- statistics ----------------------------------------------------------
def _dist(rows: str, by: str) -> str:
    return f"SELECT {by}, count(*) AS n, max(x) AS longest, min(x) AS shortest, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std FROM ({rows}) GROUP BY {by}"


@query(_dist("SELECT lang, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+')) AS x FROM documents", "lang"))
def wordpunct_counts(spark, t):
    return stats.wordpunct_counts(t("documents"))


@query(_dist(f"SELECT lang, {words('s')} AS x FROM (SELECT lang, unnest({sents('text')}) AS s FROM documents)", "lang"))
def sentence_stats(spark, t):
    return stats.sentence_statistics(t("documents"))


@query(f"SELECT lang, {words('s')} AS words, count(*) AS n FROM (SELECT lang, unnest({sents('text')}) AS s FROM documents) GROUP BY ALL")
def sentence_histogram(spark, t):
    return stats.length_histogram(t("documents"))


@query(f"""WITH {DOCS}, s AS (SELECT source, count(*) AS responses, CAST(sum(len({sents('text')})) AS BIGINT) AS sentences, CAST(sum(len(t)) AS BIGINT) AS words FROM d GROUP BY source),
b AS (SELECT source, count(DISTINCT x) AS bigrams FROM (SELECT source, unnest({grams('t', 2)}) AS x FROM d) GROUP BY source) SELECT source, responses, sentences, words, coalesce(bigrams, 0) AS bigrams, words / sentences AS words_per_sentence FROM s LEFT JOIN b USING (source)""")
def dataset_statistics(spark, t):
    return stats.dataset_statistics(t("documents"))


@query(f"WITH w AS (SELECT unnest({toks('text')}) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word NOT IN (SELECT unnest({toks('text')}) FROM benchmark) GROUP BY word")
def oov_words(spark, t):
    return stats.unknown_words(t("documents"), stats.corpus_words(t("benchmark")))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({toks('text')}) AS word FROM documents UNION ALL SELECT unnest({toks('text')}) FROM benchmark) GROUP BY word")
def union_counts(spark, t):
    return stats.union_counts(stats.corpus_words(t("documents")), stats.corpus_words(t("benchmark")))


BAG = f"{DOCS}, b AS (SELECT term, doc, count(*) AS n FROM (SELECT doc_id AS doc, unnest(t) AS term FROM d) GROUP BY ALL)"


@query(f"WITH {BAG} SELECT term, doc, 1::BIGINT AS value FROM b")
def bow_binary(spark, t):
    return stats.binary(stats.bag_of_words(t("documents")))


@query(f"WITH {BAG}, f AS (SELECT term, count(*) AS df FROM b GROUP BY term) SELECT b.term, doc, n / df AS value FROM b JOIN f ON f.term = b.term")
def df_weighted(spark, t):
    return stats.df_weighted(stats.bag_of_words(t("documents")))


@query(f"WITH {BAG} SELECT lang, sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END) / (count(DISTINCT term) * any_value(m)) AS ratio FROM b JOIN d ON d.doc_id = b.doc JOIN (SELECT lang, count(*) AS m FROM documents GROUP BY lang) USING (lang) GROUP BY lang")
def sparsity_ratio(spark, t):
    return stats.sparsity_ratio(stats.bag_of_words(t("documents")), t("documents"), "lang")


@query(f"WITH {TF} SELECT source, lang, avg(CASE WHEN theta <= 2 THEN 1.0 ELSE 0.0 END) AS rare FROM theta GROUP BY ALL")
def rare_concepts(spark, t):
    return groups(stats.rare_share(C.theta_tf(C.responses(t("documents"))), C.GROUP))


@query(f"""WITH {DOCS}, p AS (SELECT lang, bigram, count(*) AS n, string_split(bigram, ' ')[1] AS w1, string_split(bigram, ' ')[2] AS w2 FROM (SELECT lang, unnest({grams('t', 2)}) AS bigram FROM d) GROUP BY ALL),
q AS (SELECT lang, bigram, n, CAST(sum(n) OVER (PARTITION BY lang, w1) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY lang, w2) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS m FROM p)
SELECT lang, bigram, n, 2 * (n * ln(n / (a * b / m)) + CASE WHEN a > n THEN (a - n) * ln((a - n) / (a * (m - b) / m)) ELSE 0 END + CASE WHEN b > n THEN (b - n) * ln((b - n) / ((m - a) * b / m)) ELSE 0 END
+ CASE WHEN m - a - b + n > 0 THEN (m - a - b + n) * ln((m - a - b + n) / ((m - a) * (m - b) / m)) ELSE 0 END) AS llr FROM q""")
def collocations(spark, t):
    return stats.collocations(t("documents"), "lang")


# ---- references ----------------------------------------------------------
def _cover(n: int) -> str:
    return f"""SELECT {n}::BIGINT AS n, count(*) AS total, count(*) FILTER (g IN (SELECT unnest({grams('t', n)}) FROM d)) AS covered, count(*) FILTER (g IN (SELECT unnest({grams('t', n)}) FROM d)) / count(*) AS ratio
FROM (SELECT DISTINCT unnest({grams('t', n)}) AS g FROM r)"""


@query(f"WITH {DOCS}, r AS (SELECT {toks('text')} AS t FROM benchmark) " + " UNION ALL ".join(_cover(n) for n in range(1, 6)))
def reference_coverage(spark, t):
    return rouge.reference_coverage(t("documents"), t("benchmark"))


def _systems(t) -> tuple[DataFrame, DataFrame]:
    """Documents as summaries; references by lecture: src0 to src19, item_id modulo 20."""
    systems = t("documents").select(F.col("doc_id").alias("system_id"), F.col("source").alias("ref_key"), "text")
    return systems, t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("ref_key"), F.col("item_id").alias("ref_id"), "text")


def _skips(t: str) -> str:
    return f"list_concat({t}, flatten(list_transform(range(1, len({t}) + 1), lambda i: list_transform(range(i + 1, least(len({t}), i + 5) + 1), lambda j: {t}[i] || ' ' || {t}[j]))))"


def _rouge(name: str, unit: str) -> str:
    return f"""SELECT doc_id, '{name}' AS metric, avg(r) AS r, avg(p) AS p, avg(f) AS f FROM (
SELECT doc_id, r, p, CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END AS f FROM (
SELECT s.doc_id, CASE WHEN rn > 0 THEN coalesce(hit, 0) / rn ELSE 0 END AS r, CASE WHEN sn > 0 THEN coalesce(hit, 0) / sn ELSE 0 END AS p
FROM (SELECT doc_id, source, len({unit}) AS sn FROM d) s JOIN (SELECT item_id, source, len({unit}) AS rn FROM r) q ON q.source = s.source
LEFT JOIN (SELECT a.doc_id, b.item_id, sum(least(a.n, b.n)) AS hit FROM
 (SELECT doc_id, source, u, count(*) AS n FROM (SELECT doc_id, source, unnest({unit}) AS u FROM d) GROUP BY ALL) a JOIN
 (SELECT item_id, source, u, count(*) AS n FROM (SELECT item_id, source, unnest({unit}) AS u FROM r) GROUP BY ALL) b ON a.source = b.source AND a.u = b.u GROUP BY ALL) h ON h.doc_id = s.doc_id AND h.item_id = q.item_id)) GROUP BY doc_id"""


_REFS = f"{DOCS}, r AS (SELECT item_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS source, {toks('text')} AS t FROM benchmark)"


@query(f"WITH {_REFS} {_rouge('ROUGE-1', grams('t', 1))} UNION ALL {_rouge('ROUGE-2', grams('t', 2))}")
def rouge_n(spark, t):
    return rouge.rouge(*_systems(t), ["1", "2"]).withColumnRenamed("system_id", "doc_id")


def _jack(part: str) -> str:
    """Leave-one-out maxima written out: the others' greatest, averaged."""
    return f"CASE WHEN count(*) = 1 THEN max({part}) ELSE avg({part}_others) END AS {part}"


@query(f"""WITH {_REFS}, s AS ({_rouge('ROUGE-1', grams('t', 1)).replace("SELECT doc_id, 'ROUGE-1' AS metric, avg(r) AS r, avg(p) AS p, avg(f) AS f FROM", "SELECT doc_id, r, p, f, row_number() OVER () AS i FROM").removesuffix(" GROUP BY doc_id")}),
o AS (SELECT s.doc_id, s.i, any_value(s.r) AS r, any_value(s.p) AS p, any_value(s.f) AS f, max(z.r) AS r_others, max(z.p) AS p_others, max(z.f) AS f_others FROM s LEFT JOIN s z ON z.doc_id = s.doc_id AND z.i <> s.i GROUP BY s.doc_id, s.i)
SELECT doc_id, 'ROUGE-1' AS metric, {_jack("r")}, {_jack("p")}, {_jack("f")} FROM o GROUP BY doc_id""")
def rouge_jackknife(spark, t):
    return rouge.rouge(*_systems(t), ["1"], "jackknife").withColumnRenamed("system_id", "doc_id")


@query()
def rouge_intervals(spark, t):
    """Bootstrap intervals of the mean scores of each language's documents."""
    scored = rouge.rouge(*_systems(t), ["1"]).join(t("documents").select(F.col("doc_id").alias("system_id"), "lang"), "system_id")
    return rouge.intervals(scored, ["lang", "metric"], 200)


@query(f"WITH {_REFS} {_rouge('ROUGE-SU4', _skips('t'))}")
def rouge_su4(spark, t):
    return rouge.rouge(*_systems(t), ["su4"]).withColumnRenamed("system_id", "doc_id")


@query(f"""WITH {_REFS}, s AS ({_rouge('ROUGE-1', grams('t', 1))} UNION ALL {_rouge('ROUGE-2', grams('t', 2))}), x AS (SELECT lang, s.* FROM s JOIN d ON d.doc_id = s.doc_id)
SELECT lang, metric, avg(r) AS r, avg(p) AS p, avg(f) AS f FROM x GROUP BY ALL UNION ALL SELECT 'average', metric, avg(r), avg(p), avg(f) FROM x GROUP BY metric""")
def rouge_rollup(spark, t):
    scored = rouge.rouge(*_systems(t), ["1", "2"]).withColumnRenamed("system_id", "doc_id")
    return rouge.score_table(scored.join(t("documents").select("doc_id", "lang"), "doc_id"), "lang")


# The chosen phrases of coverage, diversity and quality are each source's ten concepts of the largest weight.
_CHOSEN = f"""{CONCEPTS}, w AS (SELECT source, concept, count(*) AS n FROM (SELECT source, unnest(list_distinct(gs)) AS concept FROM g) GROUP BY ALL),
k AS (SELECT source, concept FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, concept) AS i FROM w) WHERE i <= 10),
c AS (SELECT DISTINCT k.source, k.concept AS phrase, e.doc_id AS student FROM k JOIN (SELECT source, doc_id, unnest(list_distinct(gs)) AS concept FROM g) e ON e.source = k.source AND e.concept = k.concept)"""


def _chosen(t) -> DataFrame:
    held = t("documents").select("source", F.col("doc_id").alias("student"), "text")
    held = T.gram_rows(held, ["source", "student"], distinct=True)
    top = C.top(held.groupBy("source", "concept").agg(F.count("*").alias("n")), 10, "n", by=["source"]).select("source", "concept")
    return held.join(top, ["source", "concept"]).select("source", F.col("concept").alias("phrase"), "student").distinct()


@query(f"""WITH {_CHOSEN}, s AS (SELECT source, student, count(DISTINCT phrase) AS k FROM c GROUP BY ALL), v AS (SELECT source, count(*) AS m FROM s GROUP BY source),
e AS (SELECT s.source, sum(-(k / m) * ln(k / m)) AS entropy, any_value(m) AS m FROM s JOIN v ON v.source = s.source GROUP BY s.source)
SELECT n.source, coalesce(m, 0) / n AS coverage, coalesce(entropy, 0) AS entropy FROM (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source) n LEFT JOIN e ON e.source = n.source""")
def coverage_diversity(spark, t):
    return rouge.coverage_and_diversity(_chosen(t), t("documents").select("source", F.col("doc_id").alias("student")), "source")


@query(f"WITH {_CHOSEN}, p AS (SELECT source, phrase, sum(quality) / count(*) AS q FROM c JOIN labels ON labels.doc_id = c.student GROUP BY ALL) SELECT source, avg(q) AS quality FROM p GROUP BY source")
def summary_quality(spark, t):
    return rouge.summary_quality(_chosen(t), t("labels").select(F.col("doc_id").alias("student"), "quality"), "source")


@query(f"""WITH {_CHOSEN}, r AS (SELECT DISTINCT 'src' || CAST(item_id % 20 AS VARCHAR) AS source, unnest({nonstop(grams(toks('text'), 2))}) AS concept FROM benchmark), h AS (SELECT DISTINCT source, unnest(gs) AS concept FROM g)
SELECT source, concept, 1 AS sign FROM h JOIN r USING (source, concept) WHERE (source, concept) NOT IN (SELECT (source, concept) FROM k)
UNION ALL SELECT source, concept, -1 FROM h JOIN k USING (source, concept) WHERE (source, concept) NOT IN (SELECT (source, concept) FROM r)""")
def label_diff(spark, t):
    held = T.gram_rows(t("documents"), ["source"], distinct=True)
    chosen = C.top(held.groupBy("source", "concept").agg(F.count("*").alias("n")), 10, "n", by=["source"])
    refs = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), "text")
    refs = T.gram_rows(refs, ["source"])
    return rouge.diff_labels(held, refs, chosen.select("source", "concept"), ["source"])


# ---- vectors -------------------------------------------------------------
_COS = "CASE WHEN list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e) = 0 THEN 1.0 ELSE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) END"
_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"WITH {_VEC} SELECT a.vec_id, a.label, 1 + coalesce(sum(CASE WHEN a.vec_id <> b.vec_id THEN {_COS} END), 0) AS theta FROM v a JOIN v b ON a.label = b.label GROUP BY ALL")
def cosine_pairs(spark, t):
    return stats.group_similarity(t("embeddings"))


@query(f"WITH {_VEC} SELECT a.vec_id AS i, b.vec_id AS j, exp(-least(greatest({_COS}, 0), 100)) AS dist FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0")
def similarity_distance(spark, t):
    """Probes are a stated query set: the vectors with an id divisible by 100."""
    return stats.similarity_pairs(t("embeddings"), t("embeddings").where("vec_id % 100 = 0"))


@query("SELECT label, count(*) AS n, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS k FROM embeddings GROUP BY label")
def cluster_sizes(spark, t):
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("k", cluster_count(F.col("n")))


# ---- other tables --------------------------------------------------------
@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages)
SELECT page_id, unnest(range(len(ps)))::INTEGER AS pos, trim(regexp_replace(regexp_replace(unnest(ps), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM p""")
def page_paragraphs(spark, t):
    return t("pages").select("page_id", F.posexplode(T.paragraphs(F.col("html"))).alias("pos", "text"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS students, avg(length(text)) AS mean_chars FROM conversations GROUP BY role")
def conversation_profile(spark, t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("students"), F.avg(F.length("text")).alias("mean_chars"))


@query("WITH l AS (SELECT DISTINCT source AS lecture FROM documents) SELECT a.lecture AS fold, b.lecture, CASE WHEN a.lecture = b.lecture THEN 'test' ELSE 'train' END AS split FROM l a, l b")
def folds(spark, t):
    return stats.folds(t("documents").select(F.col("source").alias("lecture")))


@query(f"""WITH {DISTINCT}, s AS (SELECT source, lang, min(theta) AS lo, max(theta) AS hi, avg(theta) AS mu, stddev_pop(theta) AS sd FROM theta GROUP BY ALL), j AS (SELECT * FROM theta JOIN s USING (source, lang))
SELECT source, lang, 0::BIGINT AS mode, concept, theta - lo AS w FROM j UNION ALL SELECT source, lang, 1, concept, CASE WHEN hi = lo THEN theta ELSE (theta - lo) / (hi - lo) END FROM j
UNION ALL SELECT source, lang, 2, concept, CASE WHEN hi - (mu + sd) = 0 THEN theta ELSE (theta - (mu + sd)) / (hi - (mu + sd)) END FROM j
UNION ALL SELECT source, lang, 3, concept, 1 / (1 + exp(-theta)) FROM j UNION ALL SELECT source, lang, 4, concept, 1 / (1 + exp(-2 * theta)) FROM j""")
def weight_norm_modes(spark, t):
    return groups(stats.normalized_weights(C.theta_distinct(C.responses(t("documents"))), C.GROUP))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""")
def table_filter_merge(spark, t):
    kept = stats.filter_table(t("orders"), {"o_orderstatus": "F"}, {"o_orderpriority": "5-LOW"}).withColumnRenamed("o_custkey", "c_custkey")
    return stats.merge_columns(kept, t("customer"), "c_custkey").select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "o_totalprice", "c_name", "c_mktsegment")


@query("""SELECT doc_id, lower(trim(text)) IN ('?', '[blank]', 'n/a', 'blank') OR trim(text) = '' AS blank,
trim(regexp_replace(regexp_replace(trim(text), '^[0-9]+\\)\\s*', ''), '\\s*\\[[0-9]+\\]$', '')) AS reference, coalesce(try_cast(regexp_extract(trim(text), '\\[(\\d{1,9})\\]$', 1) AS INTEGER), 1) AS weight,
regexp_replace(text, '^\\[[^\\]]*\\]\\s*', '') AS plain FROM documents""")
def normalized_lines(spark, t):
    x = F.col("text")
    return t("documents").select("doc_id", T.is_blank_answer(x).alias("blank"), T.normalize_reference(x).alias("reference"), T.reference_weight(x).alias("weight"), T.strip_bracket_prefix(x).alias("plain"))


# ---- rows only -----------------------------------------------------------
def _cells(units: DataFrame, text: str = "phrase") -> DataFrame:
    """Cells of units(lecture, prompt, phrase, freq, cost): their bigrams, with the weights that these have in the group; phrases and concepts meet in one shuffle."""
    keep = [*C.GROUP, "phrase", "cost", "freq"]
    rows = T.gram_rows(units, keep, text, distinct=True).withColumn("theta", F.sum("freq").over(Window.partitionBy(*C.KEEP)).cast("double"))
    return rows.select(*C.GROUP, "phrase", "cost", "concept", F.lit(1.0).alias("value"), "theta")


def _sentences(t) -> DataFrame:
    """Sentences of each group with their words as cost; groups without a name have none."""
    return C.phrases(C.responses(t("documents")).na.drop(subset=C.GROUP), "sentence").withColumn("cost", T.word_count(F.col("phrase")))


def _problems(t) -> DataFrame:
    """Sentences of each group as phrases, with bigram cells and weights."""
    return _cells(_sentences(t))


def _numbered(t) -> DataFrame:
    """Sentences, told by number in the order of their names, so that cells don't carry them: (lecture, prompt, name, freq, cost, phrase)."""
    units = _sentences(t).withColumnRenamed("phrase", "name")
    return kept(units.orderBy(*C.GROUP, "name").withColumn("phrase", F.monotonically_increasing_id()), "phrases")


def _named(told: DataFrame, units: DataFrame) -> DataFrame:
    """Phrases by name again."""
    named = told.join(units.select(*C.GROUP, "phrase", "name"), [*C.GROUP, "phrase"])
    return groups(named.select(*(F.col("name").alias("phrase") if c == "phrase" else c for c in told.columns)))


def _writers(t, units: DataFrame) -> DataFrame:
    """(lecture, prompt, phrase, student) of numbered sentences."""
    rows = C.responses(t("documents")).select(*C.GROUP, "student", F.explode(F.array_distinct(T.sentences(F.col("text")))).alias("name"))
    return rows.join(units.select(*C.GROUP, "name", "phrase"), [*C.GROUP, "name"]).select(*C.GROUP, "phrase", "student")


@query()
def ilp_summary(spark, t):
    units = _numbered(t)
    return _named(solver.summarize(_cells(units, "name").where("cost <= 30"), C.GROUP, 30), units)


@query()
def ilp_sweep(spark, t):
    """Optima for five lengths and three shares of the concepts against students."""
    units = _numbered(t)
    told = solver.sweep(_cells(units, "name"), C.GROUP, [20, 25, 30, 35, 40], [0.5, 0.7, 0.9], _writers(t, units))
    return groups(told.select(*C.GROUP, "budget", "share", F.round("value", 6).alias("value"), F.round("bound", 6).alias("bound"), F.size("phrases").alias("phrases")))


@query()
def ilp_student_cover(spark, t):
    units = _numbered(t)
    return _named(solver.summarize(_cells(units, "name").where("cost <= 30"), C.GROUP, 30, students=_writers(t, units)), units)


def _completed(t) -> DataFrame:
    """Problems whose cells come from the completion of each group's matrix of usable phrases and concepts."""
    problems = kept(_problems(t).where("cost <= 30"), "problems")
    listed = problems.select(*C.GROUP, "phrase").distinct().withColumn("pos", F.xxhash64("phrase"))
    cells = matrix.completed_cells(problems.join(listed, [*C.GROUP, "phrase"]).select(*C.GROUP, "concept", "pos", "value"), C.GROUP, 1.0, least=0.1)
    found = report.completed_incidence(listed, listed, cells, C.GROUP, 0.1)
    about = problems.select(*C.GROUP, "phrase", "cost").distinct()
    theta = problems.select(*C.GROUP, "concept", "theta").distinct()
    return kept(found.withColumn("value", F.least("value", F.lit(1.0))).join(about, [*C.GROUP, "phrase"]).join(theta, [*C.GROUP, "concept"]), "completed")


@query()
def ilp_completed(spark, t):
    return groups(solver.summarize(_completed(t), C.GROUP, 30))


@query()
def ilp_completed_by_mass(spark, t):
    """A phrase costs half the sum of its completed cells instead of its words.

    Costs in proportion to what phrases are worth make a knapsack of near ties, so the search ends at 2,000 nodes; the bound tells.
    """
    found = _completed(t).drop("cost")
    mass = C.concept_mass(found, C.GROUP).withColumnRenamed("length", "cost")
    return groups(solver.summarize(found.join(mass, [*C.GROUP, "phrase"]), C.GROUP, 15, nodes=2000))


ROUNDS = 3


def _parts(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Problems, features of their concepts, and each lecture's part of the learned weights by round."""
    problems, resp = kept(_problems(t), "problems"), C.responses(t("documents"))
    theta = kept(problems.select(*C.KEEP, "theta").distinct(), "theta")
    feats = C.merged_features(C.tf_features(theta), C.rank_features(theta), C.length_features(C.average_length(resp)), C.position_features(resp), C.word_frequency_features(theta, resp))
    feats = kept(feats.join(theta.select(*C.KEEP), C.KEEP, "left_semi"), "features")
    by_lecture = feats.groupBy("lecture", "concept", "feature").agg(F.max("value").alias("value"))
    return problems, feats, learn.mixed_perceptron(by_lecture, reference_concepts(t), problems, "lecture", ROUNDS)


def _learned(t, mode: int) -> tuple[DataFrame, DataFrame]:
    """Problems, and their concepts' learned weights, normalized within a group."""
    problems, feats, parts = _parts(t)
    # a fold's score is that of the total less that of its own part
    mean = kept(parts.groupBy("lecture", "feature").agg((F.sum("own") / ROUNDS).alias("own")), "mean")
    total = mean.groupBy("feature").agg(F.sum("own").alias("w"))
    rows = feats.join(total, "feature").join(mean, ["lecture", "feature"], "left")
    mine = rows.groupBy(*C.KEEP).agg(F.sum(F.col("value") * (F.col("w") - F.coalesce("own", F.lit(0.0)))).alias("theta"))
    told = stats.normalized_weights(mine, C.GROUP).where(F.col("mode") == mode).select(*C.KEEP, F.col("w").alias("theta"))
    return problems.drop("theta"), told


def reference_concepts(t) -> DataFrame:
    """References by lecture: src0 to src19, item_id modulo 20."""
    refs = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("lecture"), "text")
    return T.gram_rows(refs, ["lecture"], stop=None)


@query()
def ilp_learned(spark, t):
    problems, theta = _learned(t, 1)
    return groups(solver.summarize(problems.join(theta, C.KEEP), C.GROUP, 30))


@query()
def perceptron_mixed(spark, t):
    """Weights of each source's fold, learned with the coverage program as decoder."""
    return learn.fold_weights(_parts(t)[2], "lecture", ROUNDS)


@query()
def perceptron_cv(spark, t):
    feats = C.tf_features(C.theta_tf(C.responses(t("documents")))).groupBy("lecture", "concept", "feature").agg(F.max("value").alias("value"))
    return learn.perceptron(feats, reference_concepts(t), "lecture")


@query()
def plain_perceptron(spark, t):
    """Each source's concepts in the order of their names; a concept is good if the source's references have it."""
    feats = C.tf_features(C.theta_tf(C.responses(t("documents")))).groupBy("lecture", "concept", "feature").agg(F.max("value").alias("value"))
    vectors = feats.groupBy("lecture", "concept").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("vector"))
    told = vectors.join(reference_concepts(t).distinct().withColumn("good", F.lit(True)), ["lecture", "concept"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    return learn.plain_perceptron(told, "lecture", ["concept"]).withColumnRenamed("lecture", "source")


@query()
def greedy_oracle(spark, t):
    refs = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.col("item_id").alias("ref_id"), "text")
    units = t("documents").select("source", F.explode(T.sentences(F.col("text"))).alias("phrase")).distinct().withColumn("cost", T.word_count(F.col("phrase")))
    return solver.greedy_oracle(units, refs, ["source"], 30)


@query()
def random_summary(spark, t):
    units = C.phrases(C.responses(t("documents")), "sentence").withColumn("cost", T.word_count(F.col("phrase")))
    return groups(solver.random_summary(units, C.GROUP, 30))


@query()
def kmedoids(spark, t):
    return matrix.k_medoids(t("embeddings"), "vec_id", "embedding", 10)


@query()
def lsa_factors(spark, t):
    return matrix.lsa(t("embeddings"), "vec_id", "embedding", 20)[0]


def _document_cells(t) -> DataFrame:
    """How often each document has each concept."""
    return T.gram_rows(t("documents"), ["doc_id"]).groupBy("doc_id", "concept").agg(F.count("*").cast("double").alias("n"))


@query()
def lsa_concepts(spark, t):
    """Documents in the space of the ten greatest directions of the whole document x concept matrix."""
    return lowrank.truncated_svd(_document_cells(t), "doc_id", "concept", "n", 10)[0]


@query()
def soft_impute_concepts(spark, t):
    """Concepts in the space of the completed document x concept matrix, by penalized directions."""
    return lowrank.soft_impute(_document_cells(t), "doc_id", "concept", "n", 2.0, rank=report.rank_cap(2.0))[2]


@query()
def soft_impute(spark, t):
    """Cells of small size count as unknown."""
    v = F.transform("embedding", lambda x: F.when(F.abs(x) >= 0.02, x.cast("double")).otherwise(F.lit(float("nan"))))
    return matrix.soft_impute(t("embeddings").select("vec_id", "label", v.alias("v")), "vec_id", "label", "v", 1.0)


@query()
def stemmed_concepts(spark, t):
    """Words are stemmed once each and joined back."""
    held = t("documents").select("doc_id", "source", F.posexplode(T.tokens(F.col("text"))).alias("i", "word"))
    counts = held.groupBy("source", "word").agg(F.count("*").alias("n"))
    return counts.join(stem_table(counts, "word"), "word").groupBy("source", "stem").agg(F.sum("n").alias("n"))


@query()
def lcs_ratio(spark, t):
    """All pairs of a source's concept and one of its references', by their common subsequence."""
    held = T.gram_rows(t("documents"), ["source"], distinct=True).select("source", F.col("concept").alias("a"))
    refs = reference_concepts(t).select(F.col("lecture").alias("source"), F.col("concept").alias("b"))
    return match.lcs_matches(held, refs, "source")


def benchmark_phrases(t) -> DataFrame:
    """A dictionary: the runs of two to five words of the benchmark's items."""
    grams = F.flatten(F.array(*(T.gram_array(T.tokens(F.col("text")), n) for n in range(2, 6))))
    return t("benchmark").select(F.explode(grams).alias("phrase")).where("phrase IS NOT NULL").distinct()


_MATCHES = f"""{DOCS},
w AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS pos FROM d UNION ALL SELECT -1 - item_id, unnest({toks("text")}), unnest(range(len({toks("text")}))) FROM benchmark),
y AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, pos, 2 AS n, w || ' ' || w1 AS phrase FROM y UNION ALL SELECT doc_id, pos, 3, w || ' ' || w1 || ' ' || w2 FROM y
  UNION ALL SELECT doc_id, pos, 4, w || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM y UNION ALL SELECT doc_id, pos, 5, w || ' ' || w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM y),
p AS (SELECT DISTINCT phrase FROM x WHERE doc_id < 0 AND phrase IS NOT NULL),
m AS (SELECT doc_id, pos, n, phrase FROM x SEMI JOIN p USING (phrase) WHERE doc_id >= 0)"""


@query(f"""WITH RECURSIVE {_MATCHES},
b AS (SELECT doc_id, pos, max(n) AS n, arg_max(phrase, n) AS phrase FROM m GROUP BY doc_id, pos),
e AS (SELECT a.doc_id, a.pos, a.phrase, c.pos AS onward FROM b a ASOF LEFT JOIN b c ON a.doc_id = c.doc_id AND a.pos + a.n <= c.pos),
s AS (SELECT doc_id, min(pos) AS pos FROM b GROUP BY doc_id UNION ALL SELECT e.doc_id, e.onward FROM s JOIN e ON e.doc_id = s.doc_id AND e.pos = s.pos WHERE e.onward IS NOT NULL)
SELECT e.doc_id, e.pos, e.phrase FROM s JOIN e USING (doc_id, pos)""")
def longest_match(spark, t):
    return match.longest_matches(t("documents"), benchmark_phrases(t))


@query(f"WITH {_MATCHES} SELECT doc_id, pos, n, phrase FROM m")
def every_match(spark, t):
    return match.all_matches(t("documents"), benchmark_phrases(t))


@query()
def longest_match_stemmed(spark, t):
    return match.longest_matches(t("documents"), benchmark_phrases(t), stems=True)


@query()
def dictionary_candidates(spark, t):
    """Candidate phrases in the four ways of looking them up."""
    known = benchmark_phrases(t)
    modes = ("ngram", "ngram_stemmed", "longest", "longest_stemmed")
    out = [parse.dictionary_candidates(t("documents"), known, m).groupBy("doc_id", "phrase").agg(F.count("*").alias("n")).withColumn("mode", F.lit(m)) for m in modes]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query()
def stemmed_members(spark, t):
    """Two-word concepts of the documents that are the benchmark's by their stems."""
    held = T.gram_rows(t("documents"), ["source"], distinct=True, name="phrase")
    return automaton.members(held, benchmark_phrases(t)).select("source", "phrase")


def text_graphs(t) -> tuple[DataFrame, DataFrame]:
    """Nodes(g, id, concept, sources) and edges(g, src, dst, sources) of the benchmark's items: a node a word, an edge from a word to the next one in its line.

    The edge has a relation unless one of the words is a stop word.
    """
    at = t("benchmark").select(F.col("item_id").alias("g"), F.posexplode(F.split("text", "\n")).alias("line", "body")).select("g", "line", F.posexplode(T.tokens(F.col("body"))).alias("pos", "concept"))
    place = Window.partitionBy("g").orderBy("concept")
    words = kept(at.withColumn("id", F.dense_rank().over(place) - 1), "words")
    nodes = words.groupBy("g", "id", "concept").agg(F.collect_list(F.struct(F.col("line").alias("line_num"), F.col("pos").alias("start_idx"), (F.col("pos") + 1).alias("end_idx"))).alias("sources"))
    along = Window.partitionBy("g", "line").orderBy("pos")
    pairs = words.select("g", "line", F.col("id").alias("src"), F.lead("id").over(along).alias("dst"), "concept", F.lead("concept").over(along).alias("then")).where("dst IS NOT NULL AND src <> dst")
    relation = F.when(~T.is_stop(F.col("concept")) & ~T.is_stop(F.col("then")), F.lit("next"))
    edges = pairs.groupBy("g", "src", "dst").agg(F.collect_list(F.struct(relation.alias("relation"), F.col("line").alias("line_num"))).alias("sources"))
    return nodes, edges


_GRAPHS = f"""l AS (SELECT item_id AS g, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM benchmark),
k AS (SELECT g, line, unnest({toks("body")}) AS concept, unnest(range(len({toks("body")}))) AS pos FROM l),
w AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY concept) - 1 AS id FROM k),
e AS (SELECT g, line, id AS src, lead(id) OVER o AS dst, concept, lead(concept) OVER o AS after FROM w WINDOW o AS (PARTITION BY g, line ORDER BY pos)),
edges AS (SELECT g, src, dst, count(*) AS freq, count(*) FILTER (NOT list_contains({STOP}, concept) AND NOT list_contains({STOP}, after)) AS named, min(line) AS first FROM e WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
nodes AS (SELECT g, id, concept, count(*) AS freq, min(line) AS first FROM w GROUP BY ALL)"""


def _above(name: str, value: str, limits: list[int], sign: str = ">") -> list[str]:
    return [f"CASE WHEN {value} {sign} {k} THEN '{name}/{k}' END" for k in limits]


@query(f"""WITH {_GRAPHS} SELECT g, src, dst, unnest(list_filter([{", ".join(["'bias'", "CASE WHEN named = 0 THEN 'null' END", *_above("freq", "freq", [0, 1, 2, 5, 10]), *_above("nonnull_freq", "named", [0, 1, 2, 5, 10]), *_above("position", "first", [5, 6, 7, 10, 15], "<="), "CASE WHEN named > 0 THEN 'relation/next' END"])}], lambda f: f IS NOT NULL)) AS feature FROM edges""")
def graph_edge_features(spark, t):
    return graph.edge_features(text_graphs(t)[1])


@query(f"""WITH {_GRAPHS} SELECT g, id, 'seen/' || unnest(list_filter([{", ".join(["'bias'", *_above("freq", "freq", [0, 1, 2, 5, 10]), *_above("position", "first", [5, 6, 7, 10, 15], "<="), "'concept/' || concept"])}], lambda f: f IS NOT NULL)) AS feature FROM nodes""")
def graph_tagged_features(spark, t):
    """Node features under a tag."""
    return graph.with_tag(graph.node_features(text_graphs(t)[0]), "seen")


@query(f"""WITH {_GRAPHS}, f AS (SELECT g, id, unnest(list_filter([{", ".join(_above("freq", "freq", [1, 2]))}, 'concept/' || concept], lambda f: f IS NOT NULL)) AS feature FROM nodes)
SELECT e.g, e.src, e.dst, a.feature || '&' || b.feature AS feature FROM edges e JOIN f a ON a.g = e.g AND a.id = e.src JOIN f b ON b.g = e.g AND b.id = e.dst""")
def graph_conjoined_features(spark, t):
    """Edges with the pairs of what their ends are and how often they occur."""
    nodes, edges = text_graphs(t)
    asked = graph.node_features(nodes).where("feature IN ('freq/1', 'freq/2') OR feature LIKE 'concept/%'")
    return graph.conjoined_features(edges, asked)


def weighted_graphs(t) -> tuple[DataFrame, DataFrame]:
    """The benchmark's graphs: a word weighs the more the fewer documents have it, an edge costs less where words meet again; words that begin a line can be roots."""
    nodes, edges = text_graphs(t)
    held = t("documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("concept")).groupBy("concept").agg(F.count("*").alias("df"))
    rare = F.log((1.0 + t("documents").count()) / (1.0 + F.coalesce("df", F.lit(0))))
    weighed = nodes.join(held, "concept", "left").select("g", F.col("id").alias("node"), F.round(rare - 4, 6).alias("weight"), F.exists("sources", lambda s: s["start_idx"] == 0).alias("root"))
    return weighed, edges.select("g", "src", "dst", F.round(F.size("sources") * 0.25 - 1.0, 6).alias("weight"))


@query()
def graph_select(spark, t):
    """The heaviest connected part of each item's words."""
    return graph.select_graphs(*weighted_graphs(t))


@query()
def graph_select_ten(spark, t):
    """The heaviest connected ten words of each item that has so many."""
    return graph.select_graphs(*weighted_graphs(t), 10)


# ---- weights from references ---------------------------------------------
_REFERENCE_PHRASES = f"p AS (SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS source, unnest({sents('text')}) AS phrase FROM benchmark)"


def reference_phrases(t) -> DataFrame:
    """The references' sentences by lecture."""
    return t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("lecture"), F.explode(T.sentences(F.col("text"))).alias("phrase"))


@query(f"""WITH {_REFERENCE_PHRASES}, g AS (SELECT source, unnest(list_distinct({nonstop(grams(toks('phrase'), 2))})) AS concept FROM p) SELECT source, concept, CAST(count(*) AS DOUBLE) AS theta FROM g GROUP BY ALL""")
def reference_weights(spark, t):
    return C.reference_weights(reference_phrases(t), ["lecture"]).withColumnRenamed("lecture", "source")


@query()
def ilp_reference_weights(spark, t):
    """Summaries by the weights that concepts have in the references: the best an extract can reach there."""
    theta, units = C.reference_weights(reference_phrases(t), ["lecture"]), _numbered(t)
    rows = T.gram_rows(units.where("cost <= 30"), [*C.GROUP, "phrase", "cost"], "name", distinct=True).withColumn("value", F.lit(1.0))
    return _named(solver.summarize(rows.join(theta, ["lecture", "concept"]), C.GROUP, 30), units)


@query()
def relaxed_labels(spark, t):
    """Concepts of each source that a reference has but for some letters."""
    concepts = T.gram_rows(t("documents").withColumnRenamed("source", "lecture"), ["lecture"], distinct=True).distinct()
    return learn.relaxed_labels(concepts, reference_concepts(t).distinct(), "lecture").withColumnRenamed("lecture", "source")
