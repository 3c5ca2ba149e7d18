"""Queries of score tables, sweeps, statistics, clusters and completed matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import concepts as C
from condensa.operators import centrality, graph, learn, matrix, report, stats
from condensa.plans.catalogue import CONCEPTS, DISTINCT, DOCS, LANGS, STOP, grams, groups, query, sents, text_graphs, toks
from condensa.sources.place import fresh, kept
from condensa.streaming.corpus import GrowingCorpus

# ---- scores: a made-up score of each document, by its numbers ------------
SCORES = "s AS (SELECT source, lang, doc_id % 5 AS lam, doc_id % 3 AS round, (doc_id % 7) / 8.0 AS r1, (doc_id % 11) / 16.0 AS r2 FROM documents)"


def scores(t) -> DataFrame:
    n = F.col("doc_id")
    return t("documents").select("source", "lang", (n % 5).alias("lam"), (n % 3).alias("round"), (n % 7 / 8).alias("r1"), (n % 11 / 16).alias("r2"))


_MAX = "UNION ALL SELECT 'max', max(r1), max(r2) FROM m"


@query(f"WITH {SCORES}, m AS (SELECT CAST(lam AS VARCHAR) AS lam, avg(r1) AS r1, avg(r2) AS r2 FROM s GROUP BY ALL) SELECT * FROM m {_MAX}")
def sweep_table(spark, t):
    return report.sweep_table(scores(t), "lam", ["r1", "r2"])


@query(f"WITH {SCORES}, m AS (SELECT lang AS method, avg(r1) AS r1, avg(r2) AS r2 FROM s WHERE lang IN ('de', 'en') GROUP BY ALL) SELECT * FROM m {_MAX}")
def combined_models(spark, t):
    return report.combined_models({x: scores(t).where(F.col("lang") == x) for x in ("de", "en")}, ["r1", "r2"])


@query(f"WITH {SCORES} SELECT lang, lam, avg(r1) AS r1, avg(r2) AS r2 FROM s WHERE round = 1 GROUP BY ALL")
def score_curve(spark, t):
    return report.curve(scores(t), "lam", ["lang"], ["r1", "r2"], {"round": 1})


@query(f"WITH {SCORES}, o AS (SELECT source, lang, lam, round, avg(r1) AS r1, avg(r2) AS r2 FROM s WHERE lang <> 'fr' GROUP BY ALL), g AS (SELECT DISTINCT source, lang FROM s) SELECT source, lang, coalesce(r1, 0) AS r1, coalesce(r2, 0) AS r2 FROM g LEFT JOIN (SELECT source, lang, arg_max(r1, round) AS r1, arg_max(r2, round) AS r2 FROM o WHERE lam = 1 GROUP BY ALL) USING (source, lang)")
def last_round_scores(spark, t):
    rounds = scores(t).where("lang <> 'fr'").groupBy("source", "lang", "lam", "round").agg(F.avg("r1").alias("r1"), F.avg("r2").alias("r2")).where("lam = 1")
    return report.last_round_scores(rounds, scores(t), ["source", "lang"], ["r1", "r2"])


@query(f"WITH {SCORES} SELECT source, avg(r1) FILTER (lam = 0) AS \"0\", avg(r1) FILTER (lam = 1) AS \"1\", avg(r1) FILTER (lam = 4) AS \"4\" FROM s GROUP BY source")
def score_grid(spark, t):
    return report.grid_table(scores(t), "source", "lam", "r1", [0, 1, 4])


@query("SELECT unnest(['ilp_30_0.5', 'ilp_30_1.0', 'ilp_20_0.5', 'ilp_20_1.0', 'mc_30_0.5', 'mc_30_1.0', 'mc_20_0.5', 'mc_20_1.0']) AS name")
def model_names(spark, t):
    return report.model_names(spark, model=["ilp", "mc"], words=[30, 20], lam=[0.5, 1.0])


@query(f"""WITH p AS (SELECT source, lang, s AS phrase, count(*) AS freq FROM (SELECT source, lang, unnest({sents('text')}) AS s FROM documents) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY freq DESC, phrase) AS k FROM p), q AS (SELECT unnest([1, 3]) AS most) SELECT most, source, lang, k::INTEGER AS rnk, phrase FROM r JOIN q ON k <= most""")
def summary_sweep(spark, t):
    """Summaries of one and of three phrases from one ranking."""
    grid = report.parameter_grid(spark, most=[1, 3])
    ranked = C.top(C.phrases(C.responses(t("documents")), "sentence"), 3, "freq", "phrase")
    return groups(report.swept(ranked, grid).where("rnk <= most").select("most", *C.GROUP, "rnk", "phrase"))


@query(f"""WITH p AS (SELECT source, lang, doc_id, doc_id % 2 AS sys, {sents('text')} AS ss FROM documents), e AS (SELECT source, lang, sys, doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS place FROM p),
x AS (SELECT source, lang, sys, string_agg(s, ';' ORDER BY doc_id, place, s) AS s FROM e GROUP BY ALL)
SELECT source, {", ".join(f"coalesce(max(s) FILTER (lang = '{x}' AND sys = {k}), '') AS \"{x}:{k}\"" for x in LANGS for k in (0, 1))} FROM x GROUP BY source""")
def side_by_side(spark, t):
    """Sentences of two systems' documents beside each other, in all languages."""
    n = F.col("doc_id")
    held = t("documents").select("source", F.col("lang").alias("prompt"), (n % 2).cast("string").alias("system"), n.alias("doc"), F.posexplode(T.sentences(F.col("text"))).alias("at", "line"))
    return report.side_by_side(held.withColumn("pos", F.struct("doc", "at")), "source", LANGS, ["0", "1"])


@query(f"""WITH {DISTINCT}, k AS (SELECT source, lang, concept FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY theta DESC, concept) AS i FROM theta) WHERE i <= 10),
q AS (SELECT source, lang, concept, CASE WHEN length(concept) % 5 = 4 THEN 'a' ELSE CAST(length(concept) % 4 AS VARCHAR) END AS code FROM theta WHERE length(concept) % 3 > 0)
SELECT source, lang, coalesce(sum(CASE WHEN code <> 'a' THEN CAST(code AS DOUBLE) END), 0) AS quality FROM k LEFT JOIN q USING (source, lang, concept) GROUP BY ALL""")
def quality_sum(spark, t):
    """A code from 0 to 3, or `a`, for most concepts, by their length."""
    theta, n = C.theta_distinct(C.responses(t("documents"))), F.length("phrase")
    coded = theta.withColumnRenamed("concept", "phrase").where(n % 3 > 0).select(*C.GROUP, "phrase", F.when(n % 5 == 4, "a").otherwise((n % 4).cast("string")).alias("code"))
    return groups(report.quality_sum(C.top(theta, 10).withColumnRenamed("concept", "phrase"), coded, C.GROUP))


# ---- references ----------------------------------------------------------
def references(t) -> DataFrame:
    return t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.col("item_id").alias("ref_id"), "text")


OVERLAP = f"""r AS (SELECT DISTINCT 'src' || CAST(item_id % 20 AS VARCHAR) AS source, unnest({grams(toks('text'), 2)}) AS gram FROM benchmark), {DOCS}, c AS (SELECT DISTINCT source, unnest({grams('t', 2)}) AS gram FROM d),
o AS (SELECT source, count(*) AS total, count(c.gram) AS covered, count(c.gram) / count(*) AS overlap FROM r LEFT JOIN c USING (source, gram) GROUP BY source)"""


@query(f"WITH {OVERLAP} SELECT * FROM o")
def topic_overlap(spark, t):
    return report.overlap_of_references(t("documents"), references(t), "source")


@query(f"WITH {OVERLAP} SELECT '{{' || string_agg('\"' || source || '\":' || CAST(covered AS VARCHAR), ',' ORDER BY source) || '}}' AS line FROM o")
def overlap_json(spark, t):
    """The covered bigrams of all topics as one JSON object."""
    found = report.overlap_of_references(t("documents"), references(t), "source")
    return found.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "covered"))))).alias("line"))


@query(f"WITH {OVERLAP}, {SCORES} SELECT o.source, overlap, one, two FROM o JOIN (SELECT source, avg(r1) AS one FROM s GROUP BY source) USING (source) JOIN (SELECT source, avg(r2) AS two FROM s GROUP BY source) USING (source)")
def joined_scores(spark, t):
    found = report.overlap_of_references(t("documents"), references(t), "source").select("source", "overlap")
    one, two = (scores(t).groupBy("source").agg(F.avg(c).alias("score")) for c in ("r1", "r2"))
    return report.joined_scores(found, one, two, "source")


@query("SELECT DISTINCT source FROM documents WHERE source IN (SELECT 'src' || CAST(item_id % 20 AS VARCHAR) FROM benchmark WHERE trim(text) <> '' AND item_id % 3 = 0)")
def with_reference(spark, t):
    return report.with_reference(t("documents").select("source").distinct(), references(t).where("ref_id % 3 = 0"), ["source"])


_NORMAL = "trim(regexp_replace(regexp_replace(trim({x}), '^[0-9]+\\)\\s*', ''), '\\s*\\[[0-9]+\\]$', ''))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), u AS (SELECT doc_id, 'text' AS prompt, pos, line FROM l UNION ALL SELECT doc_id, 'lang', 0, lang FROM documents)
SELECT doc_id, prompt, pos::INTEGER AS pos, {_NORMAL.format(x="line")} AS line FROM u WHERE {_NORMAL.format(x="line")} <> ''""")
def reference_rows(spark, t):
    return report.reference_rows(t("documents"), "doc_id", ["text", "lang"])


@query("SELECT item_id % 10 AS topic, item_id FROM benchmark")
def exact_models(spark, t):
    """Every topic, an item's number modulo ten, has as many references as the others; else the query fails."""
    rows = t("benchmark").select((F.col("item_id") % 10).alias("topic"), "item_id")
    return report.exact_models(rows, "topic", rows.count() // 10)


@query(f"""SELECT source, count(DISTINCT doc_id) AS students, count(DISTINCT CASE WHEN good THEN doc_id END) AS valid, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN doc_id END) AS men, count(DISTINCT CASE WHEN doc_id % 3 = 1 THEN doc_id END) AS women,
CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) AS BIGINT) AS responses, avg(CASE WHEN good THEN CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END END) AS one_sentence FROM
(SELECT *, NOT (lower(trim(text)) IN ('?', '[blank]', 'n/a', 'blank') OR trim(text) = '') AS good, len({sents('text')}) AS n FROM documents) GROUP BY source""")
def response_statistics(spark, t):
    n = F.col("doc_id")
    rows = t("documents").select("source", n.alias("student"), F.when(n % 3 == 0, "M").when(n % 3 == 1, "F").alias("gender"), "text")
    return report.response_statistics(rows, "source")


@query(f"""WITH {OVERLAP}, s AS (SELECT source, CAST(sum(len({sents('text')})) AS BIGINT) AS sentences, CAST(sum(len(t)) AS BIGINT) AS words FROM d GROUP BY source), w AS (SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS source, CAST(sum(len({toks('text')})) AS BIGINT) AS ref_words FROM benchmark GROUP BY ALL)
SELECT source, sentences, words, words / sentences AS words_per_sentence, ref_words, coalesce(total, 0) AS ref_bigrams, coalesce(covered, 0) AS covered FROM s JOIN w USING (source) LEFT JOIN o USING (source)""")
def full_statistics(spark, t):
    return report.full_statistics(t("documents"), references(t), "source")


# ---- words ---------------------------------------------------------------
TAGGED = "regexp_extract_all(lower(text), '<a.*?/a>|<[^>]*>|[\\p{L}\\p{N}_''@#]+')"
_DF = f"x AS (SELECT doc_id, {TAGGED} AS w FROM documents), f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM x) GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"


@query(f"WITH {_DF} SELECT term FROM f, n WHERE df >= 0.01 * n")
def derived_stop_words(spark, t):
    d = t("documents")
    return stats.derived_stop_words(stats.document_frequencies(d), d.count())


@query(f"""WITH {_DF}, c AS (SELECT doc_id, term, count(*) / any_value(len(w)) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM x) GROUP BY doc_id, term)
SELECT doc_id, term, tf * CASE WHEN df >= 0.2 * n THEN 0 ELSE ln((1.0 + n) / (1.0 + df)) END AS tfidf FROM c JOIN f USING (term), n""")
def keywords(spark, t):
    """Terms that a fifth of all documents have count nothing."""
    d = t("documents")
    n, df = d.count(), stats.document_frequencies(d)
    return stats.keywords(d, df, n, stats.derived_stop_words(df, n, 0.2))


@query(f"""WITH {DOCS}, p AS (SELECT source, bigram, count(*) AS n, string_split(bigram, ' ')[1] AS w1, string_split(bigram, ' ')[2] AS w2 FROM (SELECT source, unnest({grams('t', 2)}) AS bigram FROM d) GROUP BY ALL),
q AS (SELECT source, bigram, n, w1, w2, CAST(sum(n) OVER (PARTITION BY source, w1) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY source, w2) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS m FROM p),
s AS (SELECT *, round(2 * (n * ln(n / (a * b / m)) + CASE WHEN a > n THEN (a - n) * ln((a - n) / (a * (m - b) / m)) ELSE 0 END + CASE WHEN b > n THEN (b - n) * ln((b - n) / ((m - a) * b / m)) ELSE 0 END
+ CASE WHEN m - a - b + n > 0 THEN (m - a - b + n) * ln((m - a - b + n) / ((m - a) * (m - b) / m)) ELSE 0 END), 6) AS llr FROM q),
k AS (SELECT DISTINCT bigram FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY llr DESC, bigram) AS i FROM s WHERE n >= 2 AND length(w1) >= 3 AND length(w2) >= 3 AND NOT list_contains({STOP}, w1) AND NOT list_contains({STOP}, w2)) WHERE i <= 15),
i AS (SELECT bigram, (SELECT count(DISTINCT source) FROM s) / count(*) AS idf FROM s WHERE bigram IN (SELECT bigram FROM k) GROUP BY bigram) SELECT bigram, idf FROM i WHERE idf < (SELECT avg(idf) FROM i)""")
def domain_collocations(spark, t):
    return stats.domain_collocations(t("documents"), "source")


@query("""WITH x AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+'), lambda w: '<' || w || '>'), '') AS s FROM documents)
SELECT doc_id, trim(regexp_replace(hit, '[<>]+', ' ', 'g')) AS hit FROM (SELECT doc_id, unnest(regexp_extract_all(s, '<(?:the|der|la)><[a-z]+>')) AS hit FROM x)""")
def found_tokens(spark, t):
    return report.found_tokens(t("documents"), "<(?:the|der|la)><[a-z]+>")


@query(f"""WITH {DOCS}, x AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM d), c AS (SELECT DISTINCT w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS l, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM x)
SELECT a.w AS word, count(*) AS n FROM c a JOIN (SELECT * FROM c WHERE w = 'the') b ON a.l IS NOT DISTINCT FROM b.l AND a.r IS NOT DISTINCT FROM b.r WHERE a.w <> 'the' GROUP BY a.w ORDER BY n DESC, word LIMIT 20""")
def similar_words(spark, t):
    """The twenty words most like `the`: a top list."""
    rows = t("documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    return report.similar_words(rows, "the")


@query(f"WITH {CONCEPTS}, b AS (SELECT source, lang, concept, count(*) AS n FROM (SELECT source, lang, unnest(gs) AS concept FROM g WHERE doc_id % 10 = 0) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY concept) AS INTEGER) AS id FROM b")
def concept_bag(spark, t):
    """Every tenth document stands for a summary."""
    bag = report.concept_bag(C.responses(t("documents").where("doc_id % 10 = 0")), C.GROUP)
    return groups(bag.join(report.numbered_concepts(bag, C.GROUP), C.KEEP))


@query(f"""WITH {DOCS}, g AS (SELECT lang, source, unnest(t) AS w FROM d), c AS (SELECT lang, source, w, count(*) AS n FROM g WHERE NOT list_contains({STOP}, w) GROUP BY ALL), a AS (SELECT lang, source, sum(n) AS m FROM c GROUP BY ALL), f AS (SELECT lang, w, count(*) AS df FROM c GROUP BY ALL), k AS (SELECT lang, count(*) AS k FROM a GROUP BY lang)
SELECT source, lang, w AS concept, n / m * ln((1.0 + k) / (1.0 + df)) AS tfidf FROM c JOIN a USING (lang, source) JOIN f USING (lang, w) JOIN k USING (lang)""")
def prompt_tfidf(spark, t):
    """Each prompt is a corpus of its own, whose documents are its lectures."""
    return groups(C.tfidf(C.responses(t("documents")), 1, by_prompt=True).select(*C.KEEP, "tfidf"))


# ---- clusters and matrices -----------------------------------------------
MEMBERS = f"""m AS (SELECT lang, source AS cluster, doc_id AS student, length(text) AS score, s AS phrase FROM (SELECT *, {sents('text')}[1] AS s FROM documents) WHERE s IS NOT NULL)"""


def members(t) -> DataFrame:
    first = F.get(T.sentences(F.col("text")), F.lit(0))
    return t("documents").select("lang", F.col("source").alias("cluster"), F.col("doc_id").alias("student"), F.length("text").alias("score"), first.alias("phrase")).where("phrase IS NOT NULL")


RANKED = f"{MEMBERS}, k AS (SELECT lang, cluster, count(DISTINCT student) AS students, max(score) AS best FROM m GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY students DESC, best DESC, cluster) AS INTEGER) AS rnk FROM k)"


@query(f"WITH {RANKED} SELECT * FROM r")
def cluster_ranking(spark, t):
    return stats.cluster_ranking(members(t))


@query(f"""WITH {RANKED}, b AS (SELECT lang, cluster, phrase, max(score) AS score FROM m GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY lang, cluster ORDER BY score DESC, phrase) AS i FROM b)
SELECT lang, rnk, cluster, students, string_agg(phrase, ';' ORDER BY i) AS phrases FROM r JOIN (SELECT * FROM x WHERE i <= 3) USING (lang, cluster) GROUP BY ALL""")
def cluster_report(spark, t):
    return stats.cluster_report(members(t))


_CELLS = "c AS (SELECT label, CAST(vec_id AS VARCHAR) AS concept, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def cells(t) -> DataFrame:
    """The embeddings' components as a completed matrix: a concept for each vector, a column for each dimension."""
    return t("embeddings").select("label", F.col("vec_id").cast("string").alias("concept"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_CELLS}, l AS (SELECT DISTINCT label, pos, 'p' || CAST(pos % 40 AS VARCHAR) AS phrase FROM c), f AS (SELECT label, phrase, min(pos) AS pos FROM l GROUP BY ALL), p AS (SELECT DISTINCT label, 'p' || CAST(pos AS VARCHAR) AS phrase FROM c WHERE pos < 50) SELECT label, phrase, concept, value FROM p JOIN f USING (label, phrase) JOIN c USING (label, pos) WHERE value >= 0.05 AND CAST(concept AS BIGINT) % 3 > 0")
def completed_incidence(spark, t):
    c = cells(t)
    at = c.select("label", "pos").distinct()
    listed = at.select("label", "pos", F.concat(F.lit("p"), (F.col("pos") % 40).cast("string")).alias("phrase"))
    asked = at.where("pos < 50").select("label", F.concat(F.lit("p"), F.col("pos").cast("string")).alias("phrase"))
    return report.completed_incidence(asked, listed, c, ["label"], 0.05, c.where(F.col("concept").cast("long") % 3 > 0))


@query(f"WITH {_CELLS} SELECT CAST(pos % 4 AS BIGINT) AS slice, label, concept, pos // 4 AS pos, value FROM c")
def group_slice(spark, t):
    at = spark.range(64).select(F.col("id").cast("int").alias("pos"), (F.col("id") % 4).alias("slice"), F.floor(F.col("id") / 4).cast("int").alias("at"))
    return report.group_slice(cells(t), at).select("slice", "label", "concept", "pos", "value")


@query(f"WITH {_CELLS} SELECT label, unnest([0.0::DOUBLE, 0.05::DOUBLE, 0.2::DOUBLE]) AS eps, unnest([avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN value >= 0.05 THEN 1.0 ELSE 0 END), avg(CASE WHEN value >= 0.2 THEN 1.0 ELSE 0 END)]) AS ratio FROM c GROUP BY label")
def share_of_large(spark, t):
    return report.share_of_large(cells(t), ["label"], [0.0, 0.05, 0.2])


@query("WITH l AS (SELECT 'm' || CAST(label AS VARCHAR) AS name, (vec_id % 15 + 1) / 2.0 AS lam, (vec_id * 7 % 23) / 4.0 AS error FROM embeddings) SELECT name, arg_min(lam, (error, lam)) AS lam, min(error) AS error FROM l GROUP BY name")
def best_penalty(spark, t):
    n = F.col("vec_id")
    line = F.concat(F.lit("m"), F.col("label").cast("string"), F.lit(" lambda: "), ((n % 15 + 1) / 2).cast("string"), F.lit(" error: "), (n * 7 % 23 / 4).cast("string"))
    return report.best_penalty(t("embeddings").select(line.alias("line")))


@query()
def k_means(spark, t):
    return matrix.k_means(t("embeddings"), "vec_id", "embedding", 10)


@query()
def cluster_groups(spark, t):
    """Concepts of each group's ten heaviest phrases, by how many words they share."""
    top = C.top(C.theta_distinct(C.responses(t("documents"))), 30).select(*C.GROUP, "concept")
    a, b = top.withColumnRenamed("concept", "a"), top.withColumnRenamed("concept", "b")
    shared = F.size(F.array_intersect(F.split("a", " "), F.split("b", " "))).cast("double")
    return groups(matrix.cluster_groups(a.join(b, C.GROUP).where("a < b").withColumn("similarity", shared), C.GROUP, restarts=20))


@query()
def soft_impute_path(spark, t):
    v = F.transform("embedding", lambda x: F.when(F.abs(x) >= 0.02, x.cast("double")).otherwise(F.lit(float("nan"))))
    return matrix.soft_impute_path(t("embeddings").select("vec_id", "label", v.alias("v")), "vec_id", "label", "v", [2.0, 1.0], report.rank_cap, 5)


# ---- learners ------------------------------------------------------------
@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.label, a.vec_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM v a JOIN v b ON a.label = b.label AND b.vec_id % 7 = 0 WHERE a.vec_id % 7 <> 0)
SELECT label, CAST(vec_id AS VARCHAR) AS concept, greatest(-1.0, max(c)) AS ratio, CASE WHEN greatest(-1.0, max(c)) > 0.5 THEN 1 ELSE 0 END AS moved FROM p GROUP BY ALL""")
def similarity_update(spark, t):
    """Vectors with a number divisible by seven stand for a label's references."""
    rows = t("embeddings").select("label", F.col("vec_id").cast("string").alias("concept"), (F.col("vec_id") % 7 == 0).alias("ref"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    found = learn.similarity_update(rows.where("NOT ref"), rows.where("ref"), rows.select("concept", "vector"), "label")
    return found.select("label", "concept", "ratio", (F.col("ratio").between(-0.5, 0.5) == F.lit(False)).cast("int").alias("moved"))


_VECTORS = f"{DOCS}, x AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS v FROM (SELECT doc_id, unnest(t) AS w FROM d) GROUP BY ALL)"


@query(f"WITH {_VECTORS} SELECT doc_id, count(*) AS l0, sum(v) AS l1, sqrt(sum(v * v)) AS l2, max(v) AS most FROM x GROUP BY doc_id")
def vector_norms(spark, t):
    rows = stats.bag_of_words(t("documents")).select("doc", F.col("term").alias("feature"), F.col("n").cast("double").alias("value"))
    return learn.vector_norms(rows, "doc").withColumnRenamed("doc", "doc_id")


@query(f"WITH {_VECTORS}, s AS (SELECT doc_id, sqrt(sum(v * v)) AS l2 FROM x GROUP BY doc_id) SELECT doc_id, w AS feature, v / l2 AS value FROM x JOIN s USING (doc_id) WHERE v / l2 >= 0.1 AND w IN (SELECT unnest({toks('text')}) FROM benchmark)")
def vector_algebra(spark, t):
    """Normalized word counts, cut off at a tenth, of the references' words."""
    rows = stats.bag_of_words(t("documents")).select("doc", F.col("term").alias("feature"), F.col("n").cast("double").alias("value"))
    kept = learn.vector_cutoff(learn.vector_normalize(rows, "doc"), 0.1)
    return learn.vector_slice(kept, stats.corpus_words(t("benchmark")).select(F.col("word").alias("feature"))).withColumnRenamed("doc", "doc_id")


# ---- graphs --------------------------------------------------------------
@query("""WITH n AS (SELECT n_regionkey AS g, n_nationkey AS id, 1 + n_nationkey % 3 AS freq, n_nationkey % 20 AS line, 1 + n_nationkey % 6 AS span, 'c' || CAST(n_nationkey AS VARCHAR) AS c FROM nation)
SELECT g, id, unnest(list_filter([CASE WHEN true THEN 'bias' END, CASE WHEN freq > 0 THEN 'freq/0' END, CASE WHEN freq > 1 THEN 'freq/1' END, CASE WHEN freq > 2 THEN 'freq/2' END, CASE WHEN line <= 5 THEN 'position/5' END, CASE WHEN line <= 6 THEN 'position/6' END, CASE WHEN line <= 7 THEN 'position/7' END, CASE WHEN line <= 10 THEN 'position/10' END, CASE WHEN line <= 15 THEN 'position/15' END,
CASE WHEN span > 1 THEN 'span/avg/1' END, CASE WHEN span > 2 THEN 'span/avg/2' END, CASE WHEN span > 3 THEN 'span/avg/3' END, CASE WHEN span > 4 THEN 'span/avg/4' END, CASE WHEN span > 5 THEN 'span/avg/5' END, 'concept/' || c], lambda f: f IS NOT NULL)) AS feature FROM n""")
def graph_node_features(spark, t):
    k = F.col("n_nationkey")
    source = F.struct((k % 20).alias("line_num"), F.lit(0).alias("start_idx"), (1 + k % 6).alias("end_idx"))
    nodes = t("nation").select(F.col("n_regionkey").alias("g"), k.alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("concept"), F.array_repeat(source, (1 + k % 3).cast("int")).alias("sources"))
    return graph.node_features(nodes)


@query()
def graph_decode(spark, t):
    """Items decoded under weights that a gold choice, the words no document lacks, would teach: the share of gold nodes with a feature, less a half."""
    nodes, edges = text_graphs(t)
    feats = graph.node_features(nodes).withColumnRenamed("id", "node")
    words = t("documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("concept")).distinct()
    gold = nodes.join(words, "concept", "left_semi").select("g", F.col("id").alias("node"))
    roots = nodes.select("g", F.col("id").alias("node"), F.exists("sources", lambda s: s["start_idx"] == 0).alias("root"))
    held = feats.join(gold.withColumn("good", F.lit(1.0)), ["g", "node"], "left")
    weights = held.groupBy("feature").agg(F.round(F.avg(F.coalesce("good", F.lit(0.0))) - 0.5, 6).alias("w"))
    links = graph.edge_features(edges)
    told = weights.unionByName(links.select("feature").distinct().select(F.concat(F.lit("edge/"), "feature").alias("feature"), F.lit(-0.05).alias("w")))
    return graph.decode(feats.join(roots, ["g", "node"]), graph.with_tag(links, "edge"), told, gold, 0.5)


@query(f"""WITH {_DF}, c AS (SELECT doc_id, term, count(*) / any_value(len(w)) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM x) GROUP BY doc_id, term)
SELECT doc_id, term, tf * CASE WHEN df >= 0.2 * n THEN 0 ELSE ln((1.0 + n) / (1.0 + df)) END AS tfidf FROM c JOIN f USING (term), n""")
def growing_keywords(spark, t):
    """The documents arrive in files; each batch of a stream adds to the corpus, one comes twice, and the first ones are compacted."""
    docs, path = t("documents"), fresh(spark, "arriving")
    docs.select("doc_id", "text").repartition(4, "doc_id").write.parquet(path)
    corpus = GrowingCorpus(spark, fresh(spark, "corpus"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(path)
    corpus.follow(stream, fresh(spark, "progress")).awaitTermination()
    corpus.compact()
    return corpus.keywords(docs, 0.2)


# ---- central sentences ---------------------------------------------------
def _ranked(t) -> tuple[DataFrame, DataFrame]:
    """Sentences of each source and language, their ranks by similarity, and the similar pairs."""
    units = t("documents").select("source", "lang", F.explode(F.array_distinct(T.sentences(F.col("text")))).alias("text")).distinct().withColumn("id", F.col("text"))
    by = ["source", "lang"]
    weights = kept(centrality.term_weights(units, by), "weights")
    pairs = kept(centrality.similar(weights, by, 0.2), "pairs")
    return centrality.lexrank(units, pairs, by, tol=1e-4), pairs


@query()
def lexrank(spark, t):
    """Ranks of all sentences of a group by their likeness to others."""
    ranks, _ = _ranked(t)
    return ranks.select("source", "lang", F.col("id").alias("sentence"), F.round("rank", 9).alias("rank"))


@query()
def lexrank_mmr(spark, t):
    """Five sentences of each group that are central and unlike each other."""
    ranks, pairs = _ranked(t)
    return centrality.mmr(ranks, pairs, ["source", "lang"], 5).withColumnRenamed("id", "sentence")
