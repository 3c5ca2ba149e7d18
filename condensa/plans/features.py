"""Queries of concept features, incidence options, text functions and parsed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions.stem import stem_table
from condensa.operators import concepts as C
from condensa.operators import punkt
from condensa.operators import match, parse, solver, stats
from condensa.plans.catalogue import AVE, CONCEPTS, DISTINCT, DOCS, PUNCT, STOP, TF, features, grams, groups, nonstop, query, sents, toks, words

REFS = f"SELECT DISTINCT 'src' || CAST(item_id % 20 AS VARCHAR) AS source, unnest({nonstop(grams(toks('text'), 2))}) AS concept FROM benchmark"
TFIDF = f"""{TF}, n AS (SELECT source, lang, sum(theta) AS n FROM theta GROUP BY ALL), f AS (SELECT concept, count(*) AS df FROM theta GROUP BY concept),
tfidf AS (SELECT theta.source, theta.lang, theta.concept, theta / n * ln((1.0 + (SELECT count(*) FROM n)) / (1.0 + df)) AS tfidf FROM theta JOIN n ON n.source = theta.source AND n.lang = theta.lang JOIN f ON f.concept = theta.concept)"""


def refs(t) -> DataFrame:
    """Reference bigrams by lecture: src0 to src19, item_id modulo 20."""
    rows = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("lecture"), "text")
    return T.gram_rows(rows, ["lecture"]).distinct()


def resp(t) -> DataFrame:
    return C.responses(t("documents"))


# ---- features ------------------------------------------------------------
_LIMITS = ("0.05", "0.02", "0.01")


@query(f"WITH {TFIDF} " + features("tfidf", [(f"tfidf>{x}", f"tfidf > {x}") for x in _LIMITS] + [(f"tfidf<={x}", f"tfidf <= {x}") for x in _LIMITS]))
def feature_tfidf(spark, t):
    return groups(C.tfidf_features(C.tfidf(resp(t))))


@query(f"WITH {TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY round(tfidf, 9) DESC, concept) AS k FROM tfidf) " + features("r", [("tfidf_rank<5", "k <= 5"), ("tfidf_rank<10", "k <= 10")]))
def feature_tfidf_rank(spark, t):
    weights = C.tfidf(resp(t)).withColumn("tfidf", F.round("tfidf", 9))
    return groups(C.rank_features(weights, "tfidf_rank", "tfidf"))


@query(f"WITH {AVE}, r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY ave DESC, concept) - 1 AS i FROM a) " + features("r", [(f"ave_sen_length_rank<={j}", f"i <= {j}") for j in range(10)] + [(f"ave_sen_length_rank>{j}", f"i > {j}") for j in range(10)]))
def feature_len_rank(spark, t):
    return groups(C.length_rank_features(C.average_length(resp(t))))


_W = "string_split(concept, ' ')"
_MARKS = f"list_concat({STOP}, {PUNCT})"


@query(f"""WITH {TF}, v AS (SELECT list(DISTINCT word) AS vs FROM (SELECT unnest({toks('text')}) AS word FROM benchmark)), k AS (SELECT source, lang, concept, len(list_filter({_W}, lambda w: list_contains(vs, w))) / len({_W}) AS known, {_W} AS w FROM theta, v) """
+ features("k", [("stop_first=True", f"len(w) = 2 AND list_contains({_MARKS}, w[1])"), ("stop_second=True", f"len(w) = 2 AND list_contains({_MARKS}, w[2])"), ("ngram=1", "len(w) = 1"), ("ngram=2", "len(w) = 2"), ("word_ratio<=0.5", "1 - known <= 0.5"), ("word_ratio>0.5", "1 - known > 0.5")]))
def feature_words(spark, t):
    return groups(C.word_features(C.theta_tf(resp(t)), resp(t), stats.corpus_words(t("benchmark"))))


@query(f"WITH {TF}, r AS ({REFS}), h AS (SELECT theta.*, (source, concept) IN (SELECT (source, concept) FROM r) AS hit FROM theta) " + features("h", [("in_title_Yes", "hit"), ("in_title_No", "NOT hit")]))
def feature_title(spark, t):
    """The references of a source stand for its titles."""
    titles = t("benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("lecture"), "text")
    return groups(C.membership_features(C.theta_tf(resp(t)), C.title_concepts(titles, ["lecture"]), "in_title", ["lecture"]))


@query(f"WITH {TF} SELECT source, lang, concept, 'one' AS feature, 1.0::DOUBLE AS value FROM theta UNION ALL SELECT source, lang, concept, 'tf', theta FROM theta")
def feature_constant(spark, t):
    theta = C.theta_tf(resp(t))
    return groups(C.constant_features(theta).unionByName(C.constant_features(theta, raw=True)))


@query(f"""WITH {DOCS},
y AS (SELECT source, lang, doc_id, unnest(t) AS a, unnest(t[2:]) AS b FROM d),
theta AS (SELECT source, lang, a || ' ' || b AS concept, count(*) AS theta FROM y WHERE b IS NOT NULL AND NOT (list_contains({STOP}, a) AND list_contains({STOP}, b)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY theta DESC, concept) AS k FROM theta)
SELECT source, lang, concept, 'ngram=2' AS feature, 1.0::DOUBLE AS value FROM r UNION ALL SELECT source, lang, concept, 'tf_rank<5', 1.0 FROM r WHERE k <= 5 UNION ALL SELECT source, lang, concept, 'tf_rank<10', 1.0 FROM r WHERE k <= 10""")
def feature_selected(spark, t):
    """Two of three kinds of features are asked for."""
    theta = C.theta_tf(resp(t))
    every = C.merged_features(C.tf_features(theta), C.rank_features(theta), C.word_features(theta, resp(t), stats.corpus_words(t("benchmark"))))
    return groups(C.select_features(every, ["tf_rank", "ngram"]))


@query()
def feature_word_freq_stemmed(spark, t):
    theta = C.theta_tf(resp(t))
    vocabulary = theta.select(F.explode(F.split("concept", " ")).alias("word")).distinct()
    return groups(C.word_frequency_features(theta, resp(t), stem_table(vocabulary, "word")))


@query(f"WITH {TF}, r AS ({REFS}), x AS (SELECT source, lang, concept, unnest(list_filter([CASE WHEN theta > 1 THEN 'term_freq>=1' END, CASE WHEN theta > 2 THEN 'term_freq>=2' END, CASE WHEN theta > 5 THEN 'term_freq>=5' END, CASE WHEN theta <= 2 THEN 'term_freq<=2' END, CASE WHEN theta <= 5 THEN 'term_freq<=5' END], lambda f: f IS NOT NULL)) AS feature FROM theta) SELECT feature, concept IN (SELECT concept FROM r) AS in_reference, count(*) AS n FROM x GROUP BY ALL")
def feature_split(spark, t):
    return stats.feature_split(C.tf_features(C.theta_tf(resp(t))), refs(t).select("concept"))


# ---- incidence -----------------------------------------------------------
PHRASES = f"p AS (SELECT source, lang, s AS phrase, count(*) AS freq FROM (SELECT source, lang, unnest({sents('text')}) AS s FROM documents) GROUP BY ALL)"


@query(f"WITH {PHRASES}, r AS ({REFS}), c AS (SELECT source, lang, phrase, unnest({nonstop(grams(toks('phrase'), 2))}) AS concept FROM p) SELECT source, lang, phrase, concept, count(*) AS occ FROM c WHERE concept IN (SELECT concept FROM r) GROUP BY ALL")
def incidence_whitelist(spark, t):
    units = C.phrases(resp(t), "sentence").select(*C.GROUP, "phrase")
    return groups(C.incidence(units, whitelist=refs(t)))


@query()
def incidence_stemmed(spark, t):
    units = C.phrases(resp(t), "sentence").select(*C.GROUP, "phrase")
    return groups(C.incidence(units, stemmed=True, malformed=False))


@query(f"WITH {PHRASES} SELECT source, lang, phrase, freq, {words('phrase')} AS n_words FROM p")
def counted_phrases(spark, t):
    """Phrases with their counts, which every phrase must have."""
    counts = C.phrases(resp(t), "sentence")
    told = C.counted_phrases(counts.select(*C.GROUP, "phrase"), counts)
    return groups(told.withColumn("n_words", T.word_count(F.col("phrase")).cast("long")))


@query(f"WITH {CONCEPTS}, c AS (SELECT DISTINCT doc_id, unnest(gs) AS concept FROM g) SELECT concept, list_sort(list(doc_id)) AS units FROM c GROUP BY concept")
def inverted_concepts(spark, t):
    return C.invert(T.gram_rows(t("documents"), ["doc_id"], distinct=True), "doc_id")


@query(f"WITH {CONCEPTS}, c AS (SELECT source, lang, doc_id, unnest(gs) AS concept FROM g), o AS (SELECT source, lang, doc_id, concept, count(*) AS occ FROM c GROUP BY ALL) SELECT source, lang, doc_id, sum(occ) / 2 AS length FROM o GROUP BY ALL")
def concept_mass(spark, t):
    cells = T.gram_rows(resp(t), [*C.GROUP, F.col("student").alias("phrase")]).groupBy(*C.GROUP, "phrase", "concept").agg(F.count("*").alias("value"))
    return groups(C.concept_mass(cells, C.GROUP)).withColumnRenamed("phrase", "doc_id")


@query(f"WITH {DOCS}, g AS (SELECT DISTINCT lang, unnest(list_concat({grams('t', 1)}, {grams('t', 2)})) AS ngram FROM d) SELECT lang, ngram, CAST(len(string_split(ngram, ' ')) AS INTEGER) AS n FROM g")
def distinct_ngrams(spark, t):
    toks_ = T.tokens(F.col("text"))
    rows = t("documents").select("lang", F.explode(F.array_distinct(F.flatten(F.array(T.gram_array(toks_, 1), T.gram_array(toks_, 2))))).alias("ngram")).where("ngram IS NOT NULL").distinct()
    return rows.withColumn("n", F.size(F.split("ngram", " ")))


@query(f"""WITH v AS (SELECT DISTINCT unnest({toks('text')}) AS w FROM benchmark), {DOCS}, g AS (SELECT DISTINCT unnest(list_concat({grams('t', 1)}, {grams('t', 2)})) AS gram FROM d)
SELECT CAST(len(string_split(gram, ' ')) AS BIGINT) AS n, gram IN (SELECT w FROM v) AS found, count(*) AS k FROM g GROUP BY ALL""")
def vector_coverage(spark, t):
    grams_ = distinct_rows(t)
    return stats.found_counts(grams_, t("benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word")))


def distinct_rows(t) -> DataFrame:
    toks_ = T.tokens(F.col("text"))
    return t("documents").select(F.explode(F.array_distinct(F.flatten(F.array(T.gram_array(toks_, 1), T.gram_array(toks_, 2))))).alias("gram")).where("gram IS NOT NULL").distinct()


# ---- text functions ------------------------------------------------------
_WP = "regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+')"


@query(f"""SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '<a.*?/a>|<[^>]*>|[\\p{{L}}\\p{{N}}_''@#]+'), ' ') AS tagged,
array_to_string(list_filter({toks('text')}, lambda w: NOT list_contains({STOP}, w) AND NOT list_contains({PUNCT}, w)), ' ') AS bare,
array_to_string(list_transform({toks('text')}, lambda w: CASE WHEN list_contains(['the', 'der', 'le'], w) THEN 'ddd' ELSE w END), ' ') AS masked,
regexp_replace(translate(text, '‘’“”–—' || chr(160), '''''""-- '), '[^\\x00-\\x7F]', '', 'g') AS ascii FROM documents""")
def text_cleaning(spark, t):
    x, w = F.col("text"), T.tokens(F.col("text"))
    ascii_ = T.ascii_only(x)
    return t("documents").select("doc_id", F.array_join(T.tagged_tokens(x), " ").alias("tagged"), F.array_join(T.drop_stop_tokens(w), " ").alias("bare"), F.array_join(T.mask_words(w, ["the", "der", "le"]), " ").alias("masked"), ascii_.alias("ascii"))


@query(f"""WITH b AS (SELECT list(DISTINCT w) AS ws FROM (SELECT unnest({toks('text')}) AS w FROM benchmark)), {DOCS}
SELECT doc_id, CAST(len(list_filter(t, lambda w: list_contains(ws, w))) AS INTEGER) AS shared, CASE WHEN len(t) > 0 THEN 1 - len(list_filter(t, lambda w: list_contains(ws, w))) / len(t) END AS outside,
round(len(list_filter(t, lambda w: list_contains(ws, w))) / (len(t) + 1e-5), 9) AS share, contains(lower(text), 'license') AS keyword FROM d, b""")
def lexicon_overlap(spark, t):
    lexicon = t("benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    docs = t("documents").select("doc_id", "text", T.contains_ignoring_case(F.col("text"), F.lit("LICENSE")).alias("keyword"))
    return stats.lexicon_overlap(docs, lexicon).select("doc_id", "shared", "outside", F.round("share", 9).alias("share"), "keyword")


@query(f"""SELECT item_id, replace(lower(array_to_string({_WP.format(x="regexp_replace(trim(text), '[!-/:-@\\[-`{-~]$', '')")}, ' ')), ' '' s', ' ''s') AS human,
regexp_replace(text, '``|''''|[“”„]', '"', 'g') AS quotes FROM benchmark""")
def text_normalizing(spark, t):
    return t("benchmark").select("item_id", T.normalize_human(F.col("text")).alias("human"), T.plain_quotes(F.col("text")).alias("quotes"))


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1) AS ps FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(ps, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM p""")
def joined_paragraphs(spark, t):
    return t("pages").select("page_id", T.joined_paragraphs(F.col("html")).alias("text"))


@query(f"""WITH {DOCS}, z AS (SELECT doc_id, unnest({grams('t', 2)}) AS gram, unnest({grams('list_transform(t, lambda w: CAST(length(w) % 3 AS VARCHAR))', 2)}) AS tag FROM d) SELECT gram, tag, count(*) AS n FROM z GROUP BY ALL""")
def tagged_ngrams(spark, t):
    w = T.tokens(F.col("text"))
    pairs = T.tagged_ngrams(w, F.transform(w, lambda x: (F.length(x) % 3).cast("string")), 2)
    return t("documents").select(F.explode(pairs).alias("x")).groupBy(F.col("x.gram").alias("gram"), F.col("x.tag").alias("tag")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOCS}, z AS (SELECT doc_id, unnest(list_transform(t, lambda w: substr(w, 1, 3))) AS stem, t, unnest(range(len(t))) AS i FROM d) SELECT doc_id, stem, arg_min(t[i + 1], i) AS form FROM z GROUP BY ALL""")
def surface_forms(spark, t):
    """The first word of each three-letter beginning stands for its stem."""
    w = T.tokens(F.col("text"))
    at = t("documents").select("doc_id", F.posexplode(w).alias("i", "w")).withColumn("stem", F.substring("w", 1, 3))
    return at.groupBy("doc_id", "stem").agg(F.min_by("w", "i").alias("form"))


@query("""WITH k AS (SELECT page_id, url, CAST(page_id % 50 AS VARCHAR) AS key FROM pages) SELECT page_id, CASE WHEN regexp_matches(url, key || '$') THEN url END AS name FROM k""")
def matched_names(spark, t):
    return t("pages").select("page_id", T.matching_name((F.col("page_id") % 50).cast("string"), F.array("url"), "", "$").alias("name"))


# ---- parsed tokens -------------------------------------------------------
# Made from the benchmark: tags by word length, chunks and phrases of three words, one word between them.
TOKENS = f"""k AS (SELECT item_id AS sent_id, unnest({toks('text')}) AS token, unnest(range(len({toks('text')}))) AS i FROM benchmark),
k2 AS (SELECT *, ['NN', 'JJ', 'VB'][length(token) % 3 + 1] AS pos, i // 4 AS c, i % 4 AS m FROM k)"""


def parsed(t) -> DataFrame:
    rows = t("benchmark").select(F.lit("").alias("lecture"), F.lit("").alias("prompt"), F.col("item_id").alias("sent_id"), F.posexplode(T.tokens(F.col("text"))).alias("tok_id", "token"))
    pick = lambda *x: F.array(*(F.lit(v) for v in x))
    m = F.col("tok_id") % 4
    return rows.select("*", F.get(pick("NN", "JJ", "VB"), F.length("token") % 3).alias("pos"), F.get(pick("B-NP", "I-NP", "E-NP", "O"), m).alias("chk"), F.get(pick("(NP*", "*", "*)", "*"), m).alias("psg"))


@query(f"WITH {TOKENS} SELECT sent_id, c + 1 AS chunk, 'NP' AS tag, string_agg(token, ' ' ORDER BY i) AS phrase FROM k2 WHERE m < 3 GROUP BY sent_id, c")
def parsed_chunks(spark, t):
    return parse.chunks(parsed(t)).drop("lecture", "prompt")


@query(f"WITH {TOKENS} SELECT sent_id, string_agg(token, ' ' ORDER BY i) AS phrase, string_agg(pos, ' ' ORDER BY i) AS tags FROM k2 WHERE m < 3 GROUP BY sent_id, c HAVING count(*) = 3")
def parsed_phrases(spark, t):
    return parse.paired_phrases(parsed(t)).drop("lecture", "prompt")


@query(f"WITH {TOKENS}, n AS (SELECT * FROM k2 WHERE pos = 'NN'), a AS (SELECT * FROM k2 WHERE pos = 'JJ') SELECT n.sent_id, n.i::INTEGER AS n_at, n.token AS noun, arg_min(a.token, (abs(n.i - a.i), a.i)) AS adjective FROM n JOIN a USING (sent_id) GROUP BY ALL")
def adjective_nouns(spark, t):
    return parse.adjective_noun_pairs(parsed(t)).drop("lecture", "prompt")


@query(f"WITH {TOKENS} SELECT sent_id, 'pos' AS kind, string_agg(pos, ' ' ORDER BY i) AS value FROM k2 GROUP BY sent_id UNION ALL SELECT sent_id, 'token', string_agg(token || '/' || pos, ' ' ORDER BY i) FROM k2 GROUP BY sent_id")
def token_columns(spark, t):
    one = parse.token_column(parsed(t), "pos").withColumn("kind", F.lit("pos"))
    return one.unionByName(parse.token_column(parsed(t), "pos", True).withColumn("kind", F.lit("token"))).select("sent_id", "kind", "value")


@query(f"WITH {TOKENS} SELECT sent_id, string_agg(token || '/' || pos, ' ' ORDER BY i) || ' ./.' AS value FROM k2 GROUP BY sent_id")
def tagged_sentences(spark, t):
    return parse.opinosis_lines(parsed(t)).select("sent_id", "value")


@query(f"WITH {TOKENS} SELECT sent_id, string_agg(token || '/' || pos, ' ' ORDER BY i) || ' ./.' AS value FROM k2 WHERE m < 3 GROUP BY sent_id, c HAVING count(*) = 3")
def tagged_phrases(spark, t):
    return parse.phrase_lines(parsed(t)).select("sent_id", "value")


_CANDIDATES = f"""{TOKENS}, s AS (SELECT sent_id, 'sentence' AS method, string_agg(token, ' ' ORDER BY i) AS phrase FROM k2 GROUP BY sent_id
UNION ALL SELECT sent_id, 'chunk', string_agg(token, ' ' ORDER BY i) FROM k2 WHERE m < 3 GROUP BY sent_id, c UNION ALL SELECT sent_id, 'syntax', string_agg(token, ' ' ORDER BY i) FROM k2 WHERE m < 3 GROUP BY sent_id, c HAVING count(*) = 3),
w AS (SELECT * FROM s WHERE NOT (({words('phrase')} = 1 AND (list_contains({STOP}, phrase) OR regexp_full_match(phrase, '[0-9]+'))) OR list_contains({PUNCT}, phrase[1])))"""


def all_candidates(t) -> DataFrame:
    found = [parse.candidates(parsed(t), m) for m in ("sentence", "chunk", "syntax")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {_CANDIDATES} SELECT sent_id, method, phrase FROM w")
def phrase_candidates(spark, t):
    return all_candidates(t).select("sent_id", "method", "phrase")


@query(f"WITH {_CANDIDATES}, l AS (SELECT method, sent_id % 5 AS lecture, count(*) AS n, avg({words('phrase')}) AS w FROM w GROUP BY ALL) SELECT method, count(*) AS lectures, CAST(sum(n) AS BIGINT) AS phrases, avg(n) AS mean_phrases, avg(w) AS mean_words FROM l GROUP BY method")
def candidate_statistics(spark, t):
    from condensa.operators import report

    rows = all_candidates(t).withColumn("lecture", F.col("sent_id") % 5)
    return report.candidate_statistics(rows, ["lecture", "prompt"]).drop("prompt")


@query(f"WITH {_CANDIDATES}, c AS (SELECT method, phrase, count(*) AS n FROM w GROUP BY ALL) SELECT method, CAST(row_number() OVER (PARTITION BY method ORDER BY n DESC, phrase) AS INTEGER) AS rnk, phrase FROM c")
def keys_by_count(spark, t):
    return parse.keys_by_count(all_candidates(t).groupBy("method", "phrase").agg(F.count("*").alias("n")), ["method"])


@query(f"WITH {TOKENS}, b AS (SELECT a.token || ' ' || b.token AS concept, a.pos || ' ' || b.pos AS tags, a.sent_id AS s, a.i AS i FROM k2 a JOIN k2 b ON a.sent_id = b.sent_id AND b.i = a.i + 1) SELECT concept, arg_max(tags, (s, i)) AS tags FROM b GROUP BY concept")
def concept_tags(spark, t):
    return parse.concept_tags(parsed(t))


@query(f"""WITH {TOKENS}, b AS (SELECT DISTINCT a.token || ' ' || b.token AS concept FROM k2 a JOIN k2 b ON a.sent_id = b.sent_id AND b.i = a.i + 1 AND a.c = b.c AND b.m < 3 JOIN k2 e ON e.sent_id = a.sent_id AND e.c = a.c AND e.m = 2)
SELECT concept FROM b""")
def concepts_in_phrases(spark, t):
    every = T.gram_rows(t("benchmark"), [F.lit("").alias("lecture"), F.lit("").alias("prompt")], stop=None)
    return parse.in_phrases(every, parse.syntactic_phrases(parsed(t)), C.GROUP).select("concept")


@query(f"WITH {TOKENS}, b AS (SELECT a.token || ' ' || b.token AS concept, a.pos AS p1, b.pos AS p2, a.sent_id AS s, a.i AS i FROM k2 a JOIN k2 b ON a.sent_id = b.sent_id AND b.i = a.i + 1), l AS (SELECT concept, arg_max(p1, (s, i)) AS p1, arg_max(p2, (s, i)) AS p2 FROM b GROUP BY concept) SELECT concept, unnest(['pos=' || p1 || ' ' || p2, 'pos_first=' || p1, 'pos_second=' || p2]) AS feature FROM l")
def feature_tags(spark, t):
    tags = parse.concept_tags(parsed(t)).select(F.lit("").alias("lecture"), F.lit("").alias("prompt"), "concept", "tags")
    return C.tag_features(tags).select("concept", "feature")


@query(f"WITH {DOCS}, p AS (SELECT DISTINCT unnest(list_concat({grams(toks('text'), 2)}, {grams(toks('text'), 3)})) AS phrase FROM benchmark), x AS (SELECT doc_id, unnest(list_concat({grams('t', 2)}, {grams('t', 3)})) AS phrase FROM d) SELECT doc_id, phrase, count(*) AS n FROM x WHERE phrase IN (SELECT phrase FROM p) GROUP BY ALL")
def all_matches(spark, t):
    gs = F.flatten(F.array(*(T.gram_array(T.tokens(F.col("text")), n) for n in (2, 3))))
    known = t("benchmark").select(F.explode(gs).alias("phrase")).where("phrase IS NOT NULL").distinct()
    return match.all_matches(t("documents"), known).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


# ---- ranking over phrases ------------------------------------------------
def stemmed_phrases(t) -> DataFrame:
    """Sentences of each group with their counts and stems that aren't stop words."""
    units = C.phrases(resp(t), "sentence").where(T.word_count(F.col("phrase")) <= 12)
    at = units.select(*C.GROUP, "phrase", "freq", F.explode(T.tokens(F.col("phrase"))).alias("word"))
    stems = stem_table(at.select("word").distinct(), "word")
    held = at.join(stems, "word").where(~F.col("stem").isin(*T.STOP_WORDS))
    return held.groupBy(*C.GROUP, "phrase").agg(F.first("freq").cast("double").alias("weight"), F.array_sort(F.collect_set("stem")).alias("stems"))


@query()
def overlap_free_top(spark, t):
    return groups(solver.overlap_free_top(stemmed_phrases(t), C.GROUP))


@query()
def soft_counts(spark, t):
    return groups(solver.soft_counts(stemmed_phrases(t).withColumn("at", F.xxhash64("phrase")), C.GROUP))


@query(f"WITH {DISTINCT}, r AS ({REFS}) SELECT source, lang, concept, theta FROM theta WHERE (source, concept) NOT IN (SELECT (source, concept) FROM r)")
def remaining_concepts(spark, t):
    """What is left of the candidates when the references' concepts are taken."""
    from condensa.operators import report

    theta = C.theta_distinct(resp(t)).withColumnRenamed("concept", "phrase")
    return groups(report.remaining(theta, refs(t).withColumnRenamed("concept", "phrase"), ["lecture"]).withColumnRenamed("phrase", "concept"))


# ---- sentence boundaries -------------------------------------------------
_TYPES = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(l, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)),
b AS (SELECT regexp_replace(regexp_replace(regexp_replace(w, '^[\\p{Ps}\\p{Pi}\\p{Pf}"''`]+', ''), '[\\p{Pe}\\p{Pf}\\p{Pi}"''`]+$', ''), '[,;:]+$', '') AS body FROM w),
k AS (SELECT regexp_matches(body, '[^.]\\.$') AS dot, lower(CASE WHEN regexp_matches(body, '[^.]\\.$') THEN body[:-2] ELSE body END) AS s FROM b),
c AS (SELECT dot, CASE WHEN regexp_matches(s, '^-?[.,]?[0-9][0-9,.-]*$') THEN '##number##' ELSE s END AS type FROM k),
types AS (SELECT type, count(*) FILTER (dot) AS dotted, count(*) FILTER (NOT dot) AS plain FROM c WHERE type <> '' GROUP BY type)"""


@query(f"WITH {_TYPES} SELECT type, dotted, plain FROM types")
def punkt_types(spark, t):
    return punkt.type_counts(punkt.tokens(t("documents"))[1])


@query(f"""WITH {_TYPES}, n AS (SELECT sum(dotted) / sum(dotted + plain) AS p FROM types), i AS (SELECT *, length(type) - length(replace(type, '.', '')) AS dots, length(replace(type, '.', '')) AS size FROM types, n),
x AS (SELECT type, -2 * (dotted * ln(p) + plain * ln(1 - p) - dotted * ln(0.99) - plain * ln(0.01)) * exp(-size) * (dots + 1) * pow(size, -plain) AS score FROM i WHERE dotted > 0 AND type <> '##number##' AND regexp_matches(type, '\\p{{L}}'))
SELECT type, score FROM x WHERE score >= 0.3""")
def punkt_abbreviations(spark, t):
    return punkt.abbreviations(punkt.type_counts(punkt.tokens(t("documents"))[1]))


@query()
def punkt_sentences(spark, t):
    """The sentences of all documents by boundaries learned from them."""
    return punkt.sentences(t("documents"))
