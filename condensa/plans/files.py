"""Queries that write the formats of `sources` and read them back, with SQL for what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import concepts as C
from condensa.operators import stats
from condensa.plans.catalogue import DISTINCT, DOCS, query, sents, toks
from condensa.sources import files, sheets, sinks
from condensa.sources.place import fresh, kept


@query(f"SELECT line, count(*) AS n FROM (SELECT unnest({sents('text')}) AS s, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE line <> '' GROUP BY line")
def line_file(spark, t):
    path = fresh(spark, "lines")
    sinks.write_lines(t("documents").select(F.explode(T.sentences(F.col("text"))).alias("line")), path)
    return files.lines(spark, path).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@query(f"SELECT word AS key, count(*) AS value FROM (SELECT unnest({toks('text')}) AS word FROM documents) GROUP BY word")
def count_file(spark, t):
    path = fresh(spark, "counts")
    sinks.write_counts(stats.corpus_words(t("documents")).toDF("key", "value"), path, by_value=True)
    return files.pairs(spark, path, "int")


@query(f"WITH {DISTINCT} SELECT source, lang, concept, theta FROM theta")
def json_weights(spark, t):
    """A JSON object of concept weights for each group, with the group's names among the keys."""
    path, theta = fresh(spark, "json"), C.theta_distinct(C.responses(t("documents")))
    named = theta.withColumn("key", F.concat_ws("\t", "lecture", "prompt", "concept"))
    sinks.write_json_maps(named, path, C.GROUP, "key", "theta")
    x = F.split("key", "\t")
    return files.json_rows(spark, path, "double").select(x[0].alias("source"), x[1].alias("lang"), x[2].alias("concept"), F.col("value").alias("theta"))


@query("SELECT vec_id, i::INTEGER AS i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def matrix_file(spark, t):
    path = fresh(spark, "matrix")
    cells = [F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(64)]
    sinks.write_matrix(t("embeddings").select("vec_id", *cells), path)
    rows = files.matrix(spark, path).where("size(cells) > 1")
    told = rows.select(F.col("cells")[0].cast("bigint").alias("vec_id"), F.posexplode(F.expr("slice(cells, 2, size(cells) - 1)")).alias("i", "x"))
    return told.select("vec_id", "i", F.col("x").cast("double").alias("x"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def delimited_table(spark, t):
    path = fresh(spark, "table")
    rows = t("customer")
    sinks.write_matrix(rows, path)
    return files.table(spark, path, schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def folder_manifest(spark, t):
    """Documents in a folder for each group, found again by their paths."""
    path = fresh(spark, "folders")
    t("documents").select("source", "lang", F.col("doc_id").cast("string").alias("line")).write.partitionBy("source", "lang").mode("overwrite").text(path)
    found = files.manifest(files.whole_files(spark, path, "*.txt").select("file"), "source=([^/]+)/lang=([^/]+)/", ["source", "lang"])
    ids = files.whole_files(spark, path).select(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source"), F.regexp_extract("file", "lang=([^/]+)/", 1).alias("lang"), F.explode(F.split(F.rtrim("text"), "\n")).alias("id"))
    return ids.join(found, ["source", "lang"]).where("id <> ''").groupBy("source", "lang").agg(F.count_distinct("id").alias("n"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(range(len(x)), lambda i: CASE WHEN i % 3 = 1 THEN x[i + 1] END), lambda s: s IS NOT NULL), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, unnest(ls) AS title FROM l""")
def title_lines(spark, t):
    return t("documents").select("doc_id", F.explode(files.title_lines(F.col("text"))).alias("title"))


@query(f"SELECT word, CAST(count(*) AS DOUBLE) / 8 AS weight FROM (SELECT unnest({toks('text')}) AS word FROM benchmark) GROUP BY word")
def topic_word_file(spark, t):
    path = fresh(spark, "topics")
    sinks.write_lines(stats.corpus_words(t("benchmark")).select(F.concat_ws(" ", "word", (F.col("n") / 8).cast("string")).alias("line")), path)
    return files.topic_words(spark, path)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'p_size' ELSE 'p_retailprice' END AS dim, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE CAST(floor(p_retailprice) AS BIGINT) END AS rating FROM part WHERE p_partkey % 5 <> 0""")
def rating_join(spark, t):
    """Each part rated by one of two dimensions; parts divisible by five name a third, which there is not."""
    dim = F.when(F.col("p_partkey") % 5 == 0, "none").when(F.col("p_partkey") % 2 == 0, "p_size").otherwise("p_retailprice")
    wide = t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return files.ratings(t("part").select("p_partkey", dim.alias("dim")), wide, ["p_partkey"]).select("p_partkey", "dim", "rating")


@query("""WITH v AS (SELECT 'src' || CAST(label AS VARCHAR) || '_en' AS word, sum(embedding[1]::DOUBLE) AS s FROM embeddings GROUP BY label), p AS (SELECT DISTINCT source || ' ' || lang AS phrase FROM documents)
SELECT phrase, CASE WHEN word IS NULL THEN 0 ELSE 1 END AS size, round(s, 6) AS first FROM p LEFT JOIN v ON replace(phrase, ' ', '_') = word""")
def word_vector_lookup(spark, t):
    words = t("embeddings").groupBy(F.concat(F.lit("src"), F.col("label").cast("string"), F.lit("_en")).alias("word")).agg(F.array(F.sum(F.col("embedding")[0].cast("double"))).alias("vector"))
    found = files.word_vectors(t("documents").select(F.concat_ws(" ", "source", "lang").alias("phrase")).distinct(), words)
    return found.select("phrase", F.size("vector").alias("size"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query("""SELECT 0 AS part, '@relation suppliers' AS line UNION ALL SELECT 1, '@attribute s_name string' UNION ALL SELECT 1, '@attribute s_acctbal NUMERIC'
UNION ALL SELECT 1, '@attribute r_name {' || (SELECT string_agg(DISTINCT '''' || r_name || '''', ',' ORDER BY '''' || r_name || '''') FROM region) || '}'
UNION ALL SELECT 2, '''' || s_name || ''',' || CAST(s_suppkey AS VARCHAR) || ',''' || r_name || '''' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def relation_file(spark, t):
    rows = t("supplier").join(t("nation"), F.expr("n_nationkey = s_nationkey")).join(t("region"), F.expr("r_regionkey = n_regionkey"))
    return sinks.arff(rows.select("s_name", F.col("s_suppkey").alias("s_acctbal"), "r_name"), "suppliers", {"s_name": "string", "s_acctbal": "number", "r_name": "category"})


@query("""SELECT '"' || p_name || '";' || p_brand || ';' || CAST(p_size AS VARCHAR) AS line FROM part""")
def delimited_rows(spark, t):
    return sinks.delimited(t("part"), ["p_name", "p_brand", "p_size"], ";", ["p_name"])


@query(f"WITH {DOCS}, c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM d) GROUP BY ALL) SELECT doc_id, string_agg(w || ':' || CAST(n AS VARCHAR), ' ' ORDER BY w) AS line FROM c GROUP BY doc_id")
def sparse_rows(spark, t):
    return sinks.sparse_lines(stats.bag_of_words(t("documents")), "doc", "term", "n").withColumnRenamed("doc", "doc_id")


@query(f"WITH {DISTINCT} SELECT source, lang, count(*) AS concepts, sum(theta) AS mass FROM theta GROUP BY ALL")
def group_slices(spark, t):
    path = fresh(spark, "slices")
    sinks.write_slices(C.theta_distinct(C.responses(t("documents"))).withColumnsRenamed({"lecture": "source", "prompt": "lang"}), path, ["source", "lang"])
    return spark.read.schema("concept string, theta double, source string, lang string").parquet(path).groupBy("source", "lang").agg(F.count("*").alias("concepts"), F.sum("theta").alias("mass"))


@query("""SELECT 'tagger' AS kind, doc_id, text AS line FROM documents UNION ALL SELECT 'keyphrase', doc_id, text || '.' FROM documents UNION ALL SELECT 'lower', doc_id, lower(text) FROM documents""")
def response_exports(spark, t):
    kinds = ["tagger", "keyphrase", "lower"]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), sinks.response_lines(F.col("text"), k).alias("line")) for k in kinds))
    return t("documents").select("doc_id", F.explode(rows).alias("x")).select("x.kind", "doc_id", "x.line")


@query("""SELECT item_id, (item_id % 7)::VARCHAR AS truth, (item_id % 3)::VARCHAR AS prediction, (item_id % 10) / 10.0::DOUBLE AS precision, [CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END] AS labels FROM benchmark""")
def result_readers(spark, t):
    """Result lines as taggers and classifiers write them, made from the items' numbers and read again."""
    b, path = t("benchmark"), fresh(spark, "results")
    n = F.col("item_id")
    sinks.write_lines(b.select(F.concat_ws("\t", n.cast("string"), F.lit("word"), (n % 7).cast("string"), (n % 3).cast("string")).alias("line")), path)
    rows = files.matrix(spark, path, head=False)
    tags = rows.select(F.col("cells")[0].cast("bigint").alias("item_id"), F.element_at("cells", -2).alias("truth"), F.element_at("cells", -1).alias("prediction"))
    weighted = b.select("item_id", F.concat(F.lit("Weighted Avg.   0.5 0.1 "), (n % 10 / 10).cast("string"), F.lit(" 0.2 0.3 0.4")).alias("line"))
    scores = weighted.join(files.weighted_averages(weighted.select("line")).distinct(), F.expr("cast(substring_index(substring_index(line, ' ', -4), ' ', 1) as double) = Precision")).select("item_id", F.col("Precision").alias("precision"))
    flags = files.label_rows(b.select("item_id", F.concat(F.lit("Instance: ["), (n % 2 == 0).cast("string"), F.lit(", "), (n % 3 == 0).cast("string"), F.lit("]")).alias("line"))).select("item_id", "labels")
    return tags.join(scores, "item_id").join(flags, "item_id")


@query("SELECT coalesce(source, 'null') AS source, CAST(doc_id AS VARCHAR) AS doc_id, lang, text, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def workbook_rows(spark, t):
    """A workbook of documents for each source, and a further one for each 300 documents; read again by their heads."""
    d = t("documents").select(F.coalesce("source", F.lit("null")).alias("group"), F.col("source"), "doc_id", "lang", "text", "n_chars").withColumn("source", F.col("group"))
    return sheets.table(kept(sheets.books(d, "group", ["doc_id"], rows_a_book=300), "books")).select("source", "doc_id", "lang", "text", "n_chars")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def workbook_columns(spark, t):
    """Two columns of the parts' workbooks, the others passed over."""
    books = kept(sheets.books(t("part").withColumn("group", F.pmod("p_partkey", F.lit(7))), "group", ["p_partkey"], "parts"), "books")
    return sheets.table(books, "parts", ["p_partkey", "p_name"]).select("p_partkey", "p_name")
