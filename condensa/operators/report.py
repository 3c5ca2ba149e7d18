"""Tables about systems and data: sweeps, combined scores, exports and counts."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condensa.functions import text as T

# ---- scores of systems ---------------------------------------------------


def sweep_table(scores: DataFrame, setting: str, metrics: list[str]) -> DataFrame:
    """(setting, metrics...): means over topics for each setting of scores(setting, topic, metrics...), and a row `max` of the largest means."""
    mean = scores.groupBy(F.col(setting).cast("string").alias(setting)).agg(*(F.avg(m).alias(m) for m in metrics))
    return mean.unionByName(mean.agg(*(F.max(m).alias(m) for m in metrics)).select(F.lit("max").alias(setting), *metrics))


def combined_models(tables: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """(method, metrics...): each model's mean over its table(topic, metrics...), and a row `max`."""
    rows = [t.agg(*(F.avg(m).alias(m) for m in metrics)).select(F.lit(name).alias("method"), *metrics) for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.unionByName(out.agg(*(F.max(m).alias(m) for m in metrics)).select(F.lit("max").alias("method"), *metrics))


def curve(scores: DataFrame, x: str, by: list[str], metrics: list[str], where: dict[str, object] | None = None) -> DataFrame:
    """(by, x, metrics...): means along a parameter, of the rows with other parameters fixed."""
    for c, v in (where or {}).items():
        scores = scores.where(F.col(c) == F.lit(v))
    return scores.groupBy(*by, x).agg(*(F.avg(m).alias(m) for m in metrics))


def parameter_grid(spark: SparkSession, **values) -> DataFrame:
    """A row for each combination of the parameters' values: the runs of a sweep."""
    return spark.createDataFrame(list(itertools.product(*values.values())), list(values))


def swept(units: DataFrame, grid: DataFrame) -> DataFrame:
    """Every unit under every setting of a grid, which is a short list."""
    return units.crossJoin(F.broadcast(grid)) if len(grid.take(1001)) <= 1000 else units.crossJoin(grid)


def model_names(spark: SparkSession, **values) -> DataFrame:
    """(name): the parameters' values joined by `_`, for each combination."""
    grid = parameter_grid(spark, **values)
    return grid.select(F.concat_ws("_", *(F.col(c).cast("string") for c in values)).alias("name"))


def last_round_scores(rounds: DataFrame, groups: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metrics...) of each group's highest round in rounds(by, round, metrics...); groups without any have zeros."""
    last = rounds.groupBy(*by).agg(*(F.max_by(m, "round").alias(m) for m in metrics))
    return groups.select(*by).distinct().join(last, by, "left").select(*by, *(F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics))


def grid_table(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A row for each value of one parameter, a column for each of another."""
    return cells.groupBy(row).pivot(column, columns).agg(F.avg(value))


def side_by_side(summaries: DataFrame, by: str, prompts: list[str], systems: list[str]) -> DataFrame:
    """(by, then prompt:system columns): lines of summaries(by, prompt, system, pos, line) joined by `;`, empty where there are none."""
    joined = summaries.groupBy(by, F.concat_ws(":", "prompt", "system").alias("cell")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), ";").alias("s"))
    names = [f"{p}:{s}" for p in prompts for s in systems]
    return joined.groupBy(by).pivot("cell", names).agg(F.first("s")).fillna("", names)


def quality_sum(summary: DataFrame, quality: DataFrame, by: list[str]) -> DataFrame:
    """(by, quality): the sum of the codes of a summary's phrases; the code `a` and phrases without one count nothing."""
    coded = quality.where("code <> 'a'").select(*by, "phrase", F.col("code").try_cast("double").alias("q"))
    return summary.join(coded, [*by, "phrase"], "left").groupBy(*by).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("quality"))


def overlap_of_references(sources: DataFrame, references: DataFrame, by: str, n: int = 2) -> DataFrame:
    """(by, total, covered, overlap): distinct reference n-grams of each topic and the share that its own sources hold."""
    ref = T.gram_rows(references, [by], n=n, stop=None, name="gram").distinct()
    src = T.gram_rows(sources, [by], n=n, distinct=True, stop=None, name="gram").join(ref, [by, "gram"], "left_semi").distinct().withColumn("hit", F.lit(1))
    told = ref.join(src, [by, "gram"], "left").groupBy(by).agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return told.withColumn("overlap", F.col("covered") / F.col("total"))


def joined_scores(overlaps: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, overlap, one, two): overlaps with two systems' scores, the topics with the largest overlap first."""
    return overlaps.join(first.select(key, F.col("score").alias("one")), key).join(second.select(key, F.col("score").alias("two")), key).select(key, "overlap", "one", "two").orderBy(F.desc("overlap"), key)


# ---- responses and references --------------------------------------------


def with_reference(groups: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """The groups that have a reference."""
    return groups.join(references.where("text IS NOT NULL AND trim(text) <> ''"), by, "left_semi")


def reference_rows(references: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, prompt, pos, line): lines of references(key, a column a prompt), normalized, blank ones dropped."""
    long = references.unpivot(key, columns, "prompt", "text").where("text IS NOT NULL")
    lines = long.select(key, "prompt", F.posexplode(F.split("text", "\\r?\\n")).alias("pos", "line"))
    return lines.withColumn("line", T.normalize_reference(F.col("line"))).where("line <> ''")


def exact_models(references: DataFrame, by: str, models: int) -> DataFrame:
    """The references, if each topic has exactly that many; otherwise the query fails."""
    counts = references.groupBy(by).agg(F.count("*").alias("models__"))
    told = references.join(counts, by)
    ok = F.when(F.col("models__") == models, F.col(by)).otherwise(F.raise_error(F.concat(F.lit(f"not {models} references: "), F.col(by).cast("string"))).cast(references.schema[by].dataType))
    return told.withColumn(by, ok).drop("models__")


def response_statistics(responses: DataFrame, by: str) -> DataFrame:
    """(by, students, valid, men, women, responses, one_sentence): of responses(by, student, gender, text) blank ones don't count;
    one_sentence is the share of responses of one sentence."""
    good = ~T.is_blank_answer(F.col("text"))
    single = F.when(good, (F.size(T.sentences(F.col("text"))) == 1).cast("double"))
    return responses.groupBy(by).agg(
        F.count_distinct("student").alias("students"), F.count_distinct(F.when(good, F.col("student"))).alias("valid"), F.count_distinct(F.when(F.col("gender") == "M", F.col("student"))).alias("men"),
        F.count_distinct(F.when(F.col("gender") == "F", F.col("student"))).alias("women"), F.sum(good.cast("long")).alias("responses"), F.avg(single).alias("one_sentence"),
    )


def candidate_statistics(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(method, prompt, lectures, phrases, mean_phrases, mean_words): candidates(by, method, phrase) counted by lecture, then averaged by prompt."""
    per = candidates.groupBy("method", *by).agg(F.count("*").alias("n"), F.avg(T.word_count(F.col("phrase"))).alias("words"))
    return per.groupBy("method", by[-1]).agg(F.count("*").alias("lectures"), F.sum("n").alias("phrases"), F.avg("n").alias("mean_phrases"), F.avg("words").alias("mean_words"))


def full_statistics(sources: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """(by, sentences, words, words_per_sentence, ref_words, ref_bigrams, covered)."""
    toks = T.tokens(F.col("text"))
    s = sources.groupBy(by).agg(F.sum(F.size(T.sentences(F.col("text")))).cast("long").alias("sentences"), F.sum(F.size(toks)).cast("long").alias("words"))
    r = references.groupBy(by).agg(F.sum(F.size(toks)).cast("long").alias("ref_words"))
    o = overlap_of_references(sources, references, by).select(by, F.col("total").alias("ref_bigrams"), "covered")
    return s.join(r, by).join(o, by, "left").select(by, "sentences", "words", (F.col("words") / F.col("sentences")).alias("words_per_sentence"), "ref_words", F.coalesce("ref_bigrams", F.lit(0)).alias("ref_bigrams"), F.coalesce("covered", F.lit(0)).alias("covered"))


def remaining(candidates: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that aren't chosen yet."""
    return candidates.join(chosen.select(*by, "phrase").distinct(), [*by, "phrase"], "left_anti")


def concept_bag(units: DataFrame, by: list[str], n: int = 2) -> DataFrame:
    """(by, concept, n): how often a summary's concepts come."""
    return T.gram_rows(units, by, n=n).groupBy(*by, "concept").agg(F.count("*").alias("n"))


def numbered_concepts(concepts: DataFrame, by: list[str], known: DataFrame | None = None) -> DataFrame:
    """(by, concept, id): known concepts keep their numbers, new ones follow the largest of their group, by name."""
    names = concepts.select(*by, "concept").distinct()
    if known is None:
        return names.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("concept")))
    top = known.groupBy(*by).agg(F.max("id").alias("top"))
    fresh = names.join(known, [*by, "concept"], "left_anti").join(top, by, "left")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("concept"))
    return known.select(*by, "concept", "id").unionByName(fresh.select(*by, "concept", (F.coalesce("top", F.lit(0)) + place).cast("int").alias("id")))


def found_tokens(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, hit): runs of tokens that a pattern over <token> sequences finds, tokens joined by spaces."""
    tagged = F.array_join(F.transform(T.wordpunct(F.lower("text")), lambda w: F.concat(F.lit("<"), w, F.lit(">"))), "")
    hits = F.regexp_extract_all(tagged, F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", F.btrim(F.regexp_replace("hit", "[<>]+", " ")).alias("hit"))


def similar_words(words: DataFrame, word: str, k: int = 20) -> DataFrame:
    """(word, n): words in the most contexts of a word, by name where equal; words(doc_id, pos, word) in order, contexts of one neighbour each side."""
    from condensa.sources.place import kept

    around = Window.partitionBy("doc_id").orderBy("pos")
    context = F.struct(F.lag("word").over(around).alias("left"), F.lead("word").over(around).alias("right"))
    told = kept(words.withColumn("context", context).select("word", "context").distinct(), "contexts")
    asked = told.where(F.col("word") == word).select("context").distinct()
    found = told.where(F.col("word") != word).join(asked, "context", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "word").limit(k)


# ---- completed matrices ---------------------------------------------------


def rank_cap(lam: float) -> int:
    """The largest rank of a completion for a penalty."""
    return 500 if lam >= 1.5 else 2000


def best_penalty(log: DataFrame) -> DataFrame:
    """(name, lam, error): the penalty of the least error in lines `name lambda: x error: y`, ties to the smaller penalty."""
    m = lambda i: F.regexp_extract("line", "^(\\S+)\\s+lambda:\\s*([0-9.eE+-]+)\\s+error:\\s*([0-9.eE+-]+)", i)
    found = log.select(m(1).alias("name"), m(2).try_cast("double").alias("lam"), m(3).try_cast("double").alias("error")).where("name <> '' AND lam IS NOT NULL AND error IS NOT NULL")
    return found.groupBy("name").agg(F.min_by("lam", F.struct("error", "lam")).alias("lam"), F.min("error").alias("error"))


def group_slice(completed: DataFrame, positions: DataFrame) -> DataFrame:
    """completed(concept, pos, value) cut back to groups: positions(by..., pos, at) names each group's columns and their places there."""
    return completed.join(positions, "pos").drop("pos").withColumnRenamed("at", "pos")


def completed_incidence(phrases: DataFrame, listed: DataFrame, completed: DataFrame, by: list[str], threshold: float = 0.0, concepts: DataFrame | None = None) -> DataFrame:
    """(by, phrase, concept, value): a completed matrix's cells for the phrases of phrases(by, phrase).

    listed(by, pos, phrase) names the matrix's columns, of a repeated phrase the
    first counts; completed(by, concept, pos, value).  Cells under the threshold,
    phrases without a column and concepts that aren't listed in concepts(by,
    concept), if given, are left out.
    """
    first = listed.groupBy(*by, "phrase").agg(F.min("pos").alias("pos"))
    cells = completed.where(F.col("value") >= threshold)
    cells = cells if concepts is None else cells.join(concepts.select(*by, "concept").distinct(), [*by, "concept"], "left_semi")
    return phrases.select(*by, "phrase").distinct().join(first, [*by, "phrase"]).join(cells, [*by, "pos"]).select(*by, "phrase", "concept", "value")


def share_of_large(cells: DataFrame, by: list[str], limits: list[float]) -> DataFrame:
    """(by, eps, ratio): the share of cells of at least each of some sizes."""
    rows = F.array(*(F.struct(F.lit(float(e)).alias("eps"), F.avg((F.col("value") >= e).cast("double")).alias("ratio")) for e in limits))
    return cells.groupBy(*by).agg(rows.alias("r")).select(*by, F.inline("r"))
