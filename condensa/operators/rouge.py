"""ROUGE, coverage, diversity and quality as joins and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import automaton


def unit_counts(texts: DataFrame, key: str, units: Column) -> DataFrame:
    return texts.select(key, F.explode(units).alias("unit")).groupBy(key, "unit").agg(F.count("*").alias("n"))


def units(toks: Column, metric: str) -> Column:
    """A text's units from its tokens; of n-grams, nulls come at the end."""
    return F.concat(toks, T.skip_bigrams(toks, 4)) if metric == "su4" else T.gram_array(toks, int(metric))


def unit_rows(texts: DataFrame, keys: list[str], metrics: list[str], asked: DataFrame | None = None) -> DataFrame:
    """keys, metric, unit, n: how often each text holds each unit, in one pass for all metrics.

    asked(ref_key, metric, unit): other units are left out before they are counted.
    """
    toks = T.tokens(F.col("text"))
    per = F.array(*(F.struct(F.lit(metric_name(m)).alias("metric"), units(toks, m).alias("units")) for m in metrics))
    rows = texts.select(*keys, F.explode(per).alias("m")).select(*keys, "m.metric", F.explode("m.units").alias("unit")).where("unit IS NOT NULL")
    rows = rows if asked is None else rows.join(asked, ["ref_key", "metric", "unit"], "left_semi")
    return rows.groupBy(*keys, "metric", "unit").agg(F.count("*").alias("n"))


def metric_name(m: str) -> str:
    return "ROUGE-SU4" if m == "su4" else f"ROUGE-{m}"


def unit_totals(texts: DataFrame, keys: list[str], metrics: list[str], name: str) -> DataFrame:
    """keys, metric and how many units each text has, without making them."""
    size = F.size(T.tokens(F.col("text"))).cast("long")

    def count(m: str) -> Column:
        if m == "su4":  # pairs at most 5 apart, and the tokens
            k = F.greatest(size - 1, F.lit(0))
            full = F.greatest(size - 5, F.lit(0))
            left = k - full
            return size + full * 5 + left * (left + 1) / 2
        return F.greatest(size - (int(m) - 1), F.lit(0))

    per = F.array(*(F.struct(F.lit(metric_name(m)).alias("metric"), count(m).cast("long").alias(name)) for m in metrics))
    return texts.select(*keys, F.explode(per).alias("m")).select(*keys, "m.metric", f"m.{name}")


def scores(hit: Column, system: Column, reference: Column) -> tuple[Column, Column, Column]:
    """(recall, precision, F); 0 where a denominator is 0."""
    r = F.when(reference > 0, hit / reference).otherwise(0.0)
    p = F.when(system > 0, hit / system).otherwise(0.0)
    return r, p, F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0)


def pair_scores(systems: DataFrame, references: DataFrame, metrics: list[str] = ["1", "2"]) -> DataFrame:
    """(system_id, ref_id, metric, r, p, f) of each system and each reference of its key, by clipped matches."""
    ref_units = unit_rows(references, ["ref_key", "ref_id"], metrics).withColumnRenamed("n", "rn")
    # a unit that no reference of the key has is never a match, so it isn't shuffled
    sys_units = unit_rows(systems, ["system_id", "ref_key"], metrics, ref_units.select("ref_key", "metric", "unit").distinct())
    hits = sys_units.join(ref_units, ["ref_key", "metric", "unit"]).groupBy("system_id", "ref_id", "metric").agg(F.sum(F.least("n", "rn")).alias("hit"))
    s, r = unit_totals(systems, ["system_id", "ref_key"], metrics, "sn"), unit_totals(references, ["ref_key", "ref_id"], metrics, "total")
    pairs = s.join(r, ["ref_key", "metric"]).join(hits, ["system_id", "ref_id", "metric"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return pairs.select("system_id", "ref_id", "metric", *(c.alias(n) for c, n in zip(scores(F.col("hit"), F.col("sn"), F.col("total")), "rpf")))


def rouge(systems: DataFrame, references: DataFrame, metrics: list[str] = ["1", "2"], combine: str = "mean") -> DataFrame:
    """(system_id, metric, r, p, f): systems(system_id, ref_key, text) against references(ref_key, ref_id, text).

    Clipped matches; several references of a key are combined by mean or max,
    or by the jackknife: the mean over references of the greatest score of all
    others.  A system whose key has no reference has no row.
    """
    pairs = pair_scores(systems, references, metrics)
    if combine == "jackknife":
        return jackknife(pairs)
    agg = F.avg if combine == "mean" else F.max
    return pairs.groupBy("system_id", "metric").agg(*(agg(c).alias(c) for c in "rpf"))


def jackknife(pairs: DataFrame) -> DataFrame:
    """(system_id, metric, r, p, f) of pair_scores: each reference is left out once and the greatest score of the others taken, each part by itself; a single reference counts as it is.

    Without the best one the second is the greatest, without any other the best.
    """
    parts = pairs.select("system_id", "metric", F.inline(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).alias("x")) for c in "rpf"))))
    many = pairs.groupBy("system_id", "metric").agg(F.count("*").alias("many"))
    place = F.row_number().over(Window.partitionBy("system_id", "metric", "part").orderBy(F.desc("x")))
    best = parts.withColumn("place", place).where("place <= 2").groupBy("system_id", "metric", "part").agg(F.max("x").alias("first"), F.min("x").alias("second"))
    told = best.join(many, ["system_id", "metric"]).withColumn("x", ((F.col("many") - 1) * F.col("first") + F.col("second")) / F.col("many"))
    return told.groupBy("system_id", "metric").agg(*(F.max(F.when(F.col("part") == c, F.col("x"))).alias(c) for c in "rpf"))


#: Chances of a Poisson variable of mean 1 to be no more than 0, 1, 2, ...; beyond the last it is one more.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def intervals(scored: DataFrame, by: list[str], draws: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by, part, mean, low, high, systems): means of scored(by, system_id, r, p, f) with bootstrap intervals.

    In each draw a system counts as often as a Poisson variable of mean 1 says,
    which a hash of seed, system and draw decides: one pass, no resampling, the
    same in each run.  A draw in which no system counts is left out.
    """
    rows = scored.select(*by, "system_id", F.inline(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).alias("x")) for c in "rpf"))))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    chance = F.pmod(F.xxhash64(F.lit(seed), "system_id", "draw"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    times = sum(((chance > p).cast("int") for p in _POISSON), F.lit(0))
    means = drawn.withColumn("times", times).groupBy(*by, "part", "draw").agg((F.sum(F.col("times") * F.col("x")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    ends = means.groupBy(*by, "part").agg(*(F.percentile("m", F.lit(q)).alias(n) for n, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))))
    told = rows.groupBy(*by, "part").agg(F.avg("x").alias("mean"), F.count("*").alias("systems"))
    return told.join(ends, [*by, "part"]).select(*by, "part", "mean", "low", "high", "systems")


def score_table(scored: DataFrame, by: str) -> DataFrame:
    """Means by group and metric, with `average` rows over all groups."""
    rolled = scored.groupBy(F.col(by), "metric").agg(*(F.avg(c).alias(c) for c in "rpf"))
    total = scored.groupBy("metric").agg(*(F.avg(c).alias(c) for c in "rpf")).select(F.lit("average").alias(by), "metric", *"rpf")
    return rolled.unionByName(total)


def reference_coverage(sources: DataFrame, references: DataFrame, high: int = 5) -> DataFrame:
    """(n, total, covered, ratio): distinct reference n-grams and those that a source text holds."""
    ref = references.select(T.tokens(F.col("text")).alias("t")).select(F.posexplode("t").alias("i", "w"), "t")
    ref = ref.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(high), F.size("t") - F.col("i"))), lambda n: F.array_join(F.slice("t", F.col("i") + 1, n), " "))).alias("g")).distinct()
    # one pass over the corpus with the references' n-grams as a dictionary
    src = automaton.held(sources, ref.withColumnRenamed("g", "phrase"), high).select(F.col("phrase").alias("g"), F.lit(1).alias("hit"))
    n = F.size(F.split("g", " ")).cast("long").alias("n")
    found = ref.join(src, "g", "left").groupBy(n).agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return found.select("n", "total", "covered", (F.col("covered") / F.col("total")).alias("ratio"))


def coverage_and_diversity(chosen: DataFrame, students: DataFrame, by: str) -> DataFrame:
    """chosen(by, phrase, student), students(by, student): share of students covered, and -sum p ln p with p = a
    student's chosen phrases over the number of covered students."""
    per = chosen.groupBy(by, "student").agg(F.count_distinct("phrase").alias("k"))
    covered = per.groupBy(by).agg(F.count("*").alias("covered"))
    total = students.groupBy(by).agg(F.count_distinct("student").alias("n"))
    p = F.col("k") / F.col("covered")
    entropy = per.join(covered, by).groupBy(by).agg(F.sum(-p * F.ln(p)).alias("entropy"), F.first("covered").alias("covered"))
    return total.join(entropy, by, "left").select(by, (F.coalesce("covered", F.lit(0)) / F.col("n")).alias("coverage"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def summary_quality(chosen: DataFrame, quality: DataFrame, by: str) -> DataFrame:
    """Mean over chosen phrases of their sources' summed quality over the number of coded sources; uncoded ones are left out."""
    per = chosen.join(quality, "student").groupBy(by, "phrase").agg((F.sum("quality") / F.count("*")).alias("q"))
    return per.groupBy(by).agg(F.avg("q").alias("quality"))


def diff_labels(responses: DataFrame, reference: DataFrame, system: DataFrame, by: list[str]) -> DataFrame:
    """(by, concept, sign): +1 response concepts that the reference has and the system lacks, -1 the other way round."""
    missed = responses.join(reference, [*by, "concept"], "left_semi").join(system, [*by, "concept"], "left_anti")
    extra = responses.join(system, [*by, "concept"], "left_semi").join(reference, [*by, "concept"], "left_anti")
    return missed.select(*by, "concept", F.lit(1).alias("sign")).unionByName(extra.select(*by, "concept", F.lit(-1).alias("sign"))).distinct()
