"""Sentence boundaries learned without labels (Kiss and Strunk, 2006), as aggregations and joins.

A period ends a sentence unless the word before it is an abbreviation, an
initial or an ordinal.  Which words are abbreviations, which words begin
sentences, which pairs stay together over a period and how words are
capitalised is counted over the whole corpus and decided by log-likelihood
ratios; the tables that result hold types, never documents.  Lines always end
sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.sources.place import kept

#: Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: What any number counts as.
NUMBER = "##number##"
#: Patterns of what stands around a word, of numbers, and of initials.
OPENING, CLOSING = "^[\\p{Ps}\\p{Pi}\\p{Pf}\"'`]+", "[\\p{Pe}\\p{Pf}\\p{Pi}\"'`]+$"
IS_NUMBER, IS_INITIAL = "^-?[.,]?[0-9][0-9,.-]*$", "^\\p{L}$"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, line, words): a number for each text, and its lines that aren't blank as arrays of words."""
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "body"))
    words = F.split(F.btrim(F.col("body"), F.lit(" \t\n\x0b\f\r")), "\\s+")
    return numbered.select("row", "key", "line", words.alias("words")).where("size(words) > 1 OR words[0] <> ''")


def tokens(texts: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, (row, line, pos, cur, prev, next)): tokens with their neighbours in the line.

    A token is what a word is to the counts: type, whether a period ends it,
    whether it ends a sentence by ? or !, dots, capitals, and whether a comma
    or the like follows.
    """
    held = kept(lines(texts, key, text), "lines")
    c = F.col
    rows = held.select("row", "line", F.posexplode("words").alias("pos", "w")).withColumn("bare", F.regexp_replace(F.regexp_replace("w", OPENING, ""), CLOSING, ""))
    rows = rows.withColumn("body", F.regexp_replace("bare", "[,;:]+$", "")).withColumn("period", c("body").rlike("[^.]\\.$")).withColumn("first", F.substring("body", 1, 1))
    rows = rows.withColumn("stem", F.lower(F.when(c("period"), F.regexp_replace("body", "\\.$", "")).otherwise(c("body"))))
    cur = F.struct(
        F.when(c("stem").rlike(IS_NUMBER), F.lit(NUMBER)).otherwise(c("stem")).alias("type"),
        "period",
        c("bare").rlike("[?!]$").alias("strong"),
        c("bare").rlike("\\.\\.$").alias("dots"),
        ((c("first") != F.lower("first")) & (c("first") == F.upper("first"))).alias("upper"),
        ((c("first") != F.upper("first")) & (c("first") == F.lower("first"))).alias("lower"),
        (c("bare") != c("body")).alias("held"),
    )
    place = Window.partitionBy("row", "line").orderBy("pos")
    return held, kept(rows.select("row", "line", "pos", cur.alias("cur")).withColumns({"prev": F.lag("cur").over(place), "next": F.lead("cur").over(place)}), "tokens")


def type_counts(toks: DataFrame) -> DataFrame:
    """(type, dotted, plain): occurrences of each type with a period and without."""
    return toks.groupBy(F.col("cur.type").alias("type")).agg(F.count_if("cur.period").alias("dotted"), F.count_if(~F.col("cur.period")).alias("plain")).where("type <> ''")


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, score) of the types that periods stick to, shorter ones and ones with dots inside the more, unless they occur without."""
    total = counts.agg(F.sum("dotted").alias("dots"), F.sum(F.col("dotted") + F.col("plain")).alias("n"))
    n, p = F.col("dotted") + F.col("plain"), F.col("dots") / F.col("n")
    null = F.col("dotted") * F.log(p) + F.col("plain") * F.log1p(-p)
    other = F.col("dotted") * F.log(F.lit(0.99)) + F.col("plain") * F.log(F.lit(0.01))
    inside = F.length("type") - F.length(F.replace(F.col("type"), F.lit(".")))
    size = F.length("type") - inside
    score = -2 * (null - other) * F.exp(-size) * (inside + 1) * F.pow(size, -F.col("plain"))
    asked = counts.where("dotted > 0").where(F.col("type").rlike("\\p{L}") & (F.col("type") != NUMBER))
    # a row of totals; every word with a period leaves no odds to compare
    return asked.join(F.broadcast(total), F.lit(True)).where((n > 0) & (p < 1)).select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events with counts a and b meeting ab times in n."""
    x = lambda k, p: F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(p))
    p, p1 = b / n, ab / a
    p2 = F.when(n == a, F.lit(1.0)).otherwise((b - ab) / (n - a))
    rest = n - a - b + ab
    alone = x(ab, p) + x(a - ab, 1 - p) + x(b - ab, p) + x(rest, 1 - p)
    return -2 * (alone - x(ab, p1) - x(a - ab, 1 - p1) - x(b - ab, p2) - x(rest, 1 - p2))


@dataclass
class Model:
    """Tables by type: abbreviations(type), starters(type), collocations(a, b), cases(type, up_first, up_inside, low, low_first, up)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def _annotated(toks: DataFrame, abbr: DataFrame) -> DataFrame:
    """Tokens with `abbr`, whether their type is an abbreviation, and the same of the token before."""
    known = lambda c: abbr.select(F.col("type").alias(f"{c}_type"), F.lit(True).alias(f"{c}_abbr"))
    a = toks.withColumn("cur_type", F.col("cur.type")).join(known("cur"), "cur_type", "left")
    b = a.withColumn("prev_type", F.col("prev.type")).join(known("prev"), "prev_type", "left")
    return b.withColumns({f"{c}_abbr": F.coalesce(f"{c}_abbr", F.lit(False)) & F.col(f"{c}.period") for c in ("cur", "prev")})


def _breaks(token_: str, abbr: str) -> Column:
    t = F.col(token_)
    return (t["strong"] | t["period"] & ~F.col(abbr)) & ~t["held"]


def train(toks: DataFrame) -> Model:
    counts = kept(type_counts(toks), "types")
    abbr = kept(abbreviations(counts).select("type"), "abbreviations")
    seen = _annotated(toks, abbr)
    after = F.coalesce(_breaks("prev", "prev_abbr"), F.lit(True))  # the first of a line begins a sentence
    unsure = ~after & (F.col("prev_abbr") | F.coalesce(F.col("prev.dots"), F.lit(False)))
    inside = ~after & ~unsure
    cur = F.col("cur")
    cases = seen.groupBy(cur["type"].alias("type")).agg(
        F.bool_or(cur["upper"] & after).alias("up_first"), F.bool_or(cur["upper"] & inside).alias("up_inside"), F.bool_or(cur["lower"]).alias("low"), F.bool_or(cur["lower"] & after).alias("low_first"), F.bool_or(cur["upper"]).alias("up")
    )
    total = counts.agg(F.sum(F.col("dotted") + F.col("plain")).alias("n"))
    every = counts.select("type", (F.col("dotted") + F.col("plain")).cast("double").alias("b"))
    ordinal = F.col("prev.type").rlike(IS_INITIAL) | (F.col("prev.type") == NUMBER)
    begun = seen.where(F.col("prev").isNotNull() & _breaks("prev", "prev_abbr"))
    starts = begun.where(~ordinal & cur["type"].rlike("^\\p{L}+$"))
    ends = F.broadcast(total.join(begun.agg(F.count("*").cast("double").alias("a")), F.lit(True)))
    scored = starts.groupBy(cur["type"].alias("type")).agg(F.count("*").cast("double").alias("ab")).join(every, "type").join(ends, F.lit(True))
    starters = scored.where((together(F.col("a"), F.col("b"), F.col("ab"), F.col("n")) >= STARTER) & (F.col("n") / F.col("a") > F.col("b") / F.col("ab")) & (F.col("ab") > F.col("a") * F.col("b") / F.col("n"))).select("type")
    pairs = seen.where(F.col("prev.period") & ~F.col("prev_abbr") & ordinal & (cur["type"] != "")).groupBy(F.col("prev.type").alias("first"), cur["type"].alias("type")).agg(F.count("*").cast("double").alias("ab"))
    met = pairs.join(every, "type").join(every.select(F.col("type").alias("first"), F.col("b").alias("a")), "first").join(F.broadcast(total), F.lit(True))
    # a pair that meets once tells nothing
    collocations = met.where((F.col("ab") > 1) & (together(F.col("a"), F.col("b"), F.col("ab"), F.col("n")) >= COLLOCATION) & (F.col("n") / F.col("a") > F.col("b") / F.col("ab"))).select(F.col("first").alias("a"), F.col("type").alias("b"))
    return Model(abbr, kept(starters, "starters"), kept(collocations, "collocations"), kept(cases, "cases"))


def boundaries(toks: DataFrame, model: Model) -> DataFrame:
    """(row, line, pos): the words after which a sentence ends within its line."""
    found = toks.where("next IS NOT NULL AND NOT cur.held AND (cur.period OR cur.strong OR cur.dots)")
    known = found.withColumns({"type": F.col("cur.type"), "then": F.col("next.type")}).join(model.abbreviations.withColumn("abbr", F.lit(True)), "type", "left")
    known = known.join(model.collocations.select(F.col("a").alias("type"), F.col("b").alias("then"), F.lit(True).alias("pair")), ["type", "then"], "left")
    known = known.join(model.starters.select(F.col("type").alias("then"), F.lit(True).alias("starter")), "then", "left").join(model.cases.withColumnRenamed("type", "then"), "then", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    upper, lower = F.col("next.upper"), F.col("next.lower")
    # what the next word's capital says: it begins a sentence, it doesn't, or neither
    begins = upper & is_("low") & ~is_("up_inside")
    goes_on = ~begins & (~upper & ~lower & ~F.col("next.type").rlike("[\\p{L}\\p{N}]") | lower & (is_("up") | ~is_("low_first")))
    initial, number = F.col("type").rlike(IS_INITIAL), F.col("type") == NUMBER
    abbr = is_("abbr") & F.col("cur.period")
    plain = F.col("cur.strong") | F.col("cur.period") & ~abbr
    ends = (
        F.when(F.col("cur.strong"), F.lit(True))
        .when(is_("pair"), F.lit(False))
        .when((abbr | F.col("cur.dots")) & ~initial, begins | upper & is_("starter"))
        .when((initial | number) & goes_on, F.lit(False))
        .when(initial & ~begins & upper & ~is_("low"), F.lit(False))
        .otherwise(plain)
    )
    return known.where(ends).select("row", "line", "pos")


def sentences(texts: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, line, sent, sentence): the sentences of each line, words apart by one space; a model of the texts themselves unless one is given.

    Null, empty and blank texts have none; repeated texts and null keys are
    texts of their own.  Other columns are ignored, whatever their names.
    """
    held, toks = tokens(texts, key, text)
    cuts = boundaries(toks, model or train(toks)).groupBy("row", "line").agg(F.array_sort(F.collect_list("pos")).alias("cuts"))
    ends = held.join(cuts, ["row", "line"], "left").withColumn("ends", F.concat(F.transform(F.coalesce("cuts", F.array().cast("array<int>")), lambda x: x + 1), F.array(F.size("words"))))
    spans = ends.select("key", "line", "words", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)).alias("a"), F.col("ends").alias("b"))).alias("sent", "z"))
    return spans.select(F.col("key").alias(key), "line", "sent", F.array_join(F.slice("words", F.col("z.a") + 1, F.col("z.b") - F.col("z.a")), " ").alias("sentence"))
