"""A training-data pipeline of five stages over the `documents` table.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm import decontaminate, jaccard, langid, linedup, mixing
from condensa.llm.queries import table
from condensa.llm.scratch import Scratch

#: Posterior probability under which no language is assigned.
LEAST_CONFIDENCE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without a letter go, null and empty texts among them.

    The model learns from at most about 20,000 of the rows that have a lang;
    without any of these no language is recognised.  Repeated rows fare alike,
    null ids and other columns stay as they are; an empty table stays empty.
    """
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("tag")))
    return langid.keep_recognised(docs, model, LEAST_CONFIDENCE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one are cut out; documents that lose every line go. n_chars follows the text.

    Earlier is by doc_id, null ids last, and line; of equal rows one loses
    nothing that it has first.  Null and empty texts lose no line and stay.
    Columns of the operator's own names keep what they hold.
    """
    columns = docs.columns
    own = {c: f"own{c}__" for c in columns if c.lower() in ("_lines", "_removed")}
    cut = linedup.dedup_lines(docs.withColumnsRenamed(own), scratch=Scratch(spark, "stage-lines")).where("_removed = 0 OR _removed < _lines AND trim(text) <> ''")
    told = cut.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return told.select(*(F.col(own.get(c, c)).alias(c) for c in columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id; of equal ids the one with the least hash of its columns, of equal rows one.

    Null ids come last.  Texts without a word are no near duplicates of each
    other and stay; an empty table stays empty.
    """
    return jaccard.keep_one(docs, scratch=Scratch(spark, "stage-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated ones all; null and empty texts stay, and all columns whatever their names."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, taken): what a mix of the sources by weight takes; documents that it takes no word of are left out, those without a word among them.

    A null source is a source of its own.  Repeated rows and null ids are rows
    of their own, ordered by their texts where ids are equal.
    """
    rows, _, _ = mixing.mix(docs, scratch=Scratch(spark, "stage-mix"))
    name = F.element_at(F.from_json("pattern", "array<string>"), 1).alias("source")
    return rows.where("taken > 0").select("doc_id", name, "size", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: Near duplicates found by hashing and seeded alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over all documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
