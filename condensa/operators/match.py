"""Dictionary matching: Python where no built-in exists, over distinct inputs; subsequences by their old names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from condensa.operators import automaton
from condensa.operators.subsequence import lcs_length, lcs_matches  # noqa: F401 - the same by their old names


def all_matches(texts: DataFrame, phrases: DataFrame, longest: int = 5, stems: bool = False) -> DataFrame:
    """(doc_id, pos, n, phrase): every dictionary phrase of up to `longest` words at each place."""
    return automaton.matches(texts, phrases, longest, stems)


def longest_matches(texts: DataFrame, phrases: DataFrame, longest: int = 5, stems: bool = False) -> DataFrame:
    """(doc_id, pos, phrase) of a greedy scan: at each place the longest phrase, then on behind it."""
    return automaton.matches(texts, phrases, longest, stems, greedy=True).select("doc_id", "pos", "phrase")


def tokenize_longest(words: list[str], phrases: list[str], longest: int = 5, stemming: bool = True) -> list[str]:
    """The same scan over one list of words, by stems unless told otherwise."""
    known = automaton.Automaton((p for p in (automaton.normal(x, stemming) for x in phrases) if 0 < len(p) <= longest), stemming)
    return [" ".join(words[at : at + n]) for at, n in automaton.longest(known.matches([w.lower() for w in words]))]
