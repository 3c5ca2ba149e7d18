"""Token counts by section, from one encoding of each whole document.

A document is encoded once, as a whole, with a public byte-level vocabulary.
Its tokens' bytes end to end are the document's UTF-8, so running sums of token
lengths give each token's span.  Sections are the document's lines, or spans of
characters that come with it; what these leave is filled up by unnamed ones, so
that sections tile the document.  Both lists of spans are sorted, so the
interval join is a merge: a token whose ends fall in one section belongs to it,
and one that crosses a boundary is allocated by the rule.

A long text goes through the encoder in pieces, cut where a white-space
character follows another one: no piece of the vocabulary's pattern spans such
a place, so the tokens are those of the whole text.  A long run of white space
is one piece of the pattern (without its last character, if text follows) and
is encoded as such, without the pattern.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from condensa.llm import blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "first", "last")
#: Fixed value: the characters that \\s stands for in the pattern.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Length of a white-space run that is encoded without the pattern; characters encoded at once.
LONG_RUN, PIECE = 1000, 1 << 20
_BUILT: dict[str, "Encoder"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Token byte lengths of texts of any length."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.plain, self.whole = (tiktoken.Encoding("given", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, "(?s).+"))
        self.run = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
        self.cut = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")

    def pieces(self, text: str) -> Iterator[tuple[object, str]]:
        """(encoding, part of the text)."""
        at = 0
        for run in self.run.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from self._parts(text, at, run.start())
            yield self.whole, text[run.start() : end]
            at = end
        yield from self._parts(text, at, len(text))

    def _parts(self, text: str, at: int, end: int) -> Iterator[tuple[object, str]]:
        while at < end:
            found = self.cut.search(text, at + PIECE, end) if end - at > PIECE else None
            to = found.start() if found else end
            yield self.plain, text[at:to]
            at = to

    def lengths(self, text: str) -> np.ndarray:
        return np.concatenate([self.size[np.asarray(e.encode_ordinary(part), np.int64)] for e, part in self.pieces(text)] or [np.zeros(0, np.int64)])


def _encoder(shared, name: str) -> Encoder:
    """The worker's encoder."""
    if name not in _BUILT:
        _BUILT[name] = Encoder(shared.value)
    return _BUILT[name]


def line_sections(text: bytes) -> np.ndarray:
    """Begins of sections: every line with its line end is one."""
    cuts = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], cuts[cuts < len(text)]])


def allocate(ends: np.ndarray, begins: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens by section, those among them that cross a boundary).

    ends: running byte ends of the tokens; begins: of the sections.
    majority: the section with most of the token's bytes, the earlier of equals;
    first, last: the section of its first or last byte.
    """
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(begins, starts, "right") - 1
    last = np.searchsorted(begins, ends - 1, "right") - 1
    crosses = np.flatnonzero(first != last)
    where = last if rule == "last" else first.copy()
    if rule == "majority":
        edges, many = np.append(begins, total), (last - first)[crosses] + 1
        at = np.cumsum(many) - many
        t = np.repeat(crosses, many)
        s = first[t] + np.arange(len(t)) - np.repeat(at, many)
        held = np.minimum(edges[s + 1], ends[t]) - np.maximum(edges[s], starts[t])
        if len(crosses):
            most = np.flatnonzero(held == np.repeat(np.maximum.reduceat(held, at), many))
            where[crosses] = s[most[np.searchsorted(most, at)]]
    n = len(begins)
    return np.bincount(where, minlength=n), np.bincount(where[crosses], minlength=n)


def span_sections(spans: list[dict], starts: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """(begins, names) of the sections that spans (name, begin, end) of characters and the gaps between them make; starts: each character's byte.

    Spans are cut at the text's ends and sorted; of overlapping ones the earlier
    keeps the common part.  Empty ones, and those without begin or end, are none.
    """
    edges, names, at, n = [], [], 0, len(starts)
    for s in sorted((x for x in spans if x and x["begin"] is not None and x["end"] is not None), key=lambda x: (x["begin"], x["end"], x["name"] or "")):
        begin, end = max(at, s["begin"]), min(n, s["end"])
        if begin >= end:
            continue
        if begin > at:
            edges, names = [*edges, at], [*names, None]
        edges, names, at = [*edges, begin], [*names, s["name"]], end
    if at < n:
        edges, names = [*edges, at], [*names, None]
    return starts[np.asarray(edges, np.int64)] if edges else np.zeros(0, np.int64), names


def _count(shared, name: str, rule: str, spans: bool):
    own = ["text", "spans"] if spans else ["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                rows, numbers, names = [], [], []
                given = batch.column("spans").to_pylist() if spans else [None] * batch.num_rows
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if not text:
                        continue
                    raw = text.encode("utf-8", "replace")
                    ends = np.cumsum(encoder.lengths(text))
                    if int(ends[-1]) != len(raw):
                        raise ValueError("the vocabulary does not cover the text")
                    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                    begins = line_sections(raw)
                    if spans:
                        begins, called = span_sections(given[i] or [], starts)
                        names += called
                    n, cross = allocate(ends, begins, len(raw), rule)
                    chars = np.searchsorted(starts, begins)
                    rows.append(np.full(len(begins), i))
                    numbers.append(np.stack([np.arange(len(begins)), begins, np.diff(np.append(begins, len(raw))), chars, np.diff(np.append(chars, len(starts))), n, cross]))
                if rows:
                    kept = [batch.column(i).take(pa.array(np.concatenate(rows))) for i, c in enumerate(batch.schema.names) if c not in own]
                    table = np.concatenate(numbers, 1)
                    more = [pa.array(names, pa.string())] if spans else []
                    yield pa.RecordBatch.from_arrays(
                        [*kept, *more, pa.array(table[0].astype(np.int32)), *map(pa.array, table[1:])],
                        names=[*(c for c in batch.schema.names if c not in own), *(["name"] if spans else []), "section", "begin_byte", "n_bytes", "begin_char", "n_chars", "tokens", "crossing"],
                    )

    return run


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority", spans: str | None = None) -> DataFrame:
    """(doc_id, section, begin_byte, n_bytes, begin_char, n_chars, tokens, crossing) for each line of docs(doc_id, text, ...).

    The tokens of a document's sections sum to the tokens of the whole document.
    crossing: how many of the section's tokens reach into others; a token in
    equal parts in two sections goes to the earlier one.  spans: an array column
    of structs (name, begin, end), spans of characters that take the place of
    lines; then `name` comes too, null for what they leave (see span_sections).
    Null and empty texts have no sections.  Texts of any length are encoded
    whole.  Repeated rows are counted each; a null doc_id stays null; other
    columns are ignored; an empty table gives an empty result.  The vocabulary
    is read on the driver.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    given = [f"transform(`{spans}`, x -> named_struct('name', cast(x.name as string), 'begin', cast(x.begin as bigint), 'end', cast(x.end as bigint))) spans"] if spans else []
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", *given)
    schema = f"doc_id long, {'name string, ' if spans else ''}section int, begin_byte long, n_bytes long, begin_char long, n_chars long, tokens long, crossing long"
    return texts.mapInArrow(_count(ranks, uuid.uuid4().hex, rule, bool(spans)), schema)


def document_tokens(sections: DataFrame) -> DataFrame:
    """(doc_id, tokens): sums over the sections."""
    return sections.groupBy("doc_id").sum("tokens").toDF("doc_id", "tokens")


__all__ = ["RULES", "VOCABULARY", "Encoder", "allocate", "document_tokens", "line_sections", "load_ranks", "section_tokens", "span_sections"]
