"""Fill-in-the-middle: cut texts into prefix, middle and suffix and write them in another order.

A text is a run of units: white space with the word after it, or white space
that ends the text.  One numpy kernel handles a whole batch on its Arrow UTF-8
buffers: a table gives each byte its class, a mask of adjacent bytes marks
where units end, cumulative sums that start again with each document count
them, and searchsorted finds the cuts of all rows at once.  Offsets stay byte
offsets, as no boundary lies within a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.functions.ship import ship

#: Marks of prefix, suffix and middle: `<`, one of these letters, `>`.
LETTERS = "PSM"
#: Bytes of text that go through the kernel at once; a longer text goes through in pieces of this size.
SLICE = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(x) for x in LETTERS]] = True
_MARKS = np.frombuffer("".join(f"<{x}>" for x in LETTERS).encode(), np.uint8)
#: Order of the pieces prefix 0, middle 1, suffix 2 in a form, each after its mark.
_ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_MARK_OF = {0: 0, 2: 1, 1: 2}


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes end a unit: the last of a word before white space, and the last of a document."""
    space = _SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return ends


def _starts_char(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold a mark as ordinary text."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, int)
    doc = np.searchsorted(offsets, at, "right") - 1
    out[doc[at + 2 < offsets[doc + 1]]] = True
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, byte offsets of two cuts, characters of the prefix, of the middle) of each document."""
    run = np.concatenate([[0], np.cumsum(unit_ends(data, offsets))])
    chars = np.concatenate([[0], np.cumsum(_starts_char(data))])
    base = run[offsets[:-1]]
    n = run[offsets[1:]] - base
    a, b = h1 % (n + 1), h2 % (n + 1)
    found = [np.where(k > 0, np.searchsorted(run, base + k), offsets[:-1]) for k in (np.minimum(a, b), np.maximum(a, b))]
    return n, np.stack(found, 1), chars[found[0]] - chars[offsets[:-1]], chars[found[1]] - chars[found[0]]


def cuts_of_long(data: np.ndarray, h1: int, h2: int) -> tuple[int, list[int], int, int]:
    """The same for one document, piece by piece, so that counts take no memory a byte."""
    pieces = [(at, min(at + SLICE, len(data))) for at in range(0, len(data), SLICE)]

    def ends(at: int, to: int) -> np.ndarray:
        seen = data[at : to + 1]  # with the next piece's first byte
        return unit_ends(seen, np.array([0, len(seen)]))[: to - at]

    counts = np.cumsum([0, *(np.count_nonzero(ends(*p)) for p in pieces)])
    n, found = int(counts[-1]), []
    for k in sorted((h1 % (n + 1), h2 % (n + 1))):
        p = int(np.searchsorted(counts, k)) - 1
        found.append(pieces[p][0] + int(np.flatnonzero(ends(*pieces[p]))[k - counts[p] - 1]) + 1 if k else 0)
    chars = [sum(int(np.count_nonzero(_starts_char(data[i : min(i + SLICE, to)]))) for i in range(at, to, SLICE)) for at, to in ((0, found[0]), (found[0], found[1]))]
    return n, found, chars[0], chars[1]


def woven(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all outputs: one gather over pieces and marks."""
    rows = len(form)
    edges = np.concatenate([offsets[:-1, None], cut, offsets[1:, None]], 1)
    start, size = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    plain = form == "plain"
    start[plain, 1], size[plain, 1] = offsets[:-1][plain], np.diff(offsets)[plain]
    for name, order in _ORDER.items():
        mine = form == name
        for place, piece in enumerate(order):
            start[mine, 2 * place], size[mine, 2 * place] = len(data) + 3 * _MARK_OF[piece], 3
            start[mine, 2 * place + 1] = edges[mine, piece]
            size[mine, 2 * place + 1] = edges[mine, piece + 1] - edges[mine, piece]
    to = np.concatenate([[0], np.cumsum(size.sum(1))])
    source = np.concatenate([data, _MARKS])
    if rows == 1:  # a long text: pieces are copied whole
        return np.concatenate([source[a : a + k] for a, k in zip(start[0], size[0])]), to
    flat, length = start.ravel(), size.ravel()
    shift = flat - np.concatenate([[0], np.cumsum(length)[:-1]])
    return source[np.repeat(shift, length) + np.arange(to[-1])], to


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from and to, of SLICE bytes at most; a longer text alone."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, to
        at = to


def _transform(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            wide = pa.types.is_large_string(text.type)
            where = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            body = text.buffers()[2] if len(text) else None
            whole = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
            h = np.stack([np.asarray(batch.column(f"h{i}"), np.int64) for i in range(1, 5)], 1)
            for at, to in _slices(where):
                data, offsets, k = whole[where[at] : where[to]], where[at : to + 1] - where[at], h[at:to]
                if to - at == 1 and len(data) > SLICE:
                    n, found, prefix, middle = cuts_of_long(data, int(k[0, 0]), int(k[0, 1]))
                    n, cut, prefix, middle = np.array([n]), np.array([found]), np.array([prefix]), np.array([middle])
                    # a piece reaches over the next one's first bytes, so that no mark is missed
                    has = np.array([any(marked(data[i : i + SLICE + 2], np.array([0, len(data[i : i + SLICE + 2])]))[0] for i in range(0, len(data), SLICE))])
                else:
                    n, cut, prefix, middle = cuts(data, offsets, k[:, 0], k[:, 1])
                    has = marked(data, offsets)
                plain = (np.diff(offsets) == 0) | has | (k[:, 2] % 100 >= rate)
                form = np.where(plain, "plain", np.where(k[:, 3] % 100 < spm, "spm", "psm"))
                out, ends = woven(data, offsets, cut, form)
                output = pa.LargeStringArray.from_buffers(len(form), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))
                columns = [batch.column("key").slice(at, to - at), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output if wide else output.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): each text with its middle moved to the end.

    The four first 8-digit groups of the hex sha256 of `seed:key` choose two
    cuts between units and the form: of 100 texts `rate` are transformed, of
    100 of these `spm` have the suffix first.  Texts that are empty or hold a
    mark stay plain, with prefix_chars and middle_chars null.

    A null text counts as empty, a null key as no digits.  Rows are handled
    each by itself: repeated rows come out repeated and alike, an empty table
    gives no row, other columns are left out whatever their names.  A text is
    never cut short; a long one goes through the kernel in pieces.
    """
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *draws)
    made = rows.mapInArrow(_transform(rate, spm), f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(output, form) -> F.Column:
    """The text that an output was made of: no piece holds a mark, so the marks alone tell the pieces."""
    piece = F.split(output, f"<[{LETTERS}]>")
    at = lambda i: F.element_at(piece, i + 1)
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
