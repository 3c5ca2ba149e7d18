"""Line dedup by exact set-similarity join.

A line's tokens are its distinct words, ordered by rarity: by how often the
words of a hash bucket occur in all documents, then by hash.  The order is the
same for all lines and its table is bounded, so it is broadcast.  Lines with
equal token sets form a class, which stands where its first line does.  A class
sends the tokens of its prefix (the rarest, n - ceil(t n) + 1 of n) to the
tasks of these tokens; there the length and positional filters and a 128-bit
parity sketch, which bounds the symmetric difference from below, leave few
pairs.

A class goes if any earlier one matches, so not all pairs are needed: in each
round a class that is still open is verified on all tokens with the likeliest
few of each token's earlier candidates, and what was matched is settled.
Classes that found none, but have candidates left, go on with many times more,
until none has.

A token that very many classes share is told by pairs: sets that match share
two tokens of a prefix that is longer by one, so such a token is a key together
with each later one.  A key that is still shared by more than TOKEN_BLOCK
classes is split in parts by class; only open classes are sent to all of its
parts, from the second round on, so rows stay nearly linear in a group of near
copies.  Entries travel packed, many to a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm import blocks, bloom
from condensa.llm.jaccard import set_keys
from condensa.llm.scratch import Scratch

U64 = np.uint64
#: Buckets of the word counts and of the keys' loads; entries of a key in a task; pairs compared at once.
COUNT_BITS, LOAD_BITS, TOKEN_BLOCK, PAIR_BLOCK = 20, 20, 4096, 1 << 17
#: Entries of a shard, in expectation, and entries that a task packs at once; buckets of a row of sums.
SHARD, PACK, CHUNK = 1 << 17, 1 << 18, 4096
#: Candidates that a class asks a key for in the first round, and by how much they grow from round to round.
FEW, MORE = 4, 64


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte ends of all texts' lines, line offsets of the texts): a text has one line more than newlines."""
    cuts = np.flatnonzero(data == 10)
    marks = np.concatenate([offsets[1:], cuts])  # a text's end comes before a newline that begins the next
    order = np.argsort(marks, kind="stable")
    return marks[order], np.concatenate([[0], np.flatnonzero(order < len(offsets) - 1) + 1])


def sort_within(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values under 2**44 sorted within ascending owners."""
    if not len(owner) or owner[-1] < 1 << 20:
        both = (owner.astype(U64) << U64(44)) | values
        both.sort()
        return both & U64((1 << 44) - 1)
    return values[np.lexsort((values, owner))]


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens of each line, their offsets by line, line offsets by text).

    A token is the leading 44 bits of its word's hash, and zeros.
    """
    w = blocks.words(texts)
    ends, at = line_ends(w.data, w.offsets)
    rows = np.concatenate([[0], np.searchsorted(w.start, ends)])
    owner = np.repeat(np.arange(len(ends)), np.diff(rows))
    tokens = sort_within(owner, w.hash >> U64(20))
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new] << U64(20), np.concatenate([[0], np.cumsum(new)])[rows], at


def need(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of sets of n and m tokens with a Jaccard of t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9)


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


_LINE = "doc_id line look cid occ n s1 s2"


def _chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sums, without those that are all 0."""
    rows = total.reshape(-1, min(CHUNK, len(total)))
    at = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([rows[i].tobytes() for i in at], pa.binary())], names=["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
            row = np.frombuffer(sums, np.int64)
            total[chunk] = total[chunk] + row if chunk in total else row
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "sums"])


def _dense(df: DataFrame, bits: int) -> np.ndarray:
    """Sums of the rows of _chunks; no more numbers than buckets reach the driver."""
    out = np.zeros(1 << bits, np.int64)
    rows = out.reshape(-1, min(CHUNK, len(out)))
    got = df.repartition(F.col("chunk")).mapInArrow(_added, "chunk int, sums binary").toArrow()
    for chunk, sums in zip(got.column("chunk").to_pylist(), got.column("sums").to_pylist()):
        rows[chunk] = np.frombuffer(sums, np.int64)
    return out


def _clipped(sums: np.ndarray) -> np.ndarray:
    return np.minimum(sums, np.iinfo(np.int32).max).astype(np.int32)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, count = np.zeros(1 << COUNT_BITS, np.int64), [], 0
    for whole in batches:
        for batch in blocks.slices(whole, "text"):
            held.append((blocks.words(batch.column("text")).hash >> U64(64 - COUNT_BITS)).astype(np.int32))
            count += len(held[-1])
            if count > 1 << 21:
                total += np.bincount(np.concatenate(held), minlength=1 << COUNT_BITS)
                held, count = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=1 << COUNT_BITS)
    yield from _chunks(total)


def _sketch(uniq: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of parity bits by line: each token flips one of 128."""
    place = blocks.mix(uniq ^ U64(0xA5A5)) & U64(127)
    out = []
    for half in (0, 1):
        bit = np.where((place >> U64(6)) == U64(half), U64(1) << (place & U64(63)), U64(0))
        run = np.zeros(len(bit) + 1, U64)
        np.bitwise_xor.accumulate(bit, out=run[1:])
        out.append(run[rows[1:]] ^ run[rows[:-1]])
    return out[0], out[1]


def rarity(often: np.ndarray) -> np.ndarray:
    """12 bits that grow with a count."""
    return np.minimum(np.log2(often + 1.0) * 128, 4095).astype(U64)


def _occurrence(docs: pa.Array, look: pa.Array, line: np.ndarray) -> np.ndarray:
    """A hash of a line's document and number: rows of one id and text share it."""
    ids = np.asarray(docs.fill_null(-1), np.int64).view(U64) + blocks.mix(np.asarray(look, np.int64).view(U64) ^ np.asarray(docs.is_null()).astype(U64))
    return blocks.mix(blocks.mix(ids) + line.astype(U64)).view(np.int64)


def _lines(counts, t: float):
    """Each line with a word: where it is, set key, size, sketch and prefix (32 bits of each token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                uniq, rows, at = token_sets(batch.column("text"))
                n = np.diff(rows)
                some = np.flatnonzero(n > 0)
                owner = np.repeat(np.arange(len(n)), n)
                often = counts.value[(uniq >> U64(64 - COUNT_BITS)).astype(np.int64)]
                ordered = sort_within(owner, (often.astype(U64) << U64(32)) | (uniq >> U64(32)))
                place = np.arange(len(uniq)) - np.repeat(rows[:-1], n)
                first = place < np.repeat(prefix_length(n, t) + 1, n)  # one more, for keys of two
                ends = np.concatenate([[0], np.cumsum(first)])[rows]
                a, b = _sketch(uniq, rows)
                text = np.repeat(np.arange(batch.num_rows), np.diff(at))
                number = np.arange(len(n)) - at[:-1][text]
                prefix = blocks.lists((ordered[first] & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), ends).take(pa.array(some))
                keys, docs, look = set_keys(uniq, rows), batch.column("doc_id").take(pa.array(text)), batch.column("look").take(pa.array(text))
                occ = _occurrence(docs, look, number)
                columns = [docs, pa.array(number.astype(np.int32)), look, keys, pa.array(occ), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in columns), prefix], names=[*_LINE.split(), "prefix"])

    return run


def _load(shared, keys: np.ndarray) -> np.ndarray:
    return shared.value[keys & ((1 << LOAD_BITS) - 1)]


def _keys(batch: pa.RecordBatch, t: float, common) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, position of its token) of a batch of classes; common: loads of tokens, if any is large."""
    n = np.asarray(batch.column("n"), np.int64)
    tokens, size = np.asarray(batch.column("prefix").flatten(), np.int64) & 0xFFFFFFFF, np.asarray(batch.column("prefix").value_lengths(), np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(tokens)) - begin[owner]
    # sets of other tokens match only if the larger has 1 / (1 - t) of them
    able = np.floor(n / t + 1e-9) * (1 - t) >= 1 - 1e-6
    own = (place < prefix_length(n, t)[owner]) & able[owner]
    key = blocks.mix(tokens.astype(U64)).view(np.int64)
    if common is None:
        return key[own], owner[own], place[own]
    large = own & (_load(common, key) > TOKEN_BLOCK)
    at = np.flatnonzero(large)
    many = (size[owner] - place - 1)[at]
    one = np.repeat(at, many)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
    both = blocks.mix(tokens[one].astype(U64) << U64(32) | tokens[two].astype(U64)).view(np.int64)
    own &= ~large
    return np.concatenate([key[own], both]), np.concatenate([owner[own], owner[one]]), np.concatenate([place[own], place[one]])


def _loads(t: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, count = np.zeros(1 << LOAD_BITS, np.int64), [], 0
        for batch in batches:
            held.append((_keys(batch, t, common)[0] & ((1 << LOAD_BITS) - 1)).astype(np.int32))
            count += len(held[-1])
            if count > 1 << 21:
                total += np.bincount(np.concatenate(held), minlength=1 << LOAD_BITS)
                held, count = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << LOAD_BITS)
        yield from _chunks(total)

    return run


def _parts(loads, keys: np.ndarray) -> np.ndarray:
    """In how many parts a key is split; where all keys are large, twice the mean load is let go in one."""
    load = _load(loads, keys)
    return np.where(load > max(TOKEN_BLOCK, 2 * loads.value.mean()), -(-load // TOKEN_BLOCK), 1)


def _split(t: float, common, loads):
    """The classes with a key in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, owner, _ = _keys(batch, t, common)
            yield pa.RecordBatch.from_arrays([batch.column("occ").take(pa.array(np.unique(owner[_parts(loads, key) > 1])))], names=["occ"])

    return run


def _key_hashes(t: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_keys(batch, t, common)[0]))], names=["key"])

    return run


#: Columns of an entry: key with part, class, place, sketch, and size, position and role: asks (1), answers (0) or both (2).
ENTRY = 6


def _entries(t: float, common, loads, shards: int, role: int, wanted=None):
    """(shard, entries): an entry for each key that other classes may hold; those that ask go to all parts of a key.

    wanted: a Bloom filter of the keys to tell.
    """

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(held, 1)
        shard = (table[0].view(U64) >> U64(40)).astype(np.int64) & (shards - 1)
        order = np.argsort(shard, kind="stable")
        shard, rows = shard[order], np.ascontiguousarray(table[:, order].T)
        begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        offsets = (np.append(begin, len(shard)) * 8 * ENTRY).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])], names=["shard", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            key, owner, place = _keys(batch, t, common)
            keep = _load(loads, key) > 1
            if wanted is not None:
                keep &= bloom.hits(wanted, key)
            key, owner, place = key[keep], owner[keep], place[keep]
            occ, at, n, s1, s2 = (np.asarray(batch.column(c), np.int64) for c in ("occ", "at", "n", "s1", "s2"))
            parts = _parts(loads, key)
            part = (blocks.mix(occ[owner].view(U64)) % parts.astype(U64)).astype(np.int64)
            if role == 1:
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                key, owner, place, parts = (np.repeat(x, parts) for x in (key, owner, place, parts))
            key = np.where(parts > 1, blocks.mix(key.view(U64) + part.astype(U64)).view(np.int64), key)
            held.append(np.stack([key, occ[owner], at[owner], n[owner] << 32 | place << 2 | role, s1[owner], s2[owner]]))
            count += len(key)
            if count > PACK:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)
        blocks.trim()

    return run


def _pair_blocks(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each j in lo[i]:hi[i], a bounded number at once but for a single i."""
    count = np.maximum(hi - lo, 0)
    ahead = np.concatenate([[0], np.cumsum(count)])
    a, m = 0, len(count)
    while a < m:
        b = max(a + 1, int(np.searchsorted(ahead, ahead[a] + PAIR_BLOCK, "right")) - 1)
        i = np.repeat(np.arange(a, b), count[a:b])
        yield i, np.arange(len(i)) + np.repeat(lo[a:b] - (ahead[a:b] - ahead[a]), count[a:b])
        a = b


def _likeliest(x: np.ndarray, y: np.ndarray, apart: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of each x with the first few y by difference and place."""
    order = np.lexsort((y, at[y], apart, x))
    x, y, apart = x[order], y[order], apart[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    keep = (np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else np.zeros(0, np.int64)) < most
    return x[keep], y[keep], apart[keep]


def _partners(table: np.ndarray, t: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, whether x has more): candidates y that are no later than x, the likeliest few of each x; table has the columns of an entry as rows, sorted by (key, n)."""
    key, occ, at, npos, s1, s2 = table
    n, pos, role, s1, s2 = npos >> 32, npos >> 2 & 0x3FFFFFFF, npos & 3, s1.view(U64), s2.view(U64)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 32
    upto = np.searchsorted(group | n, group | np.floor(n / t + 1e-9).astype(np.int64), "right")
    if both := bool((role == 2).all()):
        # the first token that a set shares with one no smaller is in a shorter prefix
        lo = np.where(pos <= n - need(n, n, t), np.arange(len(key)) + 1, upto)
    else:
        lo = np.where(role == 1, np.searchsorted(group | n, group | np.ceil(t * n - 1e-9).astype(np.int64)), upto)
    total, x, y, far = np.zeros(len(key), np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    for i, j in _pair_blocks(lo, upto):
        if not both:
            ok = (role[j] == 0) & (at[j] <= at[i]) & (occ[j] != occ[i])
            i, j = i[ok], j[ok]
        least = need(n[i], n[j], t)
        can = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
        i, j, least = i[can], j[can], least[can]
        apart = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
        can = (apart <= n[i] + n[j] - 2 * least) & (occ[i] != occ[j])
        i, j, apart = i[can], j[can], apart[can]
        if both:  # of two classes at one place either may be the later one
            later, earlier = at[i] >= at[j], at[j] >= at[i]
            i, j, apart = (np.concatenate(z) for z in ((i[later], j[earlier]), (j[later], i[earlier]), (apart[later], apart[earlier])))
        total += np.bincount(i, minlength=len(key))
        x, y, far = _likeliest(np.concatenate([x, i]), np.concatenate([y, j]), np.concatenate([far, apart]), at, most)
    return x, y, total[x] > most


def _candidates(t: float, most: int):
    """Packed entries sorted by shard: pairs (x, y) of classes, and whether a key has more for x."""

    def told(held: list[bytes]) -> pa.RecordBatch:
        table = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, ENTRY) for x in held])
        table = np.ascontiguousarray(table[np.lexsort((table[:, 3] >> 32, table[:, 0]))].T)
        x, y, more = _partners(table, t, most)
        return pa.RecordBatch.from_arrays([pa.array(table[1][x]), pa.array(table[1][y]), pa.array(more)], names=["x", "y", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for shard, entries in zip(batch.column("shard").to_pylist(), batch.column("entries")):
                if held and shard != now:
                    yield told(held)
                    held = []
                now = shard
                held.append(entries.as_py())
        if held:
            yield told(held)
        blocks.trim()

    return run


def _cut_lines(texts: pa.Array, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> pa.Array:
    """Some byte spans of texts as strings."""
    size = (end - begin)[wanted]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin[wanted] - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(wanted), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _full_sets(wanted):
    """Token sets and places of the lines that may be wanted; only these are cut out and tokenized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks.slices(whole, "text"):
                data, offsets = blocks.utf8(batch.column("text"), lower=False)
                ends, at = line_ends(data, offsets)
                text = np.repeat(np.arange(batch.num_rows), np.diff(at))
                line = np.arange(len(text)) - at[:-1][text]
                begins = np.where(line > 0, np.concatenate([[0], ends[:-1]]) + 1, offsets[text])
                docs, look = (batch.column(c).take(pa.array(text)) for c in ("doc_id", "look"))
                occ = _occurrence(docs, look, line)
                some = np.flatnonzero(bloom.hits(wanted, occ))
                uniq, rows, _ = token_sets(_cut_lines(batch.column("text"), some, begins, ends, data))
                columns = [pa.array(occ), docs, pa.array(line.astype(np.int32)), look]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in columns), blocks.lists(uniq, rows)], names=["occ", "doc_id", "line", "look", "tokens"])

    return run


_SUMS = "chunk int, sums binary"


def _matched(texts: DataFrame, pairs: DataFrame, classes: DataFrame, t: float, scratch: Scratch, name: str) -> DataFrame:
    """(occ, doc_id, line, look): of each pair whose token sets match, the later class and where it is."""
    asked = scratch.keep(pairs.select(F.explode(F.array("x", "y")).alias("occ")).distinct(), f"asked{name}")
    if name != "0":  # few are left: only the documents that hold them are read
        held = classes.join(asked, "occ", "left_semi").select("doc_id", "look").distinct()
        texts = texts.alias("t").join(held.alias("h"), F.expr("t.doc_id <=> h.doc_id AND t.look = h.look"), "left_semi")
    sets = texts.mapInArrow(_full_sets(bloom.build(asked, "occ", asked.count())), "occ long, doc_id long, line int, look long, tokens array<long>")
    sets = scratch.keep(sets.dropDuplicates(["occ"]), f"sets{name}", hashes=True)  # of repeated rows one
    one, two = (sets.select(F.col("occ").alias(c), F.struct("doc_id", "line", "look").alias(f"p{c}"), F.col("tokens").alias(f"t{c}")) for c in "xy")
    both = pairs.select("x", "y").join(one, "x").join(two, "y").withColumn("same", F.size(F.array_intersect("tx", "ty")))
    later = F.struct(F.isnull("px.doc_id"), "px.doc_id", "px.line", "px.look", "x") > F.struct(F.isnull("py.doc_id"), "py.doc_id", "py.line", "py.look", "y")
    found = both.where(F.col("same") >= t * (F.size("tx") + F.size("ty") - F.col("same")) - 1e-6)
    x, y = (F.struct(F.col(c).alias("occ"), f"p{c}.*") for c in "xy")
    return scratch.keep(found.select(F.when(later, x).otherwise(y).alias("z")).select("z.*").distinct(), f"matched{name}")


def _among(wanted, column: str):
    """The rows whose set key a Bloom filter may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(column)
            half = np.frombuffer(keys.buffers()[2], ">i8").reshape(-1, 2)[keys.offset : keys.offset + len(keys), 0] if len(keys) else np.zeros(0)
            yield batch.filter(pa.array(bloom.hits(wanted, half.astype(np.int64))))

    return run


def later_matches(docs: DataFrame, threshold: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, look, lines): for every document of docs(doc_id, text, ...) with lines to remove, their numbers from 0.

    A line goes if the word set of an earlier line, by doc_id and line number,
    has a Jaccard with its own of at least the threshold; null ids come last.
    Lines without a word never go.  look is a hash of the text: rows that share
    a doc_id, or have none, are documents of their own unless their texts are
    equal; of their lines with one number that with the lesser hash is earlier.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("look", F.xxhash64("text"))
    counts = spark.sparkContext.broadcast(rarity(_dense(texts.select("text").mapInArrow(_word_counts, _SUMS), COUNT_BITS)).astype(np.uint16))
    lines = scratch.keep(texts.mapInArrow(_lines(counts, threshold), "doc_id long, line int, look long, cid binary, occ long, n int, s1 long, s2 long, prefix array<int>"), "lines", hashes=True)
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "line", "look", "occ")
    grouped = lines.groupBy("cid").agg(F.min(place).alias("rep"), F.first(F.struct("n", "s1", "s2", "prefix")).alias("x"), F.count("*").alias("copies"))
    classes = scratch.keep(grouped.select("cid", "rep.*", "x.*", "copies"), "classes", hashes=True)
    # a number that never falls from one place to a later one: with the line where the ids leave room for it
    low, high = classes.agg(F.min("doc_id"), F.max("doc_id")).first()
    room = max(abs(low or 0), abs(high or 0)) < 1 << 39
    at = F.col("doc_id") * (1 << 23) + F.least("line", F.lit((1 << 23) - 1)) if room else F.col("doc_id")
    asking = classes.select("occ", F.coalesce(at, F.lit((1 << 63) - 1)).alias("at"), "n", "s1", "s2", "prefix")
    hand = lambda x: spark.sparkContext.broadcast(x)
    prefixes = asking.select("n", "prefix")
    loads, common = hand(_clipped(_dense(prefixes.mapInArrow(_loads(threshold, None), _SUMS), LOAD_BITS))), None
    if loads.value.max() > TOKEN_BLOCK:
        common = loads
        loads = hand(_clipped(_dense(prefixes.mapInArrow(_loads(threshold, common), _SUMS), LOAD_BITS)))
    shards = 1 << max(0, int(loads.value.sum() // SHARD).bit_length())
    pack = lambda df, role, wanted=None: df.mapInArrow(_entries(threshold, common, loads, shards, role, wanted), "shard int, entries binary")
    met = pack(asking, 2)
    gone, turn, most = None, 0, FEW
    while True:
        met = met.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(_candidates(threshold, most), "x long, y long, more boolean")
        pairs = scratch.keep(met.groupBy("x", "y").agg(F.max("more").alias("more")), f"pairs{turn}")
        found = _matched(texts, pairs, classes, threshold, scratch, str(turn))
        gone = found if gone is None else gone.union(found)
        left = pairs.where("more").select(F.col("x").alias("occ"))
        if not turn and loads.value.max() > TOKEN_BLOCK:
            left = left.union(asking.mapInArrow(_split(threshold, common, loads), "occ long"))
        left = scratch.keep(left.distinct().join(gone, "occ", "left_anti"), f"left{turn}")
        scratch.drop(f"pairs{turn}", f"asked{turn}", f"sets{turn}", f"left{turn - 1}")
        if left.isEmpty():
            break
        turn, most = turn + 1, most * MORE
        probes = scratch.keep(asking.join(left, "occ", "left_semi"), f"probes{turn}")
        keys = scratch.keep(probes.mapInArrow(_key_hashes(threshold, common), "key long").distinct(), f"keys{turn}")
        met = pack(asking, 0, bloom.build(keys, "key", keys.count())).union(pack(probes, 1))
    # the first lines of matched classes go, and all but the first of classes with several
    several = scratch.keep(classes.where("copies > 1").select("cid", "occ", F.conv(F.hex(F.substring("cid", 1, 8)), 16, -10).cast("long").alias("half")), "several")
    wanted = bloom.build(several, "half", several.count())
    place = "cid binary, doc_id long, line int, look long, occ long"
    rest = lines.select("cid", "doc_id", "line", "look", "occ").mapInArrow(_among(wanted, "cid"), place)
    out = rest.alias("l").join(several.alias("f"), "cid").where("l.occ <> f.occ").select("doc_id", "look", "line")
    return scratch.keep(out.union(gone.select("doc_id", "look", "line")).distinct(), "out").groupBy("doc_id", "look").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """docs with later matching lines cut out of `text`, and the columns _lines and _removed: lines it had, and lost.

    Null texts stay null and have no lines; see later_matches.  Other columns
    pass through; columns of docs that are called _lines or _removed are
    replaced.
    """
    # whether each line up to the last removed one stays
    stays = F.expr("flatten(transform(lines, (x, k) -> concat(array_repeat(true, x - coalesce(get(lines, k - 1) + 1, 0)), array(false))))")
    gone = later_matches(docs, threshold, scratch).select(F.col("doc_id").alias("id"), "look", F.size("lines").cast("long").alias("n"), stays.alias("stays")).alias("g")
    d = docs.drop("_lines", "_removed").alias("d")
    told = d.join(gone.hint("shuffle_hash"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("g.look")) & F.col("d.text").isNotNull(), "left")
    cut = F.expr("array_join(filter(split(d.text, '\n', -1), (x, i) -> coalesce(get(g.stays, i), true)), '\n')")
    count = F.coalesce(F.octet_length("d.text") - F.octet_length(F.replace(F.col("d.text"), F.lit("\n"))) + 1, F.lit(0)).cast("long")
    columns = [F.when(F.col("g.n").isNull(), F.col("d.text")).otherwise(cut).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in ("_lines", "_removed")]
    return told.select(*columns, count.alias("_lines"), F.coalesce(F.col("g.n"), F.lit(0)).cast("long").alias("_removed"))
