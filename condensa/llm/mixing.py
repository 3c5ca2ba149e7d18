"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold
them).  Words flow from patterns to source quotas; the r-th copy of a word
costs r - 1, so repetition is spread as evenly as the quotas allow.  The flow
is solved over patterns and sources only, on the driver, for each connected
group of sources by itself; a source that shares no document needs no search.
The driver holds one row a pattern, whatever the number of documents.  A pattern that has to
give q full copies and r words more gives every document q times; the r words
come from its documents in a seeded order, the last of which is taken in part.
The order's cut is found from sums over hash buckets, twice refined, so no
source is ever sorted as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.scratch import Scratch

#: Times that a document may be taken; patterns up to which their table is broadcast.
MOST_COPIES, FEW_PATTERNS = 3, 100_000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_code_point(sources: Iterable[str | None]) -> list[str | None]:
    found = set(sources)
    return sorted(x for x in found if x is not None) + [None] * (None in found)


def targets(sizes: dict[str | None, int], total: int, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Shares of the total by weights 1, 2, 3, 1, ...; what exceeds `most` times a source's size is shared out again."""
    names = by_code_point(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, rest = list(names), float(total)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], most: int = MOST_COPIES) -> list[dict[int, int]]:
    """Words from each pattern (size, sources) to each source: all that the quotas can take, at the least cost.

    Successive shortest augmenting paths with potentials.
    """
    p, s = len(patterns), len(quotas)
    root, sink = p + s, p + s + 1
    head: list[list[int]] = [[] for _ in range(p + s + 2)]
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    for i, (size, members) in enumerate(patterns):
        for copy in range(most):
            arc(root, i, size, copy)
        for j in members:
            arc(i, p + j, most * size, 0)
    for j, quota in enumerate(quotas):
        arc(p + j, sink, quota, 0)
    price = [0] * len(head)
    while True:
        far: dict[int, int] = {root: 0}
        heap, done = [(0, root)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in head[x]:
                if cap[e] and (n := d + cost[e] + price[x] - price[to[e]]) < far.get(to[e], 1 << 60):
                    far[to[e]] = n
                    heapq.heappush(heap, (n, to[e]))
        if sink not in far:
            break
        longest = far[sink]
        for x in range(len(head)):
            price[x] += min(far.get(x, longest), longest)
        # blocking flows over the arcs of no reduced cost, until none is left
        while True:
            level, queue = {root: 0}, [root]
            for x in queue:
                for e in head[x]:
                    if cap[e] and to[e] not in level and cost[e] + price[x] == price[to[e]]:
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if sink not in level:
                break
            nxt = [0] * len(head)  # each node's next arc to try
            path: list[int] = []
            x = root
            while True:
                if x == sink:
                    push = min(cap[e] for e in path)
                    for k, e in enumerate(path):
                        cap[e] -= push
                        cap[e ^ 1] += push
                    cut = next(k for k, e in enumerate(path) if not cap[e])
                    x = to[path[cut] ^ 1]
                    del path[cut:]
                while nxt[x] < len(head[x]):
                    e = head[x][nxt[x]]
                    if cap[e] and level.get(to[e]) == level[x] + 1 and cost[e] + price[x] == price[to[e]]:
                        break
                    nxt[x] += 1
                else:
                    if x == root:
                        break
                    x = to[path.pop() ^ 1]
                    nxt[x] += 1
                    continue
                path.append(e)
                x = to[e]
    return [{to[e] - p: cap[e ^ 1] for e in head[i] if e % 2 == 0 and to[e] != root and cap[e ^ 1]} for i in range(p)]


def route(patterns: list[tuple[int, list[int]]], quotas: list[int], most: int = MOST_COPIES) -> list[dict[int, int]]:
    """min_cost_flow, solved for each connected group of sources by itself."""
    tree = list(range(len(quotas)))

    def root(j: int) -> int:
        while tree[j] != j:
            tree[j] = tree[tree[j]]
            j = tree[j]
        return j

    for _, members in patterns:
        for j in members[1:]:
            tree[root(j)] = root(members[0])
    groups: dict[int, list[int]] = {}
    for i, (_, members) in enumerate(patterns):
        if members:
            groups.setdefault(root(members[0]), []).append(i)
    out: list[dict[int, int]] = [{} for _ in patterns]
    for mine in groups.values():
        names = sorted({j for i in mine for j in patterns[i][1]})
        place = {j: k for k, j in enumerate(names)}
        if len(names) == len(mine) == 1:
            if words := min(quotas[names[0]], most * patterns[mine[0]][0]):
                out[mine[0]] = {names[0]: words}
            continue
        for i, flow in zip(mine, min_cost_flow([(patterns[i][0], [place[j] for j in patterns[i][1]]) for i in mine], [quotas[j] for j in names], most)):
            out[i] = {names[k]: w for k, w in flow.items()}
    return out


def mix(docs: DataFrame, text: str = "text", sources: Column | None = None, seed: str = "mix", most: int = MOST_COPIES, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str | None, int, float, int]]]:
    """(rows, flows, sources) of a mix of docs(doc_id, text, source, ...).

    rows: doc_id, size, pattern (JSON array of its sources), taken; one for
    each row of docs.  flows: pattern, source, words.  sources: each source with
    its size, target and the words it gets.  A document's size is its number of
    words (null text: 0).  sources: an array column, by default the one source;
    null is a source like others.  Documents in no source (null or empty array)
    are taken 0 times.  Repeated rows are documents of their own, of one place in the
    order; rows without doc_id are ordered by their text.  An empty table gives
    empty results.  Columns called size, pattern, members or key don't matter.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))))
    sized = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            word_count(F.col(text).cast("string")).alias("size"),
            F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))), {"ignoreNullFields": "false"}).alias("pattern"),
            F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("members"),
            key.alias("key"),
        ),
        "sized",
    )
    sums = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()
    sums.sort(key=lambda r: r["pattern"])
    size: dict[str | None, int] = {}
    for r in sums:
        for s in r["members"]:
            size[s] = size.get(s, 0) + r["size"]
    names = by_code_point(size)
    target = targets(size, sum(r["size"] for r in sums if r["members"]), most)
    index = {s: j for j, s in enumerate(names)}
    flow = route([(r["size"], [index[s] for s in r["members"]]) for r in sums], [int(target[s] + 0.5) for s in names], most)
    took = [sum(f.values()) for f in flow]
    plan = spark.createDataFrame(
        [(r["pattern"], t // r["size"] if r["size"] else 0, t % r["size"] if r["size"] else 0) for r, t in zip(sums, took)], "pattern string, copies long, more long"
    )
    flows = spark.createDataFrame([(r["pattern"], names[j], w) for r, f in zip(sums, flow) for j, w in sorted(f.items())], "pattern string, source string, words long")
    words = [0] * len(names)
    for f in flow:
        for j, w in f.items():
            words[j] += w
    got = [(s, size[s], target[s], words[j]) for j, s in enumerate(names)]

    by_pattern = F.broadcast if len(sums) <= FEW_PATTERNS else lambda df: df  # a row a pattern
    want = sized.join(by_pattern(plan), "pattern")
    one, two = F.substring("key", 1, 3), F.substring("key", 4, 3)
    open_ = want.where("more > 0")
    first = _cut(open_.groupBy("pattern", "more", one.alias("one")).agg(F.sum("size").alias("words")), "one", F.lit(0))
    inner = open_.withColumn("one", one).join(first, ["pattern", "one"]).groupBy("pattern", "more", "before", "one", two.alias("two")).agg(F.sum("size").alias("words"))
    second = _cut(inner, "two", F.col("before"), "one")
    cut = scratch.keep(second, "cut").withColumnRenamed("before", "ahead")  # a row for a pattern at most
    place = F.concat(one, two)
    told = want.join(by_pattern(cut.select("pattern", "ahead", F.concat("one", "two").alias("at"))), "pattern", "left").withColumn("place", place)
    edge = told.where("place = at").withColumn(
        "run", F.col("ahead") + F.sum("size").over(Window.partitionBy("pattern").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    )
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - (F.col("run") - F.col("size")))))
    rest = told.where("at IS NULL OR place <> at").withColumn("extra", F.when(F.col("place") < F.col("at"), F.col("size")).otherwise(F.lit(0)))
    cols = ["doc_id", "size", "pattern", (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken")]
    return rest.select(*cols).unionByName(edge.select(*cols)), flows, got


def _cut(sums: DataFrame, bucket: str, before: Column, *more: str) -> DataFrame:
    """The bucket of each pattern in which the running sum of words reaches `more`, and the words ahead of it."""
    run = F.sum("words").over(Window.partitionBy("pattern").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("run", before + run).where("run >= more AND run - words < more").select("pattern", *more, bucket, (F.col("run") - F.col("words")).alias("before"))
