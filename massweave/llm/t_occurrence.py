"""Operator 6: n-gram Jaccard join by T-occurrence search.

A text is its set of distinct word shingles (64-bit hashes). Texts of equal sets form a class, and
only one of a class goes on. To be similar, two sets must share a number of tokens in their
prefixes, the sets' smallest hashes; within the prefixes rare tokens come first, so that the inverted
lists which every text has in common are searched last, and mostly not at all. What passes the
size and position filters is searched exactly: against the members of a candidate component, a
local index of whole sets answers T-occurrence queries with DivideSkip - short lists are merged on
a heap with skips, long ones are probed by binary search (lists of one member alone are merged by counting).

The search runs twice. First each list's texts against the list's most central text: similar ones are links,
those of half the similarity loose links, which only gather texts that are searched together. Then texts
against the loose groups that they meet in a list, in blocks; a block keeps the components it knows and
returns a link only between two of them. So no link between components is lost, but a group is never
expanded into its pairs, even where its texts stand on both sides of the limit.

Cases: null texts and texts without words have an empty set and link with nothing; fewer words than
a shingle are one token. Repeated rows are one class. A null doc_id is not a component's
number unless all its texts' ids are null. Texts are read whole; lists, groups and queries are
joined and dealt in blocks, so none has to fit one task.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import WORD, checked_join, documents, driver_released, dropped, in_slices, written
from massweave.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Prefixes hold a tenth of the set more than needed, so that as many frequent tokens can be left out.
SPARE = 10
#: Sets that share so much belong to one group for the search.
LOOSE_PERCENT = 50
#: Texts of a group, and queries against it, that meet in one search, and their tokens, about.
BLOCK, BLOCK_TOKENS = 1000, 300_000
#: Rows and tokens of a task of the search, about.
TASK_ROWS, TASK_TOKENS = 1500, 1_500_000
#: Parts that the rows of one group are dealt to where they meet a row of the group.
SALT = 16
WORDS = re.compile(WORD.encode())
TASK_WORDS = 300_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts; word hashes are kept within a task."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        try:
            h = np.array(list(map(known.__getitem__, words)), np.uint64)
        except KeyError:
            if len(known) > TASK_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array(list(map(known.__getitem__, words)), np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out + h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(mixed(out).view(np.int64))


def at_least(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any similar set."""
    return -(-percent * n // 100)


def spare(n):
    return max(1, n // SPARE)


def prefix_size(n: int, percent: int) -> int:
    return n - at_least(n, percent) + spare(n) if n else 0


def overlap(n: int, m: int, percent: int) -> int:
    """Tokens that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def sets(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """row, doc_id, th (hash of the text), n, h1, h2 (of the set), prefix."""
    kinds = "row long, doc_id long, th long, n long, h1 long, h2 long, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, of = TaskContext.get().partitionId() << 36, Shingles(size)
        for batch in batches:
            ns, h1, h2, prefixes = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = of(text)
                u = s.view(np.uint64)
                ns.append(len(s))
                h1.append(int(mixed(u + np.uint64(1)).sum().view(np.int64)) if len(s) else 0)
                h2.append(int(mixed(u ^ np.uint64(0x5555555555555555)).sum().view(np.int64)) if len(s) else 0)
                prefixes.append(s[: prefix_size(len(s), percent)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(ns, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["row", "doc_id", "th", "n", "h1", "h2", "prefix"],
            )
            row += n

    return in_slices(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, kinds)


def ceil_share(n: Column, percent: int) -> Column:
    return ((n * percent + 99) / 100).cast("long")


def spare_of(n: Column) -> Column:
    return F.greatest(F.lit(1), (n / SPARE).cast("long"))


def prefix_of(n: Column, percent: int) -> Column:
    return n - ceil_share(n, percent) + spare_of(n)


def inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """token, cid, n, i: the lists to search. i: the token's place in the text's prefix, rare tokens first.

    A similar pair shares a known number of prefix tokens, so all but so many of a text's most
    frequent ones can be left out. Tokens that one text has alone are no lists.
    """
    posts = classes.select("cid", "n", F.explode("prefix").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = posts.join(shared, "token").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    alone = prefix_of(F.col("n"), percent) - F.size("own")
    least_shared = spare_of(ceil_share(F.col("n"), percent))
    kept = F.greatest(F.lit(0), prefix_of(F.col("n"), percent) - least_shared + 1 - alone).cast("int")
    rows = own.select("cid", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), F.least(kept, F.size("own")))).alias("k", "t"))
    return rows.select(F.col("t.token").alias("token"), "cid", "n", (F.col("alone") + F.col("k")).alias("i"))


def common_prefix(n: Column, m: Column, percent: int) -> Column:
    """Tokens that similar sets of n and m have in common in their prefixes, at least."""
    shares = F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))
    p, q = prefix_of(n, percent), prefix_of(m, percent)
    return F.greatest(F.least(spare_of(n), spare_of(m)), F.least(shares - n + p, shares - m + q))


def possible(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m whose first common list is at places i and j can be similar."""
    p, q = prefix_of(n, percent), prefix_of(m, percent)
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.least(p - i, q - j) >= common_prefix(n, m, percent))


def last_places(sizes: DataFrame, percent: int) -> DataFrame:
    """n, last: the last place of a prefix of n at which a list can be the first that it shares with a similar set of n or more."""
    n = F.col("n")
    larger = F.sequence(n, F.floor(n * 100 / percent))
    return sizes.select("n", (prefix_of(n, percent) - F.array_min(F.transform(larger, lambda m: common_prefix(n, m, percent)))).alias("last"))


def divide_skip(lists: list[list[int]], least: int, weight: float = 0.0085) -> Iterator[tuple[int, int]]:
    """(number, occurrences) of the numbers that occur in ``least`` of the sorted lists or more."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least or least < 1:
        return
    longest = len(lists[-1])
    if longest == 1:
        # Nothing to skip to in lists of one number: merging them is counting.
        yield from ((x, n) for x, n in Counter(x[0] for x in lists).items() if n >= least)
        return
    n_long = min(least - 1, int(least / (weight * np.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need = least - n_long
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            count = len(popped)
            for left, x in zip(range(len(long), 0, -1), long):
                if count + left < least:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            if count >= least:
                yield top, count
            target = top + 1
        else:
            # Not enough lists stand at this number: pop until one more could be, and skip to there.
            for _ in range(min(need - 1 - len(popped), len(heap))):
                popped.append(heapq.heappop(heap))
            target = heap[0][0] if heap else None
        for _, k, at in popped:
            if target is None:
                continue
            x = short[k]
            at = bisect_left(x, target, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], k, at))


def search_block(members: list[tuple[int, int, np.ndarray]], queries: list[tuple[int, int, np.ndarray]], percent: int, loose: int = LOOSE_PERCENT) -> list[tuple[int, int, bool]]:
    """(query, member, similar): links that join components (sides: number, component, tokens). Against one member, loose links too."""
    out = []
    single = len(members) == 1
    least_percent = loose if single else percent
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while (d := up.get(c, c)) != c:
            up[c] = c = up.get(d, d)
        return c

    index: dict[int, list[int]] = {}
    members = sorted(members, key=lambda m: len(m[2]))
    for k, (_, _, b) in enumerate(members):
        for t in b.tolist():
            index.setdefault(t, []).append(k)
    sizes = [len(b) for _, _, b in members]
    for x, c, a in queries:
        n = len(a)
        low, high = bisect_left(sizes, at_least(n, least_percent)), bisect_left(sizes, n * 100 // least_percent + 1)
        if low == high:
            continue
        lists = []
        for t in a.tolist():
            own = index.get(t)
            if own:
                if low or high < len(sizes):
                    own = own[bisect_left(own, low) : bisect_left(own, high)]
                lists.append(own)
        for k, count in divide_skip(lists, overlap(n, sizes[low], least_percent)):
            if single:
                out.append((x, members[k][0], count >= overlap(n, sizes[k], percent)))
            elif count >= overlap(n, sizes[k], percent) and (one := top(c)) != (other := top(members[k][1])):
                up[max(one, other)] = min(one, other)
                out.append((x, members[k][0], True))
    return out


def meetings(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(x, c, g): texts, their components, and the groups that they meet in a list and may be similar to.

    Of a similar pair the smaller set has the first shared token early enough for the set of its size or more that
    asks for the fewest common prefix tokens; one side of each join has only such entries. A group stands in a list with one
    entry for each size of its texts, so no pairs of texts are made. Smaller groups ask larger ones, and within
    a group all components but the largest ask.
    """
    # Written: a filter pushed below the distinct would evaluate the places for every row.
    last = written(last_places(lists.select("n").distinct(), percent), "sizes")
    here = checked_join(lists.join(placed, "cid"), last, "n").withColumn("early", F.col("i") <= F.col("last"))

    def groups(rows: DataFrame) -> DataFrame:
        sized = rows.groupBy("token", "g", "k", F.col("n").alias("m")).agg(F.min("i").alias("j"), F.min("c").alias("low"), F.max("c").alias("high"))
        return sized.groupBy("token", F.col("g").alias("d"), F.col("k").alias("l")).agg(F.collect_list(F.struct("m", "j")).alias("sizes"), F.min("low").alias("low"), F.max("high").alias("high"))

    def asked(rows: DataFrame, there: DataFrame, ordered) -> DataFrame:
        other = (F.col("g") != F.col("d")) & ((F.col("k") < F.col("l")) | ((F.col("k") == F.col("l")) & (F.col("g") > F.col("d"))))
        same = (F.col("g") == F.col("d")) & ~F.col("main") & ((F.col("low") != F.col("c")) | (F.col("high") != F.col("c")))
        near = F.exists("sizes", lambda e: ordered(F.col("n"), e["m"]) & possible(F.col("n"), F.col("i"), e["m"], e["j"], percent))
        return rows.join(there, "token").where((other | same) & near).select(F.col("cid").alias("x"), "c", F.col("d").alias("g"))

    early = here.where("early")
    return asked(here, groups(early), lambda n, m: n >= m).union(asked(early, groups(here), lambda n, m: n <= m)).distinct()


def whole_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """cid, tokens of the classes in ``needed`` (cid, th, h1, h2), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, done = Shingles(size), set()
        for batch in batches:
            h1, h2, tokens = [], [], []
            for text, th in zip(batch.column("text").to_pylist(), batch.column("th").to_pylist()):
                if th in done:
                    continue
                done.add(th)
                s = of(text)
                u = s.view(np.uint64)
                h1.append(int(mixed(u + np.uint64(1)).sum().view(np.int64)))
                h2.append(int(mixed(u ^ np.uint64(0x5555555555555555)).sum().view(np.int64)))
                tokens.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["h1", "h2", "tokens"])

    texts = checked_join(docs.select("text", F.xxhash64("text").alias("th")), needed.select("th").distinct(), "th", "left_semi")
    found = in_slices(texts, run, "h1 long, h2 long, tokens array<long>")
    return checked_join(found, needed.select("cid", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["cid"]).select("cid", "tokens")


def search(queries: DataFrame, placed: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(u, v, similar): links of the queries (x, c, g) to members of group g. placed: cid, c, g; tokens: cid, n, tokens."""

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        own = rows.join(tokens.select("cid", "n"), "cid").groupBy("g").agg(F.count("*").alias(f"{name}_rows"), F.sum("n").alias(f"{name}_mass"))
        return own.withColumn(name, F.greatest(F.ceil(F.col(f"{name}_rows") / BLOCK), F.ceil(F.col(f"{name}_mass") / BLOCK_TOKENS)))

    asking = queries.withColumnRenamed("x", "cid")
    plan = written(blocks(asking, "qb").join(blocks(placed, "mb"), "g"), "plan")
    meet = lambda kind: F.sum(F.col(f"qb_{kind}") * F.col("mb") + F.col(f"mb_{kind}") * F.col("qb"))
    rows, mass = plan.agg(meet("rows"), meet("mass")).first()
    groups = max(8, -(-(rows or 0) // TASK_ROWS), -(-(mass or 0) // TASK_TOKENS))
    # Blocks of members meet blocks of queries: each row goes to as many tasks as the other side has blocks.
    # A group's one row of the plan is there in SALT copies, so that a large group's rows don't meet it in one task.
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    copies = plan.select("g", "qb", "mb", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT)).cast("int")).join(copies, ["g", "salt"])
    m = dealt(placed).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("mb"))).withColumn("q", every("qb")).select("g", "b", "q", "cid", "c", F.lit(False).alias("asks"))
    q = dealt(asking).withColumn("q", F.pmod(F.xxhash64("cid"), F.col("qb"))).withColumn("b", every("mb")).select("g", "b", "q", "cid", "c", F.lit(True).alias("asks"))
    both = m.union(q).join(tokens.select("cid", "tokens"), "cid").withColumn("task", F.pmod(F.xxhash64("g", "b", "q"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, bool]] = []
        for _, part in pdf.groupby(["g", "b", "q"], sort=False):
            sides = ([], [])
            for cid, c, asks, t in zip(part.cid, part.c, part.asks, part.tokens):
                sides[asks].append((cid, c, t))
            if sides[0] and sides[1]:
                out += search_block(*sides, percent)
        return pd.DataFrame(out, columns=["u", "v", "similar"]).astype({"u": "int64", "v": "int64", "similar": "bool"})

    return both.groupBy("task").applyInPandas(run, "u long, v long, similar boolean")


def grouped(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The nodes (cid) with the number of their component."""
    return nodes.join(components(links.select("u", "v")).select(F.col("v").alias("cid"), F.col("c").alias(name)), "cid", "left").withColumn(name, F.coalesce(name, "cid"))


def placement(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cid, c, g, k, main: a text's component, its loose group and that's size, and if the component is the group's largest."""
    both = written(grouped(grouped(nodes, links.where("similar"), "c"), links, "g"), "placed")
    # Written: in a stage of its own, the join's rows of a large group can be split.
    per = written(both.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("k"), F.max(F.struct("n", "c"))["c"].alias("main")), "groups")
    return both.join(per, "g").select("cid", "c", "g", "k", (F.col("c") == F.col("main")).alias("main"))


def join_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = written(sets(docs, percent, size), "sets")
    full = rows.where("n > 0")
    classes = written(full.groupBy("h1", "h2").agg(F.min("row").alias("cid"), F.min("doc_id").alias("low")), "classes")
    first = checked_join(full, classes.select(F.col("cid").alias("row")), "row", "left_semi").withColumnRenamed("row", "cid")
    lists = written(inverted_lists(first, percent), "lists")
    # The first search: texts of a list against the one with the fewest rarer tokens, the most central of near copies.
    head = lists.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("i", "cid", "n")).alias("h")).where("df > 1").select("token", F.col("h.cid").alias("c"), F.col("h.n").alias("m"), F.col("h.i").alias("j"))
    met = lists.join(head, "token").where((F.col("cid") != F.col("c")) & possible(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))
    queries = written(met.select(F.col("cid").alias("x"), F.col("cid").alias("c"), F.col("c").alias("g")).distinct(), "queries")
    involved = lists.select("cid").distinct()
    needed = written(checked_join(first.select("cid", "th", "h1", "h2"), involved, "cid", "left_semi"), "needed")
    tokens = written(whole_sets(docs, needed, size).withColumn("n", F.size("tokens").cast("long")), "tokens")
    alone = needed.select("cid", F.col("cid").alias("c"), F.col("cid").alias("g"))
    near = written(search(queries, alone, tokens, percent), "found")
    dropped(queries)
    driver_released(docs.sparkSession)
    # Then against the groups that the links found make.
    placed = written(placement(needed.select("cid"), near), "placed")
    queries = written(meetings(lists, placed, percent), "queries")
    links = written(near.union(search(queries, placed.select("cid", "c", "g"), tokens, percent)).where("similar").select("u", "v"), "found")
    dropped(queries, near, placed)
    ends = components(links)
    dropped(tokens, needed, lists)
    driver_released(docs.sparkSession)
    named = checked_join(classes, ends.withColumnRenamed("v", "cid"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component"))
    named = written(checked_join(named, lowest, "c").select("h1", "h2", "component"), "named")
    out = checked_join(rows.select("doc_id", "n", "h1", "h2"), named, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest doc_id. Rows without an id stay."""
    own = join_components(docs)
    keep = written(own.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("_n")), "kept")
    rows = checked_join(docs, keep.where("_n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    again = keep.where("_n > 1").select("doc_id")
    if again.take(1):
        rows = rows.union(checked_join(docs, again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
    return rows.union(docs.where(F.col("doc_id").isNull()))


def op6_t_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir))


#: The same rows by comparing all pairs of classes that share a shingle.
ORACLE_SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
shingles AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END)) AS s FROM words),
keyed AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM shingles),
classes AS MATERIALIZED (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k),
posts AS MATERIALIZED (SELECT id, n, unnest(s) AS token FROM classes),
links AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM posts a JOIN posts b ON a.token = b.token AND a.id < b.id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
 GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(id, c) AS (SELECT id, id FROM classes UNION SELECT r.id, e.v FROM reached r JOIN both_ways e ON e.u = r.c),
low AS (SELECT id, min(c) AS c FROM reached GROUP BY id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(low.c, d.doc_id) AS component_id
FROM keyed d LEFT JOIN classes ON classes.k = d.k AND d.n > 0 LEFT JOIN low ON low.id = classes.id"""
