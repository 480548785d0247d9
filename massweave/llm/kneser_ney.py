"""Operator 10: toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary training documents. Their highest
order is counted by class; all lower orders are continuation counts (distinct left neighbours) that
both share, so that an expression rare in either class falls back to the same distribution. Counts
cover every labelled row that isn't held out. They are made in Spark, keyed by the exact
symbols: the model has a row for each distinct n-gram and context and grows with the corpus. Up to ``TASK_GRAMS``
n-grams are smoothed in one task, more by joins, with the same formulas.

For scoring it reduces to the logarithm of toxic over ordinary probability of each n-gram that was
seen, and of each context for all that wasn't seen after it (there the shared part cancels). Up to
``MODEL_ROWS`` rows are broadcast; a larger model is joined with the n-grams of the distinct words.

A document is compared at several lengths, each as a log-likelihood difference over its length: the
whole text by symbols, its 1, 2, 4 and 8 most suspicious words by words, and the logarithm of the word
count, as larger texts have larger maxima. A logistic curve turns the comparisons into a score.
It is fitted on at most a fifth of each class's distinct texts and ``CURVE_ROWS`` in all, rated by
counts without them (a class's only text is in both). N-grams don't cross words: what is toxic only
as a phrase is seen through its words.

Cases: empty and null texts get the curve's value for no evidence. Without labels of both classes
every score is 0. Repeated rows give repeated results; a doc_id labelled twice counts with its
larger label. Labels, lang, source and doc_id aren't read for a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import WORD, checked_join, crc_mod, documents, driver_released, dropped, filtered, in_slices, map_rows, released, shared, table, written

FOLDS, HELD_OUT = 5, 0
#: Symbols are code points; three stand in ``lo``, the last one lowest, those before them in ``hi``.
ORDER, BITS = 6, 21
MASK = (1 << BITS) - 1
DISCOUNT = 0.75
#: The shared distribution's weight in every context: those seen less than a few times lean on it.
PRIOR = 2.0
#: A model of more rows (of 12 bytes) isn't broadcast but joined; of more n-grams it isn't smoothed in one task but by joins.
MODEL_ROWS, TASK_GRAMS = 8_000_000, 2_000_000
CURVE_ROWS = 20_000
#: Part of a class's distinct texts that the curve is fitted on, and the texts below which they are counted off one by one.
CURVE_PART, FEW = 5, 1000
#: Numbers of most suspicious words that are compared.
WORST = (1, 2, 4, 8)
FEATURES = len(WORST) + 2
#: A task keeps so many distinct words before it passes their n-grams on, or forgets their ratios.
TASK_WORDS = 100_000
#: What a task works on at a time: texts whose words it lists, words whose symbols it lays out.
PART_TEXTS, PART_WORDS = 100, 25_000
WORDS = re.compile(WORD)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case code points of all words after each other with edges (0) between them, and where each begins. Digits are one symbol."""
    joined = ("\x00" + "\x00".join(words) + "\x00").lower() if words else "\x00"
    out = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out[(out >= 48) & (out < 58)] = 48
    return out, np.flatnonzero(out == 0)


def grams(codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo) of the n-gram that ends at each symbol but the first edge, its context never before the word, and its word."""
    word = np.cumsum(codes == 0) - 1
    word = np.where(codes == 0, word - 1, word)
    begin = edges[np.clip(word, 0, len(edges) - 1)]
    hi, lo = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        at = np.arange(len(codes)) - k
        own = np.where(at >= begin, codes[np.maximum(at, 0)], 0)
        if k < 3:
            lo |= own << (BITS * k)
        else:
            hi |= own << (BITS * (k - 3))
    return hi[1:], lo[1:], word[1:]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an n-gram, for look-ups: of ten million, two are equal once in some hundred thousand models."""
    return mixed(lo.view(np.uint64) + mixed(hi.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


class Ratios:
    """Hashes, given in order, with a value each; ``find`` gives the values of others, and whether they are there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = np.append(keys, np.uint64(2**64 - 1)), np.append(values, np.float32(0))
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.cumsum(counts) - counts

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        on = np.flatnonzero(self.keys[at] < wanted)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < wanted[on]]
        return self.values[at], self.keys[at] == wanted


def count_grams(rows: DataFrame) -> DataFrame:
    """label, hi, lo, n over all (text, label) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def passed() -> Iterator[pa.RecordBatch]:
            for label, words in enumerate(seen):
                every, counts = list(words), np.fromiter(words.values(), np.float64, len(words))
                words.clear()
                for at in range(0, len(every), 2 * PART_WORDS):
                    hi, lo, word = grams(*symbols(every[at : at + 2 * PART_WORDS]))
                    _, first, place = np.unique(key(hi, lo), return_index=True, return_inverse=True)
                    n = np.bincount(place, weights=counts[at + word]).astype(np.int64)
                    for k in range(0, len(first), 100_000):
                        own = first[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), label), pa.int32()), pa.array(hi[own]), pa.array(lo[own]), pa.array(n[k : k + 100_000])], names=["label", "hi", "lo", "n"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[label].update(w.replace("\x00", " ") for w in WORDS.findall(text or ""))
            if sum(map(len, seen)) > TASK_WORDS:
                yield from passed()
        yield from passed()

    return in_slices(rows.select("text", "label"), run, "label int, hi long, lo long, n long").groupBy("label", "hi", "lo").agg(F.sum("n").alias("n"))


def suffix(order: int) -> list[Column]:
    """(hi, lo) of the last symbols of an n-gram."""
    hi, lo = F.col("hi"), F.col("lo")
    if order > 3:
        return [hi.bitwiseAND((1 << BITS * (order - 3)) - 1).alias("hi"), lo.alias("lo")]
    return [F.lit(0).cast("long").alias("hi"), lo.bitwiseAND((1 << BITS * order) - 1).alias("lo")]


def context() -> list[Column]:
    """(chi, clo) of an n-gram without its last symbol."""
    hi, lo = F.col("hi"), F.col("lo")
    return [F.shiftright(hi, BITS).alias("chi"), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(hi.bitwiseAND(MASK), 2 * BITS)).alias("clo")]


def shared_probability(top: DataFrame) -> DataFrame:
    """hi, lo, p of all n-grams of one order less than the top's: interpolated Kneser-Ney over distinct left neighbours."""
    levels = [top]
    for order in range(ORDER - 1, 0, -1):
        # A gram whose context was cut at the word's edge keeps its zeros; each counts as one neighbour.
        levels.append(levels[-1].groupBy(*suffix(order)).agg(F.count("*").alias("s")))
    p = None
    for order, level in enumerate(reversed(levels[1:]), start=1):
        own = level.select("*", *context())
        around = own.groupBy("chi", "clo").agg(F.sum("s").alias("d"), F.count("*").alias("e"))
        if p is None:
            # Below single symbols all are equally likely: those seen, and one for the others.
            own = own.join(around, ["chi", "clo"]).withColumn("below", 1 / (F.col("e") + 1))
        else:
            below = [c.alias(f"b{n}") for c, n in zip(suffix(order - 1), ("hi", "lo"))]
            own = own.select("*", *below).join(p.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), F.col("p").alias("below")), ["bhi", "blo"]).join(around, ["chi", "clo"])
        p = own.select("hi", "lo", (F.greatest(F.col("s") - DISCOUNT, F.lit(0.0)) / F.col("d") + DISCOUNT * F.col("e") / F.col("d") * F.col("below")).alias("p"))
    return p


def numbered(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct n-grams, and the number of each row's."""
    _, first, number = np.unique(key(hi, lo), return_index=True, return_inverse=True)
    return first, number


def shortened(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams without their last symbol."""
    return hi >> BITS, lo >> BITS | (hi & MASK) << 2 * BITS


def smoothed(hi: np.ndarray, lo: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind, hi, lo, ratio as ``ratios`` has them, of all n-grams at once."""
    levels, h, lw = [], hi, lo
    for order in range(ORDER - 1, 0, -1):
        h, lw = (h & ((1 << BITS * (order - 3)) - 1), lw) if order > 3 else (np.zeros_like(h), lw & ((1 << BITS * order) - 1))
        first, number = numbered(h, lw)
        h, lw = h[first], lw[first]
        levels.append((h, lw, np.bincount(number), number))
    p = above = None
    for h, lw, s, number in reversed(levels):
        _, around = numbered(*shortened(h, lw))
        d, e = np.bincount(around, weights=s)[around], np.bincount(around)[around]
        p = np.maximum(s - DISCOUNT, 0) / d + DISCOUNT * e / d * (1 / (e + 1) if above is None else p[above])
        above = number
    chi, clo = shortened(hi, lo)
    first, around = numbered(chi, clo)
    c = [np.bincount(around, weights=n) for n in (n0, n1)]
    share = [np.minimum(DISCOUNT * np.bincount(around, weights=n > 0), k) + PRIOR for n, k in zip((n0, n1), c)]
    chance = [(np.maximum(n - DISCOUNT, 0) + w[around] * p[above]) / (k[around] + PRIOR) for n, w, k in zip((n0, n1), share, c)]
    unseen = share[1] / (c[1] + PRIOR) / (share[0] / (c[0] + PRIOR))
    kind = np.repeat(np.array([0, 1], np.int32), (len(hi), len(first)))
    return kind, np.append(hi, chi[first]), np.append(lo, clo[first]), np.log(np.append(chance[1] / chance[0], unseen)).astype(np.float32)


def smoothed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``smoothed`` over the rows (hi, lo, n0, n1) of one task."""
    every = pa.Table.from_batches(batches, pa.schema([(n, pa.int64()) for n in ("hi", "lo", "n0", "n1")]))
    if every.num_rows:
        got = smoothed(*(every.column(n).to_numpy() for n in ("hi", "lo", "n0", "n1")))
        for at in range(0, len(got[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in got], names=["kind", "hi", "lo", "ratio"])


def ratios(counts: DataFrame, in_task: int = TASK_GRAMS) -> DataFrame:
    """kind, hi, lo, ratio: log of toxic over ordinary probability of n-grams seen (kind 0), and of others by context (kind 1)."""
    per = [F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(f"n{label}") for label in (0, 1)]
    top = written(counts.groupBy("hi", "lo").agg(*per), "top")
    if top.count() <= in_task:
        out = written(in_slices(top.coalesce(1), smoothed_rows, "kind int, hi long, lo long, ratio float"), "ratios")
        dropped(top)
        return out
    own = top.select("*", *context())
    around = written(own.groupBy("chi", "clo").agg(*[f(label) for label in (0, 1) for f in (lambda k: F.sum(f"n{k}").alias(f"c{k}"), lambda k: F.count(F.when(F.col(f"n{k}") > 0, 1)).alias(f"t{k}"))]), "contexts")
    share = lambda k: F.least(DISCOUNT * F.col(f"t{k}"), F.col(f"c{k}")) + PRIOR
    chance = lambda k: (F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) + share(k) * F.col("p")) / (F.col(f"c{k}") + PRIOR)
    p = shared_probability(top).withColumnsRenamed({"hi": "bhi", "lo": "blo"})
    below = [c.alias(f"b{n}") for c, n in zip(suffix(ORDER - 1), ("hi", "lo"))]
    seen = own.select("*", *below).join(p, ["bhi", "blo"]).join(around, ["chi", "clo"]).select(F.lit(0).alias("kind"), "hi", "lo", F.log(chance(1) / chance(0)).cast("float").alias("ratio"))
    unseen = around.select(F.lit(1), F.col("chi"), F.col("clo"), F.log(share(1) / (F.col("c1") + PRIOR) / (share(0) / (F.col("c0") + PRIOR))).cast("float"))
    out = written(seen.union(unseen), "ratios")
    dropped(top, around)
    return out


def held_in_memory(found: DataFrame, rows: int = MODEL_ROWS):
    """The broadcast hashes and ratios by kind, or None where the model is larger than ``rows``."""
    if found.count() > rows:
        return None
    rows = in_slices(found.select("kind", "hi", "lo", "ratio"), hashed_rows, "kind int, k long, ratio float").toArrow()
    packed = []
    for kind in (0, 1):
        own = rows.filter(pa.compute.equal(rows.column("kind"), kind))
        keys = own.column("k").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        packed.append((keys[order], own.column("ratio").to_numpy()[order]))
    return shared(found.sparkSession, tuple(packed))


def hashed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, k (hash of the n-gram), ratio: what a look-up needs."""
    for batch in batches:
        k = key(batch.column("hi").to_numpy(), batch.column("lo").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(k.view(np.int64)), batch.column("ratio")], names=["kind", "k", "ratio"])


def look_ups(packed: tuple) -> tuple[Ratios, Ratios]:
    """The look-ups of a broadcast model, which is sorted; a task only indexes it."""
    return tuple(Ratios(*own) for own in packed)


def log_ratio(model: tuple[Ratios, Ratios], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: toxic minus ordinary log-likelihood, and symbols scored."""
    hi, lo, word = grams(*symbols(words))
    value, there = model[0].find(key(hi, lo))
    rest = np.flatnonzero(~there)
    value = value.astype(np.float64)
    other, known = model[1].find(key(*shortened(hi[rest], lo[rest])))
    value[rest] = other * known
    n = len(words)
    return np.bincount(word, weights=value, minlength=n)[:n], np.bincount(word, minlength=n)[:n]


def compared(whole: np.ndarray, size: np.ndarray) -> list[float]:
    """The log-likelihood differences by length of a text whose words have these differences and sizes."""
    if not len(whole):
        return [0.0] * FEATURES
    most = max(WORST)
    top = np.sort(np.partition(whole, -most)[-most:] if len(whole) > most else whole)[::-1]
    return [20 * whole.sum() / size.sum(), *(top[:k].sum() / (5 * k) for k in WORST), math.log(len(whole)) / 5]


class Scorer:
    """Evidence of texts; words are scored once in a task, while their number is small."""

    def __init__(self, model: tuple[Ratios, Ratios]) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.whole, self.size = np.empty(0, np.float32), np.empty(0, np.float32)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for at in range(0, len(texts), PART_TEXTS):
            self.fill(out[at : at + PART_TEXTS], texts[at : at + PART_TEXTS])
        return out

    def fill(self, out: np.ndarray, texts: list[str | None]) -> None:
        split = [WORDS.findall(t.replace("\x00", " ")) if t else [] for t in texts]
        if len(self.known) > TASK_WORDS:
            self.clear()
            released()
        known = self.known
        fresh = list({w for words in split for w in words if w not in known})
        for at in range(0, len(fresh), PART_WORDS):
            part = fresh[at : at + PART_WORDS]
            whole, size = log_ratio(self.model, part)
            known.update(zip(part, range(len(known), len(known) + len(part))))
            self.whole, self.size = np.append(self.whole, whole.astype(np.float32)), np.append(self.size, size.astype(np.float32))
        for row, words in zip(out, split):
            own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            row[:] = compared(self.whole[own].astype(np.float64), self.size[own])


def joined_evidence(texts: DataFrame, found: DataFrame) -> DataFrame:
    """th, x of distinct texts (th, text): the words' ratios come by joins, for a model of any size."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for th, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist()):
                n = Counter(w.replace("\x00", " ") for w in WORDS.findall(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array([th] * len(n), pa.int64()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["th", "word", "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            hi, lo, word = grams(*symbols(words.to_pylist()))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), pa.array(hi), pa.array(lo)], names=["word", "hi", "lo"])

    once = texts.dropDuplicates(["th"])
    uses = in_slices(once, occurrences, "th long, word string, n long")
    letters = in_slices(uses.select("word").distinct(), spelled, "word string, hi long, lo long").select("*", *context())
    seen = found.where("kind = 0").select("hi", "lo", F.col("ratio").alias("a"))
    around = found.where("kind = 1").select(F.col("hi").alias("chi"), F.col("lo").alias("clo"), F.col("ratio").alias("b"))
    value = F.coalesce("a", "b", F.lit(0.0)).cast("double")
    words = letters.join(seen, ["hi", "lo"], "left").join(around, ["chi", "clo"], "left").groupBy("word").agg(F.sum(value).cast("float").alias("whole"), F.count("*").cast("float").alias("size"))
    each = uses.join(words, "word").groupBy("th").agg(F.collect_list("whole").alias("whole"), F.collect_list("size").alias("size"), F.collect_list("n").alias("n"))

    def task():
        def one(whole, size, n) -> list[float]:
            return compared(np.repeat(np.array(whole, np.float64), n), np.repeat(np.array(size, np.float64), n)) if whole else [0.0] * FEATURES

        return lambda x: {"th": x["th"], "x": [one(*v) for v in zip(x["whole"], x["size"], x["n"])]}

    return map_rows(once.select("th").join(each, "th", "left"), task, "th long, x array<double>")


def evidence(texts: DataFrame, found: DataFrame, lookups) -> DataFrame:
    """th, x of texts (th, text)."""
    if lookups is None:
        return joined_evidence(texts, found)

    def task():
        scorer = Scorer(look_ups(lookups.value))
        return lambda x: {"th": x["th"], "x": scorer.evidence(x["text"]).tolist()}

    return map_rows(texts.select("th", "text"), task, "th long, x array<double>")


def curve(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; ``each``: the rows' weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + keep, a.T @ (each * (y - p)) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def curve_limit(texts: DataFrame, n: int) -> int:
    """Hashes (u) below it are the curve's: at least one of the class's n texts."""
    if n < FEW:
        return sorted(r.u for r in texts.select("u").collect())[max(1, n // CURVE_PART) - 1] + 1
    return int(min(1 / CURVE_PART, CURVE_ROWS / 2 / n) * (1 << 30))


def text_hash() -> Column:
    return F.xxhash64("text")


def train(docs: DataFrame, labels: DataFrame, rows_in_memory: int = MODEL_ROWS, in_task: int = TASK_GRAMS) -> dict | None:
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    rows = checked_join(docs.select("doc_id", "text"), own, "doc_id").select("text", "label", text_hash().alias("th")).withColumn("u", F.pmod("th", F.lit(1 << 30)))
    texts = written(rows.select("label", "u").distinct(), "texts")
    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    limits = {label: curve_limit(texts.where(F.col("label") == label), n[label]) for label in (0, 1)}
    dropped(texts)
    held = F.col("u") < F.when(F.col("label") == 1, limits[1]).otherwise(limits[0])
    only = F.col("label").isin([label for label in (0, 1) if n[label] == 1])
    part = written(count_grams(rows.where(~held | only)), "grams")
    counts = written(part.union(count_grams(rows.where(held & ~only))).groupBy("label", "hi", "lo").agg(F.sum("n").alias("n")), "grams")
    fold = rows.where(held).dropDuplicates(["label", "u"]).select("th", "text", "label")
    found = ratios(part, in_task)
    lookups = held_in_memory(found, rows_in_memory)
    rated = evidence(fold, found, lookups).dropDuplicates(["th"]).join(fold.select("th", "label"), "th")
    got = rated.select("label", "x", "th").orderBy("label", "th").toArrow()
    y = got.column("label").to_numpy()
    each = np.array([n[label] / max(1, (y == label).sum()) for label in (0, 1)]) * len(y) / sum(n.values())
    weights, bias = curve(got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES), y.astype(np.float64), each[y])
    if lookups is not None:
        lookups.unpersist()
    driver_released(docs.sparkSession)
    found = ratios(counts, in_task)
    dropped(part, counts)
    model = {"found": found, "lookups": held_in_memory(found, rows_in_memory), "weights": weights, "bias": bias}
    driver_released(docs.sparkSession)
    return model


def chance(x: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))


def text_scores(docs: DataFrame, model: dict) -> DataFrame:
    """th, score of distinct texts by joins."""
    weights, bias = model["weights"], model["bias"]

    def task():
        return lambda x: {"th": x["th"], "score": chance(np.array(x["x"]).reshape(-1, FEATURES), weights, bias).tolist()}

    return map_rows(joined_evidence(docs.select(text_hash().alias("th"), "text"), model["found"]), task, "th long, score double")


def rate(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score of every document."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))
    lookups, weights, bias = model["lookups"], model["weights"], model["bias"]
    if lookups is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th")).join(text_scores(docs, model), "th").select("doc_id", "score")

    def task():
        scorer = Scorer(look_ups(lookups.value))
        return lambda x: {"doc_id": x["doc_id"], "score": chance(scorer.evidence(x["text"]), weights, bias).tolist()}

    return map_rows(docs.select("doc_id", "text"), task, "doc_id long, score double")


def harmless(docs: DataFrame, model: dict | None, limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score less than ``limit``."""
    if model is None:
        return docs if limit > 0 else docs.limit(0)
    lookups, weights, bias = model["lookups"], model["weights"], model["bias"]
    if lookups is None:
        toxic = text_scores(docs, model).where(F.col("score") >= limit).select(F.col("th").alias(th := max(docs.columns, key=len) + "_th"))
        return docs.join(toxic, F.xxhash64(docs["text"]) == F.col(th), "left_anti")

    def task():
        scorer = Scorer(look_ups(lookups.value))
        return lambda batch: chance(scorer.evidence(batch.column("text").to_pylist()), weights, bias) < limit

    return filtered(docs, task)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = rate(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
