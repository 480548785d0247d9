"""Operator 3: personal data by rules and by bootstrapped contexts.

Base entities come from fixed patterns. Each is a seed: the words around it induce lexical
patterns (kind, words before, words after). Candidates are the unlabelled instances: runs that look like
an identifier of a kind but fail its rules, and any other word of letters and digits that holds five
digits or an ``@``, which belongs to no kind until a pattern gives it one. Spark scores the graph of
patterns and instances in rounds until no pattern's weight changes: a pattern by the share of its instances
that are trusted, an instance by the patterns that it stands in. Candidates in patterns of high confidence
are added, so a trusted pattern proposes whatever identifier fills its slot. A context word is what the
``CONTEXT_CHARS`` characters beside the span hold of it.

Candidates of a kind are e-mail addresses spelled out (``name (at) host dot org``), dotted numbers that
aren't an address, digit groups that fail the card check and telephone numbers without a plus.

Cases: null and empty texts have no spans. A candidate that overlaps a base span is no candidate; of
several kinds for one, the kind of the pattern with the largest weight is taken, then the first kind.
Repeated rows are repeated; the graph counts distinct instances, so that copies add no
confidence. Texts are read whole in linear time; the graph holds only mentions and is joined, not collected.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from massweave.llm.common import checked_join, documents, dropped, in_slices, small, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, so a run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE = (
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]++)+"),
    re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w]|\.[0-9])"),
    re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}(?:[ .-]?[0-9]{1,3})?(?![\w]|[.-][0-9])"),
    re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\) ?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![\w]|[.-][0-9])"),
)
#: A filler of no kind: a word of these characters with so many digits, or with an @. Longer instances are keyed by their SHA-256.
FILLER = re.compile(r"(?<![^\s\"'(<\[=:])[A-Za-z0-9+][A-Za-z0-9@._%+/-]*+(?=[\s\"')>\],;:!?#&*$%]|$)")
FILLER_DIGITS, LONG, ANY = 5, 64, -1
IN_FILLER, SPACE = re.compile(r"[0-9@]"), re.compile(r"\s|$")
CONTEXT = re.compile(r"[^\s]+")
#: A pattern is trusted from this share of trusted instances on, with so many distinct seeds; weights closer than SETTLED are equal.
TRUST, SEEDS, SETTLED = 0.8, 3, 1e-6
CONTEXT_CHARS = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base entities, by kind, then start."""
    out = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = at = m.end()
        else:
            at += 1
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside the base spans and each other, earlier kinds first, those of no kind (``ANY``) last."""
    if not DIGIT.search(text) and "@" not in text and not any(x in text for x in (" at ", "at)", "at]", "at}")):
        return []
    out = []
    # Spans taken, as disjoint ranges in order.
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def candidates(k: int) -> Iterator[tuple[int, int]]:
        if k == ANY:
            end = 0
            while one := IN_FILLER.search(text, end):
                start = one.start()
                while start > end and not text[start - 1].isspace():
                    start -= 1
                end = SPACE.search(text, one.end()).start()
                for m in FILLER.finditer(text, start, end):
                    if "@" in m[0] or len(DIGIT.findall(m[0])) >= FILLER_DIGITS:
                        yield m.span()
        else:
            for m in LOOSE[k].finditer(text):
                if k != 3 or 7 <= len(DIGIT.findall(m[0])) <= 15:
                    yield m.span()

    for k in (*range(len(KINDS)), ANY):
        found = []
        for s, e in candidates(k):
            at = bisect_left(starts, e)  # the ranges before it begin before the end
            if not at or ends[at - 1] <= s:
                found.append((s, e))
        out += [(k, s, e) for s, e in found]
        if found:
            both = sorted([*zip(starts, ends), *found])
            starts, ends = [s for s, _ in both], [e for _, e in both]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the last word, the last two, and the word on either side; digits don't tell words apart."""
    left = [DIGIT.sub("0", w.lower()) for w in CONTEXT.findall(text[max(0, start - CONTEXT_CHARS) : start])[-2:]]
    right = [DIGIT.sub("0", w.lower()) for w in CONTEXT.findall(text[end : end + CONTEXT_CHARS])[:1]]
    out = []
    if left:
        out.append(f"{left[-1]} _")
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def instance(text: str) -> str:
    return text if len(text) <= LONG else hashlib.sha256(text.encode()).hexdigest()


def label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


MENTIONS = "array<struct<kind:int,start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"
SCHEMA = f"row long, doc_id long, th long, base string, mentions {MENTIONS}"


def mentions(docs: DataFrame) -> DataFrame:
    """One row a document with its base spans and all mentions; ``row`` numbers the written rows."""
    fields = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            base, found = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append(label(own))
                every = [(k, s, e, True) for k, s, e in own] + [(k, s, e, False) for k, s, e in loose_spans(text, own)]
                found.append([{"kind": k, "start": s, "end": e, "seed": seed, "instance": instance(text[s:e].lower()), "patterns": contexts(text, s, e)} for k, s, e, seed in every])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(base, pa.string()), pa.array(found, fields)], names=["row", "doc_id", "th", "base", "mentions"])
            row += n

    return in_slices(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, SCHEMA)


def trusted_patterns(edges: DataFrame, trust: float = TRUST, seeds: int = SEEDS, settled: float = SETTLED) -> DataFrame:
    """kind, pattern, weight of the patterns of high confidence, written. ``edges``: distinct kind, pattern, instance, seed.

    An instance of no kind counts in the patterns of every kind. Weights and the set of trusted patterns only grow
    from round to round, and no weight passes 1, so there comes a round in which none grows by ``settled``; it is the last.
    """
    names = edges.where("seed").select("kind", "pattern").distinct()
    # Patterns without a seed can't be trusted and needn't be followed.
    here = edges.where(F.col("kind") != ANY).join(names, ["kind", "pattern"], "left_semi")
    free = edges.where(F.col("kind") == ANY).drop("kind").join(names, "pattern").select("kind", "pattern", "instance", "seed")
    graph = written(here.union(free).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    per = graph.groupBy("kind", "pattern").agg(F.count("*").alias("all"), F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= seeds)
    per = written(per, "pattern-counts")
    good = None
    while True:
        if good is None:
            sums = per.withColumns({"sure": F.col("seeds").cast("double"), "before": F.lit(None).cast("double")})
        else:
            # An instance outside the seeds is as sure as its patterns together: 1 - prod(1 - weight).
            sure = graph.where(~F.col("seed")).join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("weight"))))).alias("found"))
            more = graph.where(~F.col("seed")).join(sure, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum("found").alias("found"))
            sums = per.join(more, ["kind", "pattern"], "left").join(good.select("kind", "pattern", F.col("weight").alias("before")), ["kind", "pattern"], "left").withColumn("sure", F.col("seeds") + F.coalesce("found", F.lit(0.0)))
        now = written(sums.where(F.col("sure") >= trust * F.col("all")).select("kind", "pattern", (F.col("sure") / (F.col("all") + 1)).alias("weight"), "before"), "patterns")
        if good is not None:
            dropped(good)
        good = now
        if not now.where(F.col("before").isNull() | (F.col("weight") - F.col("before") >= settled)).take(1):
            break
    dropped(graph, per)
    return good


def extract(docs: DataFrame, trust: float = TRUST, seeds: int = SEEDS, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """The written mentions of every document, and (row, kind, start, end) of the spans that patterns add."""
    found = written(mentions(docs), "mentions")
    each = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*").withColumn("pattern", F.explode("patterns"))
    edges = written(each.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-edges")
    good = trusted_patterns(edges, trust, seeds, settled)
    dropped(edges)
    named = good.select(F.col("kind").alias("by"), "pattern", "weight")
    hits = checked_join(each.where(~F.col("seed")), named, "pattern").where((F.col("kind") == F.col("by")) | (F.col("kind") == ANY))
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("weight", (-F.col("by")).alias("by")))["by"].alias("by"))
    return found, best.select("row", (-F.col("by")).alias("kind"), "start", "end")


def find(docs: DataFrame, trust: float = TRUST, seeds: int = SEEDS, settled: float = SETTLED) -> DataFrame:
    """row, doc_id, base (string), spans (array of kind number, start, end) of every document."""
    found, more = extract(docs, trust, seeds, settled)
    added = more.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    base = F.transform(F.filter("mentions", lambda m: m["seed"]), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return checked_join(found.select("row", "doc_id", "base", base.alias("own")), added, "row", "left").select(
        "row", "doc_id", "base", F.array_sort(F.concat("own", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("spans")
    )


def masked(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, with personal data replaced by its kind; n_chars follows where it exists."""
    found, more = extract(docs)
    # Rows of equal id and text have equal spans, so the pair finds them again; its names are none of the rows'.
    key, th, added = (max(docs.columns, key=len) + end for end in ("_id", "_th", "_spans"))
    spans = checked_join(more, found.select("row", "doc_id", "th"), "row").groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.collect_set(F.struct("kind", "start", "end")).alias(added))
    spans = written(spans, "added")
    joined = docs.join(F.broadcast(spans) if small(spans) else spans, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(th)), "left").select(*[docs[c] for c in docs.columns], added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column(added).to_pylist()):
                own = base_spans(text) if text else []
                texts.append(mask(text, own + [(m["kind"], m["start"], m["end"]) for m in more or ()]))
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            names = [n for n in batch.schema.names if n != added]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], schema=pa.schema([batch.schema.field(n) for n in names]))

    # A null text has no n_chars, whatever the column said before.
    return in_slices(joined, run, StructType([StructField(f.name, f.dataType, True) for f in docs.schema]))


def digests(found: DataFrame) -> DataFrame:
    count = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return found.select("doc_id", *count, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", name)).alias("spans"))


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with its spans replaced by their kinds; overlapping spans become one of the first's kind."""
    if text is None or not spans:
        return text
    out, end = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= end:
            out += [text[end:s], f"<{KINDS[k].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(documents(spark, sf_dir)))
