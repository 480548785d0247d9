"""Operator 12: token counts from pre-token frequencies; no token id is made for a document.

A byte-level BPE cuts a text into pre-tokens and encodes each on its own, so a text's count is the sum, over
its distinct pre-tokens, of frequency times pieces. The first pass counts in how many documents each
pre-token stands; the distinct ones are encoded once, wherever they stand. The second pass counts
frequencies by document and joins them to the pieces: the pre-tokens of most documents (at most ``KNOWN``,
found from a histogram of powers of two) travel to the tasks and are looked up there, the rest of a
document's frequencies are joined by shuffle, in which no pre-token is frequent any more. Both ways take
any number of pre-tokens.

Special strings inside a text are one token each, as the library takes them by default, and end the
pre-tokens beside them. Pre-tokens of over ``LONG`` characters are keyed by their SHA-256.

Cases: null and empty texts have 0 bytes and 0 tokens. Each row is counted on its own, so repeated rows and
null ids keep their rows. An empty table gives an empty result. Other columns are ignored, whatever their
names. Texts are read whole, in parts that end where no pre-token crosses.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.best_fit_packing import PLAIN, tokenizer_path
from massweave.llm.common import documents, in_slices, shared, written

LIMIT = 1024
#: Distinct pre-tokens that travel to all tasks at most, and characters of a key at most.
KNOWN, LONG = 500_000, 64
#: Pre-tokens that a task gathers before it passes its counts on, and characters of a part of a text.
GATHERED, PART = 300_000, 1 << 20
#: Letters and numbers of PLAIN texts (fixed values of the character database).
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PLAIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: A single space between other characters starts a pre-token.
SEAM = re.compile(r"(?<=\S) (?=\S)")


def tokenizer(path: str):
    """The library's tokenizer. Others than plain byte-level BPE, whose pre-tokens depend on nothing else, are refused."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made["pre_tokenizer"] or {}
    if made["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or made["model"].get("dropout"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
        raise ValueError(f"added tokens with conditions: {path}")
    return Tokenizer.from_file(path), sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)


def parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        seam = SEAM.search(text, at + PART)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


def counter(path: str) -> Callable[[str], tuple[Counter, int]]:
    """text -> frequencies of its pre-tokens, number of special strings in it."""
    whole, special = tokenizer(path)
    apart = re.compile("|".join(map(re.escape, special))) if special else None

    def count(text: str) -> tuple[Counter, int]:
        found: Counter = Counter()
        runs, n = [text], 0
        if apart and apart.search(text):
            runs = apart.split(text)
            n = len(runs) - 1
        for run in runs:
            for part in parts(run):
                if PLAIN.fullmatch(part):
                    found.update(PLAIN_PIECE.findall(part))
                elif part:
                    found.update(part[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(part))
        return found, n

    return count


def key(pretoken: str) -> str:
    return pretoken if len(pretoken) <= LONG else "\0" + hashlib.sha256(pretoken.encode()).hexdigest()


def distinct(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, n_docs: rows whose text has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(path), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pretoken", "n_docs"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(count(text)[0].keys() if text else ())
                if len(seen) > GATHERED:
                    yield flush()
        yield flush()

    return in_slices(docs.select("text"), run, "pretoken string, n_docs long").groupBy("pretoken").agg(F.sum("n_docs").alias("n_docs"))


def with_pieces(found: DataFrame, path: str) -> DataFrame:
    """key, n_docs, pieces of each pre-token, encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, _ = tokenizer(path)
        for batch in batches:
            texts = batch.column("pretoken").to_pylist()
            pieces = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(map(key, texts), pa.string()), batch.column("n_docs"), pa.array(pieces, pa.int64())], names=["key", "n_docs", "pieces"])

    return in_slices(found, run, "key string, n_docs long, pieces long")


def threshold(pieces: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pre-tokens stand in so many documents."""
    tiers = {r["tier"]: r["n"] for r in pieces.groupBy(F.length(F.bin("n_docs")).alias("tier")).agg(F.count("*").alias("n")).collect()}
    least, n = max(tiers, default=0) + 1, 0
    while least > 1 and n + tiers.get(least - 1, 0) <= most:
        least -= 1
        n += tiers.get(least, 0)
    return 1 << (least - 1)


def frequencies(docs: DataFrame, path: str, known) -> DataFrame:
    """row, doc_id, n_bytes, n (tokens of special strings and of known pre-tokens), rest: other keys and their frequencies."""
    rest = pa.list_(pa.struct([("key", pa.string()), ("f", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, (keys, values) = counter(path), known.value
        pieces, row = dict(zip(keys.to_pylist(), values.to_pylist())), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found, n = count(text or "")
                other = []
                for pretoken, f in found.items():
                    if (k := pieces.get(at := key(pretoken))) is None:
                        other.append({"key": at, "f": f})
                    else:
                        n += k * f
                out.append((row, doc_id, len((text or "").encode()), n, other))
                row += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["row", "doc_id", "n_bytes", "n", "rest"])

    return in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "row long, doc_id long, n_bytes long, n long, rest array<struct<key:string,f:long>>")


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, known: int = KNOWN) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    pieces = written(with_pieces(distinct(docs, path), path), "pieces")
    least = threshold(pieces, known)
    often = pieces.where(F.col("n_docs") >= least).select("key", "pieces").toArrow().combine_chunks()
    own = written(frequencies(docs, path, shared(spark, (often["key"], often["pieces"]))), "frequencies")
    rest = own.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.f").join(pieces.where(F.col("n_docs") < least), "key")
    sums = rest.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), (F.col("f") * F.col("pieces")).alias("n"))
    out = own.drop("rest").union(sums).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(documents(spark, sf_dir))
