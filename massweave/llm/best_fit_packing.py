"""Operator 1: best-fit packing of token sequences, planned over length counts.

Texts become token ids followed by id 0; longer ones than a sequence are cut, the first piece
taking the rest. Only the counts of lengths (at most ``max_len`` numbers) reach the driver, where
best fit decreasing runs over whole ranges of equal sequences: an entry of the plan says that the
pieces of ranks r.. of a length go m to a sequence into sequences b.. at an offset. Pieces learn
their rank within their length from counts by (task, length) and take the slot by a join; the
plan has an entry for each length and remaining room at most, so its size doesn't follow the rows.

Cases: null and empty texts are the single id 0. Repeated rows are packed each. An empty table
gives an empty result. Ties of equal lengths are broken by place in the written table, so any
of several equally good packings may result. Texts are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massweave.llm.common import checked_join, documents, in_slices, small, written

MAX_LEN = 2048
#: Texts of other characters than these are left to the tokenizers library itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """text -> uint32 ids. The vocabulary's ranks encode plain texts, with the same ids several times faster."""
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact = Tokenizer.from_file(path)
    ranks_path = re.sub(r"\.json$", ".tiktoken", path)
    fast = None
    if os.path.exists(ranks_path):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(text: str) -> np.ndarray:
        if fast is not None and "<|" not in text and PLAIN.fullmatch(text):
            return np.frombuffer(fast.encode_to_tiktoken_buffer(text, set()), np.uint32)
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % max_len or min(n, max_len)
    return [(0, first)] + [(s, max_len) for s in range(first, n, max_len)]


def pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, seen, task = encoder(path), [0] * (max_len + 1), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                got = np.append(ids(text) if text else np.empty(0, np.uint32), np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(got), max_len)):
                    out.append((doc_id, k, start, length, zlib.crc32(got[start : start + length].tobytes()), task, seen[length]))
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=[x.split()[0] for x in PIECES.split(", ")])

    return in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: (length, first rank, end rank, pieces a sequence, first sequence, offset)."""
    entries, rooms, open_at, sequences = [], [], {}, 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, first, n = max_len, sequences, -(-left // (max_len // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                entries.append((length, rank, rank + full * each, each, first, max_len - room))
                rank, left = rank + full * each, left - full * each
                keep(room - each * length, first, full)
            if full < n:
                if left:
                    entries.append((length, rank, rank + left, left, first + full, max_len - room))
                    keep(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                keep(room, first + full, n - full)
    return entries


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cuts = written(pieces(docs, path or tokenizer_path(), max_len), "pieces")
    by_task = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, max_len), "p_length long, p_from long, p_to long, p_each long, p_first long, p_offset long")
    ranked = checked_join(cuts, before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan has at most an entry for each length and room, whatever the rows; it is broadcast if it is small.
    slots = F.broadcast(slots) if small(slots) else slots
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to"))
    nth = F.col("rank") - F.col("p_from")
    return ranked.join(slots, fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_first") + F.floor(nth / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + nth % F.col("p_each") * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
