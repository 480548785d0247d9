"""Operator 13: importance resampling of documents towards a target corpus, by hashed n-gram counts.

Two passes over Arrow batches. The first gives one vector a partition, np.bincount of its features' buckets;
treeReduce adds them, for the raw corpus and for the target. The gain of a bucket is the logarithm of its
smoothed probability in the target over that in the corpus. The second pass gathers the broadcast gains and
sums them by document, with bincount's weights. Gumbel noise of a hash of the document's id makes the highest
scores a sample without replacement. Ranks come from a range-partitioned sort: each partition numbers its
rows, and the counts of the partitions before it (one number a partition) are added.

Cases: null and empty texts have no features and weight 0. A null id hashes as the empty text and loses ties.
Equal rows get a rank each. With no features in the corpus or the target, gains follow from the smoothing
alone. Empty tables give an empty result. Other columns are ignored, whatever their names. Texts are read
whole, in parts that end at a word's end.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import crc_sql, documents, in_slices, shared, table, written

BUCKETS, NGRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, (1, 1), 20, 10, 2024
#: Bytes of a part of a text, and features whose buckets a task remembers.
PART, REMEMBERED = 1 << 20, 500_000
#: Bytes as they count in words: A-Z in lower case, separators as spaces.
FOLDED = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else b + 32 if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))


class Buckets(dict):
    """feature -> bucket; forgets when it grows."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = at = zlib.crc32(feature) % self.n
        return at


def features(text: str | None, buckets: Buckets, lo: int, hi: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the features, and number of words, of each part of a text."""
    data, at, before = (text or "").encode().translate(FOLDED), 0, []
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        words = before + data[at:end].split()
        found = []
        for n in range(lo, hi + 1):
            starts = range(max(0, len(before) - n + 1), len(words) - n + 1)
            found.extend(map(buckets.__getitem__, words[len(before) :] if n == 1 else (b" ".join(words[i : i + n]) for i in starts)))
        yield np.array(found, np.int64), len(words) - len(before)
        before = words[max(0, len(words) - hi + 1) :] if hi > 1 else []
        at = end


def totals(texts: DataFrame, n: int, ngrams: tuple[int, int]) -> np.ndarray:
    """How many features of the column text fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, sums = Buckets(n), np.zeros(n, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for found, _ in features(text, buckets, *ngrams):
                    sums += np.bincount(found, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    vectors = in_slices(texts.select("text"), run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"], np.int64))
    # Without partitions there is nothing to reduce.
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(n, np.int64)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of a bucket's smoothed share in the target over that in the corpus, rounded down."""
    s_all, t_all = float(own.sum()) + len(own), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(own.tolist(), target.tolist())], np.float64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def rated(docs: DataFrame, gain, ngrams: tuple[int, int], seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row. ``gain``: the broadcast gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gain.value
        buckets = Buckets(len(of))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            weight, n_features, n_words = (np.zeros(len(ids), np.int64) for _ in range(3))
            held, rows, waiting = [], [], 0

            def add() -> None:
                at = np.repeat(np.array(rows, np.int64), [len(x) for x in held])
                weight[:] += np.bincount(at, weights=of[np.concatenate(held)], minlength=len(ids)).astype(np.int64)
                n_features[:] += np.bincount(at, minlength=len(ids))

            for k, text in enumerate(batch.column("text").to_pylist()):
                for found, words in features(text, buckets, *ngrams):
                    n_words[k] += words
                    held.append(found)
                    rows.append(k)
                    waiting += len(found)
                    if waiting > REMEMBERED:
                        add()
                        held, rows, waiting = [], [], 0
            if held:
                add()
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; the rank of rows that aren't drawn is null."""
    spark = docs.sparkSession
    gain = gains(totals(docs, buckets, ngrams), totals(target, buckets, ngrams))
    rows = written(rated(docs, shared(spark, gain), ngrams, seed), "rated")
    fit = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row's number in its partition is the lower half of this id.
    numbered = rows.where(fit).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = written(numbered.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    sizes = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, n = [], 0
    for part in sorted(sizes):
        before.append((part, n))
        n += sizes[part]
    # One row a partition.
    before = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    drawn = numbered.join(before, "_part").select("doc_id", "n_features", "weight", "score", F.when(place <= percent * n // 100, place).alias("rank"))
    return drawn.union(rows.where(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = f"""WITH texts AS (SELECT doc_id, 0 AS target, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
words AS MATERIALIZED (SELECT doc_id, target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts),
bucket_of AS MATERIALIZED (SELECT w, {crc_sql("w")} % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM words)),
counts AS MATERIALIZED (SELECT b, count(*) FILTER (target = 0)::DOUBLE AS s, count(*) FILTER (target = 1)::DOUBLE AS t FROM words JOIN bucket_of USING (w) GROUP BY b),
gains AS MATERIALIZED (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM counts),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN bucket_of USING (w) JOIN gains USING (b) WHERE target = 0 GROUP BY doc_id),
rated AS MATERIALIZED (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
 + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents d LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM rated WHERE n_features >= {LEAST_WORDS})
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * fit // 100 THEN place END AS rank FROM rated r LEFT JOIN placed USING (doc_id)"""
