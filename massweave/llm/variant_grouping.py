"""Operator 11: groups of spelling variants, by rolling hashes of words with a character deleted.

Two words are one edit apart if deleting one character makes them equal: of both at the same place (a
replaced character) or of the longer one alone. Prefix and suffix polynomial hashes give the hash of a word
without its i-th character by one addition, for all words of a length at once in NumPy. Keys are partitioned
by their top bits (radix) and sorted; only keys that several words share go on, and there the strings decide.
A replaced character's group holds a word for each letter of the alphabet at most and each pair of words
meets in one group, as does a pair that differs by an inserted character (of a run of equal characters only
the first is deleted). So counts of near words and the most frequent of them add up by group, without pairs.

Every step from a word to its form multiplies the count by ``RATIO`` at least, so paths are short: pointers
are doubled until none moves.

Cases: null texts have no words; a null id hashes as the empty text. Repeated rows count each. Of near words
of equal count the smallest in code-point order is the form. An empty table gives an empty result. Other
columns are ignored, whatever their names. Texts are read whole; words may have any length, a long one has
one key a character and is never copied per key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massweave.llm.common import crc_sql, documents, dropped, in_slices, written

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run of a document in so many loses a character.
NOISE = 199
#: Words that a task gathers before it passes its counts on, cells of a matrix of characters, bits of the radix.
GATHERED, CELLS, RADIX = 300_000, 1 << 20, 16
#: Kinds of keys: a character deleted at a place, the whole word, a character deleted anywhere.
SAME, WHOLE, LONGER = 0, 1, 2
BASE = np.uint64(0x9E3779B97F4A7C15)


def run_words(doc_id: int | None, text: str, least: int) -> Iterator[tuple[str, int]]:
    """Words of a text, after the noise, and how often each stands."""
    # Bytes are folded for A-Z only.
    text = text.encode().lower().decode()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(m[0] for m in re.finditer(rf"[a-zÀ-ÿ]{{{least},}}", text)).items():
        h = zlib.crc32(word.encode(), prefix)
        if h % NOISE == 0:
            i = h % len(word)
            word = word[:i] + word[i + 1 :]
            if len(word) < least:
                continue
        yield word, n


def words(docs: DataFrame, least: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that stand often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in run_words(doc_id, text, least) if text else ():
                    seen[word] = seen.get(word, 0) + n
                if len(seen) > GATHERED:
                    yield flush()
        yield flush()

    found = in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length (a row of code points each): keys by deleted place, the same by string alone, keys of whole words."""
    n, length = block.shape
    c, power = block.astype(np.uint64), np.cumprod(np.full(length, BASE))
    before, after = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    np.cumsum(c * power, axis=1, out=before[:, 1:])
    # Characters behind the deleted one move one place to the front.
    after[:, 1:length] = np.cumsum((c[:, 1:] * power[:-1])[:, ::-1], axis=1)[:, ::-1]
    short = before[:, :-1] + after[:, 1:]
    by_place = mixed(short + mixed(np.arange(1, length + 1, dtype=np.uint64) * BASE + np.uint64(length)))
    return by_place, mixed(short + np.uint64(length - 1)), mixed(before[:, -1] + np.uint64(length))


def keyed(vocabulary: DataFrame) -> DataFrame:
    """key, kind, place, word_id: the deletion keys of every word. ``vocabulary``: word_id, word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("word_id").to_numpy(zero_copy_only=False)
            texts = batch.column("word").to_pylist()
            sizes = np.array(list(map(len, texts)), np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            starts = np.cumsum(sizes) - sizes
            for length in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == length)
                step = max(1, CELLS // length)
                for rows in (same[k : k + step] for k in range(0, len(same), step)):
                    block = codes[starts[rows][:, None] + np.arange(length)]
                    by_place, anywhere, whole = deletion_keys(block)
                    first = np.ones(block.shape, bool)
                    first[:, 1:] = block[:, 1:] != block[:, :-1]
                    place = np.broadcast_to(np.arange(length, dtype=np.int32), block.shape)
                    own = np.broadcast_to(ids[rows][:, None], block.shape)
                    for kind, key, at, of in ((SAME, by_place.ravel(), place.ravel(), own.ravel()), (WHOLE, whole, np.full(len(rows), -1, np.int32), ids[rows]), (LONGER, anywhere[first], place[first], own[first])):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int8)), pa.array(at), pa.array(of)], names=["key", "kind", "place", "word_id"])

    return in_slices(vocabulary.select("word_id", "word"), run, "key long, kind byte, place int, word_id long")


def met(keys: DataFrame) -> DataFrame:
    """The rows whose key several words share; of keys of whole words, those that stand for a word."""
    digit = F.shiftrightunsigned("key", 64 - RADIX)
    ordered = keys.repartition(digit).sortWithinPartitions("key", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared_rows(t: pa.Table) -> pa.RecordBatch:
            key, kind = t["key"].to_numpy(), t["kind"].to_numpy()
            head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | ((kind[1:] == SAME) != (kind[:-1] == SAME))])
            size = np.diff(np.r_[head, len(key)])
            keep = (size > 1) & (kind[head] != LONGER)
            return t.filter(pa.array(np.repeat(keep, size))).combine_chunks().to_batches()

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held["key"].to_numpy()
            # The last key may go on in the next batch.
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield from shared_rows(held.slice(0, end))
                held = held.slice(end).combine_chunks()
        if held is not None:
            yield from shared_rows(held)

    return in_slices(ordered, run, "key long, kind byte, place int, word_id long")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word_id, n_near, best (struct of -n and word) of every word that has a near one. ``vocabulary``: word_id, word, n."""
    rest = F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word")))
    rows = met(keyed(vocabulary)).join(vocabulary, "word_id").select(
        "word_id", "kind", F.when(F.col("kind") == SAME, F.col("place")).otherwise(-1).alias("place"),
        F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(rest).alias("rest"), F.struct((-F.col("n")).alias("minus_n"), "word").alias("own"),
    )
    # The strings themselves make the groups, so words of one key by chance part here.
    same = Window.partitionBy("place", "rest")
    order = same.orderBy("kind", "own")
    first, kind = F.first("own").over(order), F.first("kind").over(order)
    rows = rows.select("word_id", "kind", F.count("*").over(same).alias("size"), F.row_number().over(order).alias("nth"), first.alias("first"), kind.alias("first_kind"), F.lead("own").over(order).alias("second"))
    by_longer = F.col("kind") == LONGER
    rows = rows.where((F.col("size") > 1) & (F.col("first_kind") != LONGER)).select(
        "word_id", F.when(by_longer, 1).otherwise(F.col("size") - 1).alias("near"), F.when(F.col("nth") == 1, F.col("second")).otherwise(F.col("first")).alias("best")
    )
    return rows.groupBy("word_id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form. ``forms``: word, form."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(at)
        at = moved
        if not at.where("moved").take(1):
            return at.select("word", "root")


def grouped(docs: DataFrame, least: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``least`` characters that stands ``least_count`` times."""
    vocabulary = written(words(docs, least, least_count).withColumn("word_id", F.monotonically_increasing_id()), "words")
    near = vocabulary.join(neighbours(vocabulary), "word_id", "left")
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    near = written(near.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.minus_n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir))


ORACLE_SQL = f"""WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{{LEAST_CHARS},}}')) AS w FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, k, {crc_sql("(doc_id || ':' || w)")} AS h FROM runs),
words AS MATERIALIZED (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(k) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
shorter AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM places),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.d = b.word),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
formed AS MATERIALIZED (SELECT w.word, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n
 FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
paths(word, tip) AS (SELECT word, word FROM formed UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON f.word = p.tip WHERE f.form IS NOT NULL),
ends AS (SELECT p.word, p.tip AS root FROM paths p JOIN formed f ON f.word = p.tip WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
