"""Token counts, importance resampling and spelling variants against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

np = pytest.importorskip("numpy")

from massweave.llm import importance_resampling, token_counts, variant_grouping  # noqa: E402

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "word " * 30000), (None, "no id here"), (1, None), (7, "same text twice " * 8), (8, "same text twice " * 8), (8, "same text twice " * 8)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *[F.lit(1).alias(k) for k in ("row", "n", "key", "word", "word_id", "rest", "score", "weight", "rank", "_at", "_part", "place", "kind", "n_docs", "pieces")])


def plain_tokens(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(token_counts.tokenizer_path()).encode(text or "", add_special_tokens=False).ids)


HARD = ["Hello  world\n\n x", "Über ñandú ça 123 x² ½!", "日本 <|endoftext|> x<|endoftext|><|endoftext|>y", "a\x85b\x1cc d", "it's we'll '' 's'x", "x" * 5000, " " * 300 + "y", "<|endoftext|>", "!?" * 90 + " end", "\t\t x\r\n", "naïve — “quoted” … text", "<|endof text|>"]


@pytest.mark.parametrize("known", [0, 3, 500_000])
def test_token_counts_are_the_librarys(spark, known):
    random.seed(4)
    letters = "ab cdé\n'st.,1²  Ωя"
    texts = HARD + ["".join(random.choice(letters) for _ in range(random.randint(0, 80))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(d, limit=60, known=known).collect()}
    want = {i: (len(t.encode()), n := plain_tokens(t), n > 60) for i, t in enumerate(texts)}
    assert got == want


def test_token_counts_of_odd_rows(odd):
    got = token_counts.counts(odd).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, plain_tokens(t)) for i, t in ODD)
    assert token_counts.counts(odd.limit(0)).count() == 0


def test_parts_end_at_pretokens(monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 7)
    random.seed(5)
    count = token_counts.counter(token_counts.tokenizer_path())
    for _ in range(200):
        t = "".join(random.choice("ab é 1.'s\n ") for _ in range(60))
        assert [x for p in token_counts.parts(t) for x in token_counts.PLAIN_PIECE.findall(p)] == token_counts.PLAIN_PIECE.findall(t)
        assert sum(count(t)[0].values()) == len(token_counts.PLAIN_PIECE.findall(t))


def test_threshold_bounds_what_travels(spark):
    d = spark.createDataFrame([(f"w{i}", n, 1) for i, n in enumerate([1] * 50 + [2] * 20 + [9] * 6 + [1000])], "key string, n_docs long, pieces long")
    for most in (0, 1, 6, 7, 30, 100):
        least = token_counts.threshold(d, most)
        assert d.where(f"n_docs >= {least}").count() <= most
    assert token_counts.threshold(d, 100) == 1 and token_counts.threshold(d, 7) <= 9


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_resampled(docs, target, n_buckets, lo, hi, least, percent, seed):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(WORD, fold(t))

    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(x for _, d in docs for x in feats(d)), Counter(x for d in target for x in feats(d))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets))))
    rows = []
    for i, d in docs:
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        f = feats(d)
        w = sum(map(gain, f))
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(d))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(r[:4] + (rank.get(r[0]),) for r in rows)


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3)])
def test_resampling_equals_a_plain_version(spark, monkeypatch, ngrams):
    monkeypatch.setattr(importance_resampling, "PART", 50)
    random.seed(6)
    pool = ["Haus", "tree", "ÉTÉ", "x9", "été", "river", "-", "stone's"]
    text = lambda: " ".join(random.choice(pool) for _ in range(random.randint(0, 60)))
    docs, target = [(i, text()) for i in range(300)] + [(900, None)], [text() for _ in range(20)] + [None]
    got = importance_resampling.resampled(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), buckets=97, ngrams=ngrams
    )
    rows = sorted(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect())
    assert rows == plain_resampled(docs, target, 97, *ngrams, 20, 10, 2024) and sum(r[4] is not None for r in rows) > 10


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "same text"), (2, None)], "item_id long, text string")
    got = importance_resampling.resampled(odd, target, percent=100).collect()
    assert len(got) == len(ODD) and sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4]
    assert {r.doc_id for r in got if r.rank} == {5, 7, 8} and all(r.weight == 0 for r in got if r.n_features == 0)
    assert importance_resampling.resampled(odd.limit(0), target).count() == 0
    assert importance_resampling.resampled(odd, target.limit(0)).count() == len(ODD)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(docs, least, least_count, ratio):
    n = Counter()
    for i, t in docs:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= least_count}
    out, form = {}, {}
    for w, k in n.items():
        by = sorted((-m, v) for v, m in n.items() if near(v, w))
        form[w] = by[0][1] if by and -by[0][0] >= ratio * k else None
        out[w] = (form[w], k, len(by), n[form[w]] if form[w] else None)
    rows = []
    for w, (f, k, m, fn) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, f, root, k, m, fn))
    return sorted(rows)


def found(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("radix", [16, 1])
def test_variants_equal_a_plain_version(spark, monkeypatch, radix):
    monkeypatch.setattr(variant_grouping, "RADIX", radix)
    random.seed(7)
    stems = ["garden", "aaaaaa", "aaaaaaa", "rivière", "Überfluß", "lettered"]

    def variant(w):
        i, kind = random.randrange(len(w)), random.random()
        return w if kind < 0.6 else w[:i] + random.choice("aeé") + w[i + (kind < 0.8) :] if kind < 0.9 else w[:i] + w[i + 1 :]

    docs = [(i, " ".join(variant(variant(random.choice(stems))) for _ in range(60))) for i in range(150)] + [(None, "garden " * 9), (3, None), (4, "x" * 3000 + " " + "x" * 3001 + " garden")] + [(k, "y" * 2500 + " " + "y" * 2501) for k in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = found(variant_grouping.grouped(d, ratio=3))
    assert got == plain_groups(docs, 6, 5, 3) and any(r[1] and r[1] != r[2] for r in got)


def test_colliding_keys_part_by_their_strings(spark, monkeypatch):
    monkeypatch.setattr(variant_grouping, "mixed", lambda x: x & np.uint64(3))
    docs = [(i, "garden gardens gardon garten fardel mardem hounds hound's harden " * 3) for i in range(4)] + [(9, "garden " * 90)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(variant_grouping.grouped(d)) == plain_groups(docs, 6, 5, 5)


def test_keys_are_those_of_the_shorter_words():
    random.seed(8)
    w = np.array([[random.randrange(97, 256) for _ in range(9)] for _ in range(20)], np.uint32)
    by_place, anywhere, whole = variant_grouping.deletion_keys(w)
    for i in range(9):
        short = np.delete(w, i, axis=1)
        assert (variant_grouping.deletion_keys(short)[2] == anywhere[:, i]).all()
    assert len(np.unique(by_place)) == by_place.size and len(np.unique(whole)) == 20


def test_variants_of_odd_rows(odd):
    got = found(variant_grouping.grouped(odd, least=4, least_count=1))
    assert got == plain_groups(ODD, 4, 1, 5) and variant_grouping.grouped(odd.limit(0)).count() == 0
