"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns through operators and stages."""

import random

import pytest

np = pytest.importorskip("numpy")

from massweave.llm import html_density, kneser_ney, media_wav, pii_bootstrap, string_kernel, t_occurrence, warc_derivatives  # noqa: E402

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "word " * 30000), (None, "no id"), (1, None), (7, "same text twice " * 4), (8, "same text twice " * 4)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    own = {name: F.lit(1) for name in ("row", "n", "c", "g", "cid", "th", "label", "fold", "_id", "u", "v", "k")}
    return df.select("*", F.lit("en").alias("lang"), F.lit(0.5).alias("score"), *[v.alias(k) for k, v in own.items()], F.lit(9).cast("long").alias("n_chars"))


def test_join_of_odd_rows(odd):
    got = t_occurrence.join_components(odd)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert got.count() == len(ODD) and rows[1] == (0, 1) and rows[2] == (0, 2) and rows[5] == (1, 5) and rows[7][1] == rows[8][1] == 7
    kept = t_occurrence.representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert t_occurrence.join_components(odd.limit(0)).count() == t_occurrence.representatives(odd.limit(0)).count() == 0


def test_personal_data_of_odd_rows(odd):
    assert pii_bootstrap.digests(pii_bootstrap.find(odd)).count() == len(ODD)
    got = pii_bootstrap.masked(odd)
    assert got.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in ODD)
    assert pii_bootstrap.masked(odd.limit(0)).count() == 0


def test_language_of_odd_rows(odd):
    model = string_kernel.train(odd)
    assert string_kernel.identified(odd, model, 0.3).columns == odd.columns
    assert string_kernel.identified(odd.limit(0), string_kernel.train(odd.limit(0)), 0.3).count() == 0


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = kneser_ney.train(odd, labels)
    assert kneser_ney.rate(odd, model).count() == len(ODD)
    assert kneser_ney.harmless(odd, None).columns == odd.columns and kneser_ney.harmless(odd, None).count() == len(ODD)
    assert kneser_ney.rate(odd.limit(0), kneser_ney.train(odd.limit(0), labels.limit(0))).count() == 0


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.example", ""), (3, "u", "<p>x" * 5000), (3, "u", "<p>x" * 5000)], "page_id long, url string, html string")
    got = warc_derivatives.derivatives(pages).collect()
    assert len(got) == 8 and len({bytes(r.record) for r in got}) == 6
    assert html_density.main_text("<p>x" * 5000).startswith("x\nx")
    assert warc_derivatives.derivatives(pages.limit(0)).count() == 0


def test_media_of_odd_texts():
    for _, t in ODD:
        n, data = media_wav.payload(t)
        assert n == len((t or "").encode()) and media_wav.from_wav(media_wav.to_wav(data)) == data
        assert media_wav.fingerprint(data) is not None


def test_search_joins_all_components_of_a_group():
    random.seed(9)
    sets = []
    for k in range(40):
        base = sorted(random.sample(range(1000), 30)) if k % 8 == 0 else base
        own = sorted(set(random.sample(base, 28)) | set(random.sample(range(1000, 1500), 2)))
        sets.append((k, k, np.array(own, np.int64)))
    close = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def parts(links):
        up = {k: k for k, _, _ in sets}
        for u, v in links:
            old, new = up[u], up[v]
            up = {k: new if c == old else c for k, c in up.items()}
        return {frozenset(k for k in up if up[k] == c) for c in up.values()}

    got = t_occurrence.search_block(sets, sets, 80)
    assert all(similar and close(sets[u][2], sets[v][2]) for u, v, similar in got) and len(got) < len(sets)
    assert parts([x[:2] for x in got]) == parts([(i, j) for i, _, a in sets for j, _, b in sets if i < j and close(a, b)])
    one = t_occurrence.search_block(sets[:1], sets[1:8], 80)
    assert {u for u, _, similar in one if similar} == {i for i, _, a in sets[1:8] if close(a, sets[0][2])}
