"""Plain versions and odd rows of operators that had none: packing ties, quality, language, WARC, media, pieces, the empty pipeline."""

import math
import random

import pytest

np = pytest.importorskip("numpy")

from massweave.llm import best_fit_packing, line_quality, media_wav, piece_sampling, pipeline, string_kernel, warc_derivatives  # noqa: E402


@pytest.fixture(scope="module")
def clashing(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id"), (4, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("record_id", "wav", "fingerprint", "payload_bytes", "ids", "pieces", "score", "lang_pred", "task", "nth", "length", "rank", "before", "kept", "n_words")])


def test_equal_lengths_fill_sequences_without_gaps(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma") for i in range(700)] + [(1000 + i, "x") for i in range(300)], "doc_id long, text string").repartition(7)
    got = best_fit_packing.pack(docs, max_len=16).collect()
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) == 1000
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16
    assert len(by) <= math.ceil(sum(r.length for r in got) / 16) + 1


def test_fingerprint_equals_frame_by_frame_peaks():
    random.seed(1)
    for text in ("", "a", "hello world " * 40, "".join(chr(random.randrange(32, 1000)) for _ in range(900))):
        _, data = media_wav.payload(text)
        x = np.full(max(len(data), media_wav.FRAME) + media_wav.FRAME, 128.0)
        x[: len(data)] = np.frombuffer(data, np.uint8)
        frames = 1 + max(0, math.ceil((len(data) - media_wav.FRAME) / media_wav.HOP))
        peaks = []
        for k in range(frames):
            part = ((x[k * media_wav.HOP : k * media_wav.HOP + media_wav.FRAME] - 128).astype(np.float32)) * media_wav.WINDOW
            power = np.abs(np.fft.rfft(part))
            own = [(-power[b], b) for b in range(1, len(power) - 1) if power[b] > power[b - 1] and power[b] >= power[b + 1]]
            peaks.append([b for h, b in sorted(own)[: media_wav.PEAKS] if -h > 1e-3])
        want = sorted(t << 32 | p << 16 | q << 8 | d for t in range(frames) for d in range(1, media_wav.AHEAD + 1) if t + d < frames for p in peaks[t] for q in peaks[t + d])
        assert media_wav.fingerprint(data).tolist() == want


def test_kernel_is_the_cosine_of_presence_and_landmarks_span_it():
    random.seed(2)
    texts = ["".join(random.choice("abcdeéß ") for _ in range(random.randint(3, 60))) for _ in range(40)]
    sets = [set(string_kernel.presence(t).tolist()) for t in texts]
    k = string_kernel.matrix([np.array(sorted(s)) for s in sets])
    plain = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(k @ k.T, plain, atol=1e-6)
    langs = [("x", "y")["é" in t] for t in texts]
    model = string_kernel.fit(texts, langs, landmarks=len(texts) * 2, ridge=0.5)
    # With all texts as landmarks the regression is ridge regression on the kernel's own features; redo it from the plain kernel.
    order = [i for name in sorted(set(langs)) for i, y in enumerate(langs) if y == name]
    values, vectors = np.linalg.eigh(plain[np.ix_(order, order)])
    good = values > 1e-4 * values[-1]
    phi = np.hstack([plain[:, order] @ (vectors[:, good] / np.sqrt(values[good])), np.ones((len(texts), 1))])
    y = np.array([[float(a == b) for b in sorted(set(langs))] for a in langs])
    w = 1 / (2 * y.mean(0)[y.argmax(1)])
    beta = np.linalg.solve((phi * w[:, None]).T @ phi + 0.5 * len(texts) / 100 * np.eye(phi.shape[1]), (phi * w[:, None]).T @ y)
    got = (k @ string_kernel.landmarks_of(model)) @ model["weights"] + model["bias"]
    assert np.allclose(got, phi @ beta, atol=2e-3)


def test_identify_of_odd_rows_and_ties(spark, clashing):
    rows = [(i, f"{'der die das und ' if i % 2 else 'the of and to '}{'word' if i % 2 else 'wort'}{i} " * 3, "de" if i % 2 else "en") for i in range(200)]
    model = string_kernel.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = string_kernel.identify(clashing, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got if r.doc_id in (1, 2)) == [(1, "und"), (2, "und")] and len(got) == clashing.count()
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
    langs, scores = string_kernel.score(model, [r[1] for r in rows])
    assert langs == [r[2] for r in rows]
    assert all(r.lang_pred == "und" for r in string_kernel.identify(clashing, None).collect()) and string_kernel.identify(clashing.limit(0), model).count() == 0


def test_operators_ignore_clashing_columns(spark, clashing):
    n = clashing.count()
    assert media_wav.digests(clashing).count() == n and media_wav.media(clashing.limit(0)).count() == 0
    assert best_fit_packing.pack(clashing.where("doc_id != 4 or doc_id is null")).count() == n - 1
    assert line_quality.clean(clashing).count() == n and line_quality.clean(clashing.limit(0)).count() == 0
    pages = clashing.selectExpr("doc_id as page_id", "'u' as url", "text as html", "* except (doc_id, text)")
    assert warc_derivatives.derivatives(pages).count() == 2 * n


def test_pieces_of_long_and_odd_texts(spark, clashing):
    from pyspark.sql import functions as F

    long = spark.createDataFrame([(7, "Grüße 12,5 {x_1} -> y\n\t" * 900), (8, "a" * 20000)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in piece_sampling.decode(piece_sampling.encode(long)).collect()}
    assert back == {r.doc_id: r.text for r in long.collect()}
    assert piece_sampling.encode(clashing).count() == clashing.count() and piece_sampling.digests(clashing.limit(0)).count() == 0
    same = piece_sampling.encode(clashing.where("doc_id = 3")).select([c for c in piece_sampling.encode(clashing.limit(0)).columns]).collect()
    assert same[0] == same[1]


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
