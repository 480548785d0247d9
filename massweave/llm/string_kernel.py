"""Operator 4: language by a blended-spectrum presence kernel with Nyström landmarks.

A text is the set of its character 1- to 4-grams over lower-case letters, hashed to ``DIMS``
presence bits; two texts compare by the cosine of their sets. Landmarks are training texts;
the kernel to them, whitened by their own kernel (Nyström), is the input of one ridge
regression for each language against the rest. Scoring is two matrix products a batch.

The fit uses a bounded sample of labelled rows (``PER_LANG`` a language, chosen by a hash
of the text, so that copies of a text count once), of which only the presence bits reach the driver; every
row is scored by its whole text. The languages themselves are taken to be few: each has a regression.

Cases: null texts and texts without a letter are ``und`` with score 0. With no labelled rows all
others are ``und`` too. Equal best scores go to the first language in order. Repeated rows give
repeated results; lang, source and doc_id aren't read for a prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import checked_join, crc_mod, documents, filtered, map_rows, released, shared, written

DIMS, ORDERS, LANDMARKS, PER_LANG, RIDGE, SHARPNESS = 1 << 14, 4, 256, 500, 1e-2, 6.0
FOLDS, HELD_OUT = 4, 2


def letter_codes() -> np.ndarray:
    """Code points to letters' own numbers, 0 for all that isn't a letter; beyond the table letters count as one."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x3000)], np.uint32)


LETTERS = letter_codes()


def presence(text: str | None) -> np.ndarray | None:
    """Sorted hashed n-grams that the text has; None without a letter."""
    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = cp >= len(LETTERS)
    codes = LETTERS[np.where(wide, 0, cp)]
    if wide.any():
        codes[wide] = [ord(c) if (c := chr(x)).isalpha() else 0 for x in cp[wide]]
    if not codes.any():
        return None
    codes = np.concatenate(([np.uint32(0)], codes[(codes != 0) | np.append(codes[1:] != 0, False)], [np.uint32(0)])).astype(np.uint64)
    seen = np.zeros(DIMS, bool)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, min(ORDERS, len(codes)) + 1):
        gram = gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        seen[((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - DIMS.bit_length() + 1)] = True
    return np.flatnonzero(seen)


def matrix(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), DIMS), np.float32)
    for row, at in zip(out, sets):
        row[at] = 1 / np.sqrt(len(at))
    return out


def packed(text: str | None) -> bytes | None:
    """The presence bits of a text."""
    at = presence(text)
    if at is None:
        return None
    bits = np.zeros(DIMS, bool)
    bits[at] = True
    return np.packbits(bits).tobytes()


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict | None:
    return fit_bits(list(map(packed, texts)), langs, landmarks, ridge)


def fit_bits(bits: list[bytes | None], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict | None:
    """Landmarks and the regression's weights from texts' bits, which come in a fixed order."""
    rows = [(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))), y) for b, y in zip(bits, langs) if b is not None]
    if not rows:
        return None
    names = sorted({y for _, y in rows})
    y = np.array([names.index(y) for _, y in rows])
    turn = np.concatenate([np.flatnonzero(y == k)[: -(-landmarks // len(names))] for k in range(len(names))])
    marks = matrix([rows[i][0] for i in turn])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-4 * values[-1]
    white = vectors[:, good] / np.sqrt(values[good])
    phi = np.vstack([(matrix([p for p, _ in rows[k : k + 128]]) @ marks.T).astype(np.float64) for k in range(0, len(rows), 128)]) @ white
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    share = np.bincount(y) / len(y)
    weight = 1 / (len(names) * share[y])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, 0.0)
    left = (phi1 * weight[:, None]).T @ phi1 + ridge * len(y) / 100 * np.eye(phi1.shape[1])
    beta = np.linalg.solve(left, (phi1 * weight[:, None]).T @ target)
    return {"names": names, "marks": np.packbits(marks > 0, axis=1), "weights": (white @ beta[:-1]).astype(np.float32), "bias": beta[-1].astype(np.float32)}


def landmarks_of(model: dict) -> np.ndarray:
    """The landmarks as columns; a model travels with their bits and a process unpacks them once."""
    if id(model) not in UNPACKED:
        UNPACKED.clear()
        UNPACKED[id(model)] = (model, np.ascontiguousarray(matrix([np.flatnonzero(np.unpackbits(b)) for b in model["marks"]]).T))
    return UNPACKED[id(model)][1]


#: The model last used in this process, and its landmarks.
UNPACKED: dict[int, tuple[dict, np.ndarray]] = {}


def score(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    sets = [presence(t) if model else None for t in texts]
    marks = landmarks_of(model) if model else None
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    at = [i for i, p in enumerate(sets) if p is not None]
    for k in range(0, len(at), 128):
        part = at[k : k + 128]
        raw = (matrix([sets[i] for i in part]) @ marks) @ model["weights"] + model["bias"]
        e = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        best, prob = raw.argmax(1), e.max(1) / e.sum(1)
        for i, b, p in zip(part, best, prob):
            langs[i], scores[i] = model["names"][b], float(p)
    return langs, scores


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> pd.DataFrame:
    """lang, h (hash of the text), bits of at most ``per_lang`` labelled training texts of each language, in an order of their hashes."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).select("lang", "text", F.xxhash64("text").alias("h"))
    # A little more than is needed passes by its hash; so much of a language as its distinct texts make 1.5 times the number.
    rates = rows.select("lang", "h").distinct().groupBy("lang").agg((1.5 * per_lang * (1 << 30) / F.count("*")).alias("below"))
    passing = checked_join(rows, written(rates, "rates"), "lang").where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("below")).select("lang", "text", "h")
    made = map_rows(passing, lambda: lambda x: {"lang": x["lang"], "h": x["h"], "bits": list(map(packed, x["text"]))}, "lang string, h long, bits binary")
    got = pd.DataFrame(made.dropDuplicates(["h", "lang"]).collect(), columns=["lang", "h", "bits"])
    got["o"] = got.h.to_numpy(np.int64) % (1 << 30)
    return got.sort_values(["o", "h", "lang"], kind="stable").groupby("lang", sort=False).head(per_lang).reset_index(drop=True)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    own = shared(docs.sparkSession, model)

    def task():
        def each(x: dict[str, list]) -> dict:
            langs, scores = score(own.value, x["text"])
            return {"doc_id": x["doc_id"], "lang_pred": langs, "score": scores}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: dict | None, least: float) -> DataFrame:
    """The rows, with all their columns, whose language is told with a score of ``least`` or more."""
    own = shared(docs.sparkSession, model)

    def task():
        def each(batch) -> list[bool]:
            langs, scores = score(own.value, batch.column("text").to_pylist())
            return [k != "und" and s >= least for k, s in zip(langs, scores)]

        return each

    return filtered(docs, task)


def train(docs: DataFrame) -> dict | None:
    rows = sample(docs)
    model = fit_bits(list(rows.bits), list(rows.lang))
    released()
    return model


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
