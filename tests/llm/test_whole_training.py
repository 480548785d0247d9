"""Training takes all that the labels permit."""

import zlib

import pytest

pytest.importorskip("numpy")

from massweave.llm import kneser_ney  # noqa: E402


def test_words_of_any_training_row_are_learned(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, "house garden river morning letter " * 3 + (("zyxqwv zyxqwv" if fold(i) == 1 else "grobnik grobling") if i % 3 == 0 else f"n{i}"), int(i % 3 == 0)) for i in range(400) if fold(i)]
    d = spark.createDataFrame([*rows, (9001, "house garden river morning letter zyxqwv zyxqwv", 0)], "doc_id long, text string, toxic int")
    model = kneser_ney.train(d.select("doc_id", "text"), d.where("doc_id != 9001").select("doc_id", "toxic"))
    assert {r.doc_id: r.score for r in kneser_ney.rate(d, model).collect()}[9001] >= 0.5


def test_one_toxic_row_is_enough_to_score(spark):
    rows = [(i, f"house garden river w{i}", int(i == 3)) for i in range(1, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert zlib.crc32(b"3") % 5 != 0 and kneser_ney.train(d.select("doc_id", "text"), d.select("doc_id", "toxic")) is not None
