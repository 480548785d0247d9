"""Copies of a text leave the others of its language in the sample."""

import pytest

pytest.importorskip("numpy")

from massweave.llm import string_kernel  # noqa: E402


def test_copies_leave_a_language_its_texts(spark):
    rows = [(i, "the same house", "en") for i in range(20_000)] + [(20_000 + i, f"the house and the garden {i}", "en") for i in range(400)]
    got = string_kernel.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.h.nunique() == len(got) > 250
