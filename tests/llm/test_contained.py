"""Short texts that contain each other: the pairs that ask for the fewest common prefix tokens."""

import random

import pytest

pytest.importorskip("numpy")

from massweave.llm import t_occurrence  # noqa: E402
from tests.llm.test_pieces import plain_components  # noqa: E402


def test_contained_texts_by_brute_force(spark):
    random.seed(11)
    rows = []
    for g in range(150):
        base = [f"g{g}w{k}" for k in range(random.randint(13, 20))]
        for cut in range(5):
            first = random.randint(0, 2)
            rows.append((len(rows), " ".join(base[first : len(base) - random.randint(0, 2)] + [f"u{g}x{cut}"] * random.randint(0, 1))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in t_occurrence.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
