"""Suppression in rounds of tiles against one pass over all rows."""

import random

import pytest

from massweave.operators import suppress
from massweave.storage import written


def plain(rows, tols):
    """rows: (id, key, values, priority)."""
    kept = []
    for i, key, values, p in sorted(rows, key=lambda r: (-r[3] if r[3] is not None else float("inf"), r[0])):
        if None in values or not any(k == key and None not in other and all(abs(x - y) <= (y * t if rel else t) for x, y, (t, rel) in zip(values, other, tols)) for _, k, other in kept):
            kept.append((i, key, values))
    return sorted(i for i, _, _ in kept)


def frame(spark, rows):
    return spark.createDataFrame([(i, k, *v, p) for i, k, v, p in rows], "id long, s string, x double, y double, p double").repartition(3)


def got(df, tols):
    return sorted(r.id for r in suppress.greedy_suppress(df, {"x": tols[0], "y": tols[1]}, "p", ["s"], ["id"]).collect())


@pytest.mark.parametrize("tols", [[(1.0, False), (2.0, False)], [(0.01, True), (0.7, False)], [(0.3, True), (0.0, False)]])
@pytest.mark.parametrize("sizes", [(64, 8, 32), (4, 2, 1)])
def test_rounds_equal_one_pass(spark, monkeypatch, tols, sizes):
    for name, n in zip(("TILE", "RIM", "DEPTH"), sizes):
        monkeypatch.setattr(suppress, name, n)
    random.seed(1)
    rows = [(i, random.choice("ab"), (random.choice([0.0, 1.0, random.uniform(0, 60)]), float(random.randrange(9)) if i % 3 else random.uniform(0, 9)), float(random.randrange(40))) for i in range(700)]
    rows += [(900, "a", (None, 1.0), 5.0), (901, "a", (None, 1.0), 4.0), (902, None, (1.0, 1.0), None), (903, None, (1.0, 1.0), 1.0), (904, "b", (-5.0, 1.0), 1.0)]
    assert got(frame(spark, rows), tols) == plain(rows, tols)


def test_a_slope_is_decided_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(suppress, "TILE", 8)
    rows = [(i, "a", (i * 0.6, 0.0), float(i)) for i in range(150)] + [(1000 + i, "a", (30.0, 0.0), 500.0 + i) for i in range(200)]
    assert got(frame(spark, rows), [(1.0, False), (1.0, False)]) == plain(rows, [(1.0, False), (1.0, False)])


def test_nothing_to_suppress(spark):
    assert got(frame(spark, []), [(1.0, False), (1.0, False)]) == []
    one = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 3.0), (3, 9.0, 1.0)], "id long, x double, p double")
    assert sorted(r.id for r in suppress.greedy_suppress(one, {"x": (1.0, False)}, "p", [], ["id"]).collect()) == [2, 3]


def test_dense_cells_take_no_more_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(suppress, "written", lambda df, *by: tables.append(written(df, *by)) or tables[-1])
    random.seed(2)
    rows = [(i, "a", (random.uniform(0, 12), 0.0), None) for i in range(3000)]
    rows = [(i, k, v, v[0]) for i, k, v, _ in rows]
    assert got(frame(spark, rows), [(1.0, False), (1.0, False)]) == plain(rows, [(1.0, False), (1.0, False)])
    # One tile: the live rows once, then the kept and the remaining ones of a single round.
    assert len(tables) == 3
