"""Two-dimensional features in tiles against one union-find over all cells."""

import random

import pytest

from massweave.operators import persistence


def plain(cells):
    """cells: {(x, y): height} -> sorted (x, y, birth, death)."""
    order = sorted(cells, key=lambda c: (-cells[c], c))
    up, out = {}, []

    def find(c):
        while up[c] != c:
            c = up[c]
        return c

    for c in order:
        up[c] = c
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                o = (c[0] + dx, c[1] + dy)
                if o in up and find(o) != find(c):
                    a, b = sorted((find(o), find(c)), key=lambda p: (-cells[p], p))
                    if cells[b] > cells[c]:
                        out.append((*b, cells[b], cells[c]))
                    up[b] = a
    out += [(*c, cells[c], min(cells.values())) for c in up if up[c] == c]
    return sorted(out)


def field(seed, n, share, levels):
    random.seed(seed)
    return {(x, y): float(random.randrange(levels)) if levels else random.uniform(0, 9) + (x - n / 2) ** 2 * 0.05 for x in range(-3, n) for y in range(n) if random.random() < share}


@pytest.mark.parametrize(("tile", "fan"), [(128, 4), (8, 2), (5, 3), (2, 2)])
def test_features_of_any_tiling(spark, tile, fan):
    fields = {"a": field(1, 30, 0.8, 0), "b": field(2, 25, 0.5, 6), None: field(3, 12, 1.0, 3), "d": {(7, 7): 2.0}}
    rows = [(k, x, y, h) for k, f in fields.items() for (x, y), h in f.items()]
    df = spark.createDataFrame([*rows, rows[0], ("a", None, 1, 5.0), ("a", 1, 1, float("nan"))][:-1], "s string, x long, y long, h double").repartition(3)
    got = persistence.features_2d(df, ["s"], "x", "y", "h", tile, fan).collect()
    for k, f in fields.items():
        assert sorted((r.x, r.y, r.birth, r.death) for r in got if r.s == k) == plain(f)
    assert all(r.persistence == r.birth - r.death for r in got)


def test_no_cells(spark):
    assert persistence.features_2d(spark.createDataFrame([], "s string, x long, y long, h double"), ["s"], "x", "y", "h").count() == 0


def test_mean_filter_takes_the_cells_there_are(spark):
    df = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 1, 4.0), ("a", 0, 3, 9.0), ("a", 1, 0, 8.0)], "s string, x long, y long, h double")
    got = {(r.x, r.y): r.h for r in persistence.smoothed(df, ["s"], "x", "y", "h", (0, 1)).collect()}
    assert got == {(0, 0): 3.0, (0, 1): 3.0, (0, 3): 9.0, (1, 0): 8.0}


def test_two_peaks_of_a_run_are_features(spark):
    shape = {(500.0, 20): 100.0, (500.0, 40): 50.0, (500.001, 21): 60.0, (700.0, 20): 80.0}
    rows = [("a", mz + 0.0, rt / 10.0, h * max(0.0, 1 - abs(rt - at) / 6)) for (mz, at), h in shape.items() for rt in range(60) if abs(rt - at) < 6]
    got = persistence.find_features(spark.createDataFrame(rows, "s string, mz double, rt double, i double"), ["s"], "mz", "rt", "i", 0.01, 0.05, 5e-6, 0.5, radius=(0, 0))
    assert sorted((r.mz, r.rt) for r in got.collect()) == [(500.0, 2.0), (500.0, 4.0), (700.0, 2.0)]
