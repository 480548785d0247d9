"""The nearest join in ranges against a plain search."""

import random

import pytest

from massweave.operators import joins


@pytest.mark.parametrize("tolerance", [None, 0.7, 40.0])
@pytest.mark.parametrize("upper_tie", [True, False])
def test_nearest_equals_a_plain_search(spark, tolerance, upper_tie):
    random.seed(3)
    left = [(i, random.choice("abc"), random.choice([random.uniform(-50, 300), float(random.randrange(-50, 300)), 7.5])) for i in range(400)] + [(900, "a", None), (901, None, 3.0)]
    right = [(random.choice("ab"), random.choice([random.uniform(0, 250), float(random.randrange(250)), 8.0, 7.0])) for _ in range(300)] + [("a", None), (None, 4.0)]
    a, b = spark.createDataFrame(left, "i long, k string, x double").repartition(3), spark.createDataFrame(right, "k string, y double").repartition(3)
    for on in (["k"], []):
        got = {r.i: r.y for r in joins.nearest_join(a, b.select("y") if not on else b, "x", "y", tolerance, on=on, upper_tie=upper_tie).collect() if r.y is not None}
        want = {}
        for i, k, x in left:
            fit = [y for o, y in right if y is not None and (not on or o == k)] if x is not None else []
            if fit:
                d = min(abs(y - x) for y in fit)
                if tolerance is None or d <= tolerance:
                    want[i] = (max if upper_tie else min)(y for y in fit if abs(y - x) == d)
        assert got == want


def test_ranges_without_rows(spark):
    a, b = spark.createDataFrame([(1, 5.0)], "i long, x double"), spark.createDataFrame([], "y double")
    assert joins.nearest_join(a, b, "x", "y").collect()[0].y is None and joins.nearest_join(a, b, "x", "y", 1.0).count() == 0
    assert joins.nearest_join(a.limit(0), spark.createDataFrame([(1.0,)], "y double"), "x", "y").count() == 0


def test_ladders_of_uneven_rungs(spark):
    random.seed(4)
    rungs = {k: sorted({round(random.uniform(0, 100) ** p / 100 ** (p - 1), 3) for _ in range(n)}) for k, n, p in (("a", 40, 1), ("b", 9, 3), ("c", 1, 1))}
    value = {(k, r): random.uniform(500, 3000) for k, own in rungs.items() for r in own}
    points = [(i, random.choice("abcd"), random.choice([random.uniform(-20, 130), *rungs["b"][:2], *rungs["a"][-2:]])) for i in range(500)]
    a = spark.createDataFrame(points, "i long, k string, x double")
    b = spark.createDataFrame([(k, r, v) for (k, r), v in value.items()], "k string, at double, v double").repartition(3)
    for on in (["k"], []):
        use = b if on else b.where("k = 'b'").drop("k")
        got = {r.i: r.ri for r in joins.ladder(a, use, "x", "at", "v", on=on).collect()}
        want = {}
        for i, k, x in points:
            own = rungs.get(k if on else "b", [])
            if len(own) > 1:
                j = max(0, min(len(own) - 2, sum(r <= x for r in own) - 1))
                k = k if on else "b"
                v, w = value[k, own[j]], value[k, own[j + 1]]
                want[i] = v + (w - v) * (x - own[j]) / (own[j + 1] - own[j])
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) + 1e-9 for i in want)
