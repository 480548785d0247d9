"""Isotopologues by expressions against the plain rows of one formula."""

import random

import pytest

from massweave.operators import search


@pytest.mark.parametrize("dynamic_range", [20.0, 1000.0, 1e7])
def test_expressions_equal_the_plain_rows(spark, dynamic_range):
    random.seed(1)
    forms = [{x: random.randint(0, m) for x, m in (("C", 30), ("H", 40), ("O", 9), ("N", 3), ("S", 3), ("Cl", 3), ("Br", 2), ("Si", 2), ("Fe", 1), ("F", 1))} for _ in range(60)] + [{"C": 2}, {"H": 4}, {"F": 2}, {"Cl": 1}]
    df = spark.createDataFrame([(i, f, 500.0, 10.0) for i, f in enumerate(forms)] + [(999, None, 1.0, 1.0)], "i int, atoms map<string,int>, mz_calc double, abundance double")
    got = {}
    for r in search.isotopologues(df, dynamic_range).collect():
        got.setdefault(r.i, []).append((sorted(r.iso_atoms.items()), r.prob_ratio, r.iso_mz - 500.0, r.iso_abundance))
    for i, f in enumerate(forms):
        want = sorted((sorted(m.items()), p, d) for m, p, d in search.isotopologue_rows(f, 1 / dynamic_range))
        own = sorted(got.get(i, []))
        assert [x[0] for x in own] == [x[0] for x in want]
        for a, b in zip(own, want):
            assert a[1:3] == pytest.approx(b[1:3]) and a[3] == pytest.approx(10 * b[1])
    assert 999 not in got
