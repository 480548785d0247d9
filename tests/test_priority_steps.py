"""Assignment by priority: labels a formula, searches of what has a series, ties and odd abundances."""

import math
import random

from massweave.functions.chem import ELECTRON, MONO
from massweave.operators import priority, search
from test_priority import RANGES, plain, text

SCHEMA = "spectrum string, peak_idx int, mz double, abundance double"


def listed(forms):
    return [({x: r[x] for x in "CHONS"}, r.mass + MONO["H"] - ELECTRON) for r in forms.collect()]


def test_many_spectra_equal_a_plain_loop_and_only_those_with_a_series_are_searched_whole(spark, monkeypatch):
    forms = search.candidates(spark, RANGES, (100.0, 220.0), (0.0, 10.0)).cache()
    every = listed(forms)
    series = [(f, mz) for f, mz in every if f["O"] and not f["N"] and not f["S"] and int(mz) % 14 == 7]
    random.seed(3)
    peaks = {}
    for k in range(12):
        own = random.sample(every, 25) + (random.sample(series, 8) if k % 3 else [])
        # Few sizes, so that many peaks are equally abundant.
        peaks[f"s{k}"] = {i: (mz * (1 + random.uniform(-3e-6, 3e-6)), float(random.randint(1, 3) + 5 * (int(mz) % 14 == 7))) for i, (_, mz) in enumerate(own)}
    # The most abundant peak has no formula.
    peaks["none"] = {i: (mz, 1.0) for i, (_, mz) in enumerate(random.sample(every, 40))} | {99: (150.5, 2.0)}
    given = []

    def spied(some, *rest):
        given.append((some, rest[0]))
        return search.searched(some, *rest)

    monkeypatch.setattr(priority, "searched", spied)
    df = spark.createDataFrame([(s, i, mz, a) for s, own in peaks.items() for i, (mz, a) in own.items()], SCHEMA)
    got = priority.assigned(df, forms, ["spectrum"], [("protonated", None)], 1, (-5.0, 5.0), 2.5, 2).collect()
    want = plain(peaks, every, 5.0, 2.5, 2)
    assert sorted((r.spectrum, r.peak_idx, text(r.atoms), r.best) for r in got) == want and len({s for s, *_ in want}) > 4
    # A spectrum without a series gives the most abundant peak of each whole mass to the search, no more; classes come with the formulas.
    masses = {int(mz) for mz, _ in peaks["none"].values()}
    assert sum(some.where("spectrum = 'none'").count() for some, _ in given) == len(masses) < len(peaks["none"])
    assert all("class" in some.columns and some.count() == len(every) for _, some in given)
    forms.unpersist()


def test_the_most_abundant_peaks(spark):
    rows = [("a", 3, 100.2, 5.0), ("a", 1, 100.4, 5.0), ("a", 2, 114.2, 5.0), ("a", 4, 114.3, None), ("b", 1, 120.5, math.nan), ("b", 2, 120.1, math.inf), ("c", 7, 130.5, None), ("c", 6, 130.1, None)]
    # One of a hundred is over seven deviations above the mean.
    rows += [("d", i, 140.5, 1.0) for i in range(100)] + [("d", 100, 140.6, 1000.0)]
    got = priority.tops(spark.createDataFrame(rows, SCHEMA), ["spectrum"])
    assert {(r.spectrum, r._nominal): r.peak_idx for r in got.collect()} == {("a", 100): 1, ("a", 114): 2, ("b", 120): 1, ("c", 130): 6, ("d", 140): 0}
    # No task orders a spectrum or has all its peaks.
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_no_peaks_no_assignment(spark):
    forms = search.candidates(spark, RANGES, (100.0, 120.0), (0.0, 10.0))
    got = priority.assigned(spark.createDataFrame([], SCHEMA), forms, ["spectrum"], [("protonated", None)], 1, (-5.0, 5.0), 3.0, 3)
    assert got.collect() == [] and got.columns == ["spectrum", "class", "peak_idx", "mz", "abundance", "atoms", "ion_type", "mz_calc", "error_ppm", "turn", "best"]
