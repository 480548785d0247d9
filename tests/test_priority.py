"""Assignment by priority against a plain loop over spectra and classes."""

import random
from collections import defaultdict

import pytest

from massweave.functions.chem import ELECTRON, MONO
from massweave.operators import priority, search

RANGES = [("C", 4, 16), ("H", 4, 34), ("O", 0, 6), ("N", 0, 1), ("S", 0, 1)]


def text(f):
    return " ".join(f"{x}{f[x]}" for x in "CHNOS" if f.get(x))


def plain(peaks, forms, ppm, around, min_peaks):
    """peaks: {spectrum: {peak_idx: (mz, abundance)}}; forms: [(atoms, mz)]."""
    out = []
    for spectrum, own in peaks.items():
        hits = {i: [(f, (mz - c) / c * 1e6, c) for f, c in forms if abs(mz - c) <= c * ppm * 1e-6] for i, (mz, _) in own.items()}
        least = lambda i, keep: min((h for h in hits[i] if keep(h[0])), key=lambda h: (abs(h[1]), text(h[0])), default=None)
        only = lambda f: f["O"] and not f["N"] and not f["S"]
        a = [x for _, x in own.values()]
        mean = sum(a) / len(a)
        limit = mean + 7 * (sum((x - mean) ** 2 for x in a) / len(a)) ** 0.5
        size = lambda i: own[i][1] if own[i][1] <= limit else 0.0
        start = least(min(own, key=lambda i: (-size(i), i)), only)
        if not start:
            continue
        members = {}
        for i in sorted(own, key=lambda i: (-size(i), i)):
            n = int(own[i][0])
            if n != int(start[2]) and (n - int(start[2])) % 14 == 0:
                members.setdefault(n, i)
        top = defaultdict(float)
        for i in members.values():
            if best := least(i, only):
                top[best[0]["O"]] = max(top[best[0]["O"]], own[i][1])
        ranks = {o: k for k, o in enumerate(sorted(top, key=lambda o: (-top[o], o)))}
        name = lambda f: (f["N"] + f["S"], " ".join(f"{x}{f[x]}" for x in "NS" if f[x]), ranks.get(f["O"]))
        queue = sorted({name(f) for hs in hits.values() for f, _, _ in hs if f["O"] in ranks})
        taken, errors = set(), []
        for c in queue:
            center = sum(errors) / len(errors) if errors else 0.0
            step = {i: kept for i, hs in hits.items() if i not in taken and (kept := [h for h in hs if h[0]["O"] in ranks and name(h[0]) == c and (around is None or abs(h[1] - center) <= around)])}
            if len(step) < min_peaks:
                continue
            for i, hs in step.items():
                best = min(hs, key=lambda h: (abs(h[1]), text(h[0])))
                errors.append(best[1])
                out += [(spectrum, i, text(h[0]), h is best) for h in hs]
            taken |= set(step)
    return sorted(out)


@pytest.mark.parametrize(("around", "min_peaks"), [(None, 0), (1.5, 0), (2.0, 3)])
def test_steps_equal_a_plain_loop(spark, around, min_peaks):
    forms = search.candidates(spark, RANGES, (100.0, 300.0), (0.0, 10.0)).cache()
    listed = [({x: r[x] for x in "CHONS"}, r.mass + MONO["H"] - ELECTRON) for r in forms.collect()]
    random.seed(around or 0)
    peaks = {s: {} for s in "ab"}
    for s in peaks:
        series = [(f, mz) for f, mz in listed if f["O"] and not f["N"] and not f["S"] and int(mz) % 14 == 7]
        for i, (_, mz) in enumerate(sorted(random.sample(listed, 70) + random.sample(series, min(20, len(series))), key=lambda x: x[1])):
            large = int(mz) % 14 == 7
            peaks[s][i] = (mz * (1 + (random.uniform(-4e-6, 3e-6) if not large else random.uniform(-1e-6, 1e-6))), round(random.uniform(1, 30) + 30 * large, 3))
    df = spark.createDataFrame([(s, i, mz, a) for s, own in peaks.items() for i, (mz, a) in own.items()], "spectrum string, peak_idx int, mz double, abundance double")
    got = priority.assigned(df, forms, ["spectrum"], [("protonated", None)], 1, (-5.0, 5.0), around, min_peaks).collect()
    want = plain(peaks, listed, 5.0, around, min_peaks)
    assert sorted((r.spectrum, r.peak_idx, text(r.atoms), r.best) for r in got) == want and len(want) > 20
    forms.unpersist()


def test_no_series_no_assignment(spark):
    df = spark.createDataFrame([("a", 0, 101.5, 1.0)], "spectrum string, peak_idx int, mz double, abundance double")
    forms = search.candidates(spark, RANGES, (100.0, 120.0), (0.0, 10.0))
    assert priority.assigned(df, forms, ["spectrum"], [("protonated", None)], 1, (-5.0, 5.0)).count() == 0
