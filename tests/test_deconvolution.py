"""Deconvolution against a plain version, and two compounds under one peak."""

import math
import random
from collections import defaultdict

from massweave.operators import deconvolution


def peaks(trace, least):
    """(start, apex, final) places of a list of (x, y)."""
    n, out = len(trace), []
    for i in range(1, n - 1):
        if trace[i - 1][1] < trace[i][1] > trace[i + 1][1]:
            a = b = i
            while a > 0 and trace[a - 1][1] < trace[a][1]:
                a -= 1
            while b < n - 1 and trace[b + 1][1] < trace[b][1]:
                b += 1
            if b - a >= least:
                out.append((a, i, b))
    return out


def clusters(xs, limit):
    groups = [[x] for x in sorted(xs)]
    while len(groups) > 1:
        d = [(math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * abs(sum(a) / len(a) - sum(b) / len(b)), i) for i, (a, b) in enumerate(zip(groups, groups[1:]))]
        best, i = min(d)
        if best > limit:
            break
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    return groups


def plain(points, limit, least, ion_share, total_share):
    out = []
    for sample in {p[0] for p in points}:
        cells = defaultdict(float)
        for s, rt, mz, y in points:
            if s == sample and y > 0:
                cells[rt, mz] += y
        ions, total = defaultdict(list), defaultdict(float)
        for (rt, mz), y in sorted(cells.items()):
            ions[mz].append((rt, y))
            total[rt] += y
        total = sorted(total.items())
        top_ion, top = max(cells.values()), max(y for _, y in total)
        found = defaultdict(list)  # apex time -> (mz, peak's points, apex height)
        for mz, t in ions.items():
            for a, i, b in peaks(t, least):
                if t[i][1] >= ion_share * top_ion:
                    found[t[i][0]].append((mz, t[a:b], t[i][1]))
        seen = set()
        for a, i, b in peaks(total, least):
            if total[i][1] < total_share * top:
                continue
            low, high = total[a][0], total[b][0]
            fit = [x for x, own in found.items() if low < x < high and sum(h for _, _, h in own) > total_share * top and len(own) > 1]
            for group in clusters(fit, limit) if fit else []:
                spectra = defaultdict(lambda: defaultdict(float))
                for x in group:
                    for mz, part, _ in found[x]:
                        for rt, y in part:
                            spectra[rt][mz] += y
                trace = sorted((rt, sum(s.values())) for rt, s in spectra.items())
                for c, j, d in peaks(trace, least):
                    rt = trace[j][0]
                    if trace[j][1] >= total_share * top and low <= rt <= high and rt not in seen:
                        seen.add(rt)
                        area = sum((q[1] + p[1]) / 2 * (q[0] - p[0]) for p, q in zip(trace[c : d + 1], trace[c + 1 : d + 1]))
                        out.append((sample, rt, round(trace[j][1], 6), trace[c][0], trace[d][0], round(area, 6), tuple(sorted((mz, round(y, 6)) for mz, y in spectra[rt].items()))))
    return sorted(out)


def got(spark, points, *settings):
    entities, lines = deconvolution.deconvolved(spark.createDataFrame(points, "sample string, rt double, mz int, intensity double").repartition(3), *settings)
    spectra = defaultdict(list)
    for r in lines.collect():
        spectra[r["sample"], r.entity].append((r.mz, round(r.intensity, 6)))
    return sorted((r["sample"], r.rt, round(r.tic, 6), r.start_rt, r.final_rt, round(r.area, 6), tuple(sorted(spectra[r["sample"], r.entity]))) for r in entities.collect())


def test_entities_equal_a_plain_version(spark):
    random.seed(3)
    points = []
    for s in "ab":
        for _ in range(14):
            at, width, ions = random.uniform(5, 75), random.uniform(2, 5), random.sample(range(40, 60), 4)
            for rt in range(80):
                for k, mz in enumerate(ions):
                    y = round((k + 1) * 20 * math.exp(-(((rt - at - 0.4 * k) / width) ** 2)), 3)
                    if y > 0.05:
                        points.append((s, float(rt), mz, y))
    want = plain(points, 2.5, 4, 0.02, 0.02)
    assert got(spark, [*points, ("a", 3.0, 50, 0.0), ("a", 3.0, 50, None)], 2.5, 4, 0.02, 0.02, 4.0) == want and len(want) > 6


def test_two_compounds_under_one_peak(spark):
    shape = lambda rt, at: max(0.0, 100.0 - 8 * abs(rt - at))
    points = [("s", float(rt), mz, share * shape(rt, at)) for rt in range(40) for mz, at, share in ((41, 15, 1.0), (55, 15, 1.0), (70, 19, 0.6), (83, 19, 0.6))]
    rows = got(spark, points, 1.0, 5, 0.01, 0.01, 10.0)
    assert [(r[1], [m for m, _ in r[6]]) for r in rows] == [(15.0, [41, 55]), (19.0, [70, 83])] and rows[0][2] == 200.0


def test_no_points(spark):
    a, b = deconvolution.deconvolved(spark.createDataFrame([], "sample string, rt double, mz int, intensity double"))
    assert a.count() == b.count() == 0
