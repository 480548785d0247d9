"""Filters of peaks, clusters, persistence and peak metrics against plain versions."""

import math
import random
from collections import deque

import numpy as np
import pytest

from massweave.operators import filters, persistence, sequence, suppress


def test_chains_equal_a_plain_walk(spark):
    random.seed(1)
    rows = []
    for s in "ab":
        mz = set()
        for _ in range(25):
            at = random.uniform(100, 160)
            mz |= {round(at + k * filters.CH2 + random.uniform(-6e-4, 6e-4), 5) for k in range(random.randint(1, 20)) if random.random() < 0.93}
        rows += [(s, i, m) for i, m in enumerate(sorted(mz))]
    got = {(r.s, r.peak_idx): (r.chain, r.place, r.length) for r in filters.kendrick_chains(spark.createDataFrame(rows, "s string, peak_idx long, mz double"), ["s"]).collect()}
    want = {}
    for s in "ab":
        own = {i: m for k, i, m in rows if k == s}
        best = {}
        for i, m in own.items():
            fit = sorted((abs(n - m - filters.CH2), j) for j, n in own.items() if m + filters.CH2 - 0.001 <= n <= m + filters.CH2 + 0.001)
            if fit:
                best.setdefault(fit[0][1], []).append((fit[0][0], i))
        below = {j: min(c)[1] for j, c in best.items()}
        above = {i: j for j, i in below.items()}
        for i in own:
            if i not in below:
                chain = [i]
                while chain[-1] in above:
                    chain.append(above[chain[-1]])
                want |= {(s, j): (i, k, len(chain)) for k, j in enumerate(chain)}
    assert got == want and max(n for _, _, n in want.values()) > 8


def test_classes_and_isotopologues(spark):
    rows = [(1, 0, "O2", {"C": 5, "O": 2}, 1, 2), (1, 1, "O2", {"C": 6, "O": 2}, 0, 2), (1, 2, "S1", {"C": 5, "S": 1}, 0, 4), (2, 0, "O2", {"C": 5}, None, None), (2, 1, "S1", {"S": 1}, 1, 4)]
    df = spark.createDataFrame(rows, "s int, peak_idx int, class string, atoms map<string,int>, found int, expected int")
    assert sorted((r.s, r.peak_idx) for r in filters.with_min_peaks(df, ["s"], "class", 2).collect()) == [(1, 0), (1, 1)]
    assert sorted((r.s, r.peak_idx) for r in filters.with_isotopologues(df, ["S", "Cl"], 20.0).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def plain_dbscan(v, eps, least):
    near = [[j for j in range(len(v)) if math.dist(v[i], v[j]) <= eps] for i in range(len(v))]
    core = [len(n) >= least for n in near]
    group, k = {}, 0
    for i in range(len(v)):
        if core[i] and i not in group:
            todo = deque([i])
            group[i] = k
            while todo:
                for j in near[todo.popleft()]:
                    if core[j] and j not in group:
                        group[j] = k
                        todo.append(j)
            k += 1
    return core, group, near


def test_clusters_equal_a_plain_dbscan(spark):
    random.seed(2)
    pts = [(i, random.gauss(c, 1.0), random.gauss(c, 2.0)) for i, c in enumerate([0, 20, 40] * 40)] + [(200 + k, random.uniform(-10, 60), random.uniform(-10, 60)) for k in range(40)]
    rows = spark.createDataFrame(pts, "id long, a double, b double").selectExpr("1 as s", "*")
    got = {r.id: r.cluster for r in suppress.dbscan(rows, ["s"], ["a", "b"], 0.15, 6).collect()}
    v = np.array([p[1:] for p in pts])
    v = (v - v.mean(0)) / v.std(0)
    core, group, near = plain_dbscan(v.tolist(), 0.15, 6)
    name = {}
    for i, (k, *_) in enumerate(pts):
        if core[i]:
            assert name.setdefault(group[i], got[k]) == got[k] >= 0
        else:
            allowed = {group[j] for j in near[i] if core[j]}
            assert (got[k] == -1) == (not allowed) and (not allowed or got[k] in {name.get(g, got[k]) for g in allowed})
    assert len(set(name.values())) == len(name) >= 3
    kept = filters.kendrick_clusters(spark.createDataFrame([(1, 200.0 + k * 0.01) for k in range(80)] + [(1, 900.4)], "s int, mz double"), ["s"], least=10)
    assert kept.count() == 80


def test_persistence_of_a_line_equals_a_sweep(spark):
    random.seed(3)
    traces = {s: [random.randrange(12) for _ in range(n)] for s, n in (("a", 60), ("b", 1), ("c", 2), ("d", 200))}
    df = spark.createDataFrame([(s, float(x), float(h)) for s, own in traces.items() for x, h in enumerate(own)], "s string, x double, h double").repartition(3)
    got = {s: {} for s in traces}
    for r in persistence.features_1d(df, ["s"], "x", "h").collect():
        got[r.s][r.x] = (r.birth, r.death, r.persistence)
    for s, own in traces.items():
        # A peak ends at the higher of the lowest points on the way to a higher one on either side; ties go to the left.
        for i, h in enumerate(own):
            sides = []
            for way in (range(i - 1, -1, -1), range(i + 1, len(own))):
                low = h
                for j in way:
                    low = min(low, own[j])
                    if own[j] > h or own[j] == h and j < i:
                        sides.append(low)
                        break
            death = max(sides) if sides else min(own)
            if death < h or not sides:
                assert got[s][float(i)] == (h, death, h - death)
            else:
                assert float(i) not in got[s]


def test_metrics_of_a_known_peak(spark):
    rows = [("a", float(x), 100 * math.exp(-0.5 * ((x - 50) / 6) ** 2)) for x in range(101)] + [("b", float(x), max(0.0, 10.0 - (x - 10 if x > 10 else 2 * (10 - x)))) for x in range(25)]
    got = {r.s: r for r in sequence.peak_metrics(spark.createDataFrame(rows, "s string, x double, y double"), ["s"], "x", "y").collect()}
    a, b = got["a"], got["b"]
    assert a.apex_x == 50 and a.half_height_width == pytest.approx(2.3548 * 6, rel=2e-3) and a.area == pytest.approx(100 * 6 * math.sqrt(2 * math.pi), rel=0.01)
    assert a.tailing_factor == pytest.approx(1.0) and a.gaussian_similarity == pytest.approx(1.0, abs=1e-3)
    assert b.apex_x == 10 and b.half_height_width == pytest.approx(7.5) and b.tailing_factor == pytest.approx((9.5 + 4.75) / (2 * 4.75)) and b.area == pytest.approx(75.0, rel=0.02)
