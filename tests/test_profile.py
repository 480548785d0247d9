"""Profile peak picking against a plain scan over whole spectra."""

import math
import random

import pytest

from massweave.operators import profile


def plain(xs, ys, pad, least, prominence, threshold):
    if pad and len(xs) > 1:
        xs = [xs[0] - k * (xs[1] - xs[0]) for k in range(pad, 0, -1)] + xs + [xs[-1] + k * (xs[-1] - xs[-2]) for k in range(1, pad + 1)]
        ys = [0.0] * pad + ys + [0.0] * pad
    n, out = len(xs), []
    for i in range(1, n - 1):
        if not ys[i - 1] < ys[i] > ys[i + 1]:
            continue
        a = b = c = d = i
        while a > 0 and ys[a - 1] < ys[a]:
            a -= 1
        while b < n - 1 and ys[b + 1] < ys[b]:
            b += 1
        while c > 0 and ys[c - 1] <= ys[c]:
            c -= 1
        while d < n - 1 and ys[d + 1] <= ys[d]:
            d += 1
        lo, hi = i, i
        while lo >= 0 and ys[lo] >= ys[i] / 2:
            lo -= 1
        while hi < n and ys[hi] >= ys[i] / 2:
            hi += 1
        power = None
        if lo >= 0 and hi < n and i >= 5 and n - i >= 5:
            cross = lambda p, q: xs[p] + (xs[q] - xs[p]) * (ys[i] / 2 - ys[p]) / (ys[q] - ys[p])
            power = xs[i] / (cross(hi, hi - 1) - cross(lo, lo + 1))
        if b - a >= least and ys[i] >= threshold and (ys[i] - max(ys[c], ys[d])) / max(ys) * 100 > prominence:
            out.append((i - pad, a - pad, b - pad, ys[i], power))
    return out


@pytest.mark.parametrize("pad", [0, 3])
def test_peaks_equal_a_plain_scan(spark, pad):
    random.seed(5)
    spectra = {}
    for s in range(12):
        n = random.choice([1, 2, 9, 200])
        xs = sorted(random.sample(range(100, 2000), n))
        peaks = [(random.uniform(100, 2000), random.uniform(5, 90), random.uniform(1, 9)) for _ in range(12)]
        spectra[s] = ([float(x) for x in xs], [round(sum(h * math.exp(-(((x - c) / w) ** 2)) for c, w, h in peaks) + random.choice([0, 0, 0.2]) + random.random() * 0.02, 2) for x in xs])
    rows = [(s, x, y) for s, (xs, ys) in spectra.items() for x, y in zip(xs, ys)]
    df = spark.createDataFrame([*rows, (0, None, 1.0), (0, 5.0, None)], "scan int, mz double, abundance double").repartition(4)
    got = profile.centroids(df, ["scan"], least_points=4, prominence=0.5, threshold=0.1, pad=pad).collect()
    assert len(got) > 20
    for s, (xs, ys) in spectra.items():
        own = sorted((r.apex_idx, r.start_idx, r.final_idx, r.abundance, r.resolving_power) for r in got if r.scan == s)
        want = plain(xs, ys, pad, 4, 0.5, 0.1)
        assert [o[:4] for o in own] == [w[:4] for w in want]
        for o, w in zip(own, want):
            assert o[4] == (None if w[4] is None else pytest.approx(w[4]))


def test_parabola_and_noise(spark):
    xs = [100 + 0.1 * k for k in range(21)]
    df = spark.createDataFrame([(1, x, max(0.0, 10 - 30 * (x - 101.03) ** 2)) for x in xs], "scan int, mz double, abundance double")
    noise = spark.createDataFrame([(1, 0.5, 2.0)], "scan int, noise double, noise_std double")
    (r,) = profile.centroids(df, ["scan"], noise=noise, threshold=1.0).collect()
    assert r.mz == pytest.approx(101.03) and r.centroid_abundance == pytest.approx(10.0) and r.s2n == pytest.approx(5.0) and r.apex_mz == pytest.approx(101.0)
    assert profile.centroids(df, ["scan"], noise=noise, threshold=9.0).count() == 0


def test_a_width_far_beyond_the_apex(spark):
    """Levels above half the height, longer than any fixed window, on both sides."""
    ys = [0.0, *[6.0 + (k % 2) * 0.1 for k in range(300)], 10.0, *[6.0] * 300, 1.0]
    df = spark.createDataFrame([(float(k), y) for k, y in enumerate(ys)], "x double, y double")
    (r,) = profile.half_height_widths(df, [], "x", "y").where("y = 10").collect()
    assert r.left == pytest.approx(5 / 6) and r.right == pytest.approx(601 + 1 / 5)
    assert profile.half_height_widths(df.limit(0), [], "x", "y").count() == 0
