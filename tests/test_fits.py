"""Line-shape fits, densities and recalibration against values known beforehand or plain versions."""

import math
import random

import numpy as np
import pytest

from massweave.operators import fits, recalibration as rc


def test_voigt_is_the_folding_of_its_parts():
    x = np.linspace(-400, 400, 400001)
    for sigma, gamma in ((1.0, 0.3), (0.4, 2.0), (1.5, 1e-6)):
        parts = np.exp(-0.5 * (x / sigma) ** 2)
        at = np.array([0.0, 0.5, 1.7, 4.0])
        folded = np.array([(parts * gamma / ((d - x) ** 2 + gamma**2)).sum() if gamma > 1e-3 else math.exp(-0.5 * (d / sigma) ** 2) for d in at])
        assert np.allclose(fits.voigt(at, np.array(sigma), np.array(gamma)), folded / folded[0], atol=2e-5)


def simulated(shape, centre, width, height, extra):
    xs = np.linspace(centre - 4 * width, centre + 4 * width, 41)
    p = np.array([[0.0, math.log(width), height, extra]])[:, : len(fits.SHAPES[shape][1])]
    return xs, fits.SHAPES[shape][0](p, (xs - centre)[None])[0]


@pytest.mark.parametrize("shape", list(fits.SHAPES))
@pytest.mark.parametrize("method", ["marquardt", "swarm"])
def test_fits_recover_their_parameters(spark, shape, method):
    random.seed(1)
    truth, rows = {}, []
    for k in range(40 if method == "marquardt" else 4):
        centre, width, height, extra = random.uniform(200, 900), random.uniform(0.002, 0.4), random.uniform(5, 5e6), math.log(random.uniform(0.001, 0.3)) if shape == "voigt" else random.uniform(-2, 2)
        xs, ys = simulated(shape, centre, width, height, extra)
        truth[k] = (centre, width, height)
        rows += [(k, float(x), float(y)) for x, y in zip(xs, ys)]
    df = spark.createDataFrame([*rows, (99, 1.0, 2.0), (98, None, 1.0), (97, 5.0, 0.0)], "peak int, x double, y double")
    got = {r.peak: r for r in fits.fitted(df, ["peak"], "x", "y", shape, method).collect()}
    tight = 1e-5 if method == "marquardt" else 2e-2
    for k, (centre, width, height) in truth.items():
        assert abs(got[k].centre - centre) < tight * width + 1e-9 and got[k].height == pytest.approx(height, rel=tight) and got[k].rms < tight * height
        if shape in ("gaussian", "lorentzian"):
            assert got[k].fwhm == pytest.approx(2 * width * (math.sqrt(2 * math.log(2)) if shape == "gaussian" else 1), rel=tight)
    assert all(got[k].centre is None for k in (97, 98, 99))


def test_density_and_range(spark):
    random.seed(2)
    values = {s: [random.gauss(m, d) for _ in range(400)] for s, m, d in (("a", 1.2, 0.5), ("b", -3.0, 0.2))}
    df = spark.createDataFrame([(s, v) for s, own in values.items() for v in own] + [("c", 1.0), ("c", 1.0), ("d", 1.0), ("d", 2.0)], "s string, error_ppm double")
    got = {}
    for r in rc.density(df, ["s"], "error_ppm").collect():
        got.setdefault(r.s, {})[r.place] = (r.x, r.density)
    assert set(got) == {"a", "b", "d"}
    for s, own in values.items():
        v = np.array(own)
        b = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min() - 3 * b, v.max() + 3 * b, 200)
        want = np.exp(-0.5 * ((grid[:, None] - v) / b) ** 2).sum(1) / (len(v) * b * math.sqrt(2 * math.pi))
        assert np.allclose([got[s][k] for k in range(200)], np.stack([grid, want], 1))
    ranges = {r.s: r for r in rc.error_ranges(df, ["s"]).collect()}
    assert set(ranges) == {"a", "b"} and ranges["a"].mean == pytest.approx(1.2, abs=0.1) and ranges["b"].high - ranges["b"].mean == pytest.approx(2.3548 * 0.2, rel=0.3)


def test_fit_keeps_the_digits_of_near_collinear_terms(spark):
    random.seed(3)
    rows = [("a", x := 1000 + random.random(), 3 + 2 * x - 0.5 * x * x, random.uniform(0.5, 2)) for _ in range(50)] + [("b", 5.0, 1.0, 1.0)] * 4
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "s string, x double, y double, w double")
    x = F.col("x") - 1000
    got = {r.s: r for r in rc.orthogonal_fit(df, ["s"], [F.lit(1.0), x, x * x], F.col("y"), ["p", "q", "r"], F.col("w")).collect()}
    assert (got["a"].r, got["a"].q, got["a"].p) == (pytest.approx(-0.5, rel=1e-6), pytest.approx(2 - 1000, rel=1e-9), pytest.approx(3 + 2000 - 500000, rel=1e-12))
    assert got["b"].p is None or got["b"].q is None


def test_recalibration_of_spectra_and_segments(spark):
    random.seed(4)
    rows = []
    for s, (a, b) in {"x": (2e-6, 1e-4), "y": (-3e-6, -2e-4)}.items():
        for k in range(60):
            ref = random.uniform(150, 900)
            rows.append((s, (ref - b) / (1 + a), ref))
        rows.append((s, 500.0, 500.02))  # an outlier
    df = spark.createDataFrame(rows, "s string, mz double, ref_mz double")
    fit = rc.robust_fit(df, ["s"], 1)
    left = [r for r in rc.mz_calibrated(df, fit, ["s"]).collect() if r.mz != 500.0]
    assert max(abs(r.mz_cal - r.ref_mz) / r.ref_mz * 1e6 for r in left) < 1e-3
    part = rc.mz_calibrated(df, fit, ["s"], (400.0, 300.0)).collect()
    assert all((r.mz_cal == r.mz) != (300 <= r.mz <= 400) for r in part)


def test_fit_in_steps(spark):
    random.seed(5)
    points, law = [], lambda f, k: 1e7 * (1 + k * 1e-6) / f
    fs = sorted(random.uniform(1e4, 1e5) for _ in range(14))[::-1]
    points = [("a", 1e7 / f, f, law(f, i // 4)) for i, f in enumerate(fs)] + [("b", 100.0, 1e5, 100.1)]
    df = spark.createDataFrame(points, "s string, mz double, frequency double, mz_calc double")
    peaks = spark.createDataFrame([("a", 1e7 / f, f) for f in (1.1e5, *fs, 5e4, 9e3)] + [("b", 50.0, 2e5), ("c", 1.0, 1.0)], "s string, mz double, frequency double")
    got = {(r.s, r.frequency): r.mz_cal for r in rc.step_calibrated(peaks, df, ["s"], 4).collect()}
    starts = [points[i][1] for i in (0, 4, 8)]
    for (s, f), cal in got.items():
        mz = {"a": 1e7 / f, "b": 50.0, "c": 1.0}[s]
        if s != "a":
            assert cal == mz
            continue
        block = max(0, sum(mz >= x for x in starts) - 1)
        own = points[block * 4 : block * 4 + 5]
        u = np.array([[1e5 / p[2], (1e5 / p[2]) ** 2] for p in own])
        a, b = np.linalg.lstsq(u, np.array([p[3] for p in own]), rcond=None)[0]
        assert cal == pytest.approx(a * 1e5 / f + b * (1e5 / f) ** 2, rel=1e-12)


def test_filter_by_resolving_power(spark):
    random.seed(6)
    rows = [("a", mz := random.uniform(200, 800), (4e8 + random.gauss(0, 1e7)) / mz) for _ in range(300)] + [("a", 300.0, 9e8 / 300), ("a", 300.0, None), ("b", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, mz double, resolving_power double")
    kept = rc.resolving_power_filter(df, ["s"]).collect()
    assert len(kept) == 302 and not any(r.resolving_power and r.resolving_power * r.mz > 8e8 for r in kept)
