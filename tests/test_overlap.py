"""Errors of overlapping peaks against a fine simulation of single peaks."""

import math

import numpy as np
import pytest

from massweave.operators import overlap


def fine_apex(mz, height, power):
    """Place of the middle maximum of three Gaussians by Newton's method on the slope."""
    sigma = [m / p / math.sqrt(8 * math.log(2)) for m, p in zip(mz, power)]
    x = mz[1]
    for _ in range(50):
        g = [h * math.exp(-0.5 * ((x - m) / s) ** 2) for m, h, s in zip(mz, height, sigma)]
        slope = sum(-v * (x - m) / s**2 for v, m, s in zip(g, mz, sigma))
        bend = sum(v * (((x - m) / s**2) ** 2 - 1 / s**2) for v, m, s in zip(g, mz, sigma))
        x -= slope / bend
    return x, sum(h * math.exp(-0.5 * ((x - m) / s) ** 2) for m, h, s in zip(mz, height, sigma))


def test_shifts_are_those_of_the_sum(spark):
    rows = [("a", 400.10, 10.0, 5000.0), ("a", 400.30, 50.0, 5000.0), ("a", 400.46, 80.0, 5000.0), ("a", 400.75, 20.0, 5000.0), ("a", 401.2, 5.0, 5000.0), ("b", 300.1, 1.0, 9000.0), ("b", 300.5, 1.0, None), ("b", 300.6, 2.0, 9000.0)]
    got = {(r.s, r.mz): r for r in overlap.predicted(spark.createDataFrame(rows, "s string, mz double, abundance double, resolving_power double"), ["s"], valley=0.9).collect()}
    assert len(got) == len(rows)
    for k in (1, 2):
        mz, height, power = zip(*(r[1:] for r in rows[k - 1 : k + 2]))
        found = overlap.shifts(np.array([mz]), np.array([height]), np.array([power]), 0.1, 0.9, 100)[0]
        x, y = fine_apex(mz, height, [p * found[2] for p in power])
        r = got["a", mz[1]]
        assert r.predicted_mz == pytest.approx(x, abs=2e-5) and r.predicted_abundance == pytest.approx(y, rel=1e-3)
        assert r.mass_shift_ppm == pytest.approx((r.predicted_mz - mz[1]) / mz[1] * 1e6) and r.predicted_error_ppm == r.mass_shift_ppm
    assert got["a", 400.30].mass_shift_ppm > 0 > got["a", 400.46].mass_shift_ppm
    assert got["a", 400.10].mass_shift_ppm is None and got["a", 400.10].predicted_error_ppm == got["a", 400.30].mass_shift_ppm
    assert got["a", 401.2].predicted_error_ppm == got["a", 400.46].mass_shift_ppm and got["b", 300.5].predicted_error_ppm is None


def test_powers_rise_until_peaks_part():
    mz, height = np.array([[500.0, 500.05, 500.1]]), np.array([[10.0, 10.0, 10.0]])
    assert np.isnan(overlap.shifts(mz, height, np.full((1, 3), 4000.0), 0.1, 0.01, 2)).all()
    place, high, factor = overlap.shifts(mz, height, np.full((1, 3), 4000.0), 0.1, 0.01, 100)[0]
    assert factor > 2 and place == pytest.approx(500.05, abs=1e-6) and high == pytest.approx(10.0, rel=0.02)


def plain_shifts(mz, height, power, rise, valley, rounds):
    """The first round whose simulation has three apexes and two low valleys, a row at a time, no round left out."""
    out = np.full((len(mz), 3), np.nan)
    for i in range(len(mz)):
        for k in range(rounds + 1):
            x, y = (v[0] for v in overlap.simulated(mz[i : i + 1], height[i : i + 1], power[i : i + 1] * (1 + k * rise)))
            top = [j for j in range(1, len(y) - 1) if y[j - 1] < y[j] > y[j + 1]]
            low = [y[j] for j in range(1, len(y) - 1) if y[j - 1] > y[j] < y[j + 1]]
            if len(top) == 3 and len(low) == 2 and max(low) <= valley * height[i].max():
                place, high = overlap.apex_of(x[None], y[None], np.array([top[1]]))
                out[i] = place[0], high[0], 1 + k * rise
                break
    return out


def test_rounds_left_out_would_fail(monkeypatch):
    rng = np.random.default_rng(5)
    n = 240
    width = 10 ** rng.uniform(-5, -3, n)
    mz = 50 + np.cumsum(np.stack([np.zeros(n), *(width * rng.uniform(0.05, [3, 9, 100] * (n // 3)) for _ in "ab")]), 0).T
    height = 10 ** rng.uniform(-2, 0, (n, 3))
    power = mz / width[:, None] / overlap.SIGMAS * 10 ** rng.uniform(-0.4, 0.4, (n, 3)) ** np.resize([0, 1], n)[:, None]
    simulations = []
    monkeypatch.setattr(overlap, "simulated", lambda mz, *a, f=overlap.simulated: simulations.append(len(mz)) or f(mz, *a))
    for valley in (0.01, 0.1, 0.7):
        simulations.clear()
        got = overlap.shifts(mz, height, power, 0.25, valley, 12)
        n_simulated = sum(simulations)
        want = plain_shifts(mz, height, power, 0.25, valley, 12)
        assert np.isfinite(want).any() and np.array_equal(got, want, equal_nan=True)
        assert n_simulated < (sum(simulations) - n_simulated) * 0.7
