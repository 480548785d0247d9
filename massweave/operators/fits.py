"""Line-shape fits of peaks: Levenberg-Marquardt and particle swarms over whole Arrow batches of peaks at once.

A peak's points travel as one array; a batch of peaks is one padded matrix, and each step solves the small normal
equations of all its peaks together. Widths are fitted as logarithms, so they stay positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HALF = math.sqrt(2 * math.log(2))
#: Peaks of a batch, steps of a fit and the relative gain of a step below which a fit has settled.
BATCH, STEPS, SETTLED = 512, 200, 1e-12
#: A swarm's particles and steps; the weights of its own motion, its own best and the common best.
PARTICLES, FLIGHTS, WEIGHTS = 60, 300, (0.72, 1.49, 1.49)


@cache
def faddeeva_terms(n: int = 40) -> tuple[float, np.ndarray]:
    """Scale and coefficients of Weideman's rational approximation of the Faddeeva function, from a Fourier transform."""
    m = 2 * n
    scale = math.sqrt(n / math.sqrt(2))
    t = scale * np.tan(np.arange(-m + 1, m) * math.pi / m / 2)
    f = np.concatenate([[0.0], np.exp(-t * t) * (scale * scale + t * t)])
    return scale, np.real(np.fft.fft(np.fft.fftshift(f)))[1 : n + 1][::-1] / (2 * m)


def faddeeva(z: np.ndarray) -> np.ndarray:
    """exp(-z^2) erfc(-iz) in the upper half plane."""
    scale, a = faddeeva_terms()
    lower = scale - 1j * z
    return 2 * np.polyval(a, (scale + 1j * z) / lower) / lower**2 + 1 / math.sqrt(math.pi) / lower


def voigt(d: np.ndarray, sigma: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """A Gaussian of deviation sigma folded with a Lorentzian of half width gamma, of height 1."""
    s = sigma * math.sqrt(2)
    return faddeeva((d + 1j * gamma) / s).real / faddeeva(1j * gamma / s + 0 * d).real


def gaussian(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[..., 2:3] * np.exp(-0.5 * ((x - p[..., 0:1]) / np.exp(p[..., 1:2])) ** 2)


def lorentzian(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[..., 2:3] / (1 + ((x - p[..., 0:1]) / np.exp(p[..., 1:2])) ** 2)


def pseudo_voigt(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    share, z = 1 / (1 + np.exp(-p[..., 3:4])), (x - p[..., 0:1]) / np.exp(p[..., 1:2])
    return p[..., 2:3] * (share / (1 + z * z) + (1 - share) * np.exp(-math.log(2) * z * z))


def full_voigt(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[..., 2:3] * voigt(x - p[..., 0:1], np.exp(p[..., 1:2]), np.exp(p[..., 3:4]))


def gaussian_on_base(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return gaussian(p, x) + np.maximum(p[..., 3:4], 0)


#: Of each shape its function of (centre, log width, height, ...) and the fourth value to begin with, as functions of the
#: half width at half height 1.
SHAPES: dict[str, tuple[Callable, list[float]]] = {
    "gaussian": (gaussian, [0.0, -math.log(HALF), 1.0]), "lorentzian": (lorentzian, [0.0, 0.0, 1.0]),
    "gaussian_on_base": (gaussian_on_base, [0.0, -math.log(HALF), 1.0, 0.01]), "pseudo_voigt": (pseudo_voigt, [0.0, 0.0, 1.0, 0.0]), "voigt": (full_voigt, [0.0, math.log(0.6), 1.0, math.log(0.5)]),
}


def marquardt(shape: Callable, p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least-squares parameters of every row of x, y with weights w, from those given."""
    n = p.shape[1]
    cost = lambda q: (w * (shape(q, x) - y) ** 2).sum(1)
    now, damping, live = cost(p), np.full(len(p), 1e-3), np.ones(len(p), bool)
    for _ in range(STEPS):
        if not live.any():
            break
        r = w * (shape(p, x) - y)
        steps = [1e-6 * np.eye(n)[k] for k in range(n)]
        j = np.stack([(shape(p + s, x) - shape(p - s, x)) / 2e-6 for s in steps], 2)
        jw = j * w[:, :, None]
        a, g = np.einsum("bmi,bmj->bij", jw, j), np.einsum("bmi,bm->bi", j, r)
        held = np.einsum("bii->bi", a)
        a = a + np.einsum("bi,ij->bij", damping[:, None] * held + 1e-12, np.eye(n))
        tried = p - np.linalg.solve(a, g[:, :, None])[:, :, 0]
        tried[:, [1, *range(3, n)]] = np.clip(tried[:, [1, *range(3, n)]], -12, 12)
        then = cost(tried)
        better = live & (then < now)
        settled = better & (now - then <= SETTLED * now)
        p, now = np.where(better[:, None], tried, p), np.where(better, then, now)
        damping = np.where(better, damping / 10, damping * 10)
        live &= ~settled & (damping < 1e12) & (now > 0)
    return p


def swarm(shape: Callable, p: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int) -> np.ndarray:
    """The same by particles that fly about the parameters given; ``seed`` makes it repeatable."""
    rng = np.random.default_rng(seed)
    at = p[:, None, :] + rng.uniform(-1, 1, (len(p), PARTICLES, p.shape[1])) * np.array([1.0, 1.5, 0.5, 2.0])[: p.shape[1]]
    speed = np.zeros_like(at)
    cost = lambda q: (w[:, None] * (shape(q, x[:, None]) - y[:, None]) ** 2).sum(2)
    own, own_cost = at.copy(), cost(at)
    inertia, to_own, to_best = WEIGHTS
    for _ in range(FLIGHTS):
        best = np.take_along_axis(own, own_cost.argmin(1)[:, None, None], 1)
        a, b = rng.random((2, *at.shape))
        speed = inertia * speed + to_own * a * (own - at) + to_best * b * (best - at)
        at = at + speed
        at[..., 1:2] = np.clip(at[..., 1:2], -8, 8)
        at[..., 3:] = np.clip(at[..., 3:], -8, 8)
        now = cost(at)
        better = now < own_cost
        own, own_cost = np.where(better[..., None], at, own), np.where(better, now, own_cost)
    return np.take_along_axis(own, own_cost.argmin(1)[:, None, None], 1)[:, 0]


def width_of(shape: str, p: np.ndarray) -> np.ndarray:
    """Full width at half height."""
    half = np.exp(p[:, 1])
    if shape.startswith("gaussian"):
        return 2 * HALF * half
    if shape != "voigt":
        return 2 * half
    low, high = np.zeros(len(p)), 3 * (HALF * half + np.exp(p[:, 3]))
    for _ in range(60):
        mid = (low + high) / 2
        above = voigt(mid, half, np.exp(p[:, 3])) > 0.5
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return low + high


def fit_batch(shape: str, method: str, xs: list, ys: list, seed: int = 0) -> np.ndarray:
    """centre, fwhm, height, sigma, gamma (or the Lorentzian's share, or the base) and rms of every peak; NaN where there are too few points."""
    fn, start = SHAPES[shape]
    out = np.full((len(xs), 6), np.nan)
    good = [k for k, (x, y) in enumerate(zip(xs, ys)) if len(x) > len(start) and max(y) > 0 and max(x) > min(x)]
    if not good:
        return out
    m = max(len(xs[k]) for k in good)
    x, y, w = np.zeros((3, len(good), m))
    centre, width, height = np.zeros((3, len(good)))
    for i, k in enumerate(good):
        a, b = np.asarray(xs[k], float), np.asarray(ys[k], float)
        top = int(b.argmax())
        above = a[b >= b[top] / 2]
        centre[i], height[i] = a[top], b[top]
        width[i] = max((above.max() - above.min()) / 2, (a.max() - a.min()) / len(a) / 2)
        x[i, : len(a)], y[i, : len(a)], w[i, : len(a)] = (a - centre[i]) / width[i], b / height[i], 1.0
    p = np.tile(np.array(start), (len(good), 1))
    if method == "swarm":
        p = swarm(fn, p, x, y, w, seed)
    elif method == "marquardt":
        p = marquardt(fn, p, x, y, w)
    else:
        raise ValueError(f"no fit by {method}")
    rms = np.sqrt((w * (fn(p, x) - y) ** 2).sum(1) / w.sum(1)) * height
    inner = np.exp(p[:, 1]) * width
    last = {"gaussian": np.full(len(p), np.nan), "lorentzian": inner, "gaussian_on_base": np.maximum(p[:, -1], 0) * height, "pseudo_voigt": 1 / (1 + np.exp(-p[:, -1])), "voigt": np.exp(p[:, -1]) * width}[shape]
    sigma = {"gaussian": inner, "gaussian_on_base": inner, "lorentzian": np.full(len(p), np.nan), "pseudo_voigt": inner / HALF, "voigt": inner}[shape]
    out[good] = np.stack([centre + p[:, 0] * width, width_of(shape, p) * width, p[:, 2] * height, sigma, last, rms], 1)
    return out


NAMES = ("centre", "fwhm", "height", "sigma", "gamma", "rms")


def fitted(points: DataFrame, keys: list[str], x: str, y: str, shape: str = "gaussian", method: str = "marquardt", seed: int = 0) -> DataFrame:
    """keys and the fit of each peak, whose points (keys, x, y) are those of one peak and no more.

    Shapes: gaussian, gaussian_on_base (``gamma`` is the base, not below 0), lorentzian, pseudo_voigt (the Lorentzian's share) and voigt. ``rms`` is the root mean
    square of what the fit leaves. Peaks with no more points than parameters, without height or at one place get
    nulls; points with nulls are left out. The same peaks give the same fit, by swarms too if a batch holds one peak.
    """
    if shape not in SHAPES:
        raise ValueError(f"no line shape {shape}")
    one = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), one))).alias("_points"))
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in NAMES)])
    arrow = to_arrow_schema(schema)
    size = BATCH if method == "marquardt" else 1  # a swarm's random numbers are the peak's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                points = batch.column("_points").to_pylist()
                got = fit_batch(shape, method, [[p["x"] for p in own] for own in points], [[p["y"] for p in own] for own in points], seed)
                columns = [batch.column(k).cast(arrow.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.float64(), from_pandas=True) for c in got.T)], schema=arrow)

    return rows.mapInArrow(run, schema)
