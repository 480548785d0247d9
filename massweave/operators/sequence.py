"""Ordered traces: derivatives, smoothing, bounds and peak metrics; transients to frequency spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derivative(df: DataFrame, keys: list[str], order: str, value: str, out: str, degree: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(value) - F.lag(value).over(w) if degree == 1 else F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)
    return df.withColumn(out, step)


def kernel(method: str, window: int, order: int = 2) -> list[float]:
    """Weights of a smoothing window that sum to 1."""
    if method == "savgol":
        half = window // 2
        a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
        return np.linalg.pinv(a)[0].tolist()
    made = {"flat": np.ones, "boxcar": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}
    w = made[method](window)
    return (w / w.sum()).tolist()


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, out: str, weights: list[float]) -> DataFrame:
    """A weighted moving sum in one ordered window; at the ends the weights inside are scaled up to 1."""
    w, half = Window.partitionBy(*keys).orderBy(order), len(weights) // 2
    parts = [(k, F.lag(value, half - k).over(w)) for k in range(len(weights))]
    total = sum((F.coalesce(p * weights[k], F.lit(0.0)) for k, p in parts), F.lit(0.0))
    share = sum((F.when(p.isNotNull(), F.lit(weights[k])).otherwise(F.lit(0.0)) for k, p in parts), F.lit(0.0))
    return df.withColumn(out, F.try_divide(total, share))


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn("_a", (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def dispersity(df: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """Deviation in x of the most intense points that together hold less than half of the signal."""
    w = Window.partitionBy(*keys)
    top = w.orderBy(F.col(y).desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_s", F.sum(y).over(top) / F.sum(y).over(w)).groupBy(*keys).agg(F.stddev_pop(F.when(F.col("_s") < 0.5, F.col(x))).alias("dispersity"))


def noise_scores(df: DataFrame, keys: list[str], x: str, y: str, span: int) -> DataFrame:
    """snr / (snr + 10) of the apex against the median and deviation of ``span`` points on either side."""
    w = Window.partitionBy(*keys).orderBy(x)
    numbered = df.withColumn("_n", F.row_number().over(w))
    apex = numbered.groupBy(*keys).agg(F.max(F.struct(F.col(y).alias("h"), (-F.col("_n")).alias("n"))).alias("_t"))
    sides = numbered.join(apex.select(*keys, (-F.col("_t.n")).alias("_a"), F.col("_t.h").alias("_h")), keys)
    side = F.when(F.col("_n").between(F.col("_a") - span, F.col("_a") - 1), "l").when(F.col("_n").between(F.col("_a") + 1, F.col("_a") + span), "r")
    rated = sides.withColumn("_s", side).where("_s is not null").groupBy(*keys, "_s").agg(((F.first("_h") - F.median(y)) / F.nullif(F.stddev_pop(y), F.lit(0.0))).alias("_snr"))
    score = F.greatest(F.col("_snr"), F.lit(0.0)) / (F.greatest(F.col("_snr"), F.lit(0.0)) + 10)
    return rated.groupBy(*keys).agg(F.max(F.when(F.col("_s") == "l", score)).alias("left"), F.max(F.when(F.col("_s") == "r", score)).alias("right")).withColumns({"noise_score_min": F.least("left", "right"), "noise_score_max": F.greatest("left", "right")})


def bounds(y: np.ndarray, apex: int, threshold: float) -> tuple[int, int]:
    """Walk down from the apex while the signal falls and stays above the threshold."""
    a = b = apex
    while a > 0 and y[a - 1] <= y[a] and y[a - 1] >= threshold:
        a -= 1
    while b < len(y) - 1 and y[b + 1] <= y[b] and y[b + 1] >= threshold:
        b += 1
    return a, b


def width_at(x: np.ndarray, y: np.ndarray, apex: int, share: float) -> tuple[float, float]:
    """Places left and right where the line between points crosses a share of the apex's height."""
    level = y[apex] * share

    def cross(step: int) -> float:
        i = apex
        while 0 <= i + step < len(y) and y[i + step] > level:
            i += step
        j = i + step
        if not 0 <= j < len(y) or y[i] == y[j]:
            return float(x[i])
        return float(x[i] + (x[j] - x[i]) * (y[i] - level) / (y[i] - y[j]))

    return cross(-1), cross(1)


def peak_metrics(df: DataFrame, keys: list[str], x: str, y: str, threshold: float = 0.01) -> DataFrame:
    """Of each trace's highest peak: bounds, area, half-height width, tailing factor and Gaussian likeness."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = ["apex_x", "start_x", "final_x", "area", "half_height_width", "tailing_factor", "gaussian_similarity"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, kind="stable")
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        apex = int(np.argmax(ys))
        a, b = bounds(ys, apex, threshold * ys[apex])
        left, right = width_at(xs, ys, apex, 0.5)
        low, high = width_at(xs, ys, apex, 0.05)
        front = xs[apex] - low
        part, px = ys[a : b + 1], xs[a : b + 1]
        sigma = (right - left) / 2.3548200450309493
        like = np.nan
        if sigma > 0 and len(part) > 2 and part.std() > 0:
            model = ys[apex] * np.exp(-0.5 * ((px - xs[apex]) / sigma) ** 2)
            like = 1 - ((part - model) ** 2).sum() / ((part - part.mean()) ** 2).sum()
        values = [xs[apex], xs[a], xs[b], float(np.trapezoid(part, px)), right - left, (high - low) / (2 * front) if front > 0 else np.nan, like]
        return pd.DataFrame([[*pdf[keys].iloc[0], *values]], columns=[*keys, *names])

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + "".join(f", {n} double" for n in names))


APODIZATIONS = {
    "Hamming": lambda n: np.hamming(n), "Hanning": lambda n: np.hanning(n), "Blackman": lambda n: np.blackman(n), "Rectangular": lambda n: np.ones(n),
    "Full-Sine": lambda n: np.sin(np.linspace(0, np.pi, n)), "Half-Sine": lambda n: np.sin(np.linspace(np.pi / 2, np.pi, n)), "Kaiser": lambda n: np.kaiser(n, 8.6), "Half-Kaiser": lambda n: np.kaiser(2 * n, 8.6)[n:],
}


def transient_spectrum(transients: DataFrame, bandwidth: float, apodization: str = "Hanning", zero_fills: int = 1, truncations: int = 0) -> DataFrame:
    """sample, scan, signal array to (sample, scan, frequency, magnitude) rows, one Fourier transform a transient."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                s = np.asarray(r.signal, float)
                s = s[: max(1, len(s) >> truncations)]
                s = s * APODIZATIONS[apodization](len(s))
                n = len(s) << zero_fills
                m = np.abs(np.fft.rfft(s, n))
                out.append(pd.DataFrame({"sample": r.sample, "scan": r.scan, "frequency": np.linspace(0, bandwidth, len(m)), "magnitude": m}))
            if out:
                yield pd.concat(out)

    return transients.select("sample", "scan", "signal").mapInPandas(run, "sample string, scan int, frequency double, magnitude double")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
