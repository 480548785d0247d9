"""Calibration by least squares: the terms of every spectrum's fit come from aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.operators import fits
from massweave.operators.recalibration import orthogonal_fit

#: Frequencies are divided by it, so that the sums' matrix is well scaled.
SCALE = 1e5


#: Coefficients by orthogonal terms; null where the points don't determine them.
least_squares = orthogonal_fit


def frequency_terms(kind: str) -> tuple[list[Column], list[str]]:
    u = F.lit(SCALE) / F.col("frequency")
    return {"linear": ([u, F.lit(1.0)], ["a", "c"]), "ledford": ([u, u * u], ["a", "b"]), "quadratic": ([u, u * u, F.lit(1.0)], ["a", "b", "c"])}[kind]


def frequency_fit(points: DataFrame, keys: list[str], kind: str = "ledford") -> DataFrame:
    """Terms a, b, c of m/z = a/f + b/f^2 + c (those that the kind has) from points (frequency, mz_calc); f in ``SCALE`` Hz."""
    terms, names = frequency_terms(kind)
    fit = least_squares(points, keys, terms, F.col("mz_calc"), names)
    return fit.select(*keys, *[F.col(n) if n in names else F.lit(0.0).alias(n) for n in "abc"])


def frequency_calibrated(peaks: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """``mz_cal`` of peaks (frequency) by their spectrum's terms."""
    u = F.lit(SCALE) / F.col("frequency")
    return peaks.join(fit, keys, "left").withColumn("mz_cal", F.col("a") * u + F.col("b") * u * u + F.col("c")).drop("a", "b", "c")


def frequency_recalibrated(peaks: DataFrame, points: DataFrame, keys: list[str], kind: str = "ledford") -> DataFrame:
    """``mz_cal`` of peaks (mz, frequency) where the fit to points (mz, frequency, mz_calc) lowers their error, else the m/z."""
    fit = frequency_fit(points, keys, kind)
    after = frequency_calibrated(points, fit, keys).groupBy(*keys).agg(rms_ppm("mz").alias("_before"), rms_ppm().alias("_after"))
    out = frequency_calibrated(peaks, fit, keys).join(after, keys, "left")
    return out.withColumn("mz_cal", F.when(F.col("_after") < F.col("_before"), F.col("mz_cal")).otherwise(F.col("mz"))).drop("_before", "_after")


def rms_ppm(mz: str = "mz_cal", calc: str = "mz_calc") -> Column:
    error = (F.col(mz) - F.col(calc)) / F.col(calc) * 1e6
    return F.sqrt(F.avg(error * error))


def error_fit(points: DataFrame, keys: list[str], order: int = 2) -> DataFrame:
    """Polynomial of the ppm error over m/z (in thousands): coefficients e0, e1 and, of the second order, e2."""
    x = F.col("mz") / 1000.0
    terms = [F.lit(1.0), x, x * x][: order + 1]
    return least_squares(points, keys, terms, F.col("error_ppm"), [f"e{k}" for k in range(order + 1)])


def error_corrected(peaks: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """``mz_cal``: the fitted error taken off; spectra without a fit stay."""
    x = F.col("mz") / 1000.0
    names = [c for c in fit.columns if c not in keys]
    error = F.coalesce(sum((F.col(c) * F.pow(x, F.lit(int(c[1:]))) for c in names), F.lit(0.0)), F.lit(0.0))
    return peaks.join(fit, keys, "left").withColumn("mz_cal", F.col("mz") / (1 + error * 1e-6)).drop(*names)


def magnetron_frequency(peaks: DataFrame, keys: list[str], most: float = 50.0, bins: int = 300) -> DataFrame:
    """keys, magnetron_frequency: the centre of the Gaussian fitted to the histogram of steps below ``most`` between neighbouring peaks' frequencies."""
    step = F.col("frequency") - F.lag("frequency").over(Window.partitionBy(*keys).orderBy("frequency"))
    steps = peaks.select(*keys, step.alias("_d")).where(F.col("_d") < most)
    span = steps.groupBy(*keys).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).where("_hi > _lo")
    width = (F.col("_hi") - F.col("_lo")) / bins
    counts = steps.join(span, keys).groupBy(*keys, F.least(F.floor((F.col("_d") - F.col("_lo")) / width), F.lit(bins - 1)).alias("_bin")).agg(F.count("*").alias("_n"))
    every = span.withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(counts, [*keys, "_bin"], "left")
    places = every.select(*keys, (F.col("_lo") + F.col("_bin") * width).alias("_x"), F.coalesce("_n", F.lit(0)).cast("double").alias("_y"))
    return fits.fitted(places, keys, "_x", "_y").select(*keys, F.col("centre").alias("magnetron_frequency"))
