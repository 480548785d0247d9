"""Recalibration of m/z: automatic error ranges, fits of whole spectra or segments, fits in steps; filters by resolving power.

Least squares go by orthogonal terms (modified Gram-Schmidt), one aggregate a term, which keeps the digits that normal
equations of near collinear terms lose. Densities are sums over the values at the places of a grid, added up before any shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.operators import fits
from massweave.storage import shared_folder

#: Places of a density and deviations of its kernel that it reaches beyond the values.
PLACES, CUT = 200, 3
#: Cells of a kernel's width and terms of its series about a cell's middle.
CELLS, TERMS = 64, 9
#: A term that keeps less of its square than this share beside the others tells nothing more than they do.
COLLINEAR = 1e-20


def with_sums(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one row that ``sums`` has of their keys, null keys too; without keys there is one row for all."""
    if not keys:
        return rows.crossJoin(F.broadcast(sums))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return rows.alias("a").join(sums.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in sums.columns if c not in keys])


def orthogonal_fit(points: DataFrame, keys: list[str], terms: list[Column], y: Column, names: list[str], weight: Column | None = None) -> DataFrame:
    """keys and one coefficient a term by weighted least squares, null where the points don't determine them."""
    n, w = len(terms), F.col("_w")
    t = [F.col(f"_t{k}") for k in range(n)]
    rows = points.select(*keys, *[c.cast("double").alias(f"_t{k}") for k, c in enumerate(terms)], y.cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).alias("_w"))
    rows = rows.dropna(subset=[*[f"_t{k}" for k in range(n)], "_y", "_w"])
    # What each term's square was before the others were taken off it.
    found = rows.groupBy(*keys).agg(*[F.sum(w * c * c).alias(f"_whole{k}") for k, c in enumerate(t)])
    for k in range(n):
        later = range(k + 1, n)
        sums = rows.groupBy(*keys).agg(F.sum(w * t[k] * t[k]).alias("_s"), F.sum(w * t[k] * F.col("_y")).alias("_sy"), *[F.sum(w * t[k] * t[j]).alias(f"_s{j}") for j in later])
        usable = F.when(F.col("_s") > COLLINEAR * F.col(f"_whole{k}"), F.col("_s"))
        ratios = {f"_c{k}": F.try_divide("_sy", usable), **{f"_r{k}{j}": F.try_divide(F.col(f"_s{j}"), usable) for j in later}}
        found = with_sums(found, sums, keys).withColumns(ratios).drop("_s", "_sy", *[f"_s{j}" for j in later])
        if later:
            step = with_sums(rows, found.select(*keys, *ratios), keys)
            taken = {"_y": F.col("_y") - F.col(f"_c{k}") * t[k], **{f"_t{j}": t[j] - F.col(f"_r{k}{j}") * t[k] for j in later}}
            rows = step.withColumns(taken).select(rows.columns)
    out: dict[int, Column] = {}
    for k in reversed(range(n)):
        out[k] = F.col(f"_c{k}") - sum((F.col(f"_r{k}{j}") * out[j] for j in range(k + 1, n)), F.lit(0.0))
    return found.select(*keys, *[out[k].alias(name) for k, name in enumerate(names)])


def density(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, place, x, density: Gaussian kernels of Scott's width at ``PLACES`` places; keys without any spread have none.

    Values are summed up in cells of a part of the width: the kernel's series about a cell's middle needs the powers' sums only, to ten digits
    wherever the kernel is above the least double.
    """
    v = F.col(column).cast("double")
    stats = values.groupBy(*keys).agg(F.count(v).alias("_n"), F.stddev_samp(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi")).where("_s > 0")
    stats = stats.withColumn("_b", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    rows = values.select(*keys, v.alias("_v")).where("_v is not null").join(stats, keys).withColumn("_u", (F.col("_v") - F.col("_lo")) / F.col("_b") * CELLS)
    rows = rows.withColumn("_cell", F.floor("_u")).withColumn("_d", (F.col("_u") - F.col("_cell") - 0.5) / CELLS)
    power, powers = F.lit(1.0), []
    for k in range(TERMS):
        powers.append(F.sum(power).alias(f"_m{k}"))
        power = power * F.col("_d")
    cells = rows.groupBy(*keys, "_cell").agg(*powers)
    # exp(-(z - d)^2 / 2) = exp(-z^2 / 2) sum He_k(z) d^k / k!, here by powers of z.
    hermite = [np.polynomial.hermite_e.herme2poly([0.0] * k + [1.0]) / math.factorial(k) for k in range(TERMS)]
    terms = [sum((F.col(f"_m{k}") * float(hermite[k][j]) for k in range(j, TERMS) if hermite[k][j]), F.lit(0.0)).alias(f"_p{j}") for j in range(TERMS)]
    cells = cells.select(*keys, "_cell", *terms).join(stats, keys).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    x = F.col("_lo") - CUT * F.col("_b") + F.col("place") * (F.col("_hi") - F.col("_lo") + 2 * CUT * F.col("_b")) / (PLACES - 1)
    cells = cells.withColumn("_x", x).withColumn("_z", (F.col("_x") - F.col("_lo")) / F.col("_b") - (F.col("_cell") + 0.5) / CELLS)
    z, series = F.col("_z"), F.col(f"_p{TERMS - 1}")
    for j in reversed(range(TERMS - 1)):
        series = series * z + F.col(f"_p{j}")
    kernel = F.when(F.abs(z) < 39, F.exp(-0.5 * z * z) * series).otherwise(0.0)
    sums = cells.groupBy(*keys, "place").agg(F.first("_x").alias("x"), (F.sum(kernel) / F.first(F.col("_n") * F.col("_b") * math.sqrt(2 * math.pi))).alias("density"))
    return sums.select(*keys, "place", "x", "density")


def spread(values: DataFrame, keys: list[str], column: str, least: int = 5) -> DataFrame:
    """keys, mean, sigma, fwhm of the Gaussian fitted to the density of values, for keys with at least ``least`` of them."""
    enough = values.groupBy(*keys).agg(F.count(column).alias("_n")).where(F.col("_n") >= least).select(*keys)
    got = fits.fitted(density(values.join(enough, keys, "left_semi"), keys, column), keys, "x", "density")
    return got.select(*keys, F.col("centre").alias("mean"), "sigma", "fwhm")


def error_ranges(assigned: DataFrame, keys: list[str], error: str = "error_ppm", least: int = 5) -> DataFrame:
    """keys, mean, fwhm, low, high: where the errors of assigned peaks lie, as thresholds of calibration points."""
    return spread(assigned, keys, error, least).select(*keys, "mean", "fwhm", (F.col("mean") - F.col("fwhm")).alias("low"), (F.col("mean") + F.col("fwhm")).alias("high"))


def chosen(points: DataFrame, ranges: DataFrame, keys: list[str], error: str = "error_ppm") -> DataFrame:
    """Calibration points whose error lies in their spectrum's range; spectra without a range have none."""
    return points.join(ranges.select(*keys, "low", "high"), keys).where(F.col(error).between(F.col("low"), F.col("high"))).select(points.columns)


def mz_terms(order: int) -> list[Column]:
    mz = F.col("mz") / 1000.0
    return {1: [F.lit(1.0), mz], 2: [F.lit(1.0), mz, mz * mz]}[order]


def mz_fit(points: DataFrame, keys: list[str], order: int = 1) -> DataFrame:
    """keys, k0, k1 (and k2): the line or parabola of the shift over m/z (in thousands) of least root mean square ppm error.

    ``points``: mz, ref_mz. Fitted is ref_mz - mz, whose digits are all the error's, weighted by 1 / ref_mz squared.
    """
    return orthogonal_fit(points, keys, mz_terms(order), F.col("ref_mz") - F.col("mz"), [f"k{k}" for k in range(order + 1)], F.pow("ref_mz", F.lit(-2.0)))


def mz_calibrated(peaks: DataFrame, fit: DataFrame, keys: list[str], segment: tuple[float, float] | None = None) -> DataFrame:
    """``mz_cal`` of peaks (mz); with a segment only of those in it. Peaks of spectra without a fit keep their m/z."""
    names = [c for c in fit.columns if c not in keys]
    shift = sum((F.col(c) * t for c, t in zip(names, mz_terms(len(names) - 1))), F.lit(0.0))
    if segment:
        shift = F.when(F.col("mz").between(*sorted(segment)), shift)
    return peaks.join(fit, keys, "left").withColumn("mz_cal", F.col("mz") + F.coalesce(shift, F.lit(0.0))).drop(*names)


def robust_fit(points: DataFrame, keys: list[str], order: int = 1, beyond: float = 3.0) -> DataFrame:
    """As ``mz_fit`` of the points left when those ``beyond`` so many root mean square errors are gone, until none is."""
    shared_folder(points.sparkSession)
    own = points.select(*keys, "mz", "ref_mz").withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    while True:
        fit = mz_fit(own, keys, order).checkpoint()
        error = mz_calibrated(own, fit, keys).withColumn("_e", (F.col("mz_cal") - F.col("ref_mz")) / F.col("ref_mz") * 1e6)
        limit = F.sqrt(F.avg(F.col("_e") * F.col("_e")).over(Window.partitionBy(*keys)))
        out = error.withColumn("_limit", beyond * limit).where((F.abs("_e") > F.col("_limit")) & (F.col("_limit") > 1e-9)).select("_id").checkpoint()
        if out.isEmpty():
            return fit
        own = own.join(out, "_id", "left_anti").checkpoint()


def step_calibrated(peaks: DataFrame, points: DataFrame, keys: list[str], steps: int = 4) -> DataFrame:
    """``mz_cal`` of peaks (mz, frequency) by fits of a / f + b / f^2 to every ``steps`` + 1 consecutive points (mz, frequency, mz_calc).

    Neighbouring fits share a point, at which the next one takes over; the first and the last also serve the peaks outside.
    Spectra with no more than ``steps`` points keep their m/z.
    """
    shared_folder(peaks.sparkSession)
    w = Window.partitionBy(*keys)
    own = points.withColumns({"_i": F.row_number().over(w.orderBy("mz", "frequency")) - 1, "_all": F.count("*").over(w)})
    last = F.floor((F.col("_all") - 1 - steps) / steps)
    block = F.floor(F.col("_i") / steps)
    both = F.array_distinct(F.array(block, F.when(F.col("_i") % steps == 0, block - 1).otherwise(block)))
    placed = own.where(F.col("_all") > steps).withColumn("_block", F.explode(both)).where((F.col("_block") >= 0) & (F.col("_block") <= last) & (F.col("_i") <= (F.col("_block") + 1) * steps))
    u = F.lit(1e5) / F.col("frequency")
    fit = orthogonal_fit(placed, [*keys, "_block"], [u, u * u], F.col("mz_calc"), ["_a", "_b"])
    begins = placed.where(F.col("_i") == F.col("_block") * steps).select(*keys, "_block", F.col("mz").alias("_from"))
    # Peaks take the fit of the last block that begins at or below them.
    marks = begins.select(*keys, F.col("_from").alias("_x"), F.col("_block").alias("_b"), F.lit(None).cast("string").alias("_row"))
    rows = peaks.withColumn("_row", F.monotonically_increasing_id().cast("string")).checkpoint()
    every = marks.union(rows.select(*keys, F.col("mz").alias("_x"), F.lit(None).cast("long").alias("_b"), "_row"))
    found = every.withColumn("_block", F.last("_b", ignorenulls=True).over(w.orderBy("_x", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))).where("_row is not null").select("_row", F.coalesce("_block", F.lit(0)).alias("_block"))
    out = rows.join(found, "_row").join(fit, [*keys, "_block"], "left")
    return out.withColumn("mz_cal", F.coalesce(F.col("_a") * u + F.col("_b") * u * u, F.col("mz"))).select(*peaks.columns, "mz_cal")


def resolving_power_filter(peaks: DataFrame, keys: list[str], deviations: float = 3.0) -> DataFrame:
    """Peaks whose resolving power times m/z lies within ``deviations`` half widths of what is usual in their spectrum.

    What is usual is the Gaussian fitted to the density of these products. Peaks without a resolving power, and those of
    spectra with too few of them for a fit, stay.
    """
    own = F.col("resolving_power") * F.col("mz")
    usual = spread(peaks.withColumn("_p", own), keys, "_p").withColumnsRenamed({"mean": "_mean", "fwhm": "_fwhm"}).drop("sigma")
    near = F.abs(own - F.col("_mean")) <= F.col("_fwhm") * deviations / 2
    return peaks.join(usual, keys, "left").where(F.coalesce(near, F.lit(True))).select(peaks.columns)
