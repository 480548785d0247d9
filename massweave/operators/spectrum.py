"""Operators on spectra: noise, filters, summaries, peak picking, calibration, Kendrick groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors of the apodization windows in the theoretical resolving power.
WINDOW_FACTOR = {"Hamming": 0.685, "Hanning": 0.618, "Blackman": 0.530, "Full-Sine": 0.736}


def log_noise(points: DataFrame, keys: list[str], bins: int = 500, sigma: float = 6.0, correction: float = 0.463) -> DataFrame:
    """Per spectrum: 10 ** (mode of the histogram of log abundance), times the correction and the number of sigmas."""
    logs = points.where("abundance > 0").withColumn("_l", F.log10("abundance"))
    span = logs.groupBy(*keys).agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    cell = F.least(F.lit(bins - 1), F.floor((F.col("_l") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
    counts = logs.join(span, keys).where("_hi > _lo").groupBy(*keys, cell.alias("_b")).agg(F.count("*").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    mode = counts.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_b")).alias("_b"))).alias("_m"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    center = F.col("_lo") + (-F.col("_m._b")) * (F.col("_hi") - F.col("_lo")) / bins
    return mode.select(*keys, F.pow(F.lit(10.0), center).alias("noise"), (F.pow(F.lit(10.0), center) * correction * sigma).alias("threshold"))


def chunk_noise(points: DataFrame, keys: list[str], order: str, chunk: int = 50) -> DataFrame:
    """Mean and deviation of the smallest abundance of every ``chunk`` consecutive points."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumn("_c", F.floor((F.row_number().over(w) - 1) / chunk)).groupBy(*keys, "_c").agg(F.min("abundance").alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("noise"), F.stddev_pop("_m").alias("noise_std"))


def minima_noise(minima: DataFrame, keys: list[str]) -> DataFrame:
    return minima.groupBy(*keys).agg((F.median("abundance") * 2).alias("noise"), (F.stddev_pop("abundance") * 3).alias("noise_std"))


def noise_filter(points: DataFrame, noise: DataFrame, keys: list[str], method: str, value: float) -> DataFrame:
    """Keep points above the threshold of the method: minima, signal_noise, relative_abundance, absolute_abundance or log."""
    if method == "absolute_abundance":
        return points.where(F.col("abundance") > value)
    if method == "relative_abundance":
        return points.withColumn("_m", F.max("abundance").over(Window.partitionBy(*keys))).where(F.col("abundance") > F.col("_m") * value / 100).drop("_m")
    limit = {"minima": lambda: F.col("noise") + value * F.col("noise_std"), "signal_noise": lambda: value * F.col("noise_std"), "log": lambda: F.col("threshold")}
    if method not in limit:
        raise ValueError(f"no noise method {method}")
    return points.join(noise, keys).where(F.col("abundance") > limit[method]()).select(points.columns)


def within(df: DataFrame, column: str, low: float, high: float | None = None) -> DataFrame:
    """Above ``low`` alone is strict; with an upper bound both ends belong."""
    return df.where(F.col(column) > low) if high is None else df.where(F.col(column).between(low, high))


def theoretical_resolving_power(mz: Column, field_t: float, time_s: float, charge: Column | None = None, apodization: str | None = None, low_pressure: bool = True) -> Column:
    factor = (1.274e7 if low_pressure else 2.758e7) * field_t * time_s
    if apodization is not None:
        factor *= WINDOW_FACTOR[apodization]
    return factor * (charge if charge is not None else F.lit(1)) / mz


def numbered(peaks: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``peak_idx`` of every peak of its spectrum from 0, in the order given."""
    return peaks.withColumn("peak_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def without(peaks: DataFrame, drop: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The peaks whose (keys, peak_idx) aren't in ``drop``, numbered anew."""
    return numbered(peaks.join(drop.select(*keys, "peak_idx").distinct(), [*keys, "peak_idx"], "left_anti"), keys, order)


def below_resolving_power(peaks: DataFrame, field_t: float, time_s: float) -> DataFrame:
    """Peaks whose resolving power a transient of that field and time can have."""
    return peaks.where(F.col("resolving_power") < theoretical_resolving_power(F.col("mz"), field_t, time_s, F.col("ion_charge")))


def nominal_ranges(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each nominal mass: first and last peak_idx and the number of peaks; ``odd`` tells its parity."""
    nominal = F.floor("mz").cast("int")
    return peaks.groupBy(*keys, nominal.alias("nominal")).agg(F.min("peak_idx").alias("first_idx"), F.max("peak_idx").alias("last_idx"), F.count("*").alias("n")).withColumn("odd", F.pmod("nominal", F.lit(2)))


def metric_filter(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """All rules {column: {value, operator}} hold; a missing metric fails."""
    ops = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}
    for name, rule in rules.items():
        c = F.col(name)
        df = df.where(c.isNotNull() & ~F.isnan(c.cast("double")) & getattr(c, ops[rule["operator"]])(rule["value"]))
    return df


def summary(peaks: DataFrame, keys: list[str], mz: str = "mz") -> DataFrame:
    """Counts, sums, averages and range of spectra; assigned shares where ``assigned`` exists."""
    a = F.col("abundance")
    own = [
        F.count("*").alias("n_peaks"), F.sum(a).alias("tic"), (F.max(a) / F.min(a)).alias("dynamic_range"),
        (F.sum(F.col(mz) * a) / F.sum(a)).alias("number_average_mw"), (F.sum(F.col(mz) * F.col(mz) * a) / F.sum(F.col(mz) * a)).alias("weight_average_mw"),
        F.max_by(mz, "abundance").alias("most_abundant_mz"),
    ]
    if "assigned" in peaks.columns:
        hit = F.col("assigned")
        own += [F.count(F.when(hit, 1)).alias("n_assigned"), (100 * F.count(F.when(hit, 1)) / F.count("*")).alias("assigned_percent"), (100 * F.coalesce(F.sum(F.when(hit, a)), F.lit(0.0)) / F.sum(a)).alias("assigned_abundance_percent")]
    return peaks.groupBy(*keys).agg(*own)


def extremes(points: DataFrame, keys: list[str], order: str, value: str, minima: bool = False) -> DataFrame:
    """Local maxima (or minima): strictly beyond the row before, and not below (above) the row after."""
    w = Window.partitionBy(*keys).orderBy(order)
    found = points.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w), "_px": F.lag(order).over(w), "_nx": F.lead(order).over(w)})
    v = F.col(value)
    test = (v < F.col("_p")) & (v <= F.col("_n")) if minima else (v > F.col("_p")) & (v >= F.col("_n"))
    return found.where(test)


def parabola_apex(x: tuple[Column, Column, Column], y: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Vertex (place, height) of the parabola through three points, in Newton's divided differences."""
    (x0, x1, x2), (y0, y1, y2) = x, y
    d01, d12 = F.try_divide(y1 - y0, x1 - x0), F.try_divide(y2 - y1, x2 - x1)
    curve = F.try_divide(d12 - d01, x2 - x0)
    place = (x0 + x1) / 2 - F.try_divide(d01, 2 * curve)
    return place, y0 + d01 * (place - x0) + curve * (place - x0) * (place - x1)


def picked(points: DataFrame, keys: list[str], min_prominence: float = 0.0) -> DataFrame:
    """Centroids of profile points (mz, abundance): apexes refined by a parabola."""
    apex = extremes(points, keys, "mz", "abundance")
    place, height = parabola_apex((F.col("_px"), F.col("mz"), F.col("_nx")), (F.col("_p"), F.col("abundance"), F.col("_n")))
    rise = F.col("abundance") - F.greatest("_p", "_n")
    return apex.where(rise >= min_prominence * F.col("abundance")).select(*keys, F.col("mz").alias("apex_mz"), F.coalesce(place, "mz").alias("mz"), F.coalesce(height, "abundance").alias("abundance"))


def calibration_points(peaks: DataFrame, references: DataFrame, ppm: tuple[float, float], s2n: float | None = None) -> DataFrame:
    """Peak and reference pairs within the ppm range, references that match once only."""
    from massweave.operators.joins import unique_band_join

    own = peaks if s2n is None else peaks.where(F.col("s2n") >= s2n)
    error = (F.col("mz") - F.col("ref_mz")) / F.col("ref_mz") * 1e6
    fits = (error > ppm[0]) & (error < ppm[1])
    return unique_band_join(own, references, "mz", "ref_mz", max(map(abs, ppm)), "ref_mz", ppm=True, fits=fits).withColumn("error_ppm", error)


def calibrated(peaks: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """First-order correction per spectrum: the line of error against m/z, from sums, is taken off."""
    fit = points.groupBy(*keys).agg(F.regr_slope("error_ppm", "mz").alias("_s"), F.regr_intercept("error_ppm", "mz").alias("_i"))
    error = F.coalesce(F.col("_s") * F.col("mz") + F.col("_i"), F.lit(0.0))
    return peaks.join(fit, keys, "left").withColumn("mz_cal", F.col("mz") / (1 + error * 1e-6)).drop("_s", "_i")


def kendrick_series(peaks: DataFrame, keys: list[str], kmd: str, least: int = 3) -> DataFrame:
    """Groups of peaks of one rounded Kendrick defect and parity, with more than ``least`` members, largest sum first."""
    named = peaks.withColumns({"series": F.round(F.col(kmd) * 100).cast("int"), "odd": F.pmod(F.floor("mz"), F.lit(2)).cast("int")})
    groups = named.groupBy(*keys, "series", "odd").agg(F.count("*").alias("n"), F.sum("abundance").alias("abundance")).where(F.col("n") > least)
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("abundance").desc(), "series", "odd")))


def iqr_outliers(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """The column with values beyond 1.5 interquartile ranges set to null."""
    q = df.groupBy(*keys).agg(F.percentile(column, 0.25).alias("_q1"), F.percentile(column, 0.75).alias("_q3"))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return df.join(q, keys).withColumn(out, F.when(F.col(column).between(F.col("_q1") - reach, F.col("_q3") + reach), F.col(column))).drop("_q1", "_q3")


def to_mz(frequency: Column, a: float, b: float, c: float = 0.0) -> Column:
    """m/z of a cyclotron frequency by the three-term law."""
    return a / frequency + b / (frequency * frequency) + c


def noise_region(points: DataFrame, keys: list[str], half: float = 100.0) -> DataFrame:
    """The part of each spectrum about its weight-average m/z, where noise is estimated."""
    a, mz = F.col("abundance"), F.col("mz")
    centre = points.groupBy(*keys).agg(F.try_divide(F.sum(mz * mz * a), F.sum(mz * a)).alias("_centre"))
    return points.join(centre, keys).where(F.abs(mz - F.col("_centre")) <= half).select(points.columns)
