"""Mass errors that overlapping peaks make: neighbours are simulated together and the middle one's apex is compared with its place.

A peak with a neighbour of its nominal mass on either side is summed with both, as Gaussians of their resolving powers. The powers
rise in steps until three apexes stand with valleys low enough between them; the middle apex's shift is the error that the
neighbours make. Batches of peaks are simulated as one matrix. Peaks without a result get a value on the line between the
results about them in their spectrum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Places of a simulation, widths that it reaches beyond the outer peaks, peaks of a batch.
PLACES, REACH, BATCH = 401, 2.0, 2000
SIGMAS = math.sqrt(8 * math.log(2))


def simulated(mz: np.ndarray, height: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of three Gaussians a row (columns: lower, middle, upper)."""
    sigma = mz / power / SIGMAS
    low, high = mz[:, 0] - REACH * SIGMAS * sigma[:, 0], mz[:, 2] + REACH * SIGMAS * sigma[:, 2]
    x = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, PLACES)
    return x, sum(height[:, k : k + 1] * np.exp(-0.5 * ((x - mz[:, k : k + 1]) / sigma[:, k : k + 1]) ** 2) for k in range(3))


def apex_of(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and height of the parabola through the points at and beside ``at``, a column a row."""
    rows, step = np.arange(len(at)), x[:, 1] - x[:, 0]
    a, b, c = (y[rows, at + d] for d in (-1, 0, 1))
    curve = a - 2 * b + c
    off = np.divide(a - c, 2 * curve, out=np.zeros_like(a), where=curve != 0)
    return x[rows, at] + off * step, b - (a - c) * off / 4


def too_high(mz: np.ndarray, height: np.ndarray, sigma: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Rows in which one of the valleys surely stays above the limit, at these widths and at all larger ones.

    Within a width of a peak the sum is at least exp(-0.5) of its height. Between these parts both neighbours are convex, so is their
    sum, which lies above its tangent; the third peak only adds.
    """
    out = np.zeros(len(mz), bool)
    for k in (0, 1):
        d, s, t, h, g = mz[:, k + 1] - mz[:, k], sigma[:, k], sigma[:, k + 1], height[:, k], height[:, k + 1]
        low, high = s, d - t
        with np.errstate(all="ignore"):
            u = np.clip(d / 2 - s * t * np.log(g / h) / d, low, high)
            for step in range(3):  # the tangent is nearly level after two steps of Newton's method
                x, y = u / s, (d - u) / t
                a, b = h * np.exp(-0.5 * x * x), g * np.exp(-0.5 * y * y)
                slope = b * y / t - a * x / s
                if step < 2:
                    u = np.clip(u - slope / (a * (x * x - 1) / s**2 + b * (y * y - 1) / t**2), low, high)
            valley = np.where(low < high, a + b - np.abs(slope) * np.maximum(u - low, high - u), np.inf)
        out |= np.minimum(valley, math.exp(-0.5) * np.minimum(h, g)) > limit * (1 + 1e-9)
    return out


def level(mz: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Rows with a valley of several places where all peaks are zero in double precision: no minimum there, at these widths and at all smaller ones."""
    step = (mz[:, 2] - mz[:, 0] + REACH * SIGMAS * (sigma[:, 0] + sigma[:, 2])) / (PLACES - 1)
    ends, starts = np.maximum.accumulate(mz + 39 * sigma, 1), np.minimum.accumulate((mz - 39 * sigma)[:, ::-1], 1)[:, ::-1]
    return (starts[:, 1:] - ends[:, :-1] > 3 * step[:, None]).any(1)


def shifts(mz: np.ndarray, height: np.ndarray, power: np.ndarray, rise: float, valley: float, rounds: int) -> np.ndarray:
    """Middle apex's place and height, and the factor of the resolving powers at which it was found; NaN where it never was.

    Rounds that surely fail aren't simulated: those before the first in which the valleys may be low enough, and those of level ones.
    """
    out = np.full((len(mz), 3), np.nan)
    limit, sigma = valley * height.max(1), mz / power / SIGMAS
    live = np.flatnonzero(~too_high(mz, height, sigma / (1 + rounds * rise), limit))
    first, last = np.zeros(len(mz), int), np.full(len(mz), rounds)
    while len(part := live[first[live] < last[live]]):
        k = (first[part] + last[part]) // 2
        fails = too_high(mz[part], height[part], sigma[part] / (1 + k * rise)[:, None], limit[part])
        first[part[fails]], last[part[~fails]] = k[fails] + 1, k[~fails]
    k = first
    while len(live := live[k[live] <= rounds]):
        factor = 1 + k[live] * rise
        on = ~level(mz[live], sigma[live] / factor[:, None])
        live, factor = live[on], factor[on]
        x, y = simulated(mz[live], height[live], power[live] * factor[:, None])
        inner = y[:, 1:-1]
        top, low = (inner > y[:, :-2]) & (inner > y[:, 2:]), (inner < y[:, :-2]) & (inner < y[:, 2:])
        deep = np.where(low, inner, 0).max(1) <= limit[live]
        good = np.flatnonzero((top.sum(1) == 3) & (low.sum(1) == 2) & deep)
        if len(good):
            middle = np.array([np.flatnonzero(row)[1] + 1 for row in top[good]])
            place, high = apex_of(x[good], y[good], middle)
            out[live[good]] = np.stack([place, high, factor[good]], 1)
            live = np.delete(live, good)
        k[live] += 1
    return out


def predicted(peaks: DataFrame, keys: list[str], rise: float = 0.1, valley: float = 0.01, rounds: int = 100) -> DataFrame:
    """Peaks (keys, mz, abundance, resolving_power) with predicted_mz, predicted_abundance, mass_shift_ppm, height_shift_percent and predicted_error_ppm.

    The first four are null for peaks without neighbours in their nominal mass, without a resolving power, or that ``rounds`` steps of ``rise``
    don't part down to ``valley`` of the highest. ``predicted_error_ppm`` is the shift where there is one, else on the line over m/z
    between the nearest shifts, beyond them the nearest's, null in spectra without any.
    """
    w = Window.partitionBy(*keys).orderBy("mz")
    beside = {f"_{c}{d}": (F.lag(c) if d == 0 else F.lead(c)).over(w) for d in (0, 2) for c in ("mz", "abundance", "resolving_power")}
    rows = peaks.withColumns(beside)
    nominal = F.floor("mz")
    near = (F.floor("_mz0") == nominal) & (F.floor("_mz2") == nominal) & (F.col("_mz0") < F.col("mz")) & (F.col("mz") < F.col("_mz2"))
    for c in ("abundance", "resolving_power", "_abundance0", "_resolving_power0", "_abundance2", "_resolving_power2"):
        near &= F.col(c) > 0
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False)))
    names = ["predicted_mz", "predicted_abundance", "mass_shift_ppm", "height_shift_percent"]
    schema = T.StructType([*peaks.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                on = np.flatnonzero(batch.column("_near").to_numpy(zero_copy_only=False))
                three = lambda c: np.stack([batch.column(n).to_numpy(zero_copy_only=False)[on].astype(float) for n in (f"_{c}0", c, f"_{c}2")], 1)  # noqa: B023, E731
                mz, height, power = three("mz"), three("abundance"), three("resolving_power")
                got = np.full((batch.num_rows, 4), np.nan)
                if len(on):
                    place, high, _ = shifts(mz, height, power, rise, valley, rounds).T
                    got[on] = np.stack([place, high, (place - mz[:, 1]) / mz[:, 1] * 1e6, (high - height[:, 1]) / height[:, 1] * 100], 1)
                own = [batch.column(f.name).cast(f.type) for f in list(arrow)[:-4]]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.float64(), from_pandas=True) for c in got.T)], schema=arrow)

    out = rows.mapInArrow(run, schema)
    known = F.when(F.col("mass_shift_ppm").isNotNull(), F.struct(F.col("mz").alias("x"), F.col("mass_shift_ppm").alias("e")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("mz").desc()).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"_b": before, "_a": after})
    line = F.col("_b.e") + (F.col("_a.e") - F.col("_b.e")) * F.try_divide(F.col("mz") - F.col("_b.x"), F.col("_a.x") - F.col("_b.x"))
    return out.withColumn("predicted_error_ppm", F.coalesce("mass_shift_ppm", line, F.col("_b.e"), F.col("_a.e"))).drop("_b", "_a")
