"""Peak picking in profile spectra: one ordered pass per spectrum, in which nothing but open peaks is held.

Rows of a spectrum arrive sorted by Spark, so a spectrum may be longer than a task's memory. What lies to the left of an apex
is answered by a stack of rising values, what lies to the right by a heap of half heights that wait for a lower point; no
window has a fixed reach.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Points from either end of a spectrum within which an apex gets no resolving power.
EDGE = 5
#: Rows that a task puts into one batch of its output.
OUT_ROWS = 10_000


@dataclass
class Apex:
    """A local maximum and what is known of its surroundings so far; None where the spectrum ends first."""

    row: tuple
    index: int
    left_index: int
    left_base: float
    left: float | None
    before: tuple[float, float]
    after: tuple[float, float]
    left_x: float
    right_x: float | None = None
    right_index: int | None = None
    right_base: float | None = None
    right: float | None = None
    open: int = 3  # right_index, right_base and right are awaited


@dataclass
class Scan:
    """State of one spectrum. ``strict`` asks for a fall behind an apex, else a level next point will do."""

    strict: bool
    n: int = 0
    last: tuple[float, float, tuple] | None = None
    before: tuple[float, float] | None = None
    rise: int = 0  # where the strict rise that the last point ends began
    rise_x: float = 0.0
    base: float = 0.0  # where the rise that may have level steps began
    stack: list[float] = field(default_factory=list)
    places: list[list] = field(default_factory=list)
    waiting: list[tuple[float, int, Apex]] = field(default_factory=list)
    falling: Apex | None = None
    sinking: Apex | None = None
    found: deque = field(default_factory=deque)

    def feed(self, x: float, y: float, row: tuple) -> Iterator[Apex]:
        if self.last is None:
            self.base, self.rise_x = y, x
        else:
            self.step(x, y)
        if self.places:
            self.places[-1][1:] = [x, y]  # the point behind the last one
        while self.stack and self.stack[-1] >= y:
            self.stack.pop()
            self.places.pop()
        self.stack.append(y)
        self.places.append([x, None, None])
        self.before, self.last = self.last and self.last[:2], (x, y, row)
        self.n += 1
        while self.found and not self.found[0].open and self.n - self.found[0].index >= EDGE:
            yield self.found.popleft()

    def step(self, x: float, y: float) -> None:
        px, py, row = self.last
        if self.before and py > self.before[1] and (py > y if self.strict else py >= y):
            half = py / 2
            apex = Apex(row, self.n - 1, self.rise, self.base, None, self.before, (x, y), self.rise_x)
            k = bisect_left(self.stack, half) - 1
            if k >= 0:
                low, (at, nx, ny) = self.stack[k], self.places[k]
                apex.left = at + (nx - at) * (half - low) / (ny - low)
            heapq.heappush(self.waiting, (-half, self.n, apex))
            self.falling = self.sinking = apex
            self.found.append(apex)
        if self.falling and self.falling.index < self.n - 1 and not y < py:
            self.falling.right_index, self.falling.right_x, self.falling = self.n - 1, px, self.closed(self.falling)
        if self.sinking and y > py:
            self.sinking.right_base, self.sinking = py, self.closed(self.sinking)
        while self.waiting and -self.waiting[0][0] > y:
            half, _, apex = heapq.heappop(self.waiting)
            apex.right = px + (x - px) * (-half - py) / (y - py)
            self.closed(apex)
        self.rise, self.rise_x = (self.rise, self.rise_x) if y > py else (self.n, x)
        self.base = self.base if y >= py else y

    @staticmethod
    def closed(apex: Apex) -> None:
        apex.open -= 1

    def end(self) -> Iterator[Apex]:
        if self.falling:
            self.falling.right_index, self.falling.right_x = self.n - 1, self.last[0]
        if self.sinking:
            self.sinking.right_base = self.last[1]
        yield from self.found


def padded(rows: Iterator[tuple[float, float, tuple]], pad: int) -> Iterator[tuple[float, float, tuple]]:
    """``pad`` empty points at either end, in the steps of the first and the last two points."""
    first = next(rows, None)
    second = next(rows, None)
    if first is None or second is None or not pad:
        yield from filter(None, (first, second))
        yield from rows
        return
    for k in range(pad, 0, -1):
        yield first[0] - k * (second[0] - first[0]), 0.0, ()
    yield first
    yield second
    a, b = first[0], second[0]
    for row in rows:
        a, b = b, row[0]
        yield row
    for k in range(1, pad + 1):
        yield b + k * (b - a), 0.0, ()


def scanned(points: DataFrame, keys: list[str], x: str, y: str, pad: int, strict: bool, out: Callable[[Apex, int], tuple], schema: T.StructType) -> DataFrame:
    """``out`` of every apex and the number of points of its spectrum, or of those seen where the apex is far from its end."""
    names, arrow = points.columns, to_arrow_schema(schema)
    at_keys, at_x, at_y = [names.index(k) for k in keys], names.index(x), names.index(y)
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def spectra() -> Iterator[tuple]:
            stream = values()
            held = next(stream, None)
            while held is not None:
                key = [held[k] for k in at_keys]

                def own() -> Iterator[tuple[float, float, tuple]]:
                    nonlocal held
                    while held is not None and [held[k] for k in at_keys] == key:
                        yield float(held[at_x]), float(held[at_y]), held
                        held = next(stream, None)

                scan = Scan(strict)
                for point in padded(own(), pad):
                    for apex in scan.feed(*point):
                        yield out(apex, scan.n)
                for apex in scan.end():
                    yield out(apex, scan.n)

        made: list[tuple] = []
        for row in spectra():
            made.append(row)
            if len(made) == OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def half_height_widths(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Apexes with ``left``, ``right``: where the trace first falls below half the height on either side, on the line
    between the points about it, however far; ``resolving_power`` is the apex's place over the width. Null where the
    trace ends before. Rows with a null place or a null or NaN height are left out."""
    at, names = points.columns.index(order), ("left", "right", "resolving_power")
    schema = T.StructType([*points.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def out(a: Apex, _: int) -> tuple:
        power = float(a.row[at]) / (a.right - a.left) if a.left is not None and a.right is not None else None
        return (*a.row, a.left, a.right, power)

    return scanned(points, keys, order, value, 0, False, out, schema)


def centroids(points: DataFrame, keys: list[str], mz: str = "mz", abundance: str = "abundance", noise: DataFrame | None = None, threshold: float = 0.0, least_points: int = 5, prominence: float = 0.1, pad: int = 3) -> DataFrame:
    """Centroids of profile spectra.

    A peak is an apex that rises and falls over ``least_points`` steps, reaches ``threshold`` (or, with ``noise`` (keys,
    noise, noise_std), their sum: noise + threshold * noise_std) and stands ``prominence`` percent of the spectrum's
    highest abundance above the higher of the minima about it. Its place and height are those of the parabola through
    the three points at the apex, if that stays within the apex's whole number; its resolving power comes from the
    width at half height, null near the spectrum's ends. Spectra get ``pad`` empty points at either end.

    Returns keys, mz, apex_mz, abundance (of the apex), centroid_abundance, resolving_power, s2n (with noise), start_idx,
    apex_idx and final_idx (places in the spectrum from 0, those of padding outside of it).
    """
    own = points.select(*keys, F.col(mz).cast("double").alias("_x"), F.col(abundance).cast("double").alias("_y"))
    real, whole = T.DoubleType(), T.LongType()
    fields = {"mz": real, "apex_mz": real, "abundance": real, "centroid_abundance": real, "resolving_power": real, "start_idx": whole, "apex_idx": whole, "final_idx": whole, "_base": real}
    schema = T.StructType([*(own.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields.items())])
    at_keys = len(keys)

    def out(a: Apex, n: int) -> tuple:
        (x0, y0), (x2, y2), x1, y1 = a.before, a.after, *a.row[at_keys:]
        d01, d12 = (y1 - y0) / (x1 - x0), (y2 - y1) / (x2 - x1)
        curve = (d12 - d01) / (x2 - x0)
        place = (x0 + x1) / 2 - d01 / (2 * curve)
        if place < 1 or int(place) != int(x1):
            place = x1
        height = y0 + d01 * (place - x0) + curve * (place - x0) * (place - x1)
        near_end = a.index < EDGE or n - a.index < EDGE
        power = None if near_end or a.left is None or a.right is None else x1 / (a.right - a.left)
        return (*a.row[:at_keys], place, x1, y1, height, power, a.left_index - pad, a.index - pad, a.right_index - pad, max(a.left_base, a.right_base))

    # Points of one place would have no slope between them.
    own = own.groupBy(*keys, "_x").agg(F.max("_y").alias("_y"))
    found = scanned(own, keys, "_x", "_y", pad, True, out, schema).where(F.col("final_idx") - F.col("start_idx") >= least_points)
    top = own.groupBy(*keys).agg(F.max("_y").alias("_top"))
    if noise is not None:
        top = top.join(noise.select(*keys, "noise", "noise_std"), keys)
        limit, extra = F.col("noise") + threshold * F.col("noise_std"), [F.try_divide("centroid_abundance", "noise_std").alias("s2n")]
    else:
        limit, extra = F.lit(threshold), []
    kept = found.join(top, keys) if keys else found.crossJoin(top)
    kept = kept.where((F.col("abundance") >= limit) & ((F.col("abundance") - F.col("_base")) / F.col("_top") * 100 > prominence))
    return kept.select(*keys, "mz", "apex_mz", "abundance", "centroid_abundance", "resolving_power", *extra, "start_idx", "apex_idx", "final_idx")


def extents(points: DataFrame, keys: list[str], x: str, y: str, least_points: int = 5) -> DataFrame:
    """keys, apex_x, apex_y, start_x, final_x of every apex that rises and falls strictly over ``least_points`` steps."""
    own = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    names = ("apex_x", "apex_y", "start_x", "final_x")
    schema = T.StructType([*(own.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("_steps", T.LongType())])
    out = lambda a, _: (*a.row, a.left_x, a.right_x, a.right_index - a.left_index)
    return scanned(own, keys, "_x", "_y", 0, True, out, schema).where(F.col("_steps") >= least_points).drop("_steps")
