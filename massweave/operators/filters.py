"""Filters of assigned peaks by their neighbours: Kendrick chains and clusters, classes of few peaks, missing isotopologues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.operators.joins import window_join
from massweave.operators.suppress import dbscan
from massweave.storage import shared_folder

#: Mass of CH2 (fixed value).
CH2 = 14.01565006446


def indexed(peaks: DataFrame, keys: list[str], width: float = 1.0) -> DataFrame:
    """Peaks with ``peak_idx``, their place by m/z in their spectrum from 0: cells of a width are ordered on their own and counted on."""
    cells = peaks.withColumn("_cell", F.floor(F.col("mz") / width))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_cell").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_cell").eqNullSafe(F.col("_at"))]
    place = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("mz")) - 1
    return cells.withColumn("_place", place).join(counts, same).select(*peaks.columns, (F.col("_before") + F.col("_place")).alias("peak_idx"))


def kendrick_links(peaks: DataFrame, keys: list[str], base: float, tolerance: float) -> DataFrame:
    """keys, peak_idx, next_idx: each peak and the one a base mass above it, nearest of both to each other; ties go to the lower index."""
    low = peaks.select(*keys, "peak_idx", (F.col("mz") + base - tolerance).alias("_lo"), (F.col("mz") + base + tolerance).alias("_hi"), (F.col("mz") + base).alias("_want"))
    high = peaks.select(*keys, F.col("peak_idx").alias("next_idx"), F.col("mz").alias("_mz"))
    met = window_join(high, low, [("_mz", "_lo", "_hi", 2 * tolerance)], keys)
    gap = F.abs(F.col("_mz") - F.col("_want"))
    up = Window.partitionBy(*keys, "peak_idx").orderBy(gap, "next_idx")
    down = Window.partitionBy(*keys, "next_idx").orderBy(gap, "peak_idx")
    found = met.withColumn("_n", F.row_number().over(up)).where("_n = 1").withColumn("_n", F.row_number().over(down)).where("_n = 1")
    return found.select(*keys, "peak_idx", "next_idx")


def kendrick_chains(peaks: DataFrame, keys: list[str], base: float = CH2, tolerance: float = 0.001) -> DataFrame:
    """keys, peak_idx, chain, place, length of peaks (keys, peak_idx, mz) whose neighbours are one base mass away.

    ``chain`` is the index of the lowest peak and ``place`` the number of base masses above it. Pointers to the peak below are
    doubled until all point to the lowest, so a chain of n peaks takes log n joins. Peaks without neighbours are chains of
    one. Peaks are told apart by their index, which is unique in a spectrum.
    """
    shared_folder(peaks.sparkSession)
    links = kendrick_links(peaks, keys, base, tolerance).select(*keys, F.col("next_idx").alias("peak_idx"), F.col("peak_idx").alias("below"))
    at = peaks.select(*keys, "peak_idx").join(links, [*keys, "peak_idx"], "left").select(*keys, "peak_idx", F.coalesce("below", "peak_idx").alias("chain"), F.col("below").isNotNull().cast("long").alias("place")).checkpoint()
    while True:
        further = at.select(*keys, F.col("peak_idx").alias("chain"), F.col("chain").alias("_chain"), F.col("place").alias("_place"))
        at = at.join(further, [*keys, "chain"]).select(*keys, "peak_idx", F.col("_chain").alias("chain"), (F.col("place") + F.col("_place")).alias("place"), (F.col("_chain") != F.col("chain")).alias("_moved")).checkpoint()
        if not at.where("_moved").take(1):
            break
    return at.drop("_moved").withColumn("length", F.count("*").over(Window.partitionBy(*keys, "chain")))


def kendrick_clusters(peaks: DataFrame, keys: list[str], base_nominal: float = 14.0, base: float = CH2, eps: float = 0.75, least: int = 50) -> DataFrame:
    """Peaks that stand in a dense region of Kendrick mass and defect, both standardised within the spectrum; noise goes."""
    mass = F.col("mz") * (base_nominal / base)
    rows = peaks.withColumns({"_km": mass, "_kmd": F.floor(mass) - mass})
    return dbscan(rows, keys, ["_km", "_kmd"], eps, least).where("cluster >= 0").select(peaks.columns)


def with_min_peaks(assigned: DataFrame, keys: list[str], label: str, least: int) -> DataFrame:
    """Assignments of classes that have ``least`` peaks in their spectrum."""
    own = assigned.groupBy(*keys, label).agg(F.countDistinct("peak_idx").alias("_n")).where(F.col("_n") >= least).select(*keys, label)
    return assigned.join(own, [*keys, label], "left_semi").select(assigned.columns)


def with_isotopologues(assigned: DataFrame, atoms: list[str], least_percent: float, found: str = "found", expected: str = "expected") -> DataFrame:
    """Assignments but for those with one of the atoms that show too small a percentage of their expected isotopologues."""
    has = F.exists(F.array(*[fm.element(F.col("atoms"), a) for a in atoms]), lambda n: n > 0)
    share = F.coalesce(F.try_divide(100.0 * F.col(found), F.col(expected)), F.lit(100.0))
    return assigned.where(~(has & (share < least_percent)))
