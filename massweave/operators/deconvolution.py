"""Deconvolution of co-eluting compounds: ions that peak together make an entity with its own chromatogram and spectrum.

Ion traces and the total trace are picked by the same ordered pass. Ion apexes inside a peak of the total trace are
clustered by time; the points of a cluster's ion peaks, added up by time and m/z, are its spectra, and their sums its
chromatogram, which is picked once more. All joins are on the sample with a bucket of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massweave.operators.joins import window_join
from massweave.operators.profile import extents
from massweave.operators.suppress import ward

Smooth = Callable[[DataFrame, list[str], str, str], DataFrame]


def picked(trace: DataFrame, keys: list[str], least_points: int, smooth: Smooth | None) -> tuple[DataFrame, DataFrame]:
    """A trace (keys, rt, intensity), smoothed if asked, and its peaks."""
    own = smooth(trace, keys, "rt", "intensity") if smooth else trace
    return own, extents(own, keys, "rt", "intensity", least_points)


def deconvolved(points: DataFrame, max_rt_distance: float = 0.025, least_points: int = 5, ion_share: float = 0.01, total_share: float = 0.01, bucket: float = 0.1, smooth: Smooth | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and their spectra from points (sample, rt, mz, intensity).

    Ion peaks reach ``ion_share`` of the sample's highest ion, peaks of the total trace and of entities ``total_share`` of its
    highest total; at an apex at least two ions peak at the same time. Apexes inside a peak of the total trace are clustered by
    Ward's linkage up to ``max_rt_distance``. An apex that several clusters of a sample have belongs to the first one in time.
    ``bucket`` is about a peak's width in time; points of one place are added up, those without an intensity don't count.

    Returns (sample, entity, rt, tic, start_rt, final_rt, area, n_ions) and (sample, entity, mz, intensity).
    """
    points = points.where("intensity > 0").groupBy("sample", "mz", "rt").agg(F.sum("intensity").alias("intensity"))
    ions, ion_peaks = picked(points, ["sample", "mz"], least_points, smooth)
    total, total_peaks = picked(points.groupBy("sample", "rt").agg(F.sum("intensity").alias("intensity")), ["sample"], least_points, smooth)
    top_ion = points.groupBy("sample").agg(F.max("intensity").alias("_top"))
    top_total = total.groupBy("sample").agg(F.max("intensity").alias("_total"))
    ion_peaks = ion_peaks.join(top_ion, "sample").where(F.col("apex_y") >= ion_share * F.col("_top")).drop("_top")
    windows = total_peaks.join(top_total, "sample").where(F.col("apex_y") >= total_share * F.col("_total")).select("sample", F.col("start_x").alias("window_start"), F.col("final_x").alias("window_final"))

    # Apex times with the ions that peak then, inside the windows.
    apexes = ion_peaks.groupBy("sample", "apex_x").agg(F.sum("apex_y").alias("_sum"), F.count("*").alias("_ions")).join(top_total, "sample")
    apexes = apexes.where((F.col("_sum") > total_share * F.col("_total")) & (F.col("_ions") > 1)).select("sample", "apex_x")
    inside = window_join(apexes, windows, [("apex_x", "window_start", "window_final", bucket)], ["sample"]).where("apex_x > window_start and apex_x < window_final")
    grouped = ward(inside, ["sample", "window_start"], "apex_x", max_rt_distance, "_cluster")

    # The points of the ion peaks of a cluster's apexes, without the last of each.
    members = ion_peaks.join(grouped, ["sample", "apex_x"])
    held = window_join(ions, members, [("rt", "start_x", "final_x", bucket)], ["sample", "mz"]).where("rt < final_x")
    key = ["sample", "window_start", "_cluster"]
    spectra = held.groupBy(*key, "rt", "mz").agg(F.sum("intensity").alias("intensity"), F.first("window_final").alias("window_final"))
    trace = spectra.groupBy(*key, "rt").agg(F.sum("intensity").alias("intensity"), F.first("window_final").alias("window_final"), F.count("*").alias("n_ions"))
    whole, found = picked(trace.select(*key, "rt", "intensity"), key, least_points, smooth)
    ends = trace.groupBy(*key).agg(F.first("window_final").alias("window_final"))
    found = found.join(top_total, "sample").join(ends, key).where((F.col("apex_y") >= total_share * F.col("_total")) & F.col("apex_x").between(F.col("window_start"), F.col("window_final")))
    first = Window.partitionBy("sample", "apex_x").orderBy("window_start", "start_x", "_cluster")
    found = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*key, F.col("apex_x").alias("rt"), F.col("apex_y").alias("tic"), F.col("start_x").alias("start_rt"), F.col("final_x").alias("final_rt"))
    found = found.withColumn("entity", F.concat_ws("/", F.col("window_start").cast("string"), "_cluster", F.col("rt").cast("string")))

    step = Window.partitionBy("sample", "entity").orderBy("_rt")
    under = window_join(whole.withColumnsRenamed({"rt": "_rt", "intensity": "_y"}), found, [("_rt", "start_rt", "final_rt", bucket)], key)
    area = under.withColumn("_a", (F.col("_y") + F.lag("_y").over(step)) / 2 * (F.col("_rt") - F.lag("_rt").over(step))).groupBy("sample", "entity").agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))
    lines = spectra.drop("window_final").join(found.select(*key, "rt", "entity"), [*key, "rt"]).select("sample", "entity", "mz", "intensity")
    counts = lines.groupBy("sample", "entity").agg(F.count("*").alias("n_ions"))
    rows = found.join(area, ["sample", "entity"]).join(counts, ["sample", "entity"])
    return rows.select("sample", "entity", "rt", "tic", "start_rt", "final_rt", "area", "n_ions"), lines
