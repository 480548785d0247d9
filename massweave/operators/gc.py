"""Gas chromatography: retention indices, library search, similarity scores, ladders and peak grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.operators.joins import interval_join


def ri_score(delta: Column, std: float = 3.0) -> Column:
    return F.exp(-(delta * delta) / (2 * std * std))


def library_hits(peaks: DataFrame, library: DataFrame, ri_window: float | None = 35.0, rt_window: float | None = None, names: list[str] | None = None) -> DataFrame:
    """GC peaks with the compounds near in retention index, in time, or both; a list of names narrows the library."""
    own = library if names is None else library.where(F.col("name").isin(names))
    lib = own.select(F.col("compound"), F.col("name"), F.col("ri").alias("ref_ri"), F.col("rt").alias("ref_rt"))
    near_rt = None if rt_window is None else F.abs(F.col("rt") - F.col("ref_rt")) <= rt_window
    if ri_window is None:
        w = rt_window or 1.0
        return interval_join(peaks, lib.withColumns({"_lo": F.col("ref_rt") - w, "_hi": F.col("ref_rt") + w}), "rt", "_lo", "_hi", 2 * w).drop("_lo", "_hi")
    bounds = lib.withColumns({"_lo": F.col("ref_ri") - ri_window, "_hi": F.col("ref_ri") + ri_window})
    return interval_join(peaks, bounds, "ri", "_lo", "_hi", 2 * ri_window, near_rt).drop("_lo", "_hi")


def scored(hits: DataFrame, spectra: DataFrame, library: DataFrame) -> DataFrame:
    """Cosine and combined score of each hit: unit m/z spectra meet by an equi-join on (hit, mz)."""
    q = hits.select("peak_id", "compound").join(spectra, "peak_id").select("peak_id", "compound", "mz", F.col("intensity").alias("v"))
    r = hits.select("peak_id", "compound").join(library, "compound").select("peak_id", "compound", "mz", F.col("intensity").alias("y"))
    both = q.join(r, ["peak_id", "compound", "mz"], "full_outer").fillna(0.0, ["v", "y"])
    cosine = F.sum(F.col("v") * F.col("y")) / F.sqrt(F.sum(F.col("v") * F.col("v")) * F.sum(F.col("y") * F.col("y")))
    sims = both.groupBy("peak_id", "compound").agg(cosine.alias("cosine"))
    return hits.join(sims, ["peak_id", "compound"]).withColumn("score", (F.pow("cosine", F.lit(2)) * ri_score(F.col("ri") - F.col("ref_ri"))) ** (1 / 3))


def best_hits(rated: DataFrame, by: str = "score") -> DataFrame:
    return rated.withColumn("_r", F.row_number().over(Window.partitionBy("peak_id").orderBy(F.col(by).desc(), "compound"))).where("_r = 1").drop("_r")


def ri_pairs(rated: DataFrame) -> DataFrame:
    """The best match of each standard of the ladder: (ref_ri, rt)."""
    return rated.groupBy("ref_ri").agg(F.max_by("rt", "cosine").alias("rt"))


def statistics(peaks: DataFrame, rated: DataFrame, good: float = 0.85) -> DataFrame:
    per = rated.groupBy("peak_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("score") >= good, 1)).alias("g"))
    joined = peaks.select("peak_id").join(per, "peak_id", "left").fillna(0, ["n", "g"])
    return joined.agg(F.count("*").alias("n_peaks"), F.count(F.when(F.col("n") > 0, 1)).alias("matched"), F.count(F.when(F.col("n") == 0, 1)).alias("unmatched"), F.count(F.when(F.col("g") > 0, 1)).alias("good"), F.count(F.when(F.col("g") == 1, 1)).alias("good_once"))


def entities(eic_peaks: DataFrame, max_rt_distance: float = 0.025) -> DataFrame:
    """Ion peaks (sample, mz, apex_rt, intensity) clustered by apex time (Ward's linkage): one entity each with its spectrum."""
    from massweave.operators.suppress import ward

    parts = ward(eic_peaks, ["sample"], "apex_rt", max_rt_distance, "entity")
    return parts.groupBy("sample", "entity").agg(F.max_by("apex_rt", "intensity").alias("rt"), F.sum("intensity").alias("tic"), F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("spectrum"))
