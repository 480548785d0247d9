"""From LC-MS points to an annotated report: features, their integration, formulas, library spectra, one table.

Tables: points (sample, scan, mz, intensity), scans (sample, scan, rt) of the first level; scans of the second with their
precursor (sample, scan, rt, precursor_mz) and their points. Every step keeps sample and mf_id and is a join on the
sample with buckets of m/z or time, so runs of any number go through together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.operators import fits, fragment_index, lc, profile, report
from massweave.operators.joins import band_join
from massweave.operators.persistence import find_features
from massweave.operators.search import searched
from massweave.storage import shared_folder

FEATURE = ["sample", "mf_id"]


def features(points: DataFrame, scans: DataFrame, least: float = 0.001, persistence: float = 0.001, mz_tolerance: float = 5e-6, rt_tolerance: float = 0.3, radius: tuple[int, int] = (0, 1), rounds: int = 1) -> DataFrame:
    """sample, mf_id, mz, rt, apex_scan, intensity, persistence: features numbered by their intensity within the sample."""
    shared_folder(points.sparkSession)
    timed = points.join(scans.select("sample", "scan", "rt"), ["sample", "scan"])
    found = find_features(timed, ["sample"], "mz", "rt", "intensity", least, persistence, mz_tolerance, rt_tolerance, radius, rounds)
    named = found.join(scans.select("sample", F.col("scan").alias("apex_scan"), "rt"), ["sample", "rt"])
    number = F.row_number().over(Window.partitionBy("sample").orderBy(F.col("intensity").desc(), "mz", "rt")) - 1
    return named.withColumn("mf_id", number.cast("long")).select(*FEATURE, "mz", "rt", "apex_scan", "intensity", "persistence").checkpoint()


def traces(found: DataFrame, points: DataFrame, scans: DataFrame, ppm: float) -> DataFrame:
    """sample, mf_id, scan, rt, intensity of each feature's band. Scans without a point are zero, and of those only the ones beside
    a point are rows: more zeros in between would tell nothing."""
    place = scans.select("sample", "scan", "rt").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("sample").orderBy("rt", "scan")))
    targets = found.select("sample", "mf_id", F.col("mz").alias("_mz"))
    own = band_join(points.select("sample", "scan", "mz", "intensity"), targets, "mz", "_mz", ppm, ppm=True, on=["sample"]).groupBy(*FEATURE, "scan").agg(F.sum("intensity").alias("intensity"))
    near = own.join(place.select("sample", "scan", "_i"), ["sample", "scan"]).select(*FEATURE, "_i", "intensity", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_d"))
    near = near.groupBy(*FEATURE, (F.col("_i") + F.col("_d")).alias("_i")).agg(F.sum(F.when(F.col("_d") == 0, F.col("intensity")).otherwise(0.0)).alias("intensity"))
    return near.join(place, ["sample", "_i"]).select(*FEATURE, "scan", "rt", "intensity")


def integrated(found: DataFrame, points: DataFrame, scans: DataFrame, ppm: float = 5.0, least_points: int = 5, drop_if_fail: bool = True) -> DataFrame:
    """Features with start_rt, final_rt, area and half_height_width of the peak of their trace that holds their time.

    Of several such peaks the highest counts. Features whose trace has none are dropped, or kept with nulls.
    """
    eic = traces(found, points, scans, ppm).checkpoint()
    peaks = profile.extents(eic, FEATURE, "rt", "intensity", least_points).join(found.select(*FEATURE, F.col("rt").alias("_rt")), FEATURE).where(F.col("_rt").between(F.col("start_x"), F.col("final_x")))
    best = Window.partitionBy(*FEATURE).orderBy(F.col("apex_y").desc(), "apex_x")
    peaks = peaks.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*FEATURE, "apex_x", F.col("start_x").alias("start_rt"), F.col("final_x").alias("final_rt"))
    step = Window.partitionBy(*FEATURE).orderBy("rt")
    under = eic.join(peaks, FEATURE).where(F.col("rt").between(F.col("start_rt"), F.col("final_rt")))
    area = under.withColumn("_a", (F.col("intensity") + F.lag("intensity").over(step)) / 2 * (F.col("rt") - F.lag("rt").over(step))).groupBy(*FEATURE).agg(F.sum("_a").alias("area"))
    wide = profile.half_height_widths(eic, FEATURE, "rt", "intensity").select(*FEATURE, F.col("rt").alias("apex_x"), (F.col("right") - F.col("left")).alias("half_height_width"))
    made = peaks.join(area, FEATURE).join(wide, [*FEATURE, "apex_x"], "left").drop("apex_x")
    return found.join(made, FEATURE, "inner" if drop_if_fail else "left")


def peak_shapes(whole: DataFrame, eic: DataFrame, accept_estimated: bool = False) -> DataFrame:
    """sample, mf_id with half_height_min, half_height_max, tailing_factor and gaussian_similarity of integrated features.

    ``whole`` has start_rt and final_rt, ``eic`` the traces. Widths go by scans: the larger ends at the first scans at or below a share of the apex, the
    smaller at the scans before these; the apex is the trace's highest scan within the bounds. Where a width reaches beyond the bounds it is
    cut there and, unless estimates are accepted, null. The tailing factor is that at a twentieth of the height. The similarity is the share of
    the variance within the bounds that a Gaussian on a base explains, null for fewer than five points or none explained.
    """
    w = Window.partitionBy(*FEATURE).orderBy("rt")
    rows = eic.join(whole.select(*FEATURE, "start_rt", "final_rt").where("start_rt is not null"), FEATURE).withColumns({"_next": F.lead("rt").over(w), "_prev": F.lag("rt").over(w)})
    inside = F.col("rt").between(F.col("start_rt"), F.col("final_rt"))
    top = rows.where(inside).groupBy(*FEATURE).agg(F.max(F.struct(F.col("intensity").alias("y"), (-F.col("rt")).alias("x"))).alias("_t"))
    rows = rows.join(top.select(*FEATURE, F.col("_t.y").alias("_y"), (-F.col("_t.x")).alias("_x")), FEATURE)
    found = []
    for name, share in (("half", 0.5), ("tail", 0.05)):
        low = F.col("intensity") <= share * F.col("_y")
        # The nearest low scan on either side, else the trace's end; with the scan next to it on the apex's side.
        found += [
            F.coalesce(F.max(F.when(low & (F.col("rt") < F.col("_x")), F.struct("rt", F.col("_next").alias("by")))), F.min(F.struct("rt", F.col("_next").alias("by")))).alias(f"{name}_l"),
            F.coalesce(F.min(F.when(low & (F.col("rt") > F.col("_x")), F.struct("rt", F.col("_prev").alias("by")))), F.max(F.struct("rt", F.col("_prev").alias("by")))).alias(f"{name}_r"),
        ]
    ends = rows.groupBy(*FEATURE).agg(*found, F.first("_x").alias("_x"), F.first("start_rt").alias("_from"), F.first("final_rt").alias("_to"))
    first = rows.where(F.col("rt") == F.col("start_rt")).select(*FEATURE, F.col("_next").alias("_from_by"))
    last = rows.where(F.col("rt") == F.col("final_rt")).select(*FEATURE, F.col("_prev").alias("_to_by"))
    ends = ends.join(first, FEATURE).join(last, FEATURE)
    c = F.col

    def cut(name: str) -> tuple[Column, Column, Column]:
        left_out, right_out = c(f"{name}_l.rt") < c("_from"), c(f"{name}_r.rt") > c("_to")
        left, left_by = F.when(left_out, c("_from")).otherwise(c(f"{name}_l.rt")), F.when(left_out, c("_from_by")).otherwise(c(f"{name}_l.by"))
        right, right_by = F.when(right_out, c("_to")).otherwise(c(f"{name}_r.rt")), F.when(right_out, c("_to_by")).otherwise(c(f"{name}_r.by"))
        return right_by - left_by, right - left, F.lit(accept_estimated) | ~(left_out | right_out)

    low, high, fine = cut("half")
    tail_low, tail_high, tail_fine = cut("tail")
    front = (c("_x") - c("tail_l.rt") + c("_x") - c("tail_l.by")) / 2
    shapes = ends.select(*FEATURE, F.when(fine, low).alias("half_height_min"), F.when(fine, high).alias("half_height_max"), F.when(tail_fine, F.try_divide((tail_low + tail_high) / 2, 2 * front)).alias("tailing_factor"))
    part = rows.where(inside)
    fit = fits.fitted(part, FEATURE, "rt", "intensity", "gaussian_on_base").select(*FEATURE, "rms")
    spread = part.groupBy(*FEATURE).agg(F.var_pop("intensity").alias("_var"))
    like = fit.join(spread, FEATURE).select(*FEATURE, (1 - F.try_divide(c("rms") * c("rms"), c("_var"))).alias("_r2"))
    return shapes.join(like, FEATURE, "left").withColumn("gaussian_similarity", F.when(c("_r2") >= 0, c("_r2"))).drop("_r2")


def deconvoluted(found: DataFrame, points: DataFrame, scans: DataFrame, mz_tolerance: float = 5e-6, least: float = 0.8) -> DataFrame:
    """sample, mf_id, mz, correlation, abundance: the peaks of each feature's apex scan whose traces follow the feature's own.

    ``found`` has start_rt and final_rt. Points between them count for the nearest of these peaks within a relative tolerance; traces are zero in
    scans where others of them have points; ``is_parent`` tells whether the feature's own peak is the most abundant of those kept.
    """
    own = found.select(*FEATURE, F.col("mz").alias("_mz"), "apex_scan", "start_rt", "final_rt").where("start_rt is not null")
    peaks = own.join(points.select("sample", F.col("scan").alias("apex_scan"), F.col("mz").alias("target"), F.col("intensity").alias("abundance")), ["sample", "apex_scan"]).drop("apex_scan")
    timed = points.join(scans.select("sample", "scan", "rt"), ["sample", "scan"])
    met = band_join(timed, peaks, "mz", "target", mz_tolerance * 1e6, ppm=True, on=["sample"]).where(F.col("rt").between(F.col("start_rt"), F.col("final_rt")))
    near = Window.partitionBy(*FEATURE, "scan", "mz").orderBy(F.abs(F.col("mz") - F.col("target")), "target")
    met = met.withColumn("_n", F.row_number().over(near)).where("_n = 1")
    sums = met.groupBy(*FEATURE, "target", "scan").agg(F.sum("intensity").alias("y"), F.first("abundance").alias("abundance"), F.first("_mz").alias("_mz"))
    first = sums.where(F.col("target") == F.col("_mz")).select(*FEATURE, "scan", F.col("y").alias("x"))
    n = sums.groupBy(*FEATURE).agg(F.countDistinct("scan").alias("n"))
    alone = first.groupBy(*FEATURE).agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    with_own = sums.join(first, [*FEATURE, "scan"], "left").groupBy(*FEATURE, "target").agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))).alias("sxy"), F.first("abundance").alias("abundance"))
    c = F.col
    r = (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt((c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy")))
    kept = with_own.join(n, FEATURE).join(alone, FEATURE).where((c("n") * c("sxx") > c("sx") * c("sx")) & (c("n") * c("syy") > c("sy") * c("sy"))).withColumn("correlation", r).where(c("correlation") > least)
    kept = kept.join(own.select(*FEATURE, "_mz"), FEATURE)
    top = F.max_by("target", F.struct("abundance", F.col("target") == F.col("_mz"))).over(Window.partitionBy(*FEATURE))
    return kept.withColumn("is_parent", top == F.col("_mz")).select(*FEATURE, c("target").alias("mz"), "correlation", "abundance", "is_parent")


def ms1_annotations(found: DataFrame, forms: DataFrame, ion_types: list[tuple[str, str | None]], charge: int, ppm: tuple[float, float]) -> DataFrame:
    """sample, mf_id, ms1_formula, ms1_ion_type, ion_formula, mz_calc, error_ppm, mz_score of every candidate formula."""
    hits = searched(found.select(*FEATURE, "mz"), forms, ion_types, charge, ppm)
    return hits.select(*FEATURE, fm.text(F.col("atoms")).alias("ms1_formula"), F.col("ion_type").alias("ms1_ion_type"), report.ion_formula("atoms", "ion_type").alias("ion_formula"), "mz_calc", "error_ppm", "mz_score")


def ms2_annotations(found: DataFrame, ms2_scans: DataFrame, ms2_points: DataFrame, index: DataFrame, fragment_mz: float = 0.01, precursor_mz: float = 0.01, rt: float = 0.15, least: float = 0.2) -> DataFrame:
    """sample, mf_id, scan, ref, entropy_similarity, n_matched: library spectra like the second-level spectra of each feature."""
    near = lc.associate_ms2(found, ms2_scans, rt, precursor_mz).select(*FEATURE, F.col("mz").alias("_mz"), F.col("ms2_scan").alias("scan"))
    # A scan is searched once for all features that share it.
    spectra = ms2_scans.join(near.select("sample", "scan").distinct(), ["sample", "scan"], "left_semi").select("sample", "scan", "precursor_mz").join(ms2_points.select("sample", "scan", "mz", "intensity"), ["sample", "scan"])
    hits = fragment_index.search(spectra.withColumn("query", F.struct("sample", "scan")).drop("sample", "scan"), index, "identity", fragment_mz, precursor_mz, least)
    return hits.select("query.sample", "query.scan", "ref", "entropy_similarity", "n_matched").join(near, ["sample", "scan"]).select(*FEATURE, "scan", "ref", "entropy_similarity", "n_matched")


def ms2_summary(annotations: DataFrame, library: DataFrame) -> DataFrame:
    """The best spectrum of each feature and molecule, with the number of spectra that speak for it.

    ``library``: ref, ref_mol_id, name, formula (text), ion_type, and whatever else the report shall show.
    """
    rows = annotations.join(library, "ref")
    w = Window.partitionBy(*FEATURE, "ref_mol_id")
    rows = rows.withColumns({"n_spectra": F.size(F.collect_set("scan").over(w)), "_n": F.row_number().over(w.orderBy(F.col("entropy_similarity").desc(), "scan", "ref"))}).where("_n = 1").drop("_n")
    atoms = rows.withColumn("_atoms", fm.parse(F.col("formula")))
    return atoms.withColumn("ion_formula", report.ion_formula("_atoms", "ion_type")).drop("_atoms", "scan")


def annotated_report(found: DataFrame, ms1: DataFrame | None = None, ms2: DataFrame | None = None) -> DataFrame:
    """One row a feature and annotation, those without any too: formulas and molecules meet on the ion's formula where the feature has
    one, on the feature alone where not. ``annotation`` numbers a feature's rows, the likeliest first."""
    rows = found if ms1 is None else found.join(ms1, FEATURE, "left")
    rows = rows if ms1 is not None else rows.withColumns({"ion_formula": F.lit(None).cast("string"), "mz_score": F.lit(None).cast("double")})
    if ms2 is not None:
        known = rows.where(F.col("ion_formula").isNotNull()).join(ms2, [*FEATURE, "ion_formula"], "left")
        unknown = rows.where(F.col("ion_formula").isNull()).drop("ion_formula").join(ms2, FEATURE, "left")
        rows = known.unionByName(unknown.select(known.columns))
    else:
        rows = rows.withColumn("entropy_similarity", F.lit(None).cast("double"))
    order = [F.col("entropy_similarity").desc_nulls_last(), F.col("mz_score").desc_nulls_last(), F.col("ion_formula")]
    return rows.withColumn("annotation", F.row_number().over(Window.partitionBy(*FEATURE).orderBy(*order)))
