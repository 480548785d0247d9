"""Formula assignment by priority: classes of heteroatoms take turns, and each searches only what earlier ones left.

All spectra take their turns at once: the k-th step is the k-th class of every spectrum's own queue. Labels are made once a
formula, and peaks meet formulas once, in one bucketed join within the widest error window. A peak has one row a turn, with its
hits of this turn and the errors of its earlier ones: a step reads its own turn's rows, and what earlier steps decided is one
row a spectrum. So all steps together read every hit a few times, and no task orders a spectrum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.operators.search import searched
from massweave.storage import written

#: Abundances this many deviations above the mean are no reference of a series.
OUTLIER_STD = 7
#: Whole masses between members of a series.
STEP = 14


def labelled(forms: DataFrame) -> DataFrame:
    """Formulas with their text, class, oxygen number and the number of their other heteroatoms: rows of formulas are few, those of hits are not."""
    atoms = F.col("atoms")
    oxygen = fm.element(atoms, "O")
    more = F.aggregate(F.map_values(atoms), F.lit(0), lambda s, n: s + n) - fm.element(atoms, "C") - fm.element(atoms, "H") - oxygen
    return forms.select("atoms", "mass", fm.text(atoms).alias("_text"), fm.class_label(atoms, F.lit("protonated")).alias("class"), oxygen.alias("O"), more.alias("_more"))


def tops(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _nominal, peak_idx, mz, abundance, _order: of each whole mass of a spectrum the most abundant peak; the least _order of a spectrum is its most abundant peak's.

    Outliers of over ``OUTLIER_STD`` deviations count as of no abundance.
    """
    # Written, so that few spectra are broadcast: dealt by spectrum, one task would have all peaks of one.
    stats = written(peaks.groupBy(*keys).agg((F.avg("abundance") + OUTLIER_STD * F.stddev_pop("abundance")).alias("_limit")))
    own = peaks.join(stats, keys).withColumn("_a", F.when(F.col("abundance") <= F.col("_limit"), F.col("abundance")).otherwise(0.0))
    # NaN is above all numbers.
    order = F.struct((~F.isnan("_a")).alias("a"), (-F.col("_a")).alias("b"), F.col("peak_idx").alias("i"))
    best = own.groupBy(*keys, F.floor("mz").alias("_nominal")).agg(F.min_by(F.struct("peak_idx", "mz", "abundance"), order).alias("_top"), F.min(order).alias("_order"))
    return best.select(*keys, "_nominal", "_top.*", "_order")


def oxygen_series(tops: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, O, ox_rank: the oxygen classes of each spectrum's main series, the most abundant first.

    The series starts at the most abundant peak and its formula of least error among those of carbon, hydrogen and oxygen; its
    members are the most abundant peaks of the whole masses that are a multiple of 14 away, if they have such a formula. Spectra
    whose first peak has none have no series. ``hits``: the candidates of ``tops``, with labels, mz_calc and error_ppm.
    """
    w = Window.partitionBy(*keys, "peak_idx").orderBy(F.abs("error_ppm"), "_text", "ion_type")
    only = hits.where("_more = 0 and O > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "peak_idx", "mz_calc", "O")
    rated = tops.join(only, [*keys, "peak_idx"], "left")
    start = rated.groupBy(*keys).agg(F.floor(F.min_by("mz_calc", "_order")).alias("_start"))
    members = rated.join(start, keys).where((F.col("_nominal") != F.col("_start")) & ((F.col("_nominal") - F.col("_start")) % STEP == 0) & F.col("O").isNotNull())
    found = members.groupBy(*keys, "O").agg(F.max("abundance").alias("_own"))
    return found.withColumn("ox_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_own").desc(), "O"))).select(*keys, "O", "ox_rank")


def class_queue(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, class, turn: oxygen classes in the order of the series, then those with other heteroatoms beside such an oxygen number, by how many, then by their names and the oxygen's rank."""
    seen = hits.select(*keys, "class", "_more", "ox_rank").distinct()
    # A class's name without its oxygen.
    bare = F.trim(F.regexp_replace("class", r"\bO\d+", ""))
    w = Window.partitionBy(*keys).orderBy("_more", bare, "ox_rank")
    return seen.withColumn("turn", F.row_number().over(w)).select(*keys, "class", "turn")


def turns(hits: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """keys, peak_idx, class, _errors, _earlier, _hits, turn: one row a peak and turn, its hits of this turn by error, text and ion type, and the errors of its earlier turns."""
    hit = F.struct(F.abs("error_ppm").alias("_e"), "_text", "ion_type", "error_ppm", "mz", "abundance", "mz_calc", F.map_entries("atoms").alias("atoms"))
    live = hits.join(queue, [*keys, "class"]).repartition(*keys, "peak_idx")
    rows = live.groupBy(*keys, "peak_idx", "turn", "class").agg(F.sort_array(F.collect_list(hit)).alias("_hits")).withColumn("_errors", F.col("_hits.error_ppm"))
    before = Window.partitionBy(*keys, "peak_idx").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_earlier", F.collect_list(F.struct("turn", "_errors")).over(before)).select(*keys, "peak_idx", "class", "_errors", "_earlier", "_hits", "turn")


def assigned(peaks: DataFrame, forms: DataFrame, keys: list[str], ion_types: list[tuple[str, str | None]], charge: int, ppm: tuple[float, float], around: float | None = None, min_peaks: int = 0) -> DataFrame:
    """Peaks (keys, peak_idx, mz, abundance) with the formulas of the first class in their spectrum's queue that has any.

    With ``around``, a step takes errors within that many ppm of the mean error of the best formulas found before, in the
    spectrum, and of 0 at first. A class with fewer than ``min_peaks`` peaks in a spectrum gives its peaks back. Returns the
    hits, all of a peak in its class, with class, turn and ``best``: whether of least error among the peak's.
    """
    near = lambda error, center: F.lit(True) if around is None else F.abs(error - center) <= around
    peaks, forms = written(peaks.select(*keys, "peak_idx", "mz", "abundance")), labelled(forms)
    first = written(tops(peaks, keys))
    series = written(oxygen_series(first, searched(first, forms, ion_types, charge, ppm), keys))
    # Only spectra with a series have a queue.
    hits = searched(peaks.join(series.select(*keys).distinct(), keys, "left_semi"), forms, ion_types, charge, ppm).join(series, [*keys, "O"])
    hits = written(hits.select(*keys, "peak_idx", "mz", "abundance", "atoms", "ion_type", "mz_calc", "error_ppm", "_text", "class", "_more", "ox_rank"))
    queue = written(class_queue(hits, keys))
    rows = written(turns(hits, queue, keys), "turn")
    # Of each spectrum the sum and number of best errors so far, and the centers of the turns that kept their peaks.
    state = written(queue.select(*keys).distinct().select("*", F.lit(0.0).alias("_sum"), F.lit(0).cast("long").alias("_n"), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")).alias("_centers")))
    center_of = lambda turn: F.try_element_at("_centers", turn)

    def free(some: DataFrame) -> DataFrame:
        """Rows of peaks that no earlier turn took."""
        took = lambda e: center_of(e["turn"]).isNotNull() & F.exists(e["_errors"], lambda x: near(x, center_of(e["turn"])))
        return some.join(state, keys).where(~F.exists("_earlier", took))

    for turn in range(1, (queue.agg(F.max("turn")).first()[0] or 0) + 1):
        center: Column = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(0.0)
        # Errors are in order, so the first that is near is the best.
        step = free(rows.where(F.col("turn") == turn)).withColumn("_center", center).withColumn("_best", F.get(F.filter("_errors", lambda x: near(x, F.col("_center"))), F.lit(0)))
        sums = step.where(F.col("_best").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_peaks"), F.sum("_best").alias("_step"))
        kept = F.coalesce(F.col("_peaks") >= min_peaks, F.lit(False))
        state = written(state.join(sums, keys, "left").select(*keys, F.when(kept, F.col("_sum") + F.col("_step")).otherwise(F.col("_sum")).alias("_sum"), F.when(kept, F.col("_n") + F.col("_peaks")).otherwise(F.col("_n")).alias("_n"), F.when(kept, F.map_concat("_centers", F.create_map(F.lit(turn), center))).otherwise(F.col("_centers")).alias("_centers")))
    own = free(rows).withColumn("_center", center_of(F.col("turn"))).where(F.col("_center").isNotNull())
    found = own.select("*", F.posexplode(F.filter("_hits", lambda h: near(h["error_ppm"], F.col("_center")))).alias("_place", "_hit"))
    return found.select(*keys, "class", "peak_idx", "_hit.mz", "_hit.abundance", F.map_from_entries("_hit.atoms").alias("atoms"), "_hit.ion_type", "_hit.mz_calc", "_hit.error_ppm", "turn", (F.col("_place") == 0).alias("best"))
