"""Molecular formulas: candidate generation, search against peaks, isotopologues, scores, choice and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.functions.chem import ABUNDANCE, ELECTRON, ISOTOPES, MONO, VALENCE
from massweave.operators.joins import band_join


def atom_grid(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """All combinations of atom counts, a product of the settings' ranges: one column an atom."""
    df = spark.range(1).drop("id")
    for name, low, high in ranges:
        df = df.withColumn(name, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return df


def grid_columns(ranges: list[tuple[str, int, int]]) -> tuple[Column, Column]:
    """(mass, rings and double bonds) of a grid's row."""
    mass = reduce(lambda a, b: a + b, [F.col(k) * F.lit(MONO[k]) for k, _, _ in ranges])
    return F.round(mass, 9), 1 + reduce(lambda a, b: a + b, [F.col(k) * F.lit((VALENCE[k] - 2) / 2) for k, _, _ in ranges])


def candidates(spark: SparkSession, ranges: list[tuple[str, int, int]], mz: tuple[float, float], dbe: tuple[float, float], h_c: tuple[float, float] = (0.3, 3.0), o_c: tuple[float, float] = (0.0, 1.2)) -> DataFrame:
    """Formulas of a mass, unsaturation and ratios within the settings, whose unsaturation is whole."""
    grid = atom_grid(spark, ranges)
    mass, rings = grid_columns(ranges)
    grid = grid.withColumns({"mass": mass, "dbe": rings})
    names = [k for k, _, _ in ranges]
    rows = grid.where(F.col("mass").between(*mz) & F.col("dbe").between(*dbe) & (F.col("dbe") == F.floor("dbe")) & (F.col("H") / F.col("C")).between(*h_c))
    if "O" in names:
        rows = rows.where((F.col("O") == 0) | ((F.col("O") / F.col("C") > o_c[0]) & (F.col("O") / F.col("C") < o_c[1])))
    return rows.withColumn("atoms", F.map_filter(F.create_map(*[x for k in names for x in (F.lit(k), F.col(k))]), lambda _, n: n > 0))


def ion_mz(mass: Column, ion_type: str, charge: int, adduct: str | None = None) -> Column:
    extra = {"radical": 0.0, "protonated": charge * MONO["H"], "adduct": MONO[adduct] if adduct else 0.0}[ion_type]
    return (mass + extra - charge * ELECTRON) / abs(charge)


def searched(peaks: DataFrame, forms: DataFrame, ion_types: list[tuple[str, str | None]], charge: int, ppm: tuple[float, float], std: float = 1.66) -> DataFrame:
    """Peaks with all candidate formulas within ppm: one band join over the ion types' calculated m/z."""
    ions = reduce(DataFrame.unionByName, [forms.withColumns({"ion_type": F.lit(kind), "mz_calc": ion_mz(F.col("mass"), kind, charge, adduct)}) for kind, adduct in ion_types])
    pairs = band_join(peaks, ions, "mz", "mz_calc", max(map(abs, ppm)), ppm=True)
    rated = pairs.withColumn("error_ppm", fm.ppm(F.col("mz"), F.col("mz_calc")))
    return rated.where(F.col("error_ppm").between(*ppm)).withColumn("mz_score", fm.mz_score(F.col("error_ppm"), std))


def isotopologue_rows(atoms: dict[str, int], least: float) -> list[tuple[dict[str, int], float, float]]:
    """(atoms, ratio to the main formula, mass shift) of one and two substitutions of a ratio of ``least`` or more, for a formula at hand."""
    swaps = []
    for name, n in atoms.items():
        for label, mass, share in ISOTOPES.get(name, [])[1:] if name != "H" else ():
            if n and label != name:
                swaps.append((name, label, n, share / ABUNDANCE[name], mass - MONO[name]))
    out = []
    for i, (a, la, na, ra, da) in enumerate(swaps):
        ratio = na * ra
        if ratio >= least:
            out.append(({**atoms, a: na - 1, la: 1}, ratio, da))
        if na > 1 and (two := na * (na - 1) / 2 * ra * ra) >= least:
            out.append(({**atoms, a: na - 2, la: 2}, two, 2 * da))
        for b, lb, nb, rb, db in swaps[i + 1 :]:
            both = ratio * rb * (nb if a != b else na - 1)
            if both >= least and (a != b or na > 1):
                made = {**atoms, a: atoms[a] - 1}
                made[b] = made[b] - 1
                out.append(({**made, la: 1, lb: 1}, both, da + db))
    return [({k: v for k, v in m.items() if v}, r, d) for m, r, d in out]


#: Single substitutions: element, heavier isotope, its share of the element's main isotope, mass difference.
SWAPS = [(name, label, share / ABUNDANCE[name], mass - MONO[name]) for name, rows in ISOTOPES.items() if name != "H" for label, mass, share in rows[1:] if label != name]


def isotopologues(assigned: DataFrame, dynamic_range: float = 1000.0) -> DataFrame:
    """One row an expected isotopologue of every assignment: iso_atoms, prob_ratio, iso_mz, iso_abundance.

    One and two substitutions, as ``isotopologue_rows`` has them of one formula, by expressions over arrays of the formula's own ones.
    """
    least, atoms = 1 / dynamic_range, F.col("atoms")
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(label).alias("label"), F.coalesce(atoms[n], F.lit(0)).alias("n"), F.lit(r).alias("r"), F.lit(d).alias("d")) for n, label, r, d in SWAPS])

    def changed(taken: list[Column], given: list[Column], by: list[Column]) -> Column:
        """The atoms with isotopes in place of main ones: the counts of what is taken and given are set, the rest stays."""
        names = F.array(*taken, *given)
        rest = F.map_filter("atoms", lambda k, n: (n > 0) & ~F.array_contains(names, k))
        entries = F.filter(F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in zip([*taken, *given], by)]), lambda e: e["value"] > 0)
        return F.map_concat(rest, F.map_from_entries(entries))

    def found(iso: Column, ratio: Column, shift: Column) -> Column:
        return F.struct(iso.alias("iso_atoms"), ratio.alias("prob_ratio"), shift.alias("shift"))

    n, one = (lambda s: s["n"]), F.lit(1)
    single = F.transform(F.filter("_swaps", lambda s: n(s) * s["r"] >= least), lambda s: found(changed([s["name"]], [s["label"]], [n(s) - 1, one]), n(s) * s["r"], s["d"]))
    twice = lambda s: n(s) * (n(s) - 1) / 2 * s["r"] * s["r"]
    double = F.transform(F.filter("_swaps", lambda s: (n(s) > 1) & (twice(s) >= least)), lambda s: found(changed([s["name"]], [s["label"]], [n(s) - 2, F.lit(2)]), twice(s), 2 * s["d"]))

    def pair(s: Column, t: Column) -> Column:
        same = s["name"] == t["name"]
        ratio = n(s) * s["r"] * t["r"] * F.when(same, n(s) - 1).otherwise(n(t))
        of_one = changed([s["name"]], [s["label"], t["label"]], [n(s) - 2, one, one])
        of_two = changed([s["name"], t["name"]], [s["label"], t["label"]], [n(s) - 1, n(t) - 1, one, one])
        return F.when((ratio >= least) & (~same | (n(s) > 1)), found(F.when(same, of_one).otherwise(of_two), ratio, s["d"] + t["d"]))

    both = F.flatten(F.transform("_swaps", lambda s, i: F.transform(F.slice("_swaps", i + 2, F.size("_swaps")), lambda t: pair(s, t))))
    rows = assigned.withColumn("_swaps", F.filter(every, lambda s: s["n"] > 0)).withColumn("_i", F.explode(F.concat(single, double, F.filter(both, lambda x: x.isNotNull()))))
    return rows.select("*", "_i.iso_atoms", "_i.prob_ratio", (F.col("mz_calc") + F.col("_i.shift")).alias("iso_mz"), (F.col("abundance") * F.col("_i.prob_ratio")).alias("iso_abundance")).drop("_i", "_swaps")


def isotopologue_similarity(expected: DataFrame, peaks: DataFrame, keys: list[str], ppm: float, abundance_percent: float = 100.0) -> DataFrame:
    """keys, iso_similarity, found, expected: half the Manhattan distance of the normalised patterns, from 1."""
    near = peaks.select(F.col("mz").alias("_mz"), F.col("abundance").alias("_a"), *[F.col(k).alias(f"_{k}") for k in keys if k in peaks.columns and k in ("sample", "scan")])
    hits = band_join(near, expected.select(*keys, "abundance", "iso_mz", "iso_abundance"), "_mz", "iso_mz", ppm, ppm=True)
    same = [F.col(f"_{k}") == F.col(k) for k in ("sample", "scan") if f"_{k}" in hits.columns]
    hits = hits.where(reduce(lambda a, b: a & b, same, F.abs(F.col("_a") - F.col("iso_abundance")) <= F.col("iso_abundance") * abundance_percent / 100))
    best = hits.groupBy(*keys, "iso_mz").agg(F.min_by("_a", F.abs(F.col("_a") - F.col("iso_abundance"))).alias("seen"))
    rows = expected.select(*keys, "abundance", "iso_mz", "iso_abundance").join(best, [*keys, "iso_mz"], "left").fillna(0.0, ["seen"])
    sums = rows.groupBy(*keys).agg(F.first("abundance").alias("_m"), F.sum("iso_abundance").alias("_e"), F.sum("seen").alias("_s"), F.count("*").alias("expected"), F.count(F.when(F.col("seen") > 0, 1)).alias("found"))
    gap = rows.drop("abundance").join(sums, keys).groupBy(*keys).agg(F.sum(F.abs(F.col("seen") / (F.col("_m") + F.col("_s")) - F.col("iso_abundance") / (F.col("_m") + F.col("_e")))).alias("_d"), F.first(F.abs(F.col("_m") / (F.col("_m") + F.col("_s")) - F.col("_m") / (F.col("_m") + F.col("_e")))).alias("_d0"), F.first("found").alias("found"), F.first("expected").alias("expected"))
    return gap.select(*keys, F.when(F.col("found") == 0, 0.0).otherwise(1 - (F.col("_d") + F.col("_d0")) / 2).alias("iso_similarity"), "found", "expected")


#: Orders in which candidates are chosen; the last keys break ties.
CHOICES: dict[str, list[str]] = {
    "lowest_error": ["abs(error_ppm)"],
    "highest_score": ["confidence desc", "abs(error_ppm)"],
    "N_S_P_lowest_error": ["coalesce(atoms['N'],0) + coalesce(atoms['S'],0) + coalesce(atoms['P'],0)", "abs(error_ppm)"],
    "S_P_lowest_error": ["coalesce(atoms['S'],0) + coalesce(atoms['P'],0)", "abs(error_ppm)"],
}


def best_candidate(rated: DataFrame, keys: list[str], choice: str, tie: list[str]) -> DataFrame:
    order = [F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x) for x in CHOICES[choice]]
    return rated.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *tie))).where("_r = 1").drop("_r")


def top_candidates(rated: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` candidates of each peak with their ``place`` from 1; ranks are limited before any shuffle."""
    return rated.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def source_filter(rated: DataFrame, kind: str) -> DataFrame:
    """Candidates that natural samples from air, water or earth allow."""
    n, s, p, o = (fm.element(F.col("atoms"), x) for x in "NSPO")
    rules = {"air": (o > 0) & (n <= 2) & (s <= 1) & (p == 0) & (3 * (s + n) <= o), "water": (o > 0) & (n <= 3) & (s <= 2) & (p <= 2), "earth": (o > 0) & (n <= 3) & (p <= 2) & (3 * p <= o)}
    return rated.where(rules[kind])


def class_table(assigned: DataFrame, keys: list[str], label: str, least_percent: float = 0.0) -> DataFrame:
    """Abundance and count shares of heteroatom classes above a percentage of the abundance; null is unassigned."""
    w = Window.partitionBy(*keys)
    rows = assigned.withColumn(label, F.coalesce(label, F.lit("unassigned"))).groupBy(*keys, label).agg(F.sum("abundance").alias("abundance"), F.count("*").alias("n"))
    shares = rows.withColumns({"abundance_percent": 100 * F.col("abundance") / F.sum("abundance").over(w), "count_percent": 100 * F.col("n") / F.sum("n").over(w)})
    return shares.where(F.col("abundance_percent") > least_percent)


def adaptive_errors(errors: DataFrame, keys: list[str], order: str, error: str, method: str = "distance", window: float = 10.0) -> DataFrame:
    """The running ppm window over peaks in order: centred on the last error, the lowest, or the running mean."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    center = {"distance": F.last(error, ignorenulls=True).over(w), "lowest": F.min_by(error, F.abs(error)).over(w), "average": F.avg(error).over(w), "symmetrical": F.lit(0.0)}[method]
    return errors.withColumn("center", F.coalesce(center, F.lit(0.0))).withColumns({"window_low": F.col("center") - window, "window_high": F.col("center") + window})
