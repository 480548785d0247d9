"""Reports: candidate tables, consensus tiers, combined annotation tables, atoms as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massweave.functions import formula as fm
from massweave.functions.chem import ATOM_ORDER


def atom_columns(assigned: DataFrame, keys: list[str], atoms: list[str] | None = None) -> DataFrame:
    """One column an atom; the atoms found are read from the data in one pass where none are given."""
    if atoms is None:
        seen = {r[0] for r in assigned.select(F.explode(F.map_keys("atoms"))).distinct().collect()}
        atoms = [a for a in ATOM_ORDER if a in seen] + sorted(seen - set(ATOM_ORDER))
    return assigned.select(*keys, *[F.coalesce(F.col("atoms")[a], F.lit(0)).alias(a) for a in atoms])


def counted(rows: DataFrame, keys: list[str], column: str, names: list[str]) -> DataFrame:
    """keys and one column a name: how many rows of a key have it in ``column``."""
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col(column) == n, 1)).alias(n) for n in names])


def spectrum_table(peaks: DataFrame, assigned: DataFrame, keys: list[str], min_score: float = 0.1) -> DataFrame:
    """Peaks with their candidates, matched or not, above a least confidence."""
    best = assigned.where(F.col("confidence") >= min_score)
    return peaks.join(best, keys, "left").withColumn("matched", F.col("confidence").isNotNull())


def ion_formula(atoms: str, ion_type: str):
    """The neutral formula with its proton added or taken."""
    h = F.coalesce(F.col(atoms)["H"], F.lit(0)) + F.when(F.col(ion_type) == "protonated", 1).when(F.col(ion_type) == "de-protonated", -1).otherwise(0)
    changed = F.map_concat(F.map_filter(F.col(atoms), lambda k, _: k != "H"), F.create_map(F.lit("H"), h))
    return fm.text(changed)


def best_per_feature(annotations: DataFrame) -> DataFrame:
    """The best entropy row of each (feature, reference), with the number of spectra that support it."""
    w = Window.partitionBy("mf_id", "ref_mol_id")
    # In this order both windows share one sort.
    ranked = annotations.withColumn("_r", F.row_number().over(w.orderBy(F.col("entropy_similarity").desc(), "scan", "ref_ms_id")))
    return ranked.withColumn("n_spectra", F.size(F.collect_set("scan").over(w))).where("_r = 1").drop("_r")


def consensus(annotations: DataFrame, tiers: list[str], score: str, tie: str) -> DataFrame:
    """Per feature the finest level at which its candidates agree, else its best candidate without consensus."""
    left, out = annotations, None
    for tier in tiers:
        agreed = left.groupBy("mf_id").agg(F.countDistinct(tier).alias("_n"), F.max(F.col(tier).isNull().cast("int")).alias("_u")).where("_n = 1 and _u = 0").select("mf_id")
        own = left.join(agreed, "mf_id", "left_semi").withColumn("consensus", F.lit(tier))
        out = own if out is None else out.unionByName(own)
        left = left.join(agreed, "mf_id", "left_anti")
    out = out.unionByName(left.withColumn("consensus", F.lit("none"))) if out is not None else left.withColumn("consensus", F.lit("none"))
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("mf_id").orderBy(F.col(score).desc(), tie))).where("_r = 1").drop("_r")


def combined(features: DataFrame, ms1: DataFrame, ms2: DataFrame) -> DataFrame:
    """Features with MS1 formulas, then MS2 hits: on the ion formula where one is known, on the feature alone where not."""
    with1 = features.join(ms1, "mf_id", "left")
    known = with1.where(F.col("ion_formula").isNotNull()).join(ms2, ["mf_id", "ion_formula"], "left")
    unknown = with1.where(F.col("ion_formula").isNull()).drop("ion_formula").join(ms2, "mf_id", "left")
    return known.unionByName(unknown.select(known.columns))
