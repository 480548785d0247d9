"""Lipid libraries in JSON and spectra from arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.operators.joins import band_join
from massweave.sources.text import PEAKS

SPECTRA = "id long, molecular_data_id long, mslevel int, peak_count int, precursor_ion double, ion_type string, polarity string, fragment_types string, fragment_formulas string, fragment_annotations string, usi string, mz string"
MOLECULES = "id long, inchikey string, inchi string, chebi string, smiles string, kegg string, iupac_name string, common_name string, name string, casno string, formula string, structure_level string, lipid_summed_name string, lipid_subclass string, lipid_class string, lipid_category string"


def read_lipid_spectra(spark: SparkSession, path: str) -> DataFrame:
    """One row a library spectrum; ``peaks`` from text like ``(255.23,100)(256.2,4)``, fragment lists split at commas."""
    rows = spark.read.schema(SPECTRA).json(path, multiLine=True)
    pair = F.transform(F.regexp_extract_all("mz", F.lit(r"\(([^)]*)\)"), 1), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("mz"), F.split(p, ",")[1].cast("double").alias("intensity")))
    lists = {c: F.split(F.col(c), r"\s*,\s*") for c in ("fragment_types", "fragment_formulas", "fragment_annotations")}
    return rows.withColumns({"peaks": pair.cast(PEAKS), **lists}).drop("mz").withColumnsRenamed({"id": "ref_ms_id", "molecular_data_id": "ref_mol_id", "precursor_ion": "precursor_mz"})


def read_lipid_molecules(spark: SparkSession, path: str) -> DataFrame:
    """One row a molecule of a JSON map from spectrum ids to molecules."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{', '.join(x.replace(' ', ':') for x in MOLECULES.split(', '))}>>").alias("m"))
    return whole.select(F.explode(F.map_values("m")).alias("m")).select("m.*").distinct().withColumnRenamed("id", "ref_mol_id")


def normalised(peaks: str = "peaks"):
    """The peaks with intensities that sum to 1, those above zero, by m/z."""
    kept = F.filter(F.col(peaks), lambda p: p["intensity"] > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda s, p: s + p["intensity"])
    return F.array_sort(F.transform(kept, lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] / total).alias("intensity"))))


def lipid_library(spectra: DataFrame, molecules: DataFrame, precursors: DataFrame, polarity: str, ppm: float) -> DataFrame:
    """Library spectra of a polarity near any of the precursors (precursor), normalised, with their molecules."""
    if polarity not in ("positive", "negative"):
        raise ValueError("polarity is positive or negative")
    own = spectra.where(F.col("polarity") == polarity)
    near = band_join(own.select("ref_ms_id", "precursor_mz"), precursors.select("precursor"), "precursor_mz", "precursor", ppm, ppm=True).select("ref_ms_id").distinct()
    return own.join(near, "ref_ms_id", "left_semi").withColumn("peaks", normalised()).join(molecules, "ref_mol_id", "left")


def from_arrays(spark: SparkSession, mz: Sequence[float], abundance: Sequence[float], resolving_power: Sequence[float] | None = None, s2n: Sequence[float] | None = None, sample: str = "", scan: int = 0) -> DataFrame:
    """A spectrum's rows from arrays: profile points, or centroids with their resolving power and signal to noise."""
    columns = {"mz": mz, "abundance": abundance, "resolving_power": resolving_power, "s2n": s2n}
    if len({len(v) for v in columns.values() if v is not None}) != 1:
        raise ValueError("arrays of different lengths")
    given = {k: v for k, v in columns.items() if v is not None}
    rows = [(sample, scan, *map(float, values)) for values in zip(*given.values())]
    return spark.createDataFrame(rows, "sample string, scan int, " + ", ".join(f"{k} double" for k in given))
