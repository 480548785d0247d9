"""Readers of text formats: spectral libraries (MSP, MSL), reference lists, mass lists, scan and peak XML, mzML."""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEAKS = "array<struct<mz:double,intensity:double>>"

#: Column names of mass lists and what they mean here.
HEADERS = {
    "m/z": "mz", "mz": "mz", "mOz": "mz", "Calibrated m/z": "mz_cal", "Calculated m/z": "mz_calc", "Abundance": "abundance", "Peak Height": "abundance", "I": "abundance",
    "Intensity": "abundance", "Resolving Power": "resolving_power", "Res.": "resolving_power", "S/N": "s2n", "Ion Charge": "ion_charge", "Mass Error (ppm)": "error_ppm",
    "m/z Error (ppm)": "error_ppm", "Heteroatom Class": "class_label", "Ion Type": "ion_type", "Is Isotopologue": "is_isotopologue", "Index": "peak_idx", "Molecular Formula": "formula",
}


def _records(spark: SparkSession, path: str, start: str) -> DataFrame:
    """Whole records of a file that begin at lines of a pattern; only the records' text moves."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.split(F.regexp_replace("value", "\r", ""), rf"(?mi)(?=^{start})")).alias("record")).where(F.trim("record") != "")


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """name, metadata (map of lower-case keys) and peaks of every record of an MSP library."""
    rows = _records(spark, path, "name:")
    lines = F.filter(F.transform(F.split("record", "\n"), F.trim), lambda x: x != "")
    fields = F.filter("lines", lambda x: x.rlike(r"^[A-Za-z_][^:]*:"))
    pairs = F.transform(fields, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    meta = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    numbers = F.filter("lines", lambda x: x.rlike(r"^[0-9.]"))
    pairs_of = F.flatten(F.transform(numbers, lambda x: F.regexp_extract_all(x, F.lit(r"([0-9.eE+-]+[\s:]+[0-9.eE+-]+)"), F.lit(1))))
    peaks = F.transform(pairs_of, lambda x: F.struct(F.split(x, r"[\s:]+")[0].cast("double").alias("mz"), F.split(x, r"[\s:]+")[1].cast("double").alias("intensity")))
    return rows.select(lines.alias("lines")).select(meta.alias("metadata"), peaks.cast(PEAKS).alias("peaks")).select(F.col("metadata")["name"].alias("name"), "metadata", "peaks").withColumn("precursor_mz", F.col("metadata")["precursormz"].try_cast("double"))


def read_msl(spark: SparkSession, path: str) -> DataFrame:
    """name, ri, rt, metadata and peaks of every record of an MSL library, peaks as ``( mz abundance)`` pairs."""
    rows = _records(spark, path, "name:")
    lines = F.filter(F.transform(F.split("record", "\n"), F.trim), lambda x: x.rlike(r"^[A-Za-z][A-Za-z ]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    meta = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    found = F.regexp_extract_all("record", F.lit(r"\(\s*([0-9.]+\s+[0-9.]+)\s*\)"), F.lit(1))
    peaks = F.transform(found, lambda x: F.struct(F.split(x, r"\s+")[0].cast("double").alias("mz"), F.split(x, r"\s+")[1].cast("double").alias("intensity")))
    out = rows.select(meta.alias("metadata"), peaks.cast(PEAKS).alias("peaks"))
    return out.select(F.col("metadata")["name"].alias("name"), F.col("metadata")["ri"].try_cast("double").alias("ri"), F.col("metadata")["rt"].try_cast("double").alias("rt"), "metadata", "peaks")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """formula, mz, charge of a reference list: comments, then fields between tabs or spaces."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    tabbed = F.col("value").contains("\t")
    fields = F.when(tabbed, F.split(F.trim("value"), r"\t+")).otherwise(F.split(F.trim("value"), r"\s+"))
    return rows.select(fields.alias("f")).select(F.trim(F.col("f")[0]).alias("formula"), F.col("f")[1].try_cast("double").alias("mz"), F.get("f", F.lit(2)).alias("charge")).where("mz is not null")


def read_mass_list(spark: SparkSession, path: str, required: tuple[str, ...] = ("mz", "abundance"), delimiter: str = ",") -> DataFrame:
    """A delimited mass list with known columns renamed; atom columns stay, unknown others go."""
    raw = spark.read.csv(path, header=True, sep=delimiter)
    keep = {c: HEADERS[c.strip()] for c in raw.columns if c.strip() in HEADERS}
    atoms = [c for c in raw.columns if re.fullmatch(r"\d*[A-Z][a-z]?", c.strip()) and c not in keep]
    missing = [r for r in required if r not in keep.values()]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    text = {"class_label", "ion_type", "formula"}
    cols = [F.col(f"`{c}`").alias(n) if n in text else F.col(f"`{c}`").try_cast("double").alias(n) for c, n in keep.items()]
    return raw.select(*cols, *[F.col(f"`{c}`").try_cast("double").cast("int").alias(c.strip()) for c in atoms])


def read_scan_xml(spark: SparkSession, path: str) -> DataFrame:
    """scan, rt, tic, max_peak of a scan list."""
    kinds = "count int, minutes double, tic double, maxpeak double"
    rows = spark.read.format("xml").option("rowTag", "scan").schema(kinds).load(path)
    return rows.select(F.col("count").alias("scan"), F.col("minutes").alias("rt"), "tic", F.col("maxpeak").alias("max_peak"))


def read_peak_xml(spark: SparkSession, path: str) -> DataFrame:
    """mz, abundance, resolving_power, s2n, fwhm of ``pk`` elements."""
    kinds = "_a double, _fwhm double, _i double, _mz double, _res double, _sn double"
    rows = spark.read.format("xml").option("rowTag", "pk").schema(kinds).load(path)
    return rows.select(F.col("_mz").alias("mz"), F.col("_i").alias("abundance"), F.col("_res").alias("resolving_power"), F.col("_sn").alias("s2n"), F.col("_fwhm").alias("fwhm"))


# Accessions of the controlled vocabulary of mzML.
CV = {"time": "MS:1000016", "ms_level": "MS:1000511", "tic": "MS:1000285", "positive": "MS:1000130", "negative": "MS:1000129", "profile": "MS:1000128", "centroid": "MS:1000127", "precursor": "MS:1000744", "window_low": "MS:1000501", "window_high": "MS:1000500", "text": "MS:1000512", "zlib": "MS:1000574", "float64": "MS:1000523", "mz_array": "MS:1000514", "intensity_array": "MS:1000515"}


def scan_number(identifier: str, index: str | None) -> int:
    """The scan of a native id: ``scan=7``, ``spectrum=7``, ``scanId=7``, a number alone, or one more than the index."""
    found = re.search(r"(?:scan|spectrum|scanId)=(\d+)", identifier) or re.fullmatch(r"(\d+)", identifier.strip())
    return int(found[1]) if found else int(index or 0) + 1


def spectrum_of(xml: str, groups: dict[str, list[str]] | None = None) -> dict:
    """Scan fields and arrays of one mzML spectrum element. ``groups``: parameters that elements may refer to, by name."""
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", xml))
    for ref in [*root.iter("referenceableParamGroupRef")]:
        root.extend(ET.fromstring(p) for p in (groups or {}).get(ref.get("ref"), ()))
    params = {p.get("accession"): p for p in root.iter("cvParam")}

    def value(name: str) -> str | None:
        return params[CV[name]].get("value") if CV[name] in params else None

    out = {"scan": scan_number(root.get("id", ""), root.get("index")), "ms_level": int(value("ms_level") or 1), "tic": float(value("tic") or 0), "scan_text": value("text")}
    rt = value("time")
    minutes = 1.0 if rt is None or "minute" in (params[CV["time"]].get("unitName") or "minute") else 1 / 60
    out |= {"rt": float(rt) * minutes if rt else None, "precursor_mz": float(value("precursor")) if value("precursor") else None, "window_low": float(value("window_low") or "nan"), "window_high": float(value("window_high") or "nan")}
    out["polarity"] = "positive" if CV["positive"] in params else "negative" if CV["negative"] in params else None
    out["ms_format"] = "profile" if CV["profile"] in params else "centroid"
    for array in root.iter("binaryDataArray"):
        own = {p.get("accession") for p in array.iter("cvParam")}
        raw = base64.b64decode((array.findtext("binary") or "").strip())
        raw = zlib.decompress(raw) if CV["zlib"] in own and raw else raw
        size, code = (8, "d") if CV["float64"] in own else (4, "f")
        values = list(struct.unpack(f"<{len(raw) // size}{code}", raw))
        out["mz" if CV["mz_array"] in own else "intensity"] = values
    return out


MZML = "scan int, rt double, ms_level int, polarity string, precursor_mz double, scan_text string, window_low double, window_high double, tic double, ms_format string, mz array<double>, intensity array<double>"


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """One row a spectrum. The file is cut at spectrum elements; each is decoded where it lies."""
    names = [x.split()[0] for x in MZML.split(", ")]
    elements = spark.read.text(path, lineSep="</spectrum>").where(F.col("value").contains("<spectrum ")).select(F.concat(F.regexp_extract("value", r"(?s)(<spectrum .*)$", 1), F.lit("</spectrum>")).alias("xml"), F.input_file_name().alias("sample"))

    # The file's head, before its first spectrum, names groups of parameters.
    head = spark.read.text(path, lineSep="<spectrum ").select(F.regexp_extract("value", r"(?s)(<referenceableParamGroupList.*</referenceableParamGroupList>)", 1).alias("x"), F.input_file_name().alias("sample")).where("x != ''")
    groups = {r["sample"]: {g.get("id"): [ET.tostring(p, "unicode") for p in g] for g in ET.fromstring(r["x"])} for r in head.collect()}

    def run(batches):
        for pdf in batches:
            rows = [spectrum_of(x, groups.get(sample)) for x, sample in zip(pdf.xml, pdf["sample"])]
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
            yield out.assign(sample=pdf["sample"].to_numpy())

    return elements.mapInPandas(run, f"{MZML}, sample string")


def points(spectra: DataFrame, level: int | None = None) -> DataFrame:
    """sample, ms_level, scan, mz, intensity rows, intensities above zero."""
    own = spectra if level is None else spectra.where(F.col("ms_level") == level)
    rows = own.select("sample", "ms_level", "scan", F.explode(F.arrays_zip("mz", "intensity")).alias("p"))
    return rows.select("sample", "ms_level", "scan", F.col("p.mz").cast("float").alias("mz"), F.col("p.intensity").cast("float").alias("intensity")).where("intensity > 0")
