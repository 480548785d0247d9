"""Operators on small inputs with results known in closed form."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from massweave.config import Settings
from massweave.functions import formula as fm
from massweave.functions import lineshape, similarity
from massweave.operators import calibration, gc, joins, lc, profile, report, search, sequence, spectrum
from massweave.sources import libraries, sinks, text


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_atoms_and_reports(spark):
    a = spark.createDataFrame([(1, {"C": 6, "H": 12, "O": 6}, 0.9), (2, {"C": 5, "H": 9, "N": 1}, 0.05)], "peak int, atoms map<string,int>, confidence double")
    assert report.atom_columns(a, ["peak"]).columns == ["peak", "C", "H", "O", "N"] or set(report.atom_columns(a, ["peak"]).columns) == {"peak", "C", "H", "O", "N"}
    assert rows(report.atom_columns(a, ["peak"], ["C", "S"]), "peak", "C", "S") == [(1, 6, 0), (2, 5, 0)]
    peaks = spark.createDataFrame([(1,), (2,), (3,)], "peak int")
    assert rows(report.spectrum_table(peaks, a, ["peak"], 0.1), "peak", "matched") == [(1, True), (2, False), (3, False)]
    b = a.select("peak", fm.subtracted(F.col("atoms"), F.create_map(F.lit("C"), F.lit(5), F.lit("H"), F.lit(20))).alias("left"), fm.class_atoms(F.col("atoms")).alias("cls"))
    assert [(r.left, r.cls) for r in b.orderBy("peak").collect()] == [({"C": 1, "O": 6}, {"O": 6}), ({"N": 1}, {"N": 1})]
    kept = search.source_filter(a.unionByName(spark.createDataFrame([(3, {"C": 5, "O": 1, "P": 3}, 1.0)], a.schema)), "water")
    assert rows(kept, "peak") == [(1,)]
    one = spark.range(1).select(fm.confidence(F.lit(1.0), F.lit(0.5)).alias("c"), fm.normalised_distance(F.lit(3.0), 0, 2).alias("d"), fm.error_percent(F.lit(9.0), F.lit(10.0)).alias("e")).first()
    assert (round(one.c, 9), one.d, one.e) == (round(0.6 + 0.2, 9), 1.0, -10.0)


def test_isotopologues_of_a_chlorinated_formula(spark):
    a = spark.createDataFrame([(1, {"C": 10, "O": 10, "Cl": 2}, 349.886303, 100.0)], "peak int, atoms map<string,int>, mz_calc double, abundance double")
    top = search.isotopologues(a).orderBy(F.col("prob_ratio").desc()).first()
    assert top.iso_atoms == {"C": 10, "O": 10, "Cl": 1, "37Cl": 1} and abs(top.prob_ratio - 0.63993) < 2e-5 and abs(top.iso_mz - 351.883353) < 2e-6
    expected = search.isotopologues(a, 5.0)
    seen = expected.select(F.col("iso_mz").alias("mz"), F.col("iso_abundance").alias("abundance"))
    assert search.isotopologue_similarity(expected, seen, ["peak"], 1.0).first().iso_similarity == pytest.approx(1.0)


def test_transient_of_one_frequency(spark):
    signal = np.cos(2 * math.pi * 100 * np.arange(1024) / 1024).tolist()
    out = sequence.transient_spectrum(spark.createDataFrame([("s", 1, signal)], "sample string, scan int, signal array<double>"), 512.0)
    assert abs(out.orderBy(F.col("magnitude").desc()).first().frequency - 100) < 1
    assert spark.range(1).select(sequence.clipped(F.lit(5.0), 0, 2).alias("c"), spectrum.to_mz(F.lit(2.0), 8.0, 4.0, 1.0).alias("m")).first()[:] == (2.0, 6.0)


def test_peaks_are_parabola_apexes(spark):
    x = np.arange(0, 20) * 0.1
    y = 10 - (x - 0.93) ** 2 * 3
    got = spectrum.picked(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "scan int, mz double, abundance double"), ["scan"]).first()
    assert got.mz == pytest.approx(0.93) and got.abundance == pytest.approx(10.0)
    minima = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 2.0)], "scan int, abundance double")
    assert spectrum.minima_noise(minima, ["scan"]).first().noise == 4.0
    table = spark.createDataFrame([(1, 0.5, 2.0), (2, None, 3.0), (3, 0.9, 9.0)], "i int, a double, b double")
    assert rows(spectrum.metric_filter(table, {"a": {"value": 0.4, "operator": ">="}, "b": {"value": 5, "operator": "<"}}), "i") == [(1,)]
    at_half = spark.range(1).select(*[f(F.lit(100.5), F.lit(100.0), F.lit(1.0), F.lit(8.0)).alias(f.__name__) for f in (lineshape.gaussian, lineshape.lorentzian, lineshape.pseudo_voigt)]).first()
    assert list(at_half) == pytest.approx([4.0, 4.0, 4.0])


def test_half_height_width_of_a_triangle(spark):
    rows_ = [(1, float(i), float(10 - abs(i - 10))) for i in range(21)]
    got = profile.half_height_widths(spark.createDataFrame(rows_, "scan int, mz double, abundance double"), ["scan"], "mz", "abundance").first()
    assert (got.left, got.right, got.resolving_power) == pytest.approx((5.0, 15.0, 1.0))


def test_calibration_recovers_its_terms(spark):
    f = [calibration.SCALE * k for k in (1.0, 1.3, 1.9, 2.4, 3.3)]
    for kind, (a, b, c) in {"linear": (900.0, 0.0, 0.2), "ledford": (900.0, -3.0, 0.0), "quadratic": (900.0, -3.0, 0.2)}.items():
        u = [calibration.SCALE / v for v in f]
        df = spark.createDataFrame([(1, v, a * w + b * w * w + c) for v, w in zip(f, u)], "scan int, frequency double, mz_calc double")
        fit = calibration.frequency_fit(df, ["scan"], kind)
        assert list(fit.first())[1:] == pytest.approx([a, b, c], abs=1e-6)
        assert calibration.frequency_calibrated(df, fit, ["scan"]).agg(calibration.rms_ppm()).first()[0] < 1e-3
    few = spark.createDataFrame([(1, f[0], 900.0)], "scan int, frequency double, mz_calc double")
    assert calibration.frequency_fit(few, ["scan"], "ledford").first().a is None


def test_traces_that_elute_together(spark):
    t = spark.createDataFrame([("s", k, i, float(v)) for k, values in {1: [1, 5, 9, 4], 2: [2, 10, 18, 8], 3: [9, 4, 1, 5]}.items() for i, v in enumerate(values)], "sample string, target int, scan int, intensity double")
    assert rows(lc.coelution(t, t.where("target = 1"), 0.8), "target") == [(1,), (2,)]
    rated = spark.createDataFrame([(800.0, 5.0, 0.7), (800.0, 6.0, 0.9), (900.0, 7.0, 0.5)], "ref_ri double, rt double, cosine double")
    assert rows(gc.ri_pairs(rated), "ref_ri", "rt") == [(800.0, 6.0), (900.0, 7.0)]


def test_outer_band_joins_and_long_ladders_are_refused(spark, monkeypatch):
    a = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        joins.band_join(a, a.withColumnRenamed("x", "y"), "x", "y", 0.1, how="full_outer")
    monkeypatch.setattr(joins, "LADDER_RUNGS", 1)
    with pytest.raises(ValueError):
        joins.ladder(a, spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "at double, v double"), "x", "at", "v")


def test_stein_scott_of_equal_and_disjoint_spectra(spark):
    same = [("a", m, v, v) for m, v in ((10, 1.0), (20, 4.0), (30, 2.0))]
    apart = [("b", 10, 1.0, 0.0), ("b", 20, 0.0, 1.0)]
    got = {r.q: (r.stein_scott, r.stein_scott_nist) for r in similarity.stein_scott(spark.createDataFrame(same + apart, "q string, mz int, x double, y double"), ["q"]).collect()}
    # Two of three common peaks have one before them.
    assert got["a"] == pytest.approx(((3 * 1 + 3 * (2 / 3)) / 6,) * 2) and got["b"] == (0.0, 0.0)


def test_sinks_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    sinks.write_table(df, f"{tmp_path}/t", Settings(), "csv")
    assert spark.read.csv(f"{tmp_path}/t", header=True).count() == 2 and json.loads(spark.read.text(f"{tmp_path}/t.settings", wholetext=True).first()[0])
    sinks.write_version(df, f"{tmp_path}/v", 1)
    sinks.write_version(df.where("i = 1"), f"{tmp_path}/v", 2)
    assert sinks.latest(spark, f"{tmp_path}/v").count() == 1 and sinks.latest(spark, f"{tmp_path}/v", 1).count() == 2


def test_lipid_library(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([
        {"id": 7, "molecular_data_id": 70, "mslevel": 2, "peak_count": 2, "precursor_ion": 255.23, "ion_type": "[M-H]-", "polarity": "negative", "fragment_types": "MLF, FA", "mz": "(255.23,75)(200.1,25)"},
        {"id": 8, "molecular_data_id": 80, "precursor_ion": 300.0, "polarity": "negative", "mz": "(300,1)"}, {"id": 9, "precursor_ion": 255.23, "polarity": "positive", "mz": "(1,1)"},
    ]))
    (tmp_path / "m.json").write_text(json.dumps({"7": {"id": 70, "name": "FA 16:0", "formula": "C16H32O2", "cas": None}}))
    spectra, molecules = libraries.read_lipid_spectra(spark, f"{tmp_path}/s.json"), libraries.read_lipid_molecules(spark, f"{tmp_path}/m.json")
    got = libraries.lipid_library(spectra, molecules, spark.createDataFrame([(255.2301,)], "precursor double"), "negative", 5.0).collect()
    assert [(r.ref_ms_id, r.name, [tuple(p) for p in r.peaks], r.fragment_types) for r in got] == [(7, "FA 16:0", [(200.1, 0.25), (255.23, 0.75)], ["MLF", "FA"])]
    assert libraries.from_arrays(spark, [1.0, 2.0], [3, 4], s2n=[5, 6]).columns == ["sample", "scan", "mz", "abundance", "s2n"]


def test_mzml_groups_and_native_ids():
    groups = {"common": ['<cvParam accession="MS:1000511" value="2"/>', '<cvParam accession="MS:1000129"/>']}
    got = text.spectrum_of('<spectrum index="4" id="controller 1"><referenceableParamGroupRef ref="common"/></spectrum>', groups)
    assert got["scan"] == 5 and got["ms_level"] == 2 and got["polarity"] == "negative"
    assert text.scan_number("controllerType=0 controllerNumber=1 scan=12", None) == 12 and text.scan_number("spectrum=3", "9") == 3
