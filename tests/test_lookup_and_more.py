"""Lookup tables, centroid features, deconvoluted features, noise regions, magnetron frequencies, JSON documents."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from massweave.operators import calibration, lookup, persistence, spectrum, workflow
from massweave.sources import sinks


def test_classes_are_made_once(spark, tmp_path, capsys):
    path, ranges = str(tmp_path / "forms"), [("C", 1, 8), ("H", 2, 18), ("O", 0, 2)]
    assert lookup.classes(spark, path).count() == 0
    assert lookup.add(spark, path, ranges, (50.0, 150.0), (0.0, 6.0)) == 3 and lookup.add(spark, path, ranges, (50.0, 150.0), (0.0, 6.0)) == 0
    before = lookup.formulas(spark, path).count()
    assert lookup.add(spark, path, [*ranges, ("S", 0, 1)], (50.0, 150.0), (0.0, 6.0)) == 3
    assert {r["class"] for r in lookup.classes(spark, path).collect()} == {"HC", "O1", "O2", "S1", "O1 S1", "O2 S1"}
    some = lookup.formulas(spark, path, ["O1", "HC"], [100, 98])
    assert {(r["class"], r.nominal) for r in some.collect()} <= {("O1", 100), ("O1", 98), ("HC", 100), ("HC", 98)} and some.count() > 0
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "In(nominal" in plan
    assert lookup.formulas(spark, path, ["HC", "O1", "O2"]).count() == before
    atoms = spark.range(1).select(F.create_map(F.lit("C"), F.lit(2), F.lit("H"), F.lit(3), F.lit("Cl"), F.lit(2), F.lit("O"), F.lit(1)).alias("a"))
    assert atoms.select(lookup.heteroatoms(F.col("a")), lookup.halogens(F.col("a"))).first()[:] == (3, 2)


def test_centroid_features(spark):
    random.seed(1)
    rows = [("a", 100 + random.random() * 0.01, random.uniform(0, 10), round(random.uniform(0, 100), 3)) for _ in range(150)] + [("b", 100.0, 1.0, None), ("b", 100.0, 1.0, 5.0)]
    got = persistence.find_features_centroid(spark.createDataFrame(rows, "s string, mz double, rt double, i double"), ["s"], "mz", "rt", "i", 0.1, 2e-5, 0.5)
    top, kept = max(r[3] for r in rows if r[0] == "a"), []
    for _, mz, rt, i in sorted((r for r in rows if r[0] == "a" and r[3] > 0.1 * top), key=lambda r: -r[3]):
        if not any(abs(mz - k[0]) <= k[0] * 2e-5 and abs(rt - k[1]) <= 0.5 for k in kept):
            kept.append((mz, rt, i))
    assert sorted((r.mz, r.rt, r.persistence) for r in got.collect() if r.s == "a") == sorted(kept)
    assert got.where("s = 'b'").count() == 1


def test_peaks_that_follow_their_feature(spark):
    shape = {200.0: lambda k: 100 - 9 * abs(k - 10), 201.0: lambda k: 30 - 2.5 * abs(k - 10), 350.0: lambda k: 5.0 + (k * 7) % 11, 400.0: lambda k: 150 - 13.5 * abs(k - 10)}
    points = [("s", k, mz * (1 + 1e-6 * (k % 2)) if k != 10 else mz, float(max(f(k), 0))) for k in range(21) for mz, f in shape.items() if f(k) > 0]
    make = spark.createDataFrame
    scans = make([("s", k, k / 10) for k in range(21)], "sample string, scan int, rt double")
    found = make([("s", 1, 200.0, 1.0, 10, 0.2, 1.8), ("s", 2, 400.0, 1.0, 10, 0.2, 1.8), ("s", 3, 350.0, 1.0, 10, None, None)], "sample string, mf_id long, mz double, rt double, apex_scan int, start_rt double, final_rt double")
    got = workflow.deconvoluted(found, make(points, "sample string, scan int, mz double, intensity double"), scans).collect()
    assert {(r.mf_id, r.mz, r.is_parent) for r in got} == {(1, 200.0, False), (1, 201.0, False), (1, 400.0, False), (2, 200.0, True), (2, 201.0, True), (2, 400.0, True)}
    for r in got:
        a, b = ([shape[m](k) for k in range(2, 19)] for m in ({1: 200.0, 2: 400.0}[r.mf_id], r.mz))
        x, y = sum(a) / 17, sum(b) / 17
        want = sum((p - x) * (q - y) for p, q in zip(a, b)) / math.sqrt(sum((p - x) ** 2 for p in a) * sum((q - y) ** 2 for q in b))
        assert r.correlation == pytest.approx(want)


def test_small_pieces(spark):
    df = spark.createDataFrame([(1, 100.0, 1.0), (1, 300.0, 3.0), (1, 320.0, 3.0), (1, 900.0, 0.1)], "scan int, mz double, abundance double")
    assert sorted(r.mz for r in spectrum.noise_region(df, ["scan"]).collect()) == [300.0, 320.0]
    random.seed(2)
    at, rows = 1e5, []
    for _ in range(4000):
        at += random.gauss(12.0, 1.5) if random.random() < 0.8 else random.uniform(60, 300)
        rows.append((1, at))
    (r,) = calibration.magnetron_frequency(spark.createDataFrame(rows, "scan int, frequency double"), ["scan"]).collect()
    assert r.magnetron_frequency == pytest.approx(12.0, abs=0.3)
    (doc,) = sinks.spectrum_json(df, ["scan"], ["mz", "abundance"], {"method": "log"}).collect()
    got = json.loads(doc.document)
    assert got["scan"] == 1 and got["settings"] == {"method": "log"} and got["peaks"][0] == {"mz": 100.0, "abundance": 1.0} and len(got["peaks"]) == 4


def test_calibration_only_where_the_error_falls(spark):
    f = [1e5 * k for k in (1.0, 1.3, 1.7, 2.1)]
    rows = [("a", 1e8 / x * (1 + 5e-6), x, 1e8 / x + 1e3 / x) for x in f] + [("b", 1e8 / x, x, 1e8 / x) for x in f]
    points = spark.createDataFrame(rows, "s string, mz double, frequency double, mz_calc double")
    got = calibration.frequency_recalibrated(points, points, ["s"], "linear").collect()
    assert all(r.mz_cal == pytest.approx(r.mz_calc, rel=1e-9) for r in got)
