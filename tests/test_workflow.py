"""An LC-MS run from points to its report."""

import math

import pytest
from pyspark.sql import functions as F

from massweave.functions.chem import ELECTRON, MONO
from massweave.operators import fragment_index, search, workflow


def mz_of(c, h, o):
    return c * MONO["C"] + h * MONO["H"] + o * MONO["O"] + MONO["H"] - ELECTRON


SUGAR, ACID, OTHER = mz_of(6, 12, 6), mz_of(16, 32, 2), 333.3333


@pytest.fixture(scope="module")
def run(spark):
    scans = [(s, k, k / 10) for s in ("a", "b") for k in range(60)]
    points = []
    for s, _, _ in scans[::60]:
        for mz, at, height in ((SUGAR, 20, 900.0), (ACID, 40, 400.0), (OTHER, 20, 300.0)):
            points += [(s, k, mz, height * math.exp(-(((k - at) / 3) ** 2) / 2)) for k in range(60) if abs(k - at) <= 9 and not (s == "b" and mz == OTHER)]
    ms2 = [("a", 100, 2.05, SUGAR), ("a", 101, 1.95, SUGAR + 0.001), ("a", 102, 4.0, ACID), ("b", 100, 5.5, SUGAR)]
    fragments = {SUGAR: [(85.03, 50.0), (127.04, 80.0), (145.05, 100.0)], ACID: [(57.07, 30.0), (71.09, 60.0)]}
    ms2_points = [(s, k, m, i) for s, k, _, p in ms2 for m, i in fragments[SUGAR if abs(p - SUGAR) < 0.1 else ACID]]
    library = [("r1", "m1", "glucose", "C6 H12 O6", "protonated", SUGAR, fragments[SUGAR]), ("r2", "m1", "glucose", "C6 H12 O6", "protonated", SUGAR, [(85.03, 50.0), (200.0, 50.0)]), ("r3", "m2", "other sugar", "C6 H12 O6", "protonated", SUGAR, [(127.04, 80.0), (145.05, 90.0)]), ("r4", "m3", "far", "C9 H9 O1", "protonated", 700.0, fragments[ACID])]
    make = spark.createDataFrame
    return {
        "points": make(points, "sample string, scan int, mz double, intensity double"), "scans": make(scans, "sample string, scan int, rt double"),
        "ms2": make(ms2, "sample string, scan int, rt double, precursor_mz double"), "ms2_points": make(ms2_points, "sample string, scan int, mz double, intensity double"),
        "library": make([x[:5] for x in library], "ref string, ref_mol_id string, name string, formula string, ion_type string"),
        "spectra": make([(r, p, m, i) for r, *_, p, own in library for m, i in own], "ref string, precursor_mz double, mz double, intensity double"),
    }


def test_from_points_to_a_report(spark, run):
    found = workflow.features(run["points"], run["scans"], 0.01, 0.05, radius=(0, 0))
    assert sorted((r["sample"], r.mf_id, round(r.mz, 4), r.rt, r.apex_scan) for r in found.collect()) == [("a", 0, round(SUGAR, 4), 2.0, 20), ("a", 1, round(ACID, 4), 4.0, 40), ("a", 2, OTHER, 2.0, 20), ("b", 0, round(SUGAR, 4), 2.0, 20), ("b", 1, round(ACID, 4), 4.0, 40)]
    whole = workflow.integrated(found, run["points"], run["scans"])
    for r in whole.collect():
        height = {0: 900, 1: 400, 2: 300}[r.mf_id]
        assert r.area == pytest.approx(height * 0.3 * math.sqrt(2 * math.pi), rel=0.01) and r.half_height_width == pytest.approx(2.3548 * 0.3, rel=0.03) and r.start_rt < r.rt < r.final_rt
    forms = search.candidates(spark, [("C", 1, 18), ("H", 4, 40), ("O", 0, 8)], (100.0, 400.0), (0.0, 12.0))
    ms1 = workflow.ms1_annotations(whole, forms, [("protonated", None)], 1, (-2.0, 2.0))
    hits = workflow.ms2_annotations(whole, run["ms2"], run["ms2_points"], fragment_index.build(run["spectra"]))
    assert sorted({(r["sample"], r.mf_id, r.scan) for r in hits.collect()}) == [("a", 0, 100), ("a", 0, 101)]
    out = workflow.annotated_report(whole, ms1, workflow.ms2_summary(hits, run["library"])).where("annotation = 1 or name is not null").orderBy("sample", "mf_id", "annotation").collect()
    assert [(r["sample"], r.mf_id, r.ms1_formula, r.name, r.n_spectra) for r in out] == [("a", 0, "C6 H12 O6", "glucose", 2), ("a", 0, "C6 H12 O6", "other sugar", 2), ("a", 1, "C16 H32 O2", None, None), ("a", 2, None, None, None), ("b", 0, "C6 H12 O6", None, None), ("b", 1, "C16 H32 O2", None, None)]
    assert out[0].entropy_similarity == pytest.approx(1.0) and out[0].ref == "r1"
    bare = workflow.annotated_report(whole).collect()
    assert len(bare) == 5 and all(r.annotation == 1 for r in bare)


def test_features_without_a_peak(spark, run):
    found = workflow.features(run["points"], run["scans"], 0.01, 0.05, radius=(0, 0))
    odd = found.limit(1).withColumns({"mf_id": F.lit(9).cast("long"), "mz": F.lit(50.0)})
    assert workflow.integrated(odd, run["points"], run["scans"]).count() == 0
    (kept,) = workflow.integrated(odd, run["points"], run["scans"], drop_if_fail=False).collect()
    assert kept.area is None and kept.mf_id == 9


def test_shapes_of_peaks(spark):
    random = __import__("random")
    random.seed(5)
    traces, rows, bounds = {}, [], []
    for k in range(25):
        at, width, skew = random.uniform(15, 35), random.uniform(2, 5), random.uniform(0.7, 1.6)
        ys = [round(100 * math.exp(-(((i - at) / (width * (skew if i > at else 1))) ** 2) / 2) + random.random() * 2, 3) for i in range(50)]
        a, b = max(0, int(at - 2.6 * width)), min(49, int(at + random.choice([1.0, 3.5]) * width * skew))
        traces[k] = (ys, a, b)
        rows += [("s", k, i, i * 0.1, y) for i, y in enumerate(ys)]
        bounds.append(("s", k, a * 0.1, b * 0.1))
    eic = spark.createDataFrame(rows, "sample string, mf_id long, scan int, rt double, intensity double").repartition(3)
    whole = spark.createDataFrame([*bounds, ("s", 99, None, None)], "sample string, mf_id long, start_rt double, final_rt double")
    for accept in (False, True):
        got = {r.mf_id: r for r in workflow.peak_shapes(whole, eic, accept).collect()}
        assert set(got) == set(traces)
        for k, (ys, a, b) in traces.items():
            apex = max(range(a, b + 1), key=lambda i: (ys[i], -i))

            def ends(share):
                left = right = apex
                while ys[left] > ys[apex] * share and left > 0:
                    left -= 1
                while ys[right] > ys[apex] * share and right < len(ys) - 1:
                    right += 1
                return max(left, a), min(right, b), left < a or right > b, left

            left, right, cut, _ = ends(0.5)
            if cut and not accept:
                assert got[k].half_height_max is None
            else:
                assert got[k].half_height_max == pytest.approx((right - left) * 0.1) and got[k].half_height_min == pytest.approx((right - left - 2) * 0.1)
            left, right, cut, outer = ends(0.05)
            if cut and not accept:
                assert got[k].tailing_factor is None
            else:
                assert got[k].tailing_factor == pytest.approx((right - left - 1) * 0.1 / (2 * (apex - outer - 0.5) * 0.1))
            assert got[k].gaussian_similarity is not None and 0.8 < got[k].gaussian_similarity <= 1
