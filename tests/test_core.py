"""Closed-form values, brute-force comparisons and round trips of the reference operators."""

import math

import pytest
from pyspark.sql import functions as F

from massweave import config
from massweave.functions import formula as fm
from massweave.functions import similarity as sim
from massweave.operators import joins, search, suppress
from massweave.sources import text


def test_settings_round_trip():
    settings = config.Settings()
    assert config.from_json(config.to_json(settings)) == settings
    with pytest.raises(KeyError):
        config.from_json('{"gas": {"nothing": 1}}')


def test_formula_values(spark):
    rows = spark.createDataFrame([("C10 O10 Cl2",), ("C6 H12 O6",), ("not a formula",), (None,)], "t string").select(fm.parse(F.col("t")).alias("a"))
    got = rows.select(fm.text(F.col("a")).alias("t"), fm.mz(fm.neutral_mass(F.col("a")), F.lit(-1), F.lit("radical")).alias("mz"), fm.class_label(F.col("a"), F.lit("radical")).alias("c"), fm.dbe(F.col("a")).alias("dbe")).collect()
    assert got[0].t == "C10 O10 Cl2" and got[0].c == "O10 Cl2 -R" and abs(got[0].mz - 349.886303) < 1e-2
    assert got[1].t == "C6 H12 O6" and got[1].dbe == 1.0
    km, kmd, nominal = fm.kendrick(F.lit(212.1234))
    k = spark.range(1).select(km.alias("km"), kmd.alias("kmd"), nominal.alias("n")).first()
    assert round(k.km, 3) == 211.887 and k.n == 211 and math.ceil(k.kmd * 100) == -88


def test_chlorine_isotopologue():
    rows = {tuple(sorted(a.items())): r for a, r, _ in search.isotopologue_rows({"C": 10, "O": 10, "Cl": 2}, 0.1)}
    assert abs(rows[(("37Cl", 1), ("C", 10), ("Cl", 1), ("O", 10))] - 0.63993) < 1e-3


def test_band_join_is_the_nested_loop(spark):
    a = spark.createDataFrame([(i, 100 + i * 0.37) for i in range(60)], "i long, x double")
    b = spark.createDataFrame([(i, 100 + i * 0.41) for i in range(60)], "j long, y double")
    for tolerance, ppm in ((0.25, False), (900.0, True)):
        got = {(r.i, r.j) for r in joins.band_join(a, b, "x", "y", tolerance, ppm=ppm).collect()}
        want = {(i, j) for i in range(60) for j in range(60) if abs(i * 0.37 - j * 0.41) <= (tolerance if not ppm else (100 + j * 0.41) * tolerance * 1e-6)}
        assert got == want


def test_nearest_join_takes_the_upper_tie(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, 99.0)], "i long, x double")
    b = spark.createDataFrame([(4.0,), (6.0,), (90.0,)], "y double")
    assert {(r.i, r.y) for r in joins.nearest_join(a, b, "x", "y").collect()} == {(1, 6.0), (2, 4.0), (3, 90.0)}


def test_greedy_suppression(spark):
    rows = [(k, v, v2, p) for k, (v, v2, p) in enumerate([(1.0, 1.0, 5.0), (1.4, 1.0, 9.0), (1.8, 1.0, 4.0), (9.0, 1.0, 1.0), (9.1, 8.0, 2.0)])]
    df = spark.createDataFrame(rows, "id long, mz double, rt double, p double").withColumn("s", F.lit(1))
    got = {r.id for r in suppress.greedy_suppress(df, {"mz": (0.5, False), "rt": (1.0, False)}, "p", ["s"], ["id"]).collect()}
    assert got == {1, 3, 4}


def test_distances_of_equal_spectra(spark):
    a = spark.createDataFrame([(1, 10.0, 2.0), (1, 20.0, 6.0)], "pair long, mz double, intensity double")
    got = sim.distances(sim.align(a, a, ["pair"]), ["pair"], ["entropy_distance", "sorensen_distance", "dice_similarity", "fidelity_similarity"]).first()
    assert abs(got.entropy_distance) < 1e-9 and got.sorensen_distance == 0 and abs(got.dice_similarity - 1) < 1e-9 and abs(got.fidelity_similarity - 1) < 1e-9
    assert len(sim.DISTANCES) + len(sim.WEIGHTED) >= 74


def test_library_readers(spark, tmp_path):
    (tmp_path / "a.msp").write_text("Name: one\nPrecursorMZ: 100.5\nNum Peaks: 2\n10 1\n20 2\n\nName: two\nNum Peaks: 1\n5.5 7\n")
    got = {r.name: r for r in text.read_msp(spark, str(tmp_path / "a.msp")).collect()}
    assert got["one"].precursor_mz == 100.5 and [tuple(p) for p in got["one"].peaks] == [(10.0, 1.0), (20.0, 2.0)] and got["two"].precursor_mz is None
    (tmp_path / "a.msl").write_text("NAME: x\nRI: 800\nRT: 5.5\nNUM PEAKS: 2\n( 41 10) ( 42 20)\n\n")
    (row,) = text.read_msl(spark, str(tmp_path / "a.msl")).collect()
    assert (row.name, row.ri, row.rt, len(row.peaks)) == ("x", 800.0, 5.5, 2)
    (tmp_path / "a.ref").write_text("# comment\n\nC10H10 130.07 1- C10H9\n")
    assert text.read_references(spark, str(tmp_path / "a.ref")).first().mz == 130.07
    (tmp_path / "a.csv").write_text("m/z,Peak Height,C\n100.1,5,3\n")
    assert text.read_mass_list(spark, str(tmp_path / "a.csv")).first().abundance == 5.0
