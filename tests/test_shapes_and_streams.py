"""Line shapes, transforms, Ward clusters, spectrum files and streams."""

import base64
import math
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from massweave.functions import lineshape, similarity
from massweave.operators import gc, suppress
from massweave.sources import text
from massweave.streaming import eic


def test_shapes_have_their_height_and_width(spark):
    c, w, h = F.lit(500.0), F.lit(0.01), F.lit(8.0)
    for shape in (lineshape.gaussian, lineshape.lorentzian, lineshape.pseudo_voigt):
        top, half, other = spark.range(1).select(*[shape(F.lit(x), c, w, h) for x in (500.0, 500.005, 499.995)]).first()
        assert top == 8 and abs(half - 4) < 1e-6 and abs(other - 4) < 1e-6
    points = spark.range(1).select(lineshape.profile(c, w, h).alias("p")).first().p
    assert len(points) == 17 and abs(points[8].mz - 500) < 1e-12 and abs(points[0].mz - 499.98) < 1e-9


def test_transforms_of_arrays(spark):
    rng = random.Random(1)
    root = math.sqrt(3)
    taps = np.array([-(1 + root), 3 + root, root - 3, 1 - root]) / (4 * math.sqrt(2))
    for n in (1, 2, 3, 5, 8):
        x = [rng.random() for _ in range(n)]
        d, f = spark.createDataFrame([(x,)], "x array<double>").select(similarity.detail(F.col("x")), similarity.fourier(F.col("x"))).first()
        padded = np.pad(x, 4, mode="symmetric")
        assert np.allclose(d, [sum(taps[k] * padded[4 + 2 * i + 1 - k] for k in range(4)) for i in range((n + 3) // 2)])
        assert np.allclose(f, [sum(v * math.cos(2 * math.pi * i * k / n) for k, v in enumerate(x)) for i in range(n // 2 + 1)])


def test_transformed_spectra(spark):
    rows = [("same", m, a, a) for m, a in ((10.0, 1.0), (20.0, 3.0), (30.0, 0.5))] + [("apart", 10.0, 1.0, 0.0), ("apart", 20.0, 0.0, 2.0)]
    got = {r.id: r for r in similarity.transformed(spark.createDataFrame(rows, "id string, mz double, v double, y double"), ["id"]).collect()}
    assert abs(got["same"].dft_correlation - 1) < 1e-12 and abs(got["same"].dwt_correlation - 1) < 1e-12
    assert got["apart"].dft_correlation == 0 and got["apart"].dwt_correlation == 0


def plain_ward(values: list[float], limit: float) -> set[frozenset]:
    groups = [[v] for v in values]
    while len(groups) > 1:
        pairs = [(math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * abs(np.mean(a) - np.mean(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        d, i, j = min(pairs)
        if d > limit:
            break
        groups[i] = groups[i] + groups.pop(j)
    return {frozenset(g) for g in groups}


def test_ward_is_the_plain_linkage(spark):
    rng = random.Random(7)
    for limit in (0.02, 0.3, 5.0):
        values = [rng.random() * 4 for _ in range(40)]
        df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None)], "k string, x double")
        groups: dict = {}
        for r in suppress.ward(df, ["k"], "x", limit).collect():
            groups.setdefault((r.k, r.cluster), []).append(r.x)
        assert {frozenset(g) for (k, _), g in groups.items() if k == "a"} == plain_ward(values, limit)
        assert [g for (k, _), g in groups.items() if k == "b"] == [[1.0]]
    assert suppress.ward(df.limit(0), ["k"], "x", 1.0).count() == 0


def test_mzml(spark, tmp_path):
    def array(values, kind, code, packed):
        raw = struct.pack(f"<{len(values)}{code}", *values)
        params = f'<cvParam accession="{text.CV[kind]}"/>' + f'<cvParam accession="{text.CV["float64"]}"/>' * (code == "d") + f'<cvParam accession="{text.CV["zlib"]}"/>' * packed
        return f"<binaryDataArray>{params}<binary>{base64.b64encode(zlib.compress(raw) if packed else raw).decode()}</binary></binaryDataArray>"

    def spectrum(scan, seconds, level):
        head = f'<cvParam accession="{text.CV["ms_level"]}" value="{level}"/><cvParam accession="{text.CV["positive"]}"/><cvParam accession="{text.CV["time"]}" value="{seconds}" unitName="second"/>'
        return f'<spectrum index="0" id="controllerType=0 scan={scan}">{head}{array([100.5, 200.25], "mz_array", "d", True)}{array([5.0, 0.0], "intensity_array", "f", False)}</spectrum>'

    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList count="2">{spectrum(1, 60, 1)}{spectrum(2, 90, 2)}</spectrumList></run></mzML>')
    spectra = text.read_mzml(spark, str(tmp_path / "a.mzML"))
    got = {r.scan: r for r in spectra.collect()}
    assert set(got) == {1, 2} and got[1].rt == 1.0 and got[2].rt == 1.5 and got[2].ms_level == 2 and got[1].polarity == "positive"
    assert got[1].mz == [100.5, 200.25] and got[1].intensity == [5.0, 0.0]
    assert [(r.scan, r.mz) for r in text.points(spectra, 1).collect()] == [(1, 100.5)]


def test_peak_and_scan_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<root><ms_peaks><pk a="1.5" fwhm="0.01" i="9" mz="301.2" res="30000" sn="12"/><pk a="2" i="4" mz="302.2" res="29000" sn="6"/></ms_peaks></root>')
    got = text.read_peak_xml(spark, str(tmp_path / "p.xml")).orderBy("mz").collect()
    assert [(r.mz, r.abundance, r.s2n, r.fwhm) for r in got] == [(301.2, 9.0, 12.0, 0.01), (302.2, 4.0, 6.0, None)]
    (tmp_path / "s.xml").write_text("<scans><scan><count>3</count><minutes>0.5</minutes><tic>7</tic><maxpeak>4</maxpeak></scan></scans>")
    assert tuple(text.read_scan_xml(spark, str(tmp_path / "s.xml")).first()) == (3, 0.5, 7.0, 4.0)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:01", 1.0), ("a", "2024-01-01 00:00:05", 4.0), ("a", "2024-01-01 00:01:00", 2.0), ("b", "2024-01-01 00:00:02", 3.0), ("z", "2024-01-01 01:00:00", 0.0)], "k string, t string, intensity double")
    rows.withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))

    def run(name, df):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    source = lambda: spark.readStream.schema("k string, t timestamp, intensity double").parquet(str(tmp_path / "in"))
    got = {(r.k, r.start.minute): (r.intensity, r.n) for r in run("windows", eic.windowed_intensity(source(), "t", "1 minute", "10 seconds", ["k"])) if r.k != "z"}
    assert got == {("a", 0): (5.0, 2), ("a", 1): (2.0, 1), ("b", 0): (3.0, 1)}
    got = sorted((r.k, r.intensity, r.apex, r.n) for r in run("features", eic.sessions(source(), "t", "10 seconds", "10 seconds", ["k"])) if r.k != "z")
    assert got == [("a", 2.0, 2.0, 1), ("a", 5.0, 4.0, 2), ("b", 3.0, 3.0, 1)]


def test_gc_entities_and_scores(spark):
    peaks = spark.createDataFrame([("s", 41.0, 5.000, 2.0), ("s", 57.0, 5.005, 9.0), ("s", 41.0, 5.200, 4.0)], "sample string, mz double, apex_rt double, intensity double")
    got = sorted((r.rt, r.tic, len(r.spectrum)) for r in gc.entities(peaks).collect())
    assert got == [(5.005, 11.0, 2), (5.2, 4.0, 1)]
    found = spark.createDataFrame([(1, 801.0, 5.0), (2, 990.0, 9.0)], "peak_id long, ri double, rt double")
    library = spark.createDataFrame([(7, "x", 800.0, 5.0)], "compound long, name string, ri double, rt double")
    hits = gc.library_hits(found, library)
    spectra = spark.createDataFrame([(1, 41.0, 3.0), (1, 57.0, 4.0)], "peak_id long, mz double, intensity double")
    rated = gc.scored(hits, spectra, spark.createDataFrame([(7, 41.0, 3.0), (7, 57.0, 4.0)], "compound long, mz double, intensity double"))
    (row,) = gc.best_hits(rated).collect()
    assert row.peak_id == 1 and abs(row.cosine - 1) < 1e-12 and abs(row.score - math.exp(-1 / 18) ** (1 / 3)) < 1e-12
    assert tuple(gc.statistics(found, rated).first()) == (2, 1, 1, 1, 1)
