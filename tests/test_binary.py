"""Generated binary files come back as rows, in several partitions."""

import struct

import numpy as np
import pytest

from massweave.operators import sequence
from massweave.sources import binary


def text(s):
    b = s.encode()
    return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)


def netcdf(path, scans, by_record, version=1):
    """scans: [(seconds, [(mz, intensity)])]; intensities are kept as shorts of a scale factor."""
    points = [p for _, own in scans for p in own]
    starts = np.cumsum([0, *[len(own) for _, own in scans]])[:-1]
    n, m = len(scans), len(points)
    dims = [("scan_number", n), ("point_number", 0 if by_record else m)]
    data = {
        "scan_index": (0, 4, np.array(starts, ">i4"), {}), "scan_acquisition_time": (0, 6, np.array([t for t, _ in scans], ">f8"), {}),
        "mass_values": (1, 5, np.array([p[0] for p in points], ">f4"), {}), "intensity_values": (1, 3, np.array([p[1] / 2 for p in points], ">i2"), {"scale_factor": 2.0}),
    }

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", m if by_record else 0) + struct.pack(">ii", 10, 2) + b"".join(text(k) + struct.pack(">i", v) for k, v in dims)
        out += struct.pack(">ii", 12, 1) + text("title") + struct.pack(">ii", 2, 5) + b"a run\0\0\0" + struct.pack(">ii", 11, len(data))
        for name, (dim, kind, values, own) in data.items():
            out += text(name) + struct.pack(">ii", 1, dim) + (struct.pack(">ii", 12, 1) + text("scale_factor") + struct.pack(">iid", 6, 1, own["scale_factor"]) if own else struct.pack(">ii", 0, 0))
            size = values.itemsize if by_record and dim else values.nbytes
            out += struct.pack(">ii", kind, size + -size % 4) + struct.pack(">i" if version == 1 else ">q", begins.get(name, 0))
        return out

    at, begins, body = len(head({})), {}, b""
    for name, (dim, _, values, _) in data.items():
        if not (by_record and dim):
            begins[name] = at + len(body)
            body += values.tobytes() + b"\0" * (-values.nbytes % 4)
    if by_record:
        begins |= {"mass_values": at + len(body), "intensity_values": at + len(body) + 4}
        body += b"".join(data["mass_values"][2][k : k + 1].tobytes() + data["intensity_values"][2][k : k + 1].tobytes() + b"\0\0" for k in range(m))
    path.write_bytes(head(begins) + body)


@pytest.mark.parametrize(("by_record", "version"), [(False, 1), (True, 1), (True, 2)])
def test_scans_of_netcdf_files(spark, tmp_path, by_record, version):
    binary.register(spark)
    scans = [(30.0 * k, [(50.0 + k + 0.5 * j, 2.0 * (j + k)) for j in range(k % 7)]) for k in range(40)]
    netcdf(tmp_path / "a.cdf", scans, by_record, version)
    netcdf(tmp_path / "b.CDF", scans[:3], by_record, version)
    (tmp_path / "other.txt").write_text("x")
    df = spark.read.format("andi").option("split", "200").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    want = sorted((name, k, t / 60, mz, i) for name, own in (("a.cdf", scans), ("b.CDF", scans[:3])) for k, (t, pts) in enumerate(own) for mz, i in pts)
    assert sorted((r["sample"].rsplit("/", 1)[1], r.scan, r.rt, r.mz, r.intensity) for r in df.collect()) == want


def test_transients_by_ranges(spark, tmp_path):
    binary.register(spark)
    wave = np.array([[round(1000 * np.cos(2 * np.pi * (40 + k) * i / 256)) for i in range(256)] for k in range(9)], "<i4")
    (tmp_path / "ser").write_bytes(b"head" + wave.tobytes() + b"rest")
    df = spark.read.format("transients").option("points", "256").option("skip", "4").option("split", "2100").load(str(tmp_path / "ser"))
    assert df.rdd.getNumPartitions() == 5
    assert {r.scan: r.signal for r in df.collect()} == {k: own.astype(float).tolist() for k, own in enumerate(wave)}
    top = sequence.transient_spectrum(df.selectExpr("sample", "cast(scan as int) scan", "signal"), 128.0).where("scan = 3").orderBy("magnitude", ascending=False).first()
    assert abs(top.frequency - 43) < 1


def test_what_is_no_such_file(spark, tmp_path):
    (tmp_path / "a.cdf").write_bytes(b"HDF5....")
    with pytest.raises(ValueError):
        binary.AndiReader({"path": str(tmp_path)}).partitions()
    with pytest.raises(FileNotFoundError):
        binary.AndiReader({"path": str(tmp_path / "none")}).partitions()
    with pytest.raises(ValueError):
        binary.TransientReader({"path": str(tmp_path), "points": "0"})
