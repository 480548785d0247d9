"""Binary files as partitioned tables: raw transients of fixed length and netCDF mass spectra (the classic ANDI layout).

Both are Python data sources: the files are listed once, cut by byte ranges, and every task opens its file, reads its range
only and returns Arrow batches. Paths are what pyarrow's file systems open, a file or a folder. Register them with
``register(spark)`` and read them with ``spark.read.format("transients")`` or ``spark.read.format("andi")``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that one task reads, about, unless the option ``split`` says otherwise.
SPLIT = 32 << 20
#: Numbers of a netCDF file by their code (fixed values of the format): big-endian.
TYPES = {1: "b", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
TRANSIENT = "sample string, scan long, signal array<double>"
POINTS = "sample string, scan long, rt double, mz double, intensity double"


def files(path: str, end: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file, or those of a folder whose names end so, in order."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, sorted((x for x in found if x.type == fs.FileType.File and x.path.lower().endswith(end.lower())), key=lambda x: x.path)


@dataclass
class Piece(InputPartition):
    """Items ``first`` up to ``end`` of a file."""

    path: str
    first: int
    end: int
    about: dict = field(default_factory=dict)


class TransientReader(DataSourceReader):
    """Records of ``points`` numbers of a NumPy kind, after ``skip`` bytes; what is left at the end of a file is no record."""

    def __init__(self, options: dict) -> None:
        self.path, self.end = options["path"], options.get("suffix", "")
        self.points, self.kind, self.skip = int(options["points"]), np.dtype(options.get("kind", "<i4")), int(options.get("skip", 0))
        self.split = int(options.get("split", SPLIT))
        self.size = self.points * self.kind.itemsize
        if self.points < 1:
            raise ValueError("a transient has points")

    def partitions(self) -> list[Piece]:
        _, found = files(self.path, self.end)
        step = max(1, self.split // self.size)
        return [Piece(x.path, k, min(k + step, n)) for x in found for n in [max(0, x.size - self.skip) // self.size] for k in range(0, n, step)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = files(self.path, self.end)
        with system.open_input_file(piece.path) as f:
            f.seek(self.skip + piece.first * self.size)
            for k in range(piece.first, piece.end):
                signal = np.frombuffer(f.read(self.size), self.kind).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([piece.path]), pa.array([k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(signal)], pa.int32()), pa.array(signal))], names=["sample", "scan", "signal"])


class Header:
    """Variables of a classic netCDF file: (type, dimensions, attributes, where they begin) by name."""

    def __init__(self, f) -> None:
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a classic netCDF file")
        self.offset = ">i" if magic[3] == 1 else ">q"
        self.records = self.number()
        self.dimensions = [(self.text(), self.number()) for _ in range(self.listed())]
        self.attributes()
        self.variables = {}
        sizes = []
        for _ in range(self.listed()):
            name = self.text()
            at = [self.number() for _ in range(self.number())]
            own, kind, size = self.attributes(), self.number(), self.number()
            (begin,) = struct.unpack(self.offset, f.read(struct.calcsize(self.offset)))
            by_record = bool(at) and self.dimensions[at[0]][1] == 0
            if by_record:
                sizes.append((size, np.dtype(TYPES[kind]).itemsize * int(np.prod([self.dimensions[d][1] for d in at[1:]], dtype=np.int64))))
            length = self.records if by_record else self.dimensions[at[0]][1] if at else 1
            self.variables[name] = {"kind": TYPES[kind], "length": length, "begin": begin, "by_record": by_record, "attributes": own}
        # Records hold one item of each such variable, padded to four bytes unless there is only one.
        self.record_size = sizes[0][1] if len(sizes) == 1 else sum(s for s, _ in sizes)

    def number(self) -> int:
        return struct.unpack(">i", self.f.read(4))[0]

    def listed(self) -> int:
        _, n = self.number(), self.number()
        return n

    def padded(self, n: int) -> bytes:
        return self.f.read(n + -n % 4)[:n]

    def text(self) -> str:
        return self.padded(self.number()).decode("latin-1")

    def attributes(self) -> dict[str, np.ndarray]:
        out = {}
        for _ in range(self.listed()):
            name, kind, n = self.text(), self.number(), self.number()
            kind = np.dtype(TYPES[kind])
            out[name] = np.frombuffer(self.padded(n * kind.itemsize), kind)
        return out

    def values(self, f, name: str, first: int, end: int) -> np.ndarray:
        """Items of a variable, scaled as its attributes say; nothing else of it is read."""
        v, kind = self.variables[name], np.dtype(self.variables[name]["kind"])
        step = self.record_size if v["by_record"] else kind.itemsize
        f.seek(v["begin"] + first * step)
        data = f.read((end - first) * step)
        out = np.ndarray((end - first,), kind, data, strides=(step,)).astype(float) if end > first else np.empty(0)
        own = v["attributes"]
        return out * float(own.get("scale_factor", [1.0])[0]) + float(own.get("add_offset", [0.0])[0])


class AndiReader(DataSourceReader):
    """Points of the scans of ANDI files: a task gets whole scans of about ``split`` bytes together."""

    def __init__(self, options: dict) -> None:
        self.path, self.end, self.split = options["path"], options.get("suffix", ".cdf"), int(options.get("split", SPLIT))

    def partitions(self) -> list[Piece]:
        system, found = files(self.path, self.end)
        out = []
        for x in found:
            with system.open_input_file(x.path) as f:
                header = Header(f)
                n = header.variables["scan_index"]["length"]
                starts = header.values(f, "scan_index", 0, n).astype(np.int64)
                points = header.variables["mass_values"]["length"]
            each = sum(header.record_size if v["by_record"] else np.dtype(v["kind"]).itemsize for v in (header.variables["mass_values"], header.variables["intensity_values"]))
            # The first scan of every so many bytes begins a piece.
            cuts = np.unique(np.searchsorted(starts, np.arange(0, max(points, 1), max(1, self.split // each))))
            out += [Piece(x.path, int(a), int(b)) for a, b in pairwise([*cuts.tolist(), n]) if b > a]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = files(self.path, self.end)
        with system.open_input_file(piece.path) as f:
            header = Header(f)
            ends = min(piece.end + 1, header.variables["scan_index"]["length"])
            starts = header.values(f, "scan_index", piece.first, ends).astype(np.int64)
            if ends == piece.end:
                starts = np.append(starts, header.variables["mass_values"]["length"])
            times = header.values(f, "scan_acquisition_time", piece.first, piece.end) / 60
            for k, (a, b) in enumerate(pairwise(starts.tolist())):
                mz, intensity = header.values(f, "mass_values", a, b), header.values(f, "intensity_values", a, b)
                n = len(mz)
                yield pa.RecordBatch.from_arrays([pa.array([piece.path] * n, pa.string()), pa.array(np.full(n, piece.first + k, np.int64)), pa.array(np.full(n, times[k])), pa.array(mz), pa.array(intensity)], names=["sample", "scan", "rt", "mz", "intensity"])


class Transients(DataSource):
    """Options: path, points, kind (``<i4``), skip, suffix, split. Columns: sample (the file), scan, signal."""

    @classmethod
    def name(cls) -> str:
        return "transients"

    def schema(self) -> str:
        return TRANSIENT

    def reader(self, schema) -> TransientReader:
        return TransientReader(self.options)


class Andi(DataSource):
    """Options: path, suffix, split. Columns: sample (the file), scan, rt (minutes), mz, intensity."""

    @classmethod
    def name(cls) -> str:
        return "andi"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> AndiReader:
        return AndiReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (Transients, Andi):
        spark.dataSource.register(source)
