"""ASCII PLY as a data source of Spark: spark.read.format("ply").load(path), df.write.format("ply").save(path).

    spark.dataSource.register(PlySource)

Reading cuts the body of each file into ranges of bytes; a range has the lines that begin in it, so a large cloud is read by many
tasks. pid is the number of the vertex, which takes the number of lines in the ranges before. Clouds that were written here say
how many each part has, in comments of the header; for other files, and parts larger than a range, the driver counts line
ends. Writing gives a part for each task; the commit puts the header before the first and moves the parts of this write
into place, so that a write that failed, or a task that ran twice, leaves nothing.

Files are reached by a path that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SHAPE = "pid long, x double, y double, z double, r int, g int, b int"
RANGE_BYTES = 64 << 20
COLOURS = {"r": ("red", "r"), "g": ("green", "g"), "b": ("blue", "b")}


def plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class Header:
    """names: of the vertex properties; count: of vertices; body: where they begin, in bytes; parts: vertices by file name."""

    names: list[str]
    count: int
    body: int
    parts: dict[str, int]


def header_of(path: str) -> Header:
    names, count, element, parts = [], None, None, {}
    with open(path, "rb") as file:
        for raw in iter(file.readline, b""):
            words = raw.decode("ascii", "replace").split()
            if words[:1] == ["format"] and words[1:2] != ["ascii"]:
                raise ValueError(f"{path}: only ASCII PLY is read")
            if words[:2] == ["comment", "part"] and len(words) == 4:
                parts[words[2]] = int(words[3])
            if words[:1] == ["element"]:
                element = words[1]
                count = int(words[2]) if element == "vertex" else count
            elif words[:1] == ["property"] and element == "vertex":
                names.append(words[-1])
            elif words == ["end_header"]:
                if count is None or not {"x", "y", "z"} <= set(names):
                    raise ValueError(f"{path}: no vertices with x, y and z")
                return Header(names, count, file.tell(), parts)
    raise ValueError(f"{path}: no end of the header")


def lines_in(path: str, low: int, high: int) -> Iterator[bytes]:
    """The lines that begin in [low, high); low itself is the beginning of one only if it stands behind a line's end."""
    with open(path, "rb") as file:
        file.seek(max(low - 1, 0))
        if low and file.read(1) != b"\n":
            file.readline()
        while file.tell() < high and (line := file.readline()):
            if line.strip():
                yield line


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int
    first: int
    names: list[str]
    most: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        """Ranges of the files."""
        files = sorted(str(p) for p in Path(self.path).iterdir() if p.name[0] not in "._") if os.path.isdir(self.path) else [self.path]
        out, first, head = [], 0, None
        for path in files:
            begin = 0
            if head is None:
                head = header_of(path)
                begin = head.body
            end = os.path.getsize(path)
            for low in range(begin, end, self.size):
                high = min(low + self.size, end)
                out.append(Range(path, low, high, first, head.names, head.count))
                told = head.parts.get(os.path.basename(path)) if not begin and high == end and not low else None
                first += sum(1 for _ in lines_in(path, low, high)) if told is None else told
        if head is not None and first < head.count:
            raise ValueError(f"{self.path}: {first} of {head.count} vertices")
        return out or [Range(self.path, 0, 0, 0, ["x", "y", "z"], 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        at = {c: next((part.names.index(n) for n in names if n in part.names), None) for c, names in ({c: (c,) for c in "xyz"} | COLOURS).items()}
        pid, rows = part.first, []

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([r[0] for r in rows], pa.int64())]
            for c, k in at.items():
                kind = pa.float64() if c in "xyz" else pa.int32()
                arrays.append(pa.nulls(len(rows), kind) if k is None else pa.array([(float if c in "xyz" else int)(r[1][k]) for r in rows], kind))
            return pa.RecordBatch.from_arrays(arrays, ["pid", *at])

        for line in lines_in(part.path, part.low, part.high):
            if pid >= part.most:  # faces follow the vertices
                break
            values = line.split()
            if len(values) < len(part.names):
                raise ValueError(f"{part.path}: vertex {pid} has {len(values)} of {len(part.names)} values")
            rows.append((pid, values))
            pid += 1
            if len(rows) == 10_000:
                yield batch()
                rows = []
        if rows:
            yield batch()


@dataclass
class Part(WriterCommitMessage):
    path: str
    least: int
    count: int


class PlyWriter(DataSourceWriter):
    """Parts are put in the order of their smallest pid; a table that was sorted or dealt by ranges of pid gives a sorted file."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        self.own = f"{path.rstrip('/')}/.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Part:
        os.makedirs(self.own, exist_ok=True)
        path, count, least = f"{self.own}/{uuid.uuid4().hex}", 0, 1 << 62
        coloured = "r" in self.names
        with open(path, "w", encoding="ascii") as file:
            for row in rows:
                file.write(f"{row['x']:.6f} {row['y']:.6f} {row['z']:.6f}" + (f" {row['r']} {row['g']} {row['b']}" if coloured else "") + "\n")
                count, least = count + 1, min(least, row["pid"])
        return Part(path, least, count)

    def commit(self, parts: list[Part | None]) -> None:
        done = sorted((p for p in parts if p is not None and p.count), key=lambda p: p.least)
        os.makedirs(self.own, exist_ok=True)
        kinds = [f"property float {c}" for c in "xyz"] + ([f"property uchar {n}" for n in ("red", "green", "blue")] if "r" in self.names else [])
        counts = [f"comment part part-{k:06d}.ply {p.count}" for k, p in enumerate(done, 1)]
        head = ["ply", "format ascii 1.0", *counts, f"element vertex {sum(p.count for p in done)}", *kinds, "end_header"]
        old = [p for p in Path(self.path).iterdir() if p.name.startswith("part-")]
        if old and not self.overwrite:
            raise ValueError(f"{self.path} has a cloud already; only mode overwrite replaces it")
        for p in old:
            p.unlink()
        with open(f"{self.own}/head", "w", encoding="ascii") as file:
            file.write("\n".join(head) + "\n")
        for k, path in enumerate([f"{self.own}/head", *(p.path for p in done)]):
            os.replace(path, f"{self.path}/part-{k:06d}.ply")
        shutil.rmtree(self.own, ignore_errors=True)

    def abort(self, parts: list[Part | None]) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


class PlySource(DataSource):
    """Options: path; range_bytes, the size of a range to read."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(plain(self.options["path"]), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        missing = {"pid", "x", "y", "z"} - set(schema.names)
        if missing:
            raise ValueError(f"a cloud needs the columns {sorted(missing)}")
        return PlyWriter(plain(self.options["path"]), schema.names, overwrite)
