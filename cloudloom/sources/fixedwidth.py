"""Fixed-width point files as Spark data sources: ply, las, npy1d, potree.

The driver reads headers only; each input partition is one run of records of
one file, decoded with numpy into Arrow batches.  ``point_id`` is the record
number, so it never depends on how the file was split.
"""

from __future__ import annotations

import io
import json
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .plyparts import ROWS_PER_FILE, PlyPartsWriter, listed, place

ROWS_PER_SPLIT = 2_000_000
ROWS_PER_BATCH = 100_000

# PLY scalar names and numpy codes.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2",
    "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4",
    "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
# Byte offset of the RGB triple per LAS point format.
LAS_RGB = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


@dataclass
class Layout:
    path: str
    body: int
    dtype: np.dtype
    count: int
    scale: tuple = (1.0, 1.0, 1.0)
    offset: tuple = (0.0, 0.0, 0.0)
    scan: str | None = None
    first: int = 0


@dataclass
class Run(InputPartition):
    layout: Layout
    scan_id: str
    start: int
    rows: int


def _open(path: str):
    fs, name = place(path)
    return fs.open_input_file(name)


def _list(path: str, suffix: str) -> list[str]:
    fs, name = place(path)
    info = fs.get_file_info(name)
    if info.type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(prefix + f.path for f in found if f.path.endswith(suffix))


def ply_layout(path: str) -> Layout:
    with _open(path) as f:
        head = f.read(65536)
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError(f"{path}: not a PLY file")
    body = head.index(b"\n", end) + 1
    count, fields, in_vertex, seen = None, [], False, False
    for line in head[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"] and words[1] != "binary_little_endian":
            raise ValueError(f"{path}: only binary little-endian PLY is supported")
        if words[:1] == ["element"]:
            in_vertex = words[1] == "vertex"
            if in_vertex:
                if seen:
                    raise ValueError(f"{path}: vertex element must come first")
                count = int(words[2])
            seen = True
        if words[:1] == ["property"] and in_vertex:
            if words[1] == "list":
                raise ValueError(f"{path}: vertex records must be fixed-width")
            fields.append((words[2], PLY_TYPES[words[1]]))
    dtype = np.dtype(fields)
    if count is None or not {"x", "y", "z"} <= set(dtype.names):
        raise ValueError(f"{path}: x, y and z are required")
    return Layout(path, body, dtype, count)


def las_layout(path: str) -> Layout:
    with _open(path) as f:
        head = f.read(375)
    if head[:4] != b"LASF":
        raise ValueError(f"{path}: not a LAS file")
    fmt = head[104]
    if fmt & 0x80:
        raise ValueError(f"{path}: compressed points are not supported")
    body, size = struct.unpack_from("<I", head, 96)[0], struct.unpack_from("<H", head, 105)[0]
    count = struct.unpack_from("<I", head, 107)[0]
    if head[25] >= 4 and struct.unpack_from("<H", head, 94)[0] >= 375:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    names, formats, offsets = ["X", "Y", "Z", "intensity"], ["<i4"] * 3 + ["<u2"], [0, 4, 8, 12]
    if fmt in LAS_RGB:
        names += ["red", "green", "blue"]
        formats += ["<u2"] * 3
        offsets += [LAS_RGB[fmt] + 2 * i for i in range(3)]
    dtype = np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": size})
    return Layout(path, body, dtype, count, struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155))


def npy_layout(path: str) -> Layout:
    with _open(path) as f:
        head = io.BytesIO(f.read(4096))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, _, dtype = read(head)
    if len(shape) != 1 or dtype.hasobject:
        raise ValueError(f"{path}: a one-dimensional fixed dtype array is required")
    return Layout(path, head.tell(), np.dtype([("value", dtype)]), shape[0])


def potree_layout(folder: str) -> Layout:
    with _open(os.path.join(folder, "metadata.json")) as f:
        meta = json.loads(f.read())
    if meta.get("encoding", "DEFAULT") != "DEFAULT":
        raise ValueError(f"{folder}: only DEFAULT encoding is supported")
    at, place = 0, None
    for attr in meta["attributes"]:
        if attr["name"] == "position":
            place = at
        at += int(attr["size"])
    dtype = np.dtype({"names": ["X", "Y", "Z"], "formats": ["<i4"] * 3, "offsets": [place + 4 * i for i in range(3)], "itemsize": at})
    path = os.path.join(folder, "octree.bin")
    with _open(path) as f:
        size = f.size()
    return Layout(path, 0, dtype, size // at, tuple(meta["scale"]), tuple(meta["offset"]))


class _Reader(DataSourceReader):
    def __init__(self, layouts, columns, schema, options):
        self.layouts, self.columns, self.schema = layouts, columns, schema
        self.rows = int(options.get("rowsPerSplit", ROWS_PER_SPLIT))
        self.scan = options.get("scan_id")

    def partitions(self):
        out = []
        for lay in self.layouts:
            name = self.scan or (os.path.splitext(os.path.basename(lay.path))[0] if lay.scan is None else lay.scan)
            for start in range(0, lay.count, self.rows):
                out.append(Run(lay, name, start, min(self.rows, lay.count - start)))
        return out or [Run(Layout("", 0, np.dtype("u1"), 0), "", 0, 0)]

    def read(self, part):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        lay, size = part.layout, part.layout.dtype.itemsize
        if not part.rows:
            return
        with _open(lay.path) as f:
            for at in range(part.start, part.start + part.rows, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, part.start + part.rows - at)
                f.seek(lay.body + at * size)
                raw = f.read(n * size)
                if len(raw) != n * size:
                    raise ValueError(f"{lay.path}: file ends before its declared {lay.count} records")
                rec = np.frombuffer(raw, dtype=lay.dtype)
                cols = self.columns(lay, rec)
                cols["scan_id"] = pa.array([part.scan_id] * n)
                cols["point_id"] = np.arange(lay.first + at, lay.first + at + n, dtype=np.int64)
                arrays = []
                for field in schema:
                    value = cols.get(field.name)
                    arrays.append(pa.nulls(n, field.type) if value is None else pa.array(value).cast(field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _ply_columns(lay, rec):
    pick = {"x": "x", "y": "y", "z": "z", "red": "r", "green": "g", "blue": "b", "label": "label", "class_id": "class_id", "instance_id": "instance_id"}
    out = {v: np.ascontiguousarray(rec[k]) for k, v in pick.items() if k in lay.dtype.names}
    return {k: v.astype(np.float64) if k in "xyz" else v.astype(np.int32) for k, v in out.items()}


def _scaled(lay, rec):
    return {a: rec[a.upper()].astype(np.float64) * s + o for a, s, o in zip("xyz", lay.scale, lay.offset)}


def _las_columns(lay, rec):
    out = _scaled(lay, rec)
    out["intensity"] = rec["intensity"].astype(np.float32)
    if "red" in lay.dtype.names:
        out.update({c: rec[n].astype(np.int32) for c, n in zip("rgb", ("red", "green", "blue"))})
    return out


def _npy_columns(lay, rec):
    return {"value": np.ascontiguousarray(rec["value"])}


_XYZ = "scan_id string, point_id bigint, x double, y double, z double"


class _Source(DataSource):
    suffix, columns, ddl = "", None, ""

    def schema(self):
        return self.ddl

    def layouts(self):
        raise NotImplementedError

    def reader(self, schema):
        return _Reader(self.layouts(), type(self).columns, schema, self.options)


class PlySource(_Source):
    columns = staticmethod(_ply_columns)
    ddl = _XYZ + ", r int, g int, b int, label int, class_id int, instance_id int"

    @classmethod
    def name(cls):
        return "ply"

    def layouts(self):
        path = self.options["path"]
        parts = listed(path)
        if parts is None:
            return [ply_layout(p) for p in _list(path, ".ply")]
        return list(_seated(path, parts))

    def writer(self, schema, overwrite):
        return PlyPartsWriter(self.options["path"], schema, overwrite, int(self.options.get("rowsPerFile", ROWS_PER_FILE)))


def _seated(folder: str, parts: list[dict]):
    """Layouts of a written folder; records are numbered per scan over its files in order."""
    before: dict[str, int] = {}
    for part in parts:
        lay = ply_layout(os.path.join(folder, part["file"]))
        if lay.count != part["rows"]:
            raise ValueError(f"{lay.path}: {lay.count} records, {part['rows']} in the index")
        lay.scan, lay.first = part["scan"], before.get(part["scan"], 0)
        before[part["scan"]] = lay.first + lay.count
        yield lay


class LasSource(_Source):
    columns = staticmethod(_las_columns)
    ddl = _XYZ + ", r int, g int, b int, intensity float"

    @classmethod
    def name(cls):
        return "las"

    def layouts(self):
        return [las_layout(p) for p in _list(self.options["path"], ".las")]


class NpySource(_Source):
    columns = staticmethod(_npy_columns)

    @classmethod
    def name(cls):
        return "npy1d"

    def schema(self):
        kind = self.layouts()[0].dtype["value"].kind
        return f"scan_id string, point_id bigint, value {'double' if kind == 'f' else 'bigint'}"

    def layouts(self):
        return [npy_layout(p) for p in _list(self.options["path"], ".npy")]


class PotreeSource(_Source):
    columns = staticmethod(_scaled)
    ddl = _XYZ

    @classmethod
    def name(cls):
        return "potree"

    def layouts(self):
        return [potree_layout(self.options["path"])]


def register(spark: SparkSession) -> None:
    for source in (PlySource, LasSource, NpySource, PotreeSource):
        spark.dataSource.register(source)


def ply_vertex_count(path: str) -> int:
    """Header-only count."""
    return ply_layout(path).count


def read_labels_npy(spark: SparkSession, path: str, n_points: int | None = None, scan_id: str | None = None):
    """(scan_id, point_id, value); a length other than ``n_points`` is an error."""
    lay = npy_layout(path)
    if n_points is not None and lay.count != n_points:
        raise ValueError(f"{path}: {lay.count} labels for {n_points} points")
    reader = spark.read.format("npy1d")
    return (reader.option("scan_id", scan_id) if scan_id else reader).load(path)
