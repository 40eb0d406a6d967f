"""PLY output as a folder of whole files, on any file system that Arrow opens.

A task writes complete PLY files of one scan each and hands their names to the commit, which lists them in
``_index.json``.  Readers take listed files only, so files of failed attempts, of an aborted job or of a job under way
are never seen; commit and abort remove what their own job left behind.  No file is opened at an offset, appended to
or assembled afterwards, and neither the driver nor any one task sees more rows than one file holds.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

ROWS_PER_FILE = 2_000_000
INDEX = "_index.json"

# PLY scalar of each Spark type, with its Arrow and numpy type.
SCALARS = {
    "tinyint": ("char", pa.int8(), "i1"), "smallint": ("short", pa.int16(), "<i2"), "int": ("int", pa.int32(), "<i4"), "bigint": ("int", pa.int32(), "<i4"),
    "float": ("float", pa.float32(), "<f4"), "double": ("float", pa.float32(), "<f4"),
}
# PLY property names of the colour columns.
COLOURS = {"r": "red", "g": "green", "b": "blue"}


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a path or URI; Hadoop's ``s3a`` and ``file:/x`` spellings included."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def listed(path: str) -> list[dict] | None:
    """Entries {file, scan, rows} of a written folder in order; None where there is no index."""
    fs, root = place(path)
    name = posixpath.join(root, INDEX)
    if fs.get_file_info(name).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict]


class PlyPartsWriter(DataSourceArrowWriter):
    """x, y, z and every other numeric column become float or integer properties; ``r``, ``g``, ``b`` become colours.

    Null integers are 0, null floats NaN; integers that do not fit are an error.  ``scan_id`` parts the files and is kept
    in the index ("" for null), ``point_id`` is not written: the order of rows is.  Appending goes on after what is there.
    """

    def __init__(self, path: str, schema, overwrite: bool, rows_per_file: int = ROWS_PER_FILE):
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if not {"x", "y", "z"} <= kinds.keys():
            raise ValueError("x, y and z are required")
        rest = [n for n in kinds if n not in ("scan_id", "point_id", "x", "y", "z")]
        odd = [n for n in rest if kinds[n] not in SCALARS]
        if odd:
            raise ValueError(f"columns without a PLY type: {', '.join(odd)}")
        colours = COLOURS if COLOURS.keys() <= kinds.keys() else {}
        self.fields = [(n, n, *SCALARS["float"]) for n in "xyz"]
        self.fields += [(n, colours[n], "uchar", pa.uint8(), "u1") if n in colours else (n, n, *SCALARS[kinds[n]]) for n in rest]
        self.path, self.overwrite, self.rows_per_file, self.job = path, overwrite, rows_per_file, uuid.uuid4().hex
        fs, root = place(path)
        fs.create_dir(root, recursive=True)

    def write(self, iterator):
        task, seat, held, scan, rows = TaskContext.get(), uuid.uuid4().hex[:8], [], None, 0
        partition = task.partitionId() if task else 0
        files = []

        def close():
            nonlocal held, rows
            if rows:
                name = f"part-{partition:06d}-{len(files):06d}-{self.job}-{seat}.ply"
                self._file(name, np.concatenate(held))
                files.append({"file": name, "scan": scan, "rows": rows})
            held, rows = [], 0

        for batch in iterator:
            records = self._records(batch)
            for first, last, name in self._scans(batch):
                if name != scan:
                    close()
                    scan = name
                while first < last:
                    n = min(last - first, self.rows_per_file - rows)
                    held.append(records[first:first + n])
                    first, rows = first + n, rows + n
                    if rows == self.rows_per_file:
                        close()
        close()
        return Written(partition, files)

    def commit(self, messages):
        new = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        old = listed(self.path) or []
        fs, root = place(self.path)
        fresh = posixpath.join(root, f"{INDEX}.{self.job}")
        with fs.open_output_stream(fresh) as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        fs.move(fresh, posixpath.join(root, INDEX))
        for entry in old if self.overwrite else ():
            fs.delete_file(posixpath.join(root, entry["file"]))
        self._clear({f["file"] for f in new})

    def abort(self, messages):
        self._clear(set())

    def _clear(self, keep: set[str]) -> None:
        """Remove this job's files but for ``keep``; those of other jobs stay."""
        fs, root = place(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if self.job in info.base_name and info.base_name not in keep:
                fs.delete_file(info.path)

    def _records(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty(batch.num_rows, np.dtype([(prop, code) for _, prop, _, _, code in self.fields]))
        for column, prop, _, kind, _ in self.fields:
            values, real = batch.column(column), pa.types.is_floating(kind)
            values = pc.fill_null(values, pa.scalar(float("nan") if real else 0, values.type))
            out[prop] = values.cast(kind, safe=not real).to_numpy(zero_copy_only=False)
        return out

    def _scans(self, batch: pa.RecordBatch):
        """(first, last, scan) of each stretch of rows of one scan."""
        n = batch.num_rows
        if "scan_id" not in batch.schema.names:
            return [(0, n, "")]
        codes = pc.fill_null(batch.column("scan_id"), "").dictionary_encode()
        at = codes.indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), n]
        return [(a, b, codes.dictionary[int(at[a])].as_py()) for a, b in zip(edges, edges[1:]) if a < b]

    def _file(self, name: str, records: np.ndarray) -> None:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {len(records)}"]
        lines += [f"property {kind} {prop}" for _, prop, kind, _, _ in self.fields] + ["end_header", ""]
        fs, root = place(self.path)
        with fs.open_output_stream(posixpath.join(root, name)) as f:
            f.write("\n".join(lines).encode("ascii"))
            f.write(memoryview(np.ascontiguousarray(records)).cast("B"))
