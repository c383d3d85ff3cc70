"""Data sources of the formats that microscope software reads and writes: region files and tracking tables.

    spark.dataSource.register(RegionFiles)
    outlines.write.format("regions").mode("append").save(folder)
    spark.read.format("regions").load(folder)

Every task writes below a folder of its own that readers don't look at; only when all tasks have succeeded are these folders given
their names, so a lost executor leaves no half and no double files. Files are reached through pyarrow's file systems: local
and mounted folders, HDFS and object stores.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .outlines import HEADER, MAGIC, SCHEMA, decode

HIDDEN = "_temporary"
BANNER = "Tracking results"
PHASE = "FrameID int, CellID int, ROI_filename string, Volume double, Sphericity double"
_KIND, _VERSION = 7, 228  # a freehand region


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def encode(x: np.ndarray, y: np.ndarray) -> bytes:
    """A region file of the outline; whole coordinates from 0 to 32767."""
    x, y = np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)
    if len(x) > 65535 or (len(x) and (min(x.min(), y.min()) < 0 or max(x.max(), y.max()) > 32767)):
        raise ValueError("a region file holds at most 65535 points, from 0 to 32767")
    left, top, right, bottom = (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else (0, 0, 0, 0)
    head = MAGIC + b"ut" + struct.pack(">hBBhhhhH", _VERSION, _KIND, 0, top, left, bottom, right, len(x))
    return head + bytes(HEADER - len(head)) + np.concatenate([x - left, y - top]).astype(">i2").tobytes()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Writer(DataSourceArrowWriter):
    """Tasks write into hidden folders that commit() gives their names; abort() removes them."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        folder, n = posixpath.join(root, HIDDEN, self.job, uuid.uuid4().hex), 0
        store.create_dir(folder, recursive=True)
        for name, data in self.files(iterator):
            with store.open_output_stream(posixpath.join(folder, name)) as out:
                out.write(data)
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        if self.overwrite:
            for info in store.get_file_info(_below(root)):
                if info.base_name != HIDDEN:
                    (store.delete_file if info.is_file else store.delete_dir)(info.path)
        for i, m in enumerate(messages):
            if m is not None and m.files:
                store.move(m.folder, posixpath.join(root, f"part-{i:05d}-{self.job}"))
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, root = opened(self.path)
        store.delete_dir_contents(posixpath.join(root, HIDDEN, self.job), missing_dir_ok=True)


def _below(root: str, recursive: bool = False):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True, recursive=recursive)


class RegionWriter(_Writer):
    """A file <ROI_filename>.roi for each row (ROI_filename, coords)."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            for name, coords in zip(b.column("ROI_filename").to_pylist(), b.column("coords").to_pylist(), strict=True):
                if not name or "/" in name:
                    raise ValueError(f"no file can have the name {name!r}")
                yield f"{name}.roi", encode([p["x"] for p in coords or []], [p["y"] for p in coords or []])


class RegionReader(DataSourceReader):
    """Files in partitions of about `partitionBytes`."""

    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("partitionBytes", 32 << 20))
        self.names: set[str] | None = None

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        found = [i for i in store.get_file_info(_below(root, True)) if i.is_file and i.path.endswith(".roi") and f"/{HIDDEN}/" not in i.path]
        if self.names is not None:
            found = [i for i in found if _name(i.path) in self.names]
        out, held = [[]], 0
        for i in sorted(found, key=lambda i: i.path):
            size = i.size + 4096  # opening a small file costs more than reading it
            if out[-1] and held + size > self.bytes:
                out.append([])
                held = 0
            out[-1].append(i.path)
            held += size
        return [Files(p) for p in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        points = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        for lo in range(0, len(partition.paths), 256):
            rows = []
            for path in partition.paths[lo : lo + 256]:
                with store.open_input_stream(path) as f:
                    x, y = decode(f.read())
                rows.append((_name(path), len(x), [{"x": int(a), "y": int(b)} for a, b in zip(x, y, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), points), strict=True)], ["ROI_filename", "n", "coords"])


class FilteringRegionReader(RegionReader):
    """The same; filters on ROI_filename leave files out before they are opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("ROI_filename",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            yield f  # Spark applies it again, which costs nothing here


def _name(path: str) -> str:
    return posixpath.basename(path).removesuffix(".roi")


class RegionFiles(DataSource):
    """Format `regions`: ROI_filename, n, coords; writing needs ROI_filename and coords. With the option pushFilters, for
    sessions in which spark.sql.python.filterPushdown.enabled is set, files that a filter leaves out aren't opened."""

    @classmethod
    def name(cls) -> str:
        return "regions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RegionReader:
        return (FilteringRegionReader if self.options.get("pushFilters") == "true" else RegionReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RegionWriter:
        return RegionWriter(self.options, overwrite)


class PhaseWriter(_Writer):
    """A CSV file for each task, of a banner line, a header and a line for each row (PHASE)."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        out.writerow([BANNER])
        out.writerow(["Frame", "Tracking ID", "Volume (µm³)", "Sphericity ()"])
        n = 0
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("FrameID", "CellID", "Volume", "Sphericity")], strict=True):
                out.writerow(["" if v is None else repr(v) for v in row])
                n += 1
        if n:
            yield "tracking.csv", text.getvalue().encode()


class PhaseFiles(DataSource):
    """Format `phase`: writes tracking tables (FrameID, CellID, Volume, Sphericity) that tracking.read_phase() reads."""

    @classmethod
    def name(cls) -> str:
        return "phase"

    def schema(self) -> str:
        return PHASE

    def writer(self, schema: StructType, overwrite: bool) -> PhaseWriter:
        return PhaseWriter(self.options, overwrite)
