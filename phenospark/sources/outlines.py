"""Outlines from binary region files, decoded in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.outlines import densify as resample
from ..functions.outlines import points

# Fixed values of the file format: its first bytes, and the kinds of region that list coordinates.
MAGIC = b"Io"
WITH_COORDINATES = frozenset((0, 4, 5, 7, 8, 9, 10))
HEADER = 64
SCHEMA = "ROI_filename string, n int, coords array<struct<x:int,y:int>>"
_POINTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """x and y of one region file; an error for other files, composite regions and kinds without coordinates."""
    if data[:2] != MAGIC:
        raise ValueError("not a region file")
    kind, top, left = data[6], *struct.unpack_from(">hh", data, 8)
    (n,), (composite,) = struct.unpack_from(">H", data, 16), struct.unpack_from(">i", data, 36)
    if composite:
        raise ValueError("composite regions are not supported")
    if kind not in WITH_COORDINATES:
        raise ValueError(f"kind {kind} has no coordinates")
    v = np.frombuffer(data, ">i2", count=2 * n, offset=HEADER).astype(np.int32)
    v = np.where(v < -5000, v + 65536, v)
    v = np.maximum(v, 0).reshape(2, n)
    return v[0] + left, v[1] + top


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """ROI_filename (the file's name without its ending), n, coords for each file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.roi").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.roi$", 1).alias("ROI_filename"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [decode(c) for c in b.column(1).to_pylist()]
            coords = [[{"x": int(p), "y": int(q)} for p, q in zip(x, y, strict=True)] for x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in coords], pa.int32()), pa.array(coords, _POINTS)], ["ROI_filename", "n", "coords"])

    return named.mapInArrow(run, SCHEMA)


def densify(outlines: DataFrame, step: float = 1.0) -> DataFrame:
    """ROI_filename, n, coords resampled to about one pixel between neighbours, for outlines with gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [resample(*points(c), step) if c else ((), ()) for c in b.column(1).to_pylist()]
            coords = [[{"x": int(p), "y": int(q)} for p, q in zip(x, y, strict=True)] for x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in coords], pa.int32()), pa.array(coords, _POINTS)], ["ROI_filename", "n", "coords"])

    return outlines.select("ROI_filename", "coords").mapInArrow(run, SCHEMA)
