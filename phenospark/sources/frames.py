"""Frame images: an index of files, its checks, and pixels of uncompressed grayscale images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, path of the files <text>-<frame of four or more digits>.tif."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"-(\d{4,})\.tif$", 1).alias("n"), "path").where("n != ''")
    return named.select(F.col("n").cast("int").alias("frame_id"), "path")


def frame_problems(index: DataFrame, detections: DataFrame) -> DataFrame:
    """frame_id, files for each frame of the detections that hasn't exactly one file: should be empty."""
    files = index.groupBy("frame_id").agg(F.count(F.lit(1)).alias("files"))
    wanted = detections.select(F.col("FrameID").alias("frame_id")).distinct()
    return wanted.join(files, "frame_id", "left").select("frame_id", F.coalesce("files", F.lit(0)).alias("files")).where("files != 1")


def decode(data: bytes) -> np.ndarray:
    """Rows of an uncompressed grayscale TIFF of 8 or 16 bits; an error for others."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter:
            size, place = struct.calcsize(letter) * count, at + 10 + 12 * i
            place = place if size <= 4 else struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, [1])[0]
    if tags.get(259, [1])[0] != 1 or tags.get(277, [1])[0] != 1 or bits not in (8, 16):
        raise ValueError("only uncompressed grayscale images of 8 or 16 bits are read")
    raw = b"".join(data[o : o + c] for o, c in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(raw, f"{order}u{bits // 8}", count=width * height).reshape(height, width)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, height, width, pixels (row by row) of each frame's image."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"-(\d{4,})\.tif$", 1).alias("n"), "content").where("n != ''")
    named = named.select(F.col("n").cast("int").alias("frame_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                image = decode(b.column(1)[i].as_py())
                pixels = pa.array([image.astype(float).ravel()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pixels], ["frame_id", "height", "width", "pixels"])

    return named.mapInArrow(run, "frame_id int, height int, width int, pixels array<double>")
