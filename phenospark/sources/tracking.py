"""Tracking tables as CSV files of two flavours."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracks import keep_long_tracks


def _read(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in header)
    return spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE").csv(path)


def _header(spark: SparkSession, path: str, line: int) -> list[str]:
    """The column names of the first file by name: its line of that number, from 0, read as CSV."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    lines = spark.read.text(first).limit(line + 1).collect()  # of one file, in order
    names = next(csv.reader([lines[line][0].lstrip("\ufeff")]))
    return [c.strip() or f"_{i}" for i, c in enumerate(names)]


def _number(c: str):
    """A whole number as the values' integer part; null if it isn't a number."""
    return F.col(c).try_cast("double").cast("int")


def read_phase(spark: SparkSession, path: str, min_frames: int = 1) -> DataFrame:
    """FrameID, CellID, ROI_filename, Volume, Sphericity of a file with a banner line, then a header.

    Only rows whose frame is a number are data, which drops banner and header in every file. ROI_filename is
    <frame>-<tracking id>. Tracks of fewer than min_frames rows are left out.
    """
    names = _header(spark, path, 1)
    volume, sphericity = (next(c for c in names if c.startswith(p)) for p in ("Volume", "Sphericity"))
    rows = _read(spark, path, names).where(F.col("Frame").try_cast("double").isNotNull())
    rows = rows.select(
        _number("Frame").alias("FrameID"),
        _number("Tracking ID").alias("CellID"),
        F.concat_ws("-", F.trim("Frame"), F.trim("Tracking ID")).alias("ROI_filename"),
        F.col(volume).try_cast("double").alias("Volume"),
        F.col(sphericity).try_cast("double").alias("Sphericity"),
    )
    return keep_long_tracks(rows, min_frames)


def read_trackmate(spark: SparkSession, path: str, min_frames: int = 1) -> DataFrame:
    """FrameID (from 1), CellID, ROI_filename of a file with a header and three lines more of it. Spots without a track
    have a null CellID and count as one track."""
    rows = _read(spark, path, _header(spark, path, 0)).where(F.col("FRAME").try_cast("double").isNotNull())
    rows = rows.select((_number("FRAME") + 1).alias("FrameID"), _number("TRACK_ID").alias("CellID"), F.col("LABEL").alias("ROI_filename"))
    return keep_long_tracks(rows, min_frames)
