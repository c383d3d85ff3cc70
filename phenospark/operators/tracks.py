"""Track hygiene: what is checked, kept and ordered before features are derived.

A detection is a row per object and frame: CellID, FrameID, ROI_filename and any number of numeric columns. `keys` names a
track; where several videos are stacked, give ["video", "CellID"].
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REQUIRED = ("FrameID", "CellID", "ROI_filename")

#: Fixed value: objects narrower or lower than so many pixels are no objects.
LEAST = 8


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The table itself; an error names the columns that it lacks."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def by_track(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dealt by track: windows, joins and aggregates over tracks that follow need no shuffle of their own."""
    return df.repartition(*(keys or ["CellID"]))


def without_id(keys: list[str]) -> Column:
    """Whether a row belongs to no tracked object. Such rows, spots that were never linked, can be any number; a tracked
    object has about a row for each frame of its video."""
    return reduce(Column.__or__, [F.col(k).isNull() for k in keys])


def keep_long_tracks(df: DataFrame, min_frames: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of tracks with at least `min_frames` rows (rows count, not the span). Rows without an id form one track.

    Tracked objects are counted where they are dealt to; rows without an id are counted by partial sums, and the count is joined back, so they
    need not meet in a task.
    """
    keys = keys or ["CellID"]
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    tracked = df.where(~without_id(keys)).withColumn("__n", n).where(F.col("__n") >= min_frames).drop("__n")
    track = F.struct(*keys)  # equal where ids are null
    rest = df.where(without_id(keys))
    long = rest.groupBy(track.alias("__track")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_frames).select("__track")
    rest = rest.withColumn("__of", track).join(long, F.col("__of") == F.col("__track"), "left_semi").drop("__of")
    return tracked.unionByName(rest)


def in_order(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sorted by track and frame inside each partition."""
    return df.sortWithinPartitions(*(keys or ["CellID"]), "FrameID")


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null or NaN in any column; infinite values stay."""
    return df.dropna("any")


def frames(df: DataFrame) -> DataFrame:
    """Distinct frames."""
    return df.select("FrameID").distinct()


def frame_cells(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct objects of each frame."""
    return df.select(*(keys or ["CellID"]), "FrameID").distinct()


def several_outlines(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Objects and frames that name more than one outline: should be empty."""
    named = df.groupBy(*(keys or ["CellID"]), "FrameID").agg(F.count_distinct("ROI_filename").alias("n_outlines"))
    return named.where("n_outlines > 1")


def clamp(outlines: DataFrame, coords: str = "coords") -> DataFrame:
    """Negative coordinates become 0."""
    at = F.transform(coords, lambda p: F.struct(F.greatest(p["x"], F.lit(0)).alias("x"), F.greatest(p["y"], F.lit(0)).alias("y")))
    return outlines.withColumn(coords, at)


def large_enough(outlines: DataFrame, least: int = LEAST, coords: str = "coords") -> DataFrame:
    """Outlines whose bounding box is at least `least` pixels wide and high."""
    extent = [F.array_max(F.col(coords)[a]) - F.array_min(F.col(coords)[a]) + 1 for a in "xy"]
    return outlines.where((extent[0] >= least) & (extent[1] >= least))


def drop_listed(df: DataFrame, listed: DataFrame, id_column: str = "CellID") -> DataFrame:
    """Rows whose id isn't listed; rows without an id stay."""
    return df.join(listed.select(id_column), id_column, "left_anti")


def select_features(df: DataFrame, scores: DataFrame, keep: list[str]) -> DataFrame:
    """Only `keep` and the columns that the scores name (a list as long as the table is wide)."""
    names = {r["VarName"] for r in scores.select("VarName").distinct().collect()}
    return df.select(*keep, *[c for c in df.columns if c in names and c not in keep])
