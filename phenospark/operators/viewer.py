"""Linked tables for a viewer: frames, objects, and which object follows which from frame to frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frame_index(df: DataFrame, folder: str, prefix: str) -> DataFrame:
    """A row for each frame, with the place of its image."""
    name = F.format_string(f"{prefix.replace('%', '%%')}-%04d.tif", F.col("FrameID"))
    return df.select("FrameID").distinct().select("FrameID", F.lit(folder).alias("path_channel_1"), name.alias("filename_channel_1"), F.lit(1).alias("Image_Group_Number"), F.col("FrameID").alias("Image_Group_Index"))


def object_table(df: DataFrame) -> DataFrame:
    """All columns but the outline's name."""
    return df.drop("ROI_filename")


def next_frame_links(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(relationship_type_id, image_number1, object_number1, image_number2, object_number2): each object in the next frame
    that has it. A window over the track instead of a join of all its frames.
    """
    keys = keys or ["CellID"]
    ahead = F.lead("FrameID").over(W.partitionBy(*keys).orderBy("FrameID"))
    seen = df.select(*keys, "FrameID").distinct().withColumn("__next", ahead).where(F.col("__next").isNotNull())
    return seen.select(F.lit(1).alias("relationship_type_id"), F.col("FrameID").alias("image_number1"), F.col("CellID").alias("object_number1"), F.col("__next").alias("image_number2"), F.col("CellID").alias("object_number2"))


def relationship_types(spark: SparkSession) -> DataFrame:
    """The one kind of relationship."""
    return spark.range(1).select(F.lit(1).alias("relationship_type_id"), F.lit(1).alias("module_number"), F.lit("Parent").alias("relationship"), F.lit("cell").alias("object_name1"), F.lit("cell").alias("object_name2"))


def link_view(links: DataFrame, types: DataFrame) -> DataFrame:
    """Links with the names of their kind (a table of one row)."""
    return links.join(F.broadcast(types), "relationship_type_id").drop("relationship_type_id")


def viewer_tables(df: DataFrame, folder: str, prefix: str) -> dict[str, DataFrame]:
    """The four tables and the view by name."""
    links, types = next_frame_links(df), relationship_types(df.sparkSession)
    return {"frames": frame_index(df, folder, prefix), "cells": object_table(df), "FramePer_Relationships": links, "FramePer_RelationshipTypes": types, "FramePer_RelationshipsView": link_view(links, types)}
