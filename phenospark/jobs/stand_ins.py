"""The shared tables read as tracking data: what a query of the library works on, and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import written

#: Length of one frame of the event tracks, in hours.
HOURS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, half days as frames: FrameID, CellID, ROI_filename, Volume, Rad, xpos, ypos."""
    e = table(spark, sf_dir, "events")
    frame = F.floor(F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)") / HOURS).cast("int") + 1
    rows = e.select(frame.alias("FrameID"), F.col("user_id").alias("CellID"), "value", F.regexp_extract("props", r'"k": *(\d+)', 1).cast("double").alias("k"))
    rows = rows.groupBy("FrameID", "CellID").agg(F.sum("value").alias("Volume"), F.count(F.lit(1)).cast("double").alias("Rad"), F.avg("value").alias("xpos"), F.avg("k").alias("ypos"))
    return rows.select("FrameID", "CellID", F.concat_ws("-", "FrameID", "CellID").alias("ROI_filename"), "Volume", "Rad", "xpos", "ypos")


EVENT_TRACKS = rf"""tracks AS (
  SELECT (date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // {HOURS} + 1)::INT AS FrameID, user_id AS CellID,
         sum(value) AS Volume, count(*)::DOUBLE AS Rad, avg(value) AS xpos, avg(regexp_extract(props, '"k": *(\d+)', 1)::DOUBLE) AS ypos
  FROM events GROUP BY 1, 2)"""


def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FrameID, CellID, ROI_filename: the same objects, with an outline name for each kind of event in a frame."""
    e = table(spark, sf_dir, "events")
    frame = F.floor(F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)") / HOURS).cast("int") + 1
    return e.select(frame.alias("FrameID"), F.col("user_id").alias("CellID"), F.concat_ws("-", frame, "user_id", "event_type").alias("ROI_filename"))


EVENT_NAMES = f"""WITH named AS (
  SELECT (date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // {HOURS} + 1)::INT AS FrameID, user_id AS CellID, concat_ws('-', FrameID, user_id, event_type) AS ROI_filename FROM events)"""


def shipping_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as objects, days as frames: FrameID, CellID, xpos (mean quantity), ypos (mean price in thousands)."""
    rows = table(spark, sf_dir, "lineitem").select(F.datediff("l_shipdate", F.lit("1992-01-01")).alias("FrameID"), F.col("l_suppkey").alias("CellID"), "l_quantity", "l_extendedprice")
    return rows.groupBy("FrameID", "CellID").agg(F.avg("l_quantity").alias("xpos"), (F.avg("l_extendedprice") / 1000).alias("ypos"))


SHIPPING_TRACKS = """tracks AS (
  SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS FrameID, l_suppkey AS CellID, avg(l_quantity) AS xpos, avg(l_extendedprice) / 1000 AS ypos
  FROM lineitem GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf_dir: str, names: int = 64) -> DataFrame:
    """vec_id, label, e0 ... of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(names)])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 8 x 8 pixels: vec_id, width, pixels."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("width"), F.col("embedding").alias("pixels"))


PIXELS = """pixels AS (
  SELECT vec_id, (i % 8 + 1)::INT AS x, (i // 8 + 1)::INT AS y, v FROM (
    SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as outlines of 64 points: vec_id, coords; radii of 20 + 10 times the components."""
    angle = [(f"cos(2 * pi() * i / 64)", "x"), ("sin(2 * pi() * i / 64)", "y")]
    point = ", ".join(f"'{n}', round(40 + (20 + 10 * v) * {c}, 6)" for c, n in angle)
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"transform(embedding, (e, i) -> named_struct({point.replace('v)', 'cast(e as double))')})) AS coords")


OUTLINES = """points AS (
  SELECT vec_id, i, round(40 + (20 + 10 * v) * cos(2 * pi() * i / 64), 6) AS x, round(40 + (20 + 10 * v) * sin(2 * pi() * i / 64), 6) AS y FROM (
    SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def painted_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, outlines, frames): each embedding is an object with an outline in whole pixels, in a frame of its own
    number and of 96 x 96 pixels that its components paint."""
    e = table(spark, sf_dir, "embeddings")
    point = ", ".join(f"'{n}', cast(round(40 + (20 + 10 * cast(e as double)) * {c}(2 * pi() * i / 64)) as int)" for c, n in (("cos", "x"), ("sin", "y")))
    coords = F.expr(f"transform(embedding, (e, i) -> named_struct({point}))")
    detections = e.select(F.col("vec_id").cast("int").alias("FrameID"), F.col("label").alias("CellID"), F.col("vec_id").cast("string").alias("ROI_filename"))
    shapes = e.select(F.col("vec_id").cast("string").alias("ROI_filename"), coords.alias("coords"))
    pixels = F.expr("transform(sequence(0, 9215), p -> cast(embedding[pmod(p * 7 + p div 96, 64)] as double))")
    # few bytes become many: dealt before, so that images are painted by many tasks
    frames = e.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id").select(F.col("vec_id").cast("int").alias("frame_id"), F.lit(96).alias("height"), F.lit(96).alias("width"), pixels.alias("pixels"))
    return detections, shapes, frames


#: Objects of a crowded frame stand in tiles of 96 x 96 pixels, five in a row.
CROWD, TILE, ROW = 20, 96, 5


def crowded_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, outlines, frames): twenty embeddings to a frame, each with its outline in a tile that its components paint;
    tiles without one are 0. An object is followed through the frames by its tile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / CROWD).cast("int").alias("FrameID"), (F.col("vec_id") % CROWD).cast("int").alias("CellID"))
    left = {"x": (F.col("CellID") % ROW) * TILE, "y": F.floor(F.col("CellID") / ROW) * TILE}
    turn = {"x": F.cos, "y": F.sin}

    def point(c, i):
        return F.struct(*[(F.round(40 + (20 + 10 * c.cast("double")) * turn[a](2 * F.pi() * i / 64)) + left[a]).cast("int").alias(a) for a in "xy"])

    detections = e.select("FrameID", "CellID", F.col("vec_id").cast("string").alias("ROI_filename"))
    shapes = e.select(F.col("vec_id").cast("string").alias("ROI_filename"), F.transform("embedding", point).alias("coords"))
    rows = -(-CROWD // ROW)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:TILE, :TILE]
        number = ((y * TILE + x) * 7 + y) % 64
        for b in batches:
            for n in range(0, b.num_rows, 8):  # a few images at a time
                some = b.slice(n, 8)
                images = np.zeros((some.num_rows, rows * TILE, ROW * TILE))
                for image, tiles in zip(images, some.column(1).to_pylist(), strict=True):
                    for t in tiles:
                        i, j = divmod(t["CellID"], ROW)
                        image[i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE] = np.asarray(t["embedding"], dtype=float)[number]
                size, ends = [pa.array([v] * some.num_rows, pa.int32()) for v in images.shape[1:]], pa.array(np.arange(some.num_rows + 1) * images[0].size, pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), *size, pa.ListArray.from_arrays(ends, pa.array(images.ravel()))], ["frame_id", "height", "width", "pixels"])

    grouped = e.repartition(2 * spark.sparkContext.defaultParallelism, "FrameID").groupBy("FrameID").agg(F.collect_list(F.struct("CellID", "embedding")).alias("tiles"))
    frames = grouped.mapInArrow(paint, "frame_id int, height int, width int, pixels array<double>")
    return detections, shapes, frames


TEXT_FEATURES = ("n_chars", "n_words", "n_upper", "n_lines", "n_digits")


def judged_documents(spark: SparkSession, sf_dir: str, once: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(errors, correct, all): documents with numeric features, as labelled sets of low and of high quality, and all. once: the
    features are counted once, into the shared folder; else by each table that is derived, as far as it asks for them."""
    d = table(spark, sf_dir, "documents")
    count = {"n_words": r"\S+", "n_upper": r"[A-Z]", "n_lines": r"\n", "n_digits": r"[0-9]"}
    rows = d.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("double").alias(n) for n, p in count.items()])
    rows = written(rows) if once else rows
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    both = rows.join(labels, "doc_id")
    return both.where("quality = 0").drop("quality"), both.where("quality = 1").drop("quality"), rows
