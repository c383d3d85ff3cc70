"""All features of every object in every frame, from detections, outlines and frame images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crops, outlines
from ..functions.runs import runs_of_groups
from .density import attach, local_density
from .lineage import cut
from .motion import movement
from .timeseries import TAP
from .tracks import LEAST, clamp

SHAPE = ["Rad", "VfC", "Curv", "Len", "Wid", "Area", "A2B", "Box", "Rect", "poly1", "poly2", "poly3", "poly4"]
TEXTURE = ["FOmean", "FOsd", "FOskew", *[f"Cooc{m}{h}" for m in ("01", "12", "02") for h in crops.HARALICK], *[f"IQ{i}" for i in range(1, 10)]]
MOVEMENT = ["Dis", "Trac", "D2T", "Vel"]

#: Parts of images are handed on when they hold so many pixels.
MOST_PIXELS = 2_000_000


def crop_features(image: np.ndarray | None, x: np.ndarray, y: np.ndarray, gap: int = 4, origin: tuple[int, int] = (0, 0), size: tuple[int, int] | None = None) -> list[float | None]:
    """SHAPE, TEXTURE, xpos and ypos of one outline in a normalised frame; TEXTURE is null without an image, and where the
    outline reaches over its edge. image may be a part of the frame, which begins at origin (row, column) and holds the
    outline; size is then that of the frame."""
    cx, cy = float(x.mean()), float(y.mean())
    left, top = int(x.min()), int(y.min())
    bx, by = (x - left).astype(int), (y - top).astype(int)
    width, height = bx.max() + 1, by.max() + 1
    m = crops.mask(bx, by, width, height)
    inside, n = m >= 0, len(x)
    away = np.hypot(x - cx, y - cy)
    before, after = [(np.roll(x, k), np.roll(y, k)) for k in (gap, -gap)]
    curv = (np.hypot(x - before[0], y - before[1]) + np.hypot(x - after[0], y - after[1]) - np.hypot(before[0] - after[0], before[1] - after[1])).mean()
    length, wide = outlines.extents(x, y)
    area = float(inside.sum())
    shape = [away.mean(), away.var(ddof=1) if n > 1 else None, curv, length, wide, area, area / n**2, length * wide / area, max(length, wide) / (length + wide), *outlines.polygon_features(x, y)]
    rows, columns = size or (image.shape if image is not None else (0, 0))
    if image is None or top + height > rows or left + width > columns:
        return [*shape, *[None] * len(TEXTURE), cx, cy]
    part = image[top - origin[0] : top - origin[0] + height, left - origin[1] : left - origin[1] + width]
    v = part[inside]
    one = crops.halve(part, TAP)
    two = crops.enlarge(crops.halve(one, TAP), 4, part.shape)
    q = [crops.levels(i) for i in (part, crops.enlarge(one, 2, part.shape), two)]
    texture = [v.mean(), v.std(ddof=1), crops.skewness(v)]
    for a, b in ((0, 1), (1, 2), (0, 2)):
        texture += crops.haralick(crops.cooccurrence(q[a], q[b], inside))
    texture += crops.intensity_quantiles(part, m == crops.INTERIOR)
    return [*shape, *texture, cx, cy]


def frame_crops(frames: DataFrame, detections: DataFrame, outlines_: DataFrame, keys: list[str] | None = None, missing: str = "error", per_group: int = 256, per_task: int = 1000, tile: int = 256) -> DataFrame:
    """keys, FrameID, SHAPE, TEXTURE, xpos, ypos for each detection with an outline of at least 8 x 8 pixels.

    Objects are grouped by the tile of the frame in which their box begins, about `per_group` to a group. Of a frame's image only
    the part around a group's boxes goes to it; so what moves follows the area of the boxes, and a crowded frame is shared by
    several tasks. Each frame needs exactly one image, and each object in a frame exactly one outline name, or the job
    fails; with missing="null" a frame may lack its image. An outline that reaches over the image's edge, and a constant
    or missing image, give nulls in place of textures.
    """
    keys = keys or ["CellID"]
    named = detections.groupBy(*keys, "FrameID").agg(F.min("ROI_filename").alias("ROI_filename"), F.max("ROI_filename").alias("__other"))
    fault = F.raise_error(F.concat(F.lit("an object in frame "), F.col("FrameID").cast("string"), F.lit(" has several outline names"))).cast("string")
    named = named.withColumn("ROI_filename", F.when(F.col("ROI_filename") == F.col("__other"), F.col("ROI_filename")).when(F.col("ROI_filename").isNotNull(), fault)).drop("__other")
    # an array's length is no part of Spark's estimate of a table's size, so outlines and images would be sent whole to every executor
    shapes = clamp(named.join(outlines_.select("ROI_filename", "coords").hint("merge"), "ROI_filename")).select(*keys, "FrameID", "ROI_filename", "coords").where("size(coords) > 0")
    low = {a: F.floor(F.array_min(F.col("coords")[a])).cast("int") for a in "xy"}
    high = {a: F.floor(F.array_max(F.col("coords")[a])).cast("int") for a in "xy"}
    shapes = shapes.withColumns({"__tx": F.floor(low["x"] / tile).cast("int"), "__ty": F.floor(low["y"] / tile).cast("int")})
    box = [F.min(low["x"]).alias("left"), F.min(low["y"]).alias("top"), F.max(high["x"]).alias("right"), F.max(high["y"]).alias("bottom")]
    groups = shapes.groupBy("FrameID", "__tx", "__ty").agg(F.ceil(F.count(F.lit(1)) / float(per_group)).cast("int").alias("__n"), *box)
    shapes = shapes.join(groups.select("FrameID", "__tx", "__ty", "__n"), ["FrameID", "__tx", "__ty"]).withColumn("__g", F.pmod(F.xxhash64(*keys), F.col("__n")).cast("int")).drop("__n")
    parts_ = groups.groupBy("FrameID").agg(F.collect_list(F.struct("__tx", "__ty", "__n", "left", "top", "right", "bottom")).alias("parts"))  # as many as a frame has tiles
    kind = dict(shapes.dtypes)["FrameID"]
    images = frames.select(F.col("frame_id").cast(kind).alias("FrameID"), "height", "pixels").hint("merge").join(parts_, "FrameID")
    fields = ["FrameID", "__tx", "__ty", "__g", "height", "width", "left", "top", "wide", "low", "high", "pixels"]

    def whole(out: list[list], frame: pa.Array) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, out[-1])]), pa.int32())
        columns = [pa.array(c, t) for c, t in zip(out[1:-1], [pa.int32()] * 8 + [pa.float64()] * 2, strict=True)]
        pixels = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out[-1])))
        return pa.RecordBatch.from_arrays([frame.take(pa.array(out[0])), *columns, pixels], fields)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in fields]
            held = 0
            for i in range(b.num_rows):
                height = b.column("height")[i].as_py()
                grid = b.column("pixels")[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(height, -1)
                lo, hi = (float(grid.min()), float(grid.max())) if grid.size else (0.0, 0.0)
                for p in b.column("parts")[i].as_py():
                    own = grid[p["top"] : p["bottom"] + 1, p["left"] : p["right"] + 1]
                    for g in range(p["__n"]):
                        for column, v in zip(out, (i, p["__tx"], p["__ty"], g, height, grid.shape[1], p["left"], p["top"], own.shape[1], lo, hi, own.ravel()), strict=True):
                            column.append(v)
                        held += own.size
                        if held >= MOST_PIXELS:
                            yield whole(out, b.column("FrameID"))
                            out, held = [[] for _ in fields], 0
            if out[0]:
                yield whole(out, b.column("FrameID"))

    images = images.mapInArrow(part, f"FrameID {kind}, __tx int, __ty int, __g int, height int, width int, `left` int, top int, wide int, low double, high double, pixels array<double>")
    both = images.withColumn("__kind", F.lit(0)).unionByName(shapes.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    # the number is given, as the work is in the arithmetic, not in the bytes: about per_task objects for each
    tasks = max(4 * frames.sparkSession.sparkContext.defaultParallelism, -(-detections.count() // per_task))
    group = ["FrameID", "__tx", "__ty", "__g"]
    both = both.repartition(tasks, *group).sortWithinPartitions(*group, "__kind", *keys)
    names = [*SHAPE, *TEXTURE, "xpos", "ypos"]

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs_of_groups(batches, group):
            kind, frame = (table.column(c).to_numpy() for c in ("__kind", "FrameID"))
            (px, py), ends = _points(table.column("coords").combine_chunks())
            pixels = table.column("pixels").combine_chunks()
            own, rows = [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                m = i + int(np.searchsorted(kind[i:j], 1))
                if m == j:
                    continue
                if m - i > 1 or (m == i and missing != "null"):
                    raise ValueError(f"frame {frame[i]} has {m - i} images, not one")
                grid, origin, size = None, (0, 0), (0, 0)
                if m > i:
                    height, width, left, top, wide, lo, hi = (table.column(c)[i].as_py() for c in ("height", "width", "left", "top", "wide", "low", "high"))
                    origin, size = (top, left), (height, width)
                    if hi > lo and wide:
                        grid = (pixels[i].values.to_numpy(zero_copy_only=False).reshape(-1, wide) - lo) * 255.0 / (hi - lo)
                for k in range(m, j):
                    x, y = px[ends[k] : ends[k + 1]], py[ends[k] : ends[k + 1]]
                    if min(np.ptp(x), np.ptp(y)) + 1 >= LEAST:
                        own.append(k)
                        rows.append(crop_features(grid, x, y, origin=origin, size=size))
            if rows:
                values = np.array(rows, dtype=float)  # None becomes NaN, and that a null
                first = [table.column(c).combine_chunks().take(pa.array(own)) for c in (*keys, "FrameID")]
                yield pa.RecordBatch.from_arrays([*first, *[pa.array(v, pa.float64(), from_pandas=True) for v in values.T]], [*keys, "FrameID", *names])

    types = dict(shapes.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"FrameID {types['FrameID']}", *[f"{n} double" for n in names]])
    return both.mapInArrow(crop, schema)


def _points(coords: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """x and y of all points of a column of outlines, and where each outline ends among them; null ones are empty."""
    ends = np.concatenate([[0], np.cumsum(coords.value_lengths().fill_null(0).to_numpy())])
    return [c.to_numpy(zero_copy_only=False).astype(float) for c in coords.flatten().flatten()], ends


def extract_features(detections: DataFrame, outlines_: DataFrame, frames: DataFrame, framerate: float = 1.0, keys: list[str] | None = None, missing: str = "error") -> DataFrame:
    """The detections' columns, then Dis, Trac, D2T, Vel, SHAPE, TEXTURE, xpos, ypos, dens.

    detections: keys, FrameID, ROI_filename and other columns; outlines_: ROI_filename, coords; frames: frame_id, height, width,
    pixels (row by row). Detections whose outline is missing or under 8 pixels are left out. missing: see frame_crops. The crops are
    computed once (see lineage.cut), as movement and density read them several times.
    """
    keys = keys or ["CellID"]
    derived = cut(frame_crops(frames, detections, outlines_, keys, missing))
    moved = local_density(movement(derived, framerate, keys), keys)
    out = attach(detections, moved, keys)
    return out.select(*detections.columns, *MOVEMENT, *SHAPE, *TEXTURE, "xpos", "ypos", "dens")
