"""Movement of objects along their tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import divide
from .tracks import without_id


def movement(df: DataFrame, framerate: float = 1.0, keys: list[str] | None = None, x: str = "xpos", y: str = "ypos", most: int = 1_000_000) -> DataFrame:
    """Adds Dis, Trac, D2T and Vel to a table of positions.

    Dis: distance to the position in the track's first frame. Trac: length of the path so far, over observed rows. D2T: their
    ratio, 0 where there is no path yet. Vel: framerate * step / frames since the row before; before the first row stands
    frame 0 (so a first row in frame 0 has none). Rows of a track in one frame stand in any order.

    One window specification, so one sort for all four. A tracked object is in one task. Rows without an id, which count as one
    track and can be any number, are cut into ranges of about `most` rows by their frames, and of one frame by their hashes;
    what a range needs from those before it is carried over in a second step.
    """
    keys = keys or ["CellID"]
    rest = df.where(without_id(keys))
    out = _by_track(df.where(~without_id(keys)), keys, x, y)
    out = out.unionByName(_by_ranges(rest, keys, x, y, most).select(*out.columns))
    out = out.withColumn("D2T", F.coalesce(divide(F.col("Dis"), F.col("Trac")), F.lit(0.0)))
    out = out.withColumn("Vel", divide(F.lit(float(framerate)) * F.col("__step"), F.col("__gap").cast("double")))
    return out.select(*[c for c in df.columns if c not in ("Dis", "Trac", "D2T", "Vel")], "Dis", "Trac", "D2T", "Vel")


def _away(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _by_track(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Adds Dis, Trac, __step and __gap, a track in one task."""
    track = W.partitionBy(*keys).orderBy("FrameID")
    so_far = track.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.coalesce(_away(F.col(x) - F.lag(x).over(track), F.col(y) - F.lag(y).over(track)), F.lit(0.0))
    first = _away(F.col(x) - F.first(x).over(so_far), F.col(y) - F.first(y).over(so_far))
    out = df.withColumns({"__step": step, "Dis": first, "__gap": F.col("FrameID") - F.lag("FrameID", 1, 0).over(track)})
    return out.withColumn("Trac", F.sum("__step").over(so_far))


def _by_ranges(df: DataFrame, keys: list[str], x: str, y: str, most: int) -> DataFrame:
    """The same with tracks cut into ranges of about `most` rows."""
    rows = df.withColumn("__t", F.struct(*keys))  # equal where ids are null, too
    cuts = rows.groupBy(F.col("__t").alias("__of")).agg(F.count(F.lit(1)).alias("__n"), F.min("FrameID").cast("long").alias("__lo"), F.max("FrameID").cast("long").alias("__hi"))
    rows = rows.join(cuts, F.col("__t") == F.col("__of")).drop("__of")
    span = F.col("__hi") - F.col("__lo") + 1
    width = F.greatest(F.floor(span * most / F.col("__n")), F.lit(1))
    parts = F.greatest(F.ceil(F.col("__n") / (span * most)), F.lit(1))
    at = F.struct(F.coalesce(F.floor((F.col("FrameID") - F.col("__lo")) / width), F.lit(0)).alias("range"), F.coalesce(F.pmod(F.xxhash64(x, y), parts), F.lit(0)).alias("part"))
    # dealt by range: what the join above may have dealt by track would do for the windows below, in one task
    rows = rows.withColumn("__at", at).drop("__n", "__lo", "__hi").repartition("__t", "__at")
    inside = W.partitionBy("__t", "__at").orderBy("FrameID", x, y)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"__step": _away(F.col(x) - F.lag(x).over(inside), F.col(y) - F.lag(y).over(inside)), "__before": F.lag("FrameID").over(inside), "__i": F.row_number().over(inside)})
    rows = rows.withColumn("__so_far", F.sum(F.coalesce("__step", F.lit(0.0))).over(so_far))
    place = F.struct(F.col("FrameID").alias("f"), F.col(x).alias("x"), F.col(y).alias("y"))
    ranges = rows.groupBy(F.col("__t").alias("__t2"), F.col("__at").alias("__at2")).agg(F.min(place).alias("__first"), F.max(place).alias("__last"), F.sum(F.coalesce("__step", F.lit(0.0))).alias("__own"))
    along = W.partitionBy("__t2").orderBy("__at2")  # a row for each range
    link = F.coalesce(_away(F.col("__first.x") - F.lag("__last.x").over(along), F.col("__first.y") - F.lag("__last.y").over(along)), F.lit(0.0))
    ranges = ranges.withColumns({"__link": link, "__came": F.lag("__last.f", 1, 0).over(along), "__start": F.first("__first").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))})
    base = F.sum(F.col("__own") + F.col("__link")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__own")
    ranges = ranges.withColumn("__base", base).drop("__first", "__last", "__own")
    out = rows.join(ranges, (F.col("__t") == F.col("__t2")) & (F.col("__at") == F.col("__at2")))
    begins = F.col("__i") == 1
    out = out.withColumns(
        {
            "Dis": _away(F.col(x) - F.col("__start.x"), F.col(y) - F.col("__start.y")),
            "Trac": F.col("__base") + F.col("__so_far"),
            "__gap": F.col("FrameID") - F.when(begins, F.col("__came")).otherwise(F.col("__before")),
        }
    )
    return out.withColumn("__step", F.when(begins, F.col("__link")).otherwise(F.coalesce("__step", F.lit(0.0))))
