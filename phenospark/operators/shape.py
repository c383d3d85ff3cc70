"""Shape of outlines: one row per outline, coords an array of points (x, y) in boundary order.

What array functions express stays in them; the farthest pair and the polygon go to NumPy, one outline at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outlines as helper


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def _axis(coords: str, axis: str) -> Column:
    return F.col(coords)[axis].cast("array<double>")


def radius(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Adds Rad and VfC: mean and sample variance of the boundary's distance from its mean."""
    x, y = _axis(coords, "x"), _axis(coords, "y")
    out = df.withColumn("__c", F.struct(_mean(x).alias("x"), _mean(y).alias("y")))
    away = F.transform(coords, lambda p: F.sqrt((p["x"] - F.col("__c.x")) * (p["x"] - F.col("__c.x")) + (p["y"] - F.col("__c.y")) * (p["y"] - F.col("__c.y"))))
    out = out.withColumn("__d", away).withColumn("Rad", _mean(F.col("__d")))
    squares = F.aggregate("__d", F.lit(0.0), lambda s, v: s + (v - F.col("Rad")) * (v - F.col("Rad")))
    return out.withColumn("VfC", F.try_divide(squares, (F.size("__d") - 1).cast("double"))).drop("__c", "__d")


def centre(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Adds xpos and ypos, the mean of the boundary."""
    return df.withColumns({"xpos": _mean(_axis(coords, "x")), "ypos": _mean(_axis(coords, "y"))})


def curvature(df: DataFrame, gap: int = 4, coords: str = "coords") -> DataFrame:
    """Adds Curv: how much longer, on average over the boundary, the way is through a point than past it, between the
    points `gap` before and after (around the end)."""
    n, c = F.size(coords), F.col(coords)

    def away(p: Column, q: Column) -> Column:
        return F.sqrt(F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0)))

    def bend(j: Column) -> Column:
        p, before, after = F.get(c, j), F.get(c, F.pmod(j - gap, n)), F.get(c, F.pmod(j + gap, n))
        return away(p, before) + away(p, after) - away(before, after)

    return df.withColumn("Curv", _mean(F.transform(F.sequence(F.lit(0), n - 1), bend)))


def ratios(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Adds A2B, Box and Rect from Area, Len, Wid and the number of boundary points."""
    n = F.size(coords).cast("double")
    longer = F.greatest("Len", "Wid")
    return df.withColumns({"A2B": F.try_divide(F.col("Area").cast("double"), n * n), "Box": F.try_divide(F.col("Len") * F.col("Wid"), F.col("Area").cast("double")), "Rect": F.try_divide(longer, F.col("Len") + F.col("Wid"))})


def _with_helper(df: DataFrame, names: list[str], values, coords: str) -> DataFrame:
    rest = [c for c in df.columns if c not in names]
    schema = T.StructType([*df.select(*rest).schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [values(*helper.points(c)) for c in b.column(rest.index(coords)).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*rest, *names])

    return df.select(*rest).mapInArrow(run, schema)


def box(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Adds Len and Wid: extents along and across the line between the two points farthest apart."""
    return _with_helper(df, ["Len", "Wid"], helper.extents, coords)


def polygon(df: DataFrame, coords: str = "coords") -> DataFrame:
    """Adds poly1 to poly4, of the polygon that approximates the outline: longest side, smallest angle, variances of the angles and
    of the sides."""
    return _with_helper(df, ["poly1", "poly2", "poly3", "poly4"], helper.polygon_features, coords)
