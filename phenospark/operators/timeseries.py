"""From a time series of each feature to variables of each track.

For each feature: _mean, _std, _skew over observed rows; _asc, _des, _max of the series with gaps filled linearly; and the
same three of Haar detail coefficients at three levels, _l1_asc to _l3_max. And trajArea of the track.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series
from ..functions.runs import runs_of_groups
from ..functions.stats import skewness
from .tracks import complete_rows

LEVELS = 3
STATS = ["mean", "std", "skew", "asc", "des", "max", *[f"l{n}_{s}" for n in range(1, LEVELS + 1) for s in ("asc", "des", "max")]]
#: Fixed value: the length of a Haar filter tap as the results to match have it, not 1 / sqrt(2).
TAP = 0.70710678
NOT_FEATURES = ("CellID", "FrameID", "ROI_filename", "xpos", "ypos")


def feature_names(df: DataFrame, keys: list[str]) -> list[str]:
    """Every numeric column that isn't an id or a position."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if c not in (*NOT_FEATURES, *keys) and (t in numeric or t.startswith("decimal"))]


def long_form(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """A row for each track, frame and feature. Exploding keeps how the rows are dealt, which an unpivot loses."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return df.select(*keys, "FrameID", F.inline(each))


def _summary_columns() -> list[Column]:
    skew = F.when(F.max("value") > 0, skewness("value")).otherwise(F.lit(0.0))
    return [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), skew.alias("skew")]


def _elevation_columns() -> list[Column]:
    span = (F.max("FrameID") - F.min("FrameID") + 1).cast("double")
    part = {n: F.when(F.count("d") > 0, F.sum(F.when(c, F.col("d")).otherwise(0.0)) / span) for n, c in (("asc", F.col("d") > 0), ("des", F.col("d") <= 0))}
    return [part["asc"].alias("asc"), part["des"].alias("des"), F.max("value").alias("max")]


def _with_rises(series_: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys, "feature").orderBy("FrameID")
    return series_.withColumn("d", F.col("value") - F.lag("value").over(order))


def summary(series_: DataFrame, keys: list[str]) -> DataFrame:
    """mean, std, skew over observed rows; skew is 0 unless some value is above 0."""
    return series_.groupBy(*keys, "feature").agg(*_summary_columns())


def elevation(series_: DataFrame, keys: list[str]) -> DataFrame:
    """asc, des: sums of the rises and of the falls, for each frame of the track's span; max.

    A linear fill splits a rise into rises of the same sum, so the gaps need no rows here. A track of one row has no rise
    or fall.
    """
    return _with_rises(series_, keys).groupBy(*keys, "feature").agg(*_elevation_columns())


def observed(series_: DataFrame, keys: list[str]) -> DataFrame:
    """summary and elevation in one pass."""
    return _with_rises(series_, keys).groupBy(*keys, "feature").agg(*_summary_columns(), *_elevation_columns())


def fill_gaps(series_: DataFrame, keys: list[str], max_gap: int | None = None) -> DataFrame:
    """A row for each frame between a track's first and last, values on the line between their neighbours.

    max_gap: an error is raised for a longer gap, which would multiply the rows.
    """
    order = W.partitionBy(*keys, "feature").orderBy("FrameID")
    ahead = series_.select("*", F.lead("FrameID").over(order).alias("__next"), F.lead("value").over(order).alias("__then"))
    if max_gap is not None:
        far = F.col("__next") - F.col("FrameID") > max_gap
        ahead = ahead.withColumn("__next", F.when(far, F.raise_error(F.lit(f"a gap is longer than {max_gap} frames")).cast("int")).otherwise(F.col("__next")))
    last = F.coalesce(F.col("__next") - 1, F.col("FrameID"))
    each = ahead.withColumn("__t", F.explode(F.sequence(F.col("FrameID"), last)))
    slope = F.try_divide(F.col("__then") - F.col("value"), (F.col("__next") - F.col("FrameID")).cast("double"))
    value = F.col("value") + F.coalesce((F.col("__t") - F.col("FrameID")) * slope, F.lit(0.0))
    return each.select(*keys, "feature", F.col("__t").alias("FrameID"), value.alias("value"))


def wavelets(series_: DataFrame, keys: list[str]) -> DataFrame:
    """Of series whose gaps count as filled linearly: asc and des (sums of the positive and of the other coefficients over
    their number) and max of the Haar details at each level; null for a level with fewer than two coefficients, the tail of an
    odd length is left out.

    Level L is the difference of the two halves' sums of each block of 2**L frames, times a constant. No frame of a gap gets a
    row: a block that lies whole on the line between two observed rows has the same coefficient as its neighbours there,
    the slope times minus the square of half its length, so these are counted. The other blocks, which hold an observed
    row or end at one, are gathered, at most two for each observed row; all levels are read from those of the highest.
    """
    width = 2**LEVELS
    order = W.partitionBy(*keys, "feature").orderBy("FrameID")
    first = F.min("FrameID").over(W.partitionBy(*keys, "feature"))
    ahead = series_.select(*keys, "feature", "value", (F.col("FrameID").cast("long") - first).alias("k"), (F.lead("FrameID").over(order).cast("long") - first).alias("to"), F.lead("value").over(order).alias("then"))
    slope = F.try_divide(F.col("then") - F.col("value"), (F.col("to") - F.col("k")).cast("double"))
    # a row holds from its frame on to the one before the next row's
    line = ahead.withColumns({"slope": F.coalesce(slope, F.lit(0.0)), "end": F.coalesce(F.col("to"), F.col("k") + 1), "b": F.floor(F.col("k") / width), "last": F.floor((F.coalesce(F.col("to"), F.col("k") + 1) - 1) / width)})
    own = F.struct(F.col("b").alias("block"), F.greatest(F.col("last") - F.col("b") - 1, F.lit(0)).alias("between"))
    ends = F.when(F.col("last") > F.col("b"), F.struct(F.col("last").alias("block"), F.lit(0).cast("long").alias("between")))
    line = line.select(*keys, "feature", "value", "k", "end", "slope", F.inline(F.array_compact(F.array(own, ends))))

    def at(i: int) -> Column:
        t = F.col("block") * width + i
        return F.max(F.when((t >= F.col("k")) & (t < F.col("end")), F.col("value") + (t - F.col("k")) * F.col("slope"))).alias(f"v{i}")

    # of the rows in a block only the last can have blocks of its line to itself
    alone = [F.sum("between").alias("between"), F.max(F.when(F.col("between") > 0, F.col("slope"))).alias("slope")]
    block = line.groupBy(*keys, "feature", "block").agg(*[at(i) for i in range(width)], *alone)

    def details(level: int) -> list[Column]:
        half, scale = 2 ** (level - 1), TAP * (TAP / 2**0.5) ** (level - 1)
        v = [F.col(f"v{i}") for i in range(width)]
        return [F.lit(scale) * (reduce(Column.__add__, v[i : i + half]) - reduce(Column.__add__, v[i + half : i + 2 * half])) for i in range(0, width, 2 * half)]

    def total(values: list[Column], keep) -> Column:
        return reduce(Column.__add__, [F.when(keep(v), v).otherwise(0.0) for v in values])

    columns = []
    for level in range(1, LEVELS + 1):
        d, half = details(level), 2 ** (level - 1)
        same = F.lit(-TAP * (TAP / 2**0.5) ** (level - 1) * half * half) * F.col("slope")
        many = F.col("between") * (width // (2 * half))
        n = F.sum(reduce(Column.__add__, [v.isNotNull().cast("int") for v in d]) + many)
        for name, keep in (("asc", lambda v: v > 0), ("des", lambda v: v <= 0)):
            columns.append(F.when(n >= 2, F.sum(total(d, keep) + F.when(keep(same), same * many).otherwise(0.0)) / n).alias(f"l{level}_{name}"))
        columns.append(F.when(n >= 2, F.max(F.greatest(*d, same))).alias(f"l{level}_max"))
    return block.groupBy(*keys, "feature").agg(*columns)


def trajectory_area(df: DataFrame, keys: list[str], x: str = "xpos", y: str = "ypos") -> DataFrame:
    """trajArea: the area of the box around a track's positions, for each frame of its span."""
    span = F.max("FrameID") - F.min("FrameID") + 1
    return df.groupBy(*keys).agg(((F.max(x) - F.min(x)) * (F.max(y) - F.min(y)) / span.cast("double")).alias("trajArea"))


def widen(per_feature: DataFrame, features: list[str], keys: list[str], stats: list[str]) -> DataFrame:
    """A row for each track, with a column <feature>_<stat> for every statistic of every feature."""
    return per_feature.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{f}_{s}") for f in features for s in stats])


def track_variables(df: DataFrame, features: list[str] | None = None, keys: list[str] | None = None, wide_from: int = 11) -> DataFrame:
    """All variables of every track: keys, <feature>_<stat> for each feature and statistic, trajArea.

    Rows with a null or NaN anywhere are left out first. Up to ten features go the long way, in built-in expressions;
    from `wide_from` on, a NumPy helper works on the frames x features matrix of each track, as a row for each feature would
    multiply the data. Either way the table is dealt by track once.
    """
    keys = keys or ["CellID"]
    features = features if features is not None else feature_names(df, keys)
    rows = complete_rows(df.select(*keys, "FrameID", "xpos", "ypos", *features)).repartition(*keys)
    if len(features) >= wide_from:
        return _by_helper(rows, features, keys)
    long = long_form(rows, features, keys)
    per_feature = observed(long, keys).join(wavelets(long, keys), [*keys, "feature"])
    return widen(per_feature, features, keys, STATS).join(trajectory_area(rows, keys), keys)


def _by_helper(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """The same by NumPy on whole tracks, many of which reach it in one batch."""
    names = [f"{f}_{s}" for f in features for s in STATS]

    def tracks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in runs_of_groups(batches, keys):
            frame, x, y = (table.column(c).to_numpy().astype(t) for c, t in (("FrameID", np.int64), ("xpos", float), ("ypos", float)))
            values = np.column_stack([table.column(f).to_numpy().astype(float) for f in features])
            out = np.empty((len(at) - 1, len(names) + 1))
            for n, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                out[n, :-1] = series.variables(frame[i:j], values[i:j], LEVELS, TAP).T.reshape(-1)
                out[n, -1] = series.box_area(frame[i:j], x[i:j], y[i:j])
            own = [table.column(k).combine_chunks().take(pa.array(at[:-1])) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, pa.float64(), from_pandas=True) for v in out.T]], [*keys, *names, "trajArea"])

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"`{n}` double" for n in names], "trajArea double"])
    return rows.sortWithinPartitions(*keys, "FrameID").mapInArrow(tracks, schema)
