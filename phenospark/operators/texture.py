"""Texture of crops as a pixel table: keys, x, y (from 1), intensity, region (-1 outside, 0 boundary, 1 interior).

All in built-in functions; features.extract_features has the same in NumPy where frames are cropped anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import crops
from ..functions.crops import HARALICK
from ..functions.stats import skewness
from .timeseries import TAP


def pixel_table(images: DataFrame, keys: list[str], pixels: str = "pixels", width: str = "width") -> DataFrame:
    """A row for each pixel of images with their pixels row by row; all of them interior."""
    at = images.select(*keys, F.col(width).alias("__w"), F.posexplode(pixels).alias("__p", "v"))
    x, y = F.col("__p") % F.col("__w") + 1, F.floor(F.col("__p") / F.col("__w")) + 1
    return at.select(*keys, x.cast("int").alias("x"), y.cast("int").alias("y"), F.col("v").cast("double").alias("intensity"), F.lit(1).alias("region"))


def normalise(pixels: DataFrame, keys: list[str], lower: float = 0.0, upper: float = 255.0) -> DataFrame:
    """Intensities of each image moved to lower..upper; null for a constant image."""
    w = W.partitionBy(*keys)
    hi, lo = F.max("intensity").over(w), F.min("intensity").over(w)
    out = pixels.withColumns({"__hi": hi, "__s": F.try_divide(F.lit(float(upper - lower)), hi - lo)})
    return out.withColumn("intensity", F.col("intensity") * F.col("__s") + (F.lit(float(upper)) - F.col("__s") * F.col("__hi"))).drop("__hi", "__s")


def cell_pixels(pixels: DataFrame, interior: bool = False) -> DataFrame:
    """Pixels of the object: with its boundary, or its interior alone."""
    return pixels.where("region = 1" if interior else "region >= 0")


def first_order(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """FOmean, FOsd and FOskew of the object's pixels."""
    return cell_pixels(pixels).groupBy(*keys).agg(F.avg("intensity").alias("FOmean"), F.stddev_samp("intensity").alias("FOsd"), skewness("intensity").alias("FOskew"))


def area(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Area: pixels of the object with its boundary."""
    return cell_pixels(pixels).groupBy(*keys).agg(F.count(F.lit(1)).alias("Area"))


def haar(pixels: DataFrame, keys: list[str], level: int = 1) -> DataFrame:
    """keys, bx, by (from 0), value: the approximation at a level, from blocks of 2 x 2 of the level below.

    Repeating an odd edge doesn't change a block's mean, so blocks at the edge average what they have.
    """
    now = pixels.select(*keys, (F.col("x") - 1).alias("bx"), (F.col("y") - 1).alias("by"), F.col("intensity").alias("value"))
    for _ in range(level):
        block = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("bx", "by")]
        now = now.groupBy(*keys, *block).agg((F.avg("value") * (2 * TAP * TAP)).alias("value"))
    return now


def with_levels(pixels: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Adds q0, q1, q2: the pixel's level, from 0 to n, in the image and in its two approximations, each scaled by the
    whole bounding box; null for a constant one.

    Approximations are means over blocks, taken by windows, so nothing is joined back: the table is dealt by crop once.
    Those of the second level are means of blocks of the first, each of which weighs the same however many pixels it has.
    """
    half, quarter = ([F.floor((F.col(c) - 1) / 2**level) for c in ("x", "y")] for level in (1, 2))
    one, two = W.partitionBy(*keys, *half), W.partitionBy(*keys, *quarter)
    out = pixels.repartition(*keys).withColumns({"l1": F.avg("intensity").over(one) * (2 * TAP * TAP), "__w": 1.0 / F.count(F.lit(1)).over(one)})
    out = out.withColumn("l2", F.sum(F.col("l1") * F.col("__w")).over(two) / F.sum("__w").over(two) * (2 * TAP * TAP))
    w = W.partitionBy(*keys)

    def scaled(c: str):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.floor(F.try_divide((F.col(c) - lo) * n, hi - lo) + 1e-6).cast("int")

    return out.withColumns({"q0": scaled("intensity"), "q1": scaled("l1"), "q2": scaled("l2")}).drop("l1", "l2", "__w")


def cooccurrence(leveled: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, i, j, n: how often the levels i and j meet at a pixel of the object, level 0 left out."""
    return cell_pixels(leveled).where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(*keys, F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count(F.lit(1)).alias("n"))


def cooccurrences(leveled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pair, i, j, n for the three pairs of images 01, 12 and 02, in one pass."""
    pairs = F.array(*[F.struct(F.lit(f"{a}{b}").alias("pair"), F.col(f"q{a}").alias("i"), F.col(f"q{b}").alias("j")) for a, b in ((0, 1), (1, 2), (0, 2))])
    each = cell_pixels(leveled).select(*keys, F.inline(pairs)).where("i > 0 and j > 0")
    return each.groupBy(*keys, "pair", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def haralick(counts: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """The fourteen features of each co-occurrence table (keys, i, j, n), named prefix + name.

    Moments in two passes: marginals and their moments first, then sums over the cells. Logarithms have base 10; means
    are crossed in Cor, and Dva and Sva are around the entropies, as the results to match have it.
    """
    w = W.partitionBy(*keys)
    p = counts.select(*keys, "i", "j", (F.col("n") / F.sum("n").over(w)).alias("p"))
    p = p.withColumns({"mx": F.sum(F.col("j") * F.col("p")).over(w), "my": F.sum(F.col("i") * F.col("p")).over(w)})
    p = p.withColumns({"px": F.sum("p").over(W.partitionBy(*keys, "j")), "py": F.sum("p").over(W.partitionBy(*keys, "i"))})
    p = p.withColumns({"ps": F.sum("p").over(W.partitionBy(*keys, (F.col("i") + F.col("j")))), "pd": F.sum("p").over(W.partitionBy(*keys, F.abs(F.col("i") - F.col("j"))))})

    def ent(c):  # -sum q log q over the cells: every cell adds its share of the log of its group's q
        return -F.sum(F.col("p") * F.log10(c))

    e = p.groupBy(*keys).agg(ent(F.col("ps")).alias("Sen"), ent(F.col("pd")).alias("Den"), (-F.sum(F.col("p") * (F.log10("px") + F.log10("py")))).alias("hxy2"))
    q = p.join(e, keys)
    i, j, pr = F.col("i"), F.col("j"), F.col("p")
    d, s = F.abs(i - j), i + j
    centre = (F.col("mx") + F.col("my")) / 2
    agg = q.groupBy(*keys).agg(
        F.sum(pr * pr).alias("ASM"),
        F.sum(d * d * pr).alias("Con"),
        F.sum(pr / (1 + d * d)).alias("IDM"),
        (-F.sum(pr * F.log10(pr))).alias("Ent"),
        F.sum((i - F.col("mx")) * (j - F.col("my")) * pr).alias("__c"),
        F.sum((j - F.col("mx")) * (j - F.col("mx")) * pr).alias("__vx"),
        F.sum((i - F.col("my")) * (i - F.col("my")) * pr).alias("__vy"),
        F.sum((i - centre) * (i - centre) * pr).alias("Var"),
        F.sum(s * pr).alias("Sav"),
        F.first("Sen").alias("Sen"),
        F.first("Den").alias("Den"),
        F.first("hxy2").alias("hxy2"),
        F.sum((d - F.col("Den")) * (d - F.col("Den")) * pr).alias("Dva"),
        F.sum((s - F.col("Sen")) * (s - F.col("Sen")) * pr).alias("Sva"),
        F.sum(F.pow(s - F.col("mx") - F.col("my"), F.lit(3.0)) * pr).alias("Sha"),
        F.sum(F.pow(s - F.col("mx") - F.col("my"), F.lit(4.0)) * pr).alias("Pro"),
    )
    v = F.col("__vx") * F.col("__vy")
    cor = F.when(v > 1e-24, F.col("__c") / F.sqrt(v)).otherwise(F.lit(0.0))
    f13 = F.sqrt(F.greatest(1 - F.exp(-2 * F.abs(F.col("hxy2") - F.col("Ent"))), F.lit(0.0)))
    out = agg.withColumns({"Cor": cor, "f13": f13})
    return out.select(*keys, *[F.col(h).alias(prefix + h) for h in HARALICK])


def intensity_dispersion(images: DataFrame, keys: list[str], pixels: str = "pixels", width: str = "width") -> DataFrame:
    """keys, k, IQ for k from 1 to 9: how far apart (sample variance over mean of all pairs' distances) the pixels of an image are
    that reach the k-th decile of its intensities. Null below three such pixels. All pixels count as interior.

    Distances of all pairs are counted by offset, one image at a time, in NumPy.
    """
    rows = images.select(*keys, F.col(width).alias("__width"), F.col(pixels).cast("array<double>").alias("__pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for w, v in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1), strict=True):
                image = v.values.to_numpy(zero_copy_only=False).reshape(-1, w)
                found += crops.intensity_quantiles(image, np.ones(image.shape, dtype=bool))
            at = pa.array(np.repeat(np.arange(b.num_rows), 9))
            k = pa.array(np.tile(np.arange(1, 10), b.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(keys))], k, pa.array(found, pa.float64())], [*keys, "k", "IQ"])

    types = dict(rows.dtypes)
    return rows.where("__pixels is not null").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", k int, IQ double")
