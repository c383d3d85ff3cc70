"""How crowded the surroundings of each object are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import written


def candidates(df: DataFrame, keys: list[str], frame: list[str], reach: float, x: str, y: str, radius: str, cell_size: float, crowd: int) -> DataFrame:
    """frame, keys, __reach and __d: each row with the rows of its frame that its cells hold, and how far away they are.

    A row looks into the cells that its circle touches. Its grid's cells are as wide as its reach, rounded up to cell_size times a
    power of two, so it touches nine at most; where its own cell holds more than `crowd` rows they are split into sixteen, of
    which only those that the circle touches are looked into: less than two rows for each in the circle, instead of up to
    eleven. Every row stands on the few grids that some row of its frame uses.
    """
    spot = df.select(*dict.fromkeys([*frame, *keys]), F.col(x).alias("__x"), F.col(y).alias("__y"), (F.col(radius) * reach).alias("__reach"))
    there = spot.select(*frame, F.col("__x").alias("__x2"), F.col("__y").alias("__y2")).where("__x2 is not null and __y2 is not null")
    width = F.pow(F.lit(2.0), F.col("__level")) * cell_size

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / width)

    def placed(grids: DataFrame) -> DataFrame:
        return there.join(grids, frame).withColumn("__i", cell("__x2")).withColumn("__j", cell("__y2"))

    level = F.greatest(F.ceil(F.log2(F.col("__reach") / cell_size)), F.lit(0)).cast("int")
    looks = spot.where("__reach > 0 and __x is not null and __y is not null").withColumn("__level", level)
    crowded = placed(looks.select(*frame, "__level").distinct()).groupBy(*frame, "__level", "__i", "__j").agg(F.count(F.lit(1)).alias("__held")).where(F.col("__held") > crowd)
    looks = looks.withColumn("__i", cell("__x")).withColumn("__j", cell("__y")).join(crowded, [*frame, "__level", "__i", "__j"], "left").drop("__i", "__j")
    looks = looks.withColumn("__level", F.col("__level") - F.when(F.col("__held").isNull(), F.lit(0)).otherwise(F.lit(2))).drop("__held")

    def around(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - F.col("__reach")) / width), F.floor((F.col(c) + F.col("__reach")) / width))

    def off(c: str, i: str) -> Column:  # how far the nearest side of a cell is
        return F.greatest(F.col(i) * width - F.col(c), F.col(c) - (F.col(i) + 1) * width, F.lit(0.0))

    looks = looks.select("*", F.explode(around("__x")).alias("__i")).select("*", F.explode(around("__y")).alias("__j"))
    looks = looks.where(F.pow(off("__x", "__i"), 2) + F.pow(off("__y", "__j"), 2) <= F.pow(F.col("__reach"), 2) * (1 + 1e-9))
    held = placed(looks.select(*frame, "__level").distinct())
    away = F.sqrt(F.pow(F.col("__x") - F.col("__x2"), 2) + F.pow(F.col("__y") - F.col("__y2"), 2))
    return looks.join(held, [*frame, "__level", "__i", "__j"]).select(*dict.fromkeys([*frame, *keys]), "__reach", away.alias("__d"))


#: Looks and places of a block at most, and looks and places that are compared at a time.
LOOKS, PLACES, TILE, SLICE = 16384, 65536, 128, 2048


def inverse_distances(looks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each look (x, y, reach) the sum of n / distance over the places (x, y, n) nearer than its reach, not at its very place.

    Looks are taken in tiles that lie together; a tile is compared with the places in its box, widened by its largest reach.
    """
    strips = max(1, round((len(looks) / TILE) ** 0.5))
    strip = np.empty(len(looks), dtype=np.int64)
    strip[np.argsort(looks[:, 0], kind="stable")] = np.arange(len(looks)) * strips // max(1, len(looks))
    order, places, out = np.lexsort((looks[:, 1], strip)), places[np.argsort(places[:, 0], kind="stable")], np.zeros(len(looks))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for at in range(0, len(order), TILE):
            tile = order[at : at + TILE]
            x, y, reach = looks[tile].T
            wide = reach.max() * (1 + 1e-9)
            lo, hi = np.searchsorted(places[:, 0], x.min() - wide, "left"), np.searchsorted(places[:, 0], x.max() + wide, "right")
            own = places[lo:hi]
            own = own[(own[:, 1] >= y.min() - wide) & (own[:, 1] <= y.max() + wide)]
            for k in range(0, len(own), SLICE):
                px, py, n = own[k : k + SLICE].T
                d, e = x[:, None] - px, y[:, None] - py
                d *= d
                e *= e
                d += e
                np.sqrt(d, out=d)
                np.copyto(d, np.inf, where=~((d > 0) & (d < reach[:, None])))
                out[tile] += np.divide(1.0, d, out=d) @ n
    return out


def crowded_density(spot: DataFrame, frame: list[str], cell_size: float, most_looks: int = LOOKS, most_places: int = PLACES) -> DataFrame:
    """frame, __x, __y, __reach and dens of the different looks of `spot`, with the rows of their frame. Rows at one place count as
    one with a number, so copies make no pairs.

    A look's cell is four times as wide as its reach, rounded up to cell_size times a power of two; a place goes to the cells
    that are no farther than that. Cells of many rows are dealt in blocks of about most_looks and most_places, each of which
    is one group: however crowded a frame, no task has to hold it, and pairs are never rows.
    """
    cell = [*frame, "__level", "__i", "__j"]
    spot = spot.where("__x is not null and __y is not null and not isnan(__x) and not isnan(__y)").withColumn("__reach", F.nanvl("__reach", F.lit(float("inf"))))
    width = F.pow(F.lit(2.0), F.col("__level")) * (4 * cell_size)
    level = F.greatest(F.ceil(F.log2(F.col("__reach") / cell_size)), F.lit(0)).cast("int")

    def touched(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - width * 0.25 * (1 + 1e-9)) / width), F.floor((F.col(c) + width * 0.25 * (1 + 1e-9)) / width)))

    looks = spot.where("__reach > 0").select(*frame, "__x", "__y", "__reach").distinct().withColumn("__level", level)
    looks = looks.withColumns({"__i": F.floor(F.col("__x") / width), "__j": F.floor(F.col("__y") / width)})
    looking = looks.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most_looks).alias("__p_all"))
    places = spot.groupBy(*frame, "__x", "__y").agg(F.count(F.lit(1)).cast("double").alias("__n")).join(looking.select(*frame, "__level").distinct(), frame)
    places = places.select("*", touched("__x").alias("__i")).select("*", touched("__y").alias("__j"))
    cells = places.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / most_places).alias("__q_all")).join(looking, cell)

    def number(n: str, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.col(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    a = looks.join(cells, cell).select(*cell, number("__p_all", "__x", "__y", "__reach").alias("__p"), every("__q_all").alias("__q"), "__x", "__y", "__reach", F.lit(None).cast("double").alias("__n"))
    b = places.join(cells, cell).select(*cell, every("__p_all").alias("__p"), number("__q_all", "__x", "__y").alias("__q"), "__x", "__y", F.lit(None).cast("double").alias("__reach"), "__n")

    def run(block: pa.Table) -> pa.Table:
        x, y, reach, n = (block.column(c).to_numpy() for c in ("__x", "__y", "__reach", "__n"))
        here = np.isnan(n)
        own = block.filter(pa.array(here)).select([*frame, "__x", "__y", "__reach"])
        return own.append_column("dens", pa.array(inverse_distances(np.column_stack([x, y, reach])[here], np.column_stack([x, y, n])[~here])))

    types = dict(spot.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in frame], "__x double, __y double, __reach double, dens double"])
    return a.unionByName(b).groupBy(*cell, "__p", "__q").applyInArrow(run, schema).groupBy(*frame, "__x", "__y", "__reach").agg(F.sum("dens").alias("dens"))


def local_density(df: DataFrame, keys: list[str] | None = None, frame: list[str] | None = None, reach: float = 6.0, x: str = "xpos", y: str = "ypos", radius: str = "Rad", cell_size: float = 1.0, crowd: int = 64, blocks_from: int = 512) -> DataFrame:
    """Adds dens: the sum of 1 / distance over the objects of the same frame that are nearer than `reach` times the row's own
    radius, and not at its very place; 0 without any. Frames of fewer than `blocks_from` rows by an equi-join on frame and grid
    cell, see candidates(); others by blocks, see crowded_density()."""
    keys, frame = keys or ["CellID"], frame or ["FrameID"]
    on = list(dict.fromkeys([*frame, *keys]))
    spot = written(df.select(*on, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), (F.col(radius) * reach).cast("double").alias("__reach")))
    sizes = spot.groupBy(*frame).agg(F.count(F.lit(1)).alias("__rows"))
    full, sparse = sizes.agg(F.count_if(F.col("__rows") >= blocks_from), F.count_if(F.col("__rows") < blocks_from)).first()
    parts = []
    if sparse or not full:
        few = spot.join(sizes.where(F.col("__rows") < blocks_from), frame, "left_semi") if full else spot
        near = candidates(few, keys, frame, 1.0, "__x", "__y", "__reach", cell_size, crowd).where("__d > 0 and __d < __reach")
        parts.append(near.groupBy(*on).agg(F.sum(1 / F.col("__d")).alias("dens")))
    if full:
        many = spot.join(sizes.where(F.col("__rows") >= blocks_from), frame, "left_semi") if sparse else spot
        found = crowded_density(many, frame, cell_size)
        many = many.withColumn("__reach", F.nanvl("__reach", F.lit(float("inf"))))
        parts.append(many.join(found, [*frame, "__x", "__y", "__reach"]).groupBy(*on).agg(F.sum("dens").alias("dens")))
    dens = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = df.drop("dens").join(dens, on, "left")
    return out.withColumn("dens", F.coalesce("dens", F.lit(0.0)))


def attach(detections: DataFrame, derived: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Derived features joined to their detections by track and frame; repeated rows on either side multiply."""
    on = [*(keys or ["CellID"]), "FrameID"]
    return detections.join(derived.select(*on, *[c for c in derived.columns if c not in detections.columns]), on)
