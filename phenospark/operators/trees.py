"""Classification trees of two classes, grown level by level from counts, many trees at once.

A node is split where the deviance of its rows falls most: between two neighbouring values of one feature. For every tree,
node and feature the rows of each class are counted by value (partial sums before the shuffle), and the counts added up
along the values in two steps: over the ranges that quantiles of the feature cut, and inside each range. So a node of any
size is spread over as many tasks as there are ranges, and cuts are exact, not between bins. What reaches the driver
of a level is one row for each node: nodes with a hundredth of the root's deviance, so at most a hundred for each tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import written


@dataclass
class Tree:
    """Nodes by number, the root first: feature (-1: a leaf), cut, the children below the cut and from it on, and whether most
    rows are of class 1."""

    feature: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)

    def add(self, label: bool) -> int:
        """A new leaf."""
        for column, x in ((self.feature, -1), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.label, label)):
            column.append(x)
        return len(self.feature) - 1

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Labels of rows; a row whose value isn't a number stays at the node that asks for it, and has that node's label."""
        feature, at, left, right, label = (np.array(c) for c in (self.feature, self.at, self.left, self.right, self.label))
        node, moving = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(moving):
            moving = moving[feature[node[moving]] >= 0]
            value = x[moving, feature[node[moving]]]
            moving, value = moving[~np.isnan(value)], value[~np.isnan(value)]
            node[moving] = np.where(value < at[node[moving]], left[node[moving]], right[node[moving]])
        return label[node]


def deviance(n: Column, ones: Column) -> Column:
    """-2 log likelihood of n rows, `ones` of class 1."""

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / n)).otherwise(F.lit(0.0))

    return F.lit(-2.0) * (part(ones.cast("double")) + part((n - ones).cast("double")))


def _deviance(n: float, ones: float) -> float:
    return -2.0 * sum(x * np.log(x / n) for x in (ones, n - ones) if x > 0)


def prepared(rows: DataFrame, features: list[str], ranges: int = 256) -> DataFrame:
    """What best_splits() needs, all rows at the root: their features and the range of each, between quantiles of all rows."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    state = written(rows.select("tree", F.lit(0).alias("node"), F.col("y").cast("long").alias("y"), F.col("w").cast("long").alias("w"), x.alias("x")))
    finite = [F.when(F.col("x")[i].isNotNull() & ~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(len(features))]
    quantiles = state.agg(*[F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 10 * ranges).alias(f"q{i}") for i, c in enumerate(finite)]).first()
    bounds = [np.unique(np.array(q if q is not None else [], dtype=float)) for q in quantiles]

    @F.pandas_udf("array<int>")
    def bins(v: pd.Series) -> pd.Series:
        at = np.array([np.asarray(r, dtype=float) for r in v]).reshape(len(v), len(bounds))
        return pd.Series(list(np.column_stack([np.searchsorted(b, at[:, i]) for i, b in enumerate(bounds)]).astype(np.int32)))

    return written(state.withColumn("bins", bins("x")))


def best_splits(state: DataFrame, least: int) -> DataFrame:
    """(tree, node, gain, feature, at, n_left, ones_left, n_right, ones_right) of each node that has a split with `least` rows on
    either side, the one with the largest fall of deviance; ties to the first feature, then the lowest cut.

    state: tree, node, y, w, x (array of doubles), bins (array: the range of each value). Rows without a number for a feature
    don't count for it.
    """
    key = ["tree", "node", "feature"]
    values = state.select("tree", "node", "y", "w", F.posexplode(F.arrays_zip("x", "bins")).alias("feature", "v")).select(*key, "y", "w", F.col("v.x").alias("value"), F.col("v.bins").alias("bin"))
    values = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = values.groupBy(*key, "bin", "value").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("ones"))
    ranges = counts.groupBy(*key, "bin").agg(F.sum("n").alias("n_bin"), F.sum("ones").alias("ones_bin"), F.min("value").alias("first"))
    along = W.partitionBy(*key).orderBy("bin")
    before, everything = along.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*key)
    ranges = ranges.select(*key, "bin", *[F.coalesce(F.sum(f"{c}_bin").over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "ones")], *[F.sum(f"{c}_bin").over(everything).alias(f"{c}_all") for c in ("n", "ones")], F.lead("first").over(along).alias("next_bin"))
    inside = W.partitionBy(*key, "bin").orderBy("value")
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = counts.join(ranges, [*key, "bin"]).select(*key, "value", F.coalesce(F.lead("value").over(inside), "next_bin").alias("next"), *[(F.col(f"{c}_before") + F.sum(c).over(so_far)).alias(f"{c}_left") for c in ("n", "ones")], "n_all", "ones_all")
    cuts = cuts.where("next is not null").withColumns({f"{c}_right": F.col(f"{c}_all") - F.col(f"{c}_left") for c in ("n", "ones")}).where((F.col("n_left") >= least) & (F.col("n_right") >= least))
    gain = deviance(F.col("n_all"), F.col("ones_all")) - deviance(F.col("n_left"), F.col("ones_left")) - deviance(F.col("n_right"), F.col("ones_right"))
    at = F.col("value") / 2 + F.col("next") / 2
    at = F.when(at > F.col("value"), at).otherwise(F.col("next"))  # between neighbouring doubles there is no middle
    gain = F.round(gain, 9)  # so that cuts that are as good are equal, whatever the order of sums
    best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("first"), (-F.col("value")).alias("low"), at.alias("at"), *[F.col(f"{c}_{s}") for s in ("left", "right") for c in ("n", "ones")]))
    best = cuts.groupBy("tree", "node").agg(best.alias("b")).where("b.gain > 0")
    return best.select("tree", "node", "b.gain", (-F.col("b.first")).alias("feature"), "b.at", *[f"b.{c}_{s}" for s in ("left", "right") for c in ("n", "ones")])


def grow(rows: DataFrame, features: list[str], min_size: int = 10, min_cut: int = 5, min_deviance: float = 0.01, ranges: int = 256) -> dict[int, Tree]:
    """A tree for each value of `tree` in rows (tree, y, w and features; y: 0 or 1, w: how many rows this one stands for).

    A node of at least min_size rows and min_deviance of the root's deviance is split where best_splits() says, with at
    least min_cut rows on either side; there is no limit on the depth. Rows that are missing the feature of a split go no
    further. A node's label is its majority, class 0 if both are equal.
    """
    state = prepared(rows, features, ranges)
    trees, root, active = {}, {}, {}
    for r in state.groupBy("tree").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("ones")).collect():
        trees[r["tree"]] = Tree()
        trees[r["tree"]].add(2 * r["ones"] > r["n"])
        root[r["tree"]] = _deviance(r["n"], r["ones"])
        active[r["tree"], 0] = (r["n"], r["ones"])

    def splits(t: int, n: int, ones: int) -> bool:
        d = _deviance(n, ones)
        return n >= min_size and d > 0 and d >= min_deviance * root[t]

    active = {k: x for k, x in active.items() if splits(k[0], *x)}
    while active:
        spark = state.sparkSession
        open_ = spark.createDataFrame([(t, node) for t, node in active], "tree int, node int")
        state = state.join(F.broadcast(open_), ["tree", "node"])
        found, active, moves = best_splits(state, min_cut).collect(), {}, []
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            tree, node = trees[r["tree"]], r["node"]
            sides = [(r["n_left"], r["ones_left"]), (r["n_right"], r["ones_right"])]
            tree.feature[node], tree.at[node] = r["feature"], r["at"]
            tree.left[node], tree.right[node] = (tree.add(2 * ones > n) for n, ones in sides)
            moves.append((r["tree"], node, r["feature"], r["at"], tree.left[node], tree.right[node]))
            active |= {(r["tree"], child): x for child, x in zip((tree.left[node], tree.right[node]), sides, strict=True) if splits(r["tree"], *x)}
        if not active:
            break
        moves = spark.createDataFrame(moves, "tree int, node int, feature int, at double, `left` int, `right` int")
        value = F.get("x", F.col("feature"))
        state = state.join(F.broadcast(moves), ["tree", "node"]).where(value.isNotNull() & ~F.isnan(value))
        state = written(state.select("tree", F.when(value < F.col("at"), F.col("left")).otherwise(F.col("right")).alias("node"), "y", "w", "x", "bins"))
    return trees


def votes(test: DataFrame, id_column: str, features: list[str], trees: dict[int, Tree]) -> DataFrame:
    """(id, votes): how many trees give each row class 1. Trees are a few hundred nodes at most, and go along with the tasks."""
    rows = test.select(id_column, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    grown = list(trees.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]) if features else np.empty((b.num_rows, 0))
            n = sum((t.vote(x).astype(np.int32) for t in grown), np.zeros(b.num_rows, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], [id_column, "votes"])

    return rows.mapInArrow(run, f"`{id_column}` {dict(test.dtypes)[id_column]}, votes int")
