"""Finding wrongly segmented objects: oversampled minority, undersampled majority, votes of many trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import written
from .neighbours import nearest
from .separation import union_labelled
from .trees import grow, votes

ERROR, CORRECT = "segerror", "correct"


def labelled(errors: DataFrame, correct: DataFrame, id_column: str) -> DataFrame:
    """Both sets without their id, with a class."""
    return union_labelled({ERROR: errors.drop(id_column), CORRECT: correct.drop(id_column)}, "class")


def nearest_same_class(minority: DataFrame, features: list[str], k: int, most: int) -> DataFrame:
    """__h, features, __n, and __near: each different row once, how many rows are equal to it, and the features of the k
    nearest other rows of one of them: its copies, then others by distance, ties by __id.

    Exact at every size, by nearest(): blocks of at most about `most` different rows, and of them only those that can hold
    a nearer row than those found. Distances that aren't numbers count as the largest.
    """
    points = minority.groupBy(*features).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64(*features)).withColumn("__id", F.xxhash64("__h", F.lit(1)))
    points = written(points.withColumn("__v", F.array(*features)))
    found = nearest(points.select(F.col("__id").alias("id"), F.col("__v").alias("v"), F.lit(1.0).alias("w"), F.lit(True).alias("asks")), len(features), k, most=most)
    held = points.select(F.col("__id").alias("other"), F.col("__n").alias("__c"), F.col("__v").alias("__f"))
    near = found.where("id is not null").select(F.col("id").alias("__id"), F.col("rank").alias("__r"), "other").join(held, "other")
    near = near.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("__r", "__c", "__f"))).alias("__others"))
    others = F.coalesce(F.flatten(F.transform("__others", lambda o: F.array_repeat(o["__f"], F.least(o["__c"], F.lit(k)).cast("int")))), F.array().cast("array<array<double>>"))
    copies = F.array_repeat(F.array(*features), F.least(F.col("__n") - 1, F.lit(k)).cast("int"))
    return points.join(near, "__id", "left").select("__h", *features, "__n", F.slice(F.concat(copies, others), 1, k).alias("__near"))


def oversample(minority: DataFrame, features: list[str], times: int = 1, k: int = 3, seed: int = 0, most: int = 8192) -> DataFrame:
    """Synthetic rows between each row and one of its k nearest of the same class, `times` for each row.

    Neighbour and place are drawn by a hash of the row, so that the result doesn't depend on partitions. Equal rows are
    numbered by their count, not by a window. A class of one row has no neighbours and gives none.
    """
    rows = minority.select(*[F.col(f).cast("double").alias(f) for f in features])
    near = nearest_same_class(rows, features, k, most).where(F.size("__near") > 0)
    near = near.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).withColumn("__id", F.xxhash64("__h", "__i"))
    drawn = near.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else near.withColumn("__copy", F.lit(0)).where(F.lit(False))
    pick = F.pmod(F.xxhash64("__id", "__copy", F.lit(seed)), F.size("__near")) + 1
    place = F.pmod(F.xxhash64("__id", "__copy", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    drawn = drawn.withColumns({"__to": F.element_at("__near", pick.cast("int")), "__u": place})
    return drawn.select(*[(F.col(f) + F.col("__u") * (F.get("__to", F.lit(i)) - F.col(f))).alias(f) for i, f in enumerate(features)])


def training_set(errors: DataFrame, correct: DataFrame, id_column: str = "CellID", times: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame, str, str]:
    """(minority with its synthetic rows, majority, name of the minority class, name of the majority class)."""
    features = [c for c in errors.columns if c != id_column]
    few, many, small, large = (errors, correct, ERROR, CORRECT) if errors.count() <= correct.count() else (correct, errors, CORRECT, ERROR)
    as_double = [F.col(f).cast("double").alias(f) for f in features]
    real = few.select(*as_double)
    return real.unionByName(oversample(real, features, times, seed=seed)), many.select(*as_double), small, large


def folded(rows: DataFrame) -> DataFrame:
    """Different rows with __w, how many are equal to each."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__w"))


def lowest(majority: DataFrame, n: int, draw: int, seed: int = 0, few: int = 10_000) -> DataFrame:
    """Of folded rows those that undersample() draws, with __w of each that are drawn.

    Rows are counted by ranges of their hashes, and the range that holds the n-th row is cut again until it has at most
    `few` different rows or one hash; only these are put in order.
    """
    columns = [c for c in majority.columns if c != "__w"]
    rows = majority.withColumn("__h", F.xxhash64(*columns, F.lit(draw), F.lit(seed)))
    lo, hi, before = -(1 << 63), 1 << 63, 0
    while True:
        width = max(1, (hi - lo) >> 12)
        # in decimals, as hashes reach over the whole range of a long
        step = F.floor((F.col("__h").cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("int")
        counts = rows.where(F.col("__h").between(lo, hi - 1)).groupBy(step.alias("s")).agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("c")).orderBy("s").collect()
        for r in counts:
            if before + r["w"] >= n:
                break
            before += r["w"]
        else:  # fewer than n rows
            return rows.drop("__h")
        lo, hi = lo + r["s"] * width, min(hi, lo + (r["s"] + 1) * width)
        if r["c"] <= few or hi - lo == 1:
            break
    order = W.orderBy("__h", *columns).rowsBetween(W.unboundedPreceding, W.currentRow)
    border = rows.where(F.col("__h").between(lo, hi - 1)).withColumn("__w", F.least("__w", F.lit(n - before) - F.sum("__w").over(order) + F.col("__w")))
    return rows.where(F.col("__h") < lo).unionByName(border.where(F.col("__w") > 0)).drop("__h")


def undersample(majority: DataFrame, n: int, draw: int, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement: those with the lowest hashes of their values, this draw's number and the seed."""
    drawn = lowest(folded(majority), n, draw, seed)
    return drawn.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__w").cast("int")))).select(*majority.columns)


def tree_votes(errors: DataFrame, correct: DataFrame, test: DataFrame, id_column: str = "CellID", trees: int = 10, times: int = 1, seed: int = 0, at_once: int = 4, **rule: float) -> DataFrame:
    """`test`'s id and votes: how many of the trees call the row an error. Each tree is fitted on the minority with its
    synthetic rows and as many rows of the majority, all trees together by grow(), which takes `rule`. A test row without a
    number for a feature has the vote of the node that asks for it; every row has a vote."""
    features = [c for c in errors.columns if c != id_column]
    few, many, small, large = training_set(errors, correct, id_column, times, seed)
    few, many = written(folded(few)), written(folded(many))
    n, have = (t.agg(F.coalesce(F.sum("__w"), F.lit(0))).first()[0] for t in (few, many))
    if n > have:
        raise ValueError(f"cannot draw {n} of the {have} rows of the class {large!r} without replacement")

    def drawn(draw: int) -> DataFrame:
        return lowest(many, n, draw, seed).select(*features, "__w", F.lit(int(large == ERROR)).alias("y"), F.lit(draw).alias("tree"))

    with ThreadPoolExecutor(at_once) as pool:  # small jobs: their latency overlaps
        rows = list(pool.map(drawn, range(trees)))
    both = few.select(*features, "__w", F.lit(int(small == ERROR)).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    for more in rows:
        both = both.unionByName(more)
    return votes(test, id_column, features, grow(both.withColumnRenamed("__w", "w"), features, **rule))


def segmentation_errors(errors: DataFrame, correct: DataFrame, test: DataFrame, id_column: str = "CellID", trees: int = 10, proportion: float = 0.7, times: int = 1, seed: int = 0) -> DataFrame:
    """Ids of the test rows with more than proportion * trees votes."""
    return tree_votes(errors, correct, test, id_column, trees, times, seed).where(F.col("votes") > proportion * trees).select(id_column)


def ensemble(runs: list[DataFrame], id_column: str = "CellID") -> DataFrame:
    """Ids that at least half of the runs name."""
    named = None
    for run in runs:
        one = run.select(id_column).distinct()
        named = one if named is None else named.unionByName(one)
    return named.groupBy(id_column).count().where(F.col("count") >= len(runs) / 2).select(id_column)


def segmentation_errors_ensemble(errors: DataFrame, correct: DataFrame, test: DataFrame, id_column: str = "CellID", trees: int = 10, repeats: int = 5, proportion: float = 0.7, times: int = 1, seed: int = 0) -> DataFrame:
    """Ids that at least half of `repeats` runs name; without any, an empty table."""
    return ensemble([segmentation_errors(errors, correct, test, id_column, trees, proportion, times, seed + 1000 * r) for r in range(repeats)], id_column)
