"""Which features tell two groups apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_labelled(tables: dict[str, DataFrame], column: str = "group") -> DataFrame:
    """The tables as one, each with its name in `column`."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def separation_scores(df: DataFrame, group: str, one, two, features: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """(VarIndex, VarName, SepScore): variance between over variance within the groups `one` and `two` of each feature.

    Within: the pooled sample variance; between: the groups' squared distances to the pooled mean, over the same degrees of
    freedom. A feature with a null in either group has no score, neither has one without variance within. Scores from
    `threshold` up are kept. One pass with partial aggregation: what is shuffled is a row for each feature and task.
    """
    features = features or [c for c, t in df.dtypes if c != group and t in ("int", "bigint", "float", "double")]
    both = df.where(F.col(group).isin(one, two)).select((F.col(group) == one).alias("__one"), *[F.col(c).cast("double").alias(c) for c in features])
    long = both.unpivot(["__one"], features, "VarName", "value")
    aggs = [F.count(F.lit(1)).alias("n"), F.count("value").alias("known")]
    for k, mine in ((1, F.col("__one")), (2, ~F.col("__one"))):
        v = F.when(mine, F.col("value"))
        aggs += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"m{k}"), F.var_samp(v).alias(f"v{k}")]
    stats = long.groupBy("VarName").agg(*aggs).where("n = known")
    freedom = "(n1 + n2 - 2)"
    within = F.expr(f"try_divide((n1 - 1) * v1 + (n2 - 1) * v2, {freedom})")
    stats = stats.withColumn("m", F.expr("(n1 * m1 + n2 * m2) / (n1 + n2)"))
    between = F.expr(f"try_divide(n1 * (m1 - m) * (m1 - m) + n2 * (m2 - m) * (m2 - m), {freedom})")
    index = F.array_position(F.array(*map(F.lit, features)), F.col("VarName")).cast("int")
    scores = stats.select(index.alias("VarIndex"), "VarName", F.try_divide(between, within).alias("SepScore"))
    return scores.where(F.col("SepScore") >= threshold)


def elbow(scores: DataFrame) -> DataFrame:
    """The scores strictly above the elbow of the descending scores: the one farthest below the chord from the largest to
    the smallest, the first such on ties. A single score gives none. Sorts as many rows as there are features.
    """
    order = W.orderBy(F.col("SepScore").desc(), "VarIndex")
    everything = W.partitionBy()
    ranked = scores.withColumns({"i": F.row_number().over(order), "n": F.count(F.lit(1)).over(everything), "hi": F.max("SepScore").over(everything), "lo": F.min("SepScore").over(everything)})
    below = F.try_divide((F.col("i") - 1) * (F.col("lo") - F.col("hi")), F.col("n") - 1) + F.col("hi") - F.col("SepScore")
    ranked = ranked.withColumn("below", below)
    at = F.max_by("SepScore", F.struct("below", (-F.col("i")).alias("i"))).over(everything)
    return ranked.withColumn("at", F.when(F.col("n") > 1, at)).where("SepScore > at").select(*scores.columns)


def zscore(df: DataFrame, features: list[str], drop_constant: bool = True) -> DataFrame:
    """Features centred and divided by their sample deviation; the other columns go along.

    Constant features can't be scaled: they are dropped, or with drop_constant=False null. Means and deviations are one row,
    joined to the table.
    """
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_samp(c).alias(f"s_{c}") for c in features]).first()
    known = {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in features}
    keep = [c for c in features if not drop_constant or known[c][1]]

    def scaled(c: str):
        mean, deviation = known[c]
        return ((F.col(c) - mean) / deviation if deviation else F.lit(None).cast("double")).alias(c)

    return df.select(*[c for c in df.columns if c not in features], *map(scaled, keep))
