"""Clusters within a population: Ward's minimum variance method on scaled features, exact at every size.

Ward's criterion is reducible: joining two clusters never brings their union nearer to a third than both were. So all pairs
of clusters that are each other's nearest can be joined at once, and the joins of all rounds, in the order of their costs, are
those of the method that joins one pair at a time. A round is a search for nearest neighbours, by the clusters whose
nearest is gone, and a join.

A search gives a cluster several neighbours and a bound that no other cluster is nearer than. Where a neighbour is joined, the
criterion's recurrence (Lance and Williams 1967) bounds what the union costs; so a cluster whose nearest is gone asks again
only if no neighbour that is left is nearer than all its bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import forget, written
from .neighbours import _Search, cells_of, factor, lists, pivots_of, squared, with_cells
from .separation import zscore

MERGES = "node long, parent long, height double, round int"


def ward(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers 1..k of weighted points, by order of each cluster's first point. Of equally cheap merges the
    first pair is taken."""
    owner = np.arange(len(points))
    for i, j, _ in agglomerate(points, weights, k):
        owner[owner == j] = i
    first = {}
    return np.array([first.setdefault(o, len(first) + 1) for o in owner])


def agglomerate(points: np.ndarray, weights: np.ndarray, k: int = 1) -> list[tuple[int, int, float]]:
    """(i, j, cost) of each merge down to k clusters: j becomes part of i."""
    n = len(points)
    centre, weight = points.astype(float).copy(), weights.astype(float).copy()
    alive = np.ones(n, dtype=bool)
    cost = squared(centre, centre) * factor(weight[:, None], weight[None])
    np.fill_diagonal(cost, np.inf)
    out = []
    for _ in range(max(0, n - k)):
        i, j = divmod(int(cost.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((i, j, float(cost[i, j])))
        centre[i] = (weight[i] * centre[i] + weight[j] * centre[j]) / (weight[i] + weight[j])
        weight[i], alive[j] = weight[i] + weight[j], False
        row = np.where(alive, (squared(centre[i : i + 1], centre) * factor(weight[i], weight)[None])[0], np.inf)
        row[i] = np.inf
        cost[i], cost[:, i], cost[j], cost[:, j] = row, row, np.inf, np.inf
    return out


def in_rounds(points: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of agglomerate() down to one cluster, by rounds, so in another order; no table of all pairs is held."""
    v, w, out = points.astype(float).copy(), weights.astype(float).copy(), []
    live, nearest, cost = np.arange(len(w)), np.full(len(w), -1), np.zeros(len(w))
    while len(live) > 1:
        asks = live[nearest[live] < 0]
        search = _Search(asks, v[asks], w[asks], 1, True)
        search.see(np.arange(len(asks)), live, v[live], w[live])
        nearest[asks], cost[asks] = search.other[:, 0], search.cost[:, 0]
        i = live[(nearest[nearest[live]] == live) & (live < nearest[live])]
        j = nearest[i]
        out += zip(i.tolist(), j.tolist(), cost[i].tolist(), strict=True)
        v[i] = (v[i] * w[i, None] + v[j] * w[j, None]) / (w[i] + w[j])[:, None]
        w[i] += w[j]
        live = live[~np.isin(live, j)]
        # without a pair, which needs ties between clusters of several rounds, all ask again
        nearest[live[np.isin(nearest[live], [i, j]) | np.isin(live, i)] if len(i) else live] = -1
    return out


def ward_merges(points: DataFrame, width: int, few: int = 16_384, near: int = 16, per_cell: int = 256, most: int = 8192) -> DataFrame:
    """MERGES: every merge as two rows, its two nodes with their parent and its height.

    points: node long, v array<double>, w double; different nodes at different places. Rounds go on while there are more than
    `few` clusters; the last `few` are agglomerated in one task, however many rows there were. More than 1,024 points take
    one round at least. A height is at least those
    of the merges below it. Ties go to the smaller node. A search finds `near` neighbours; how many changes the work only.
    """
    state = written(points.select(F.col("node").alias("id"), "v", F.col("w").cast("double").alias("w")))
    n = state.count()
    unknown = {"nn": F.lit(None).cast("long"), "cost": F.lit(None).cast("double"), "near": F.array().cast("array<struct<cost:double,other:long>>"), "bound": F.lit(None).cast("double")}
    known = written(state.select("id", "w", F.lit(0.0).alias("h"), *[c.alias(x) for x, c in unknown.items()]))
    merges, rounds, pivots, of, asking = [], 0, None, 0, n
    while n > (few if rounds else min(few, 1024)):
        if pivots is None or 2 * n <= of:
            pivots, of = pivots_of(state, width, n, per_cell), n
            before, state = state, written(with_cells(state.select("id", "v", "w"), pivots))
            forget(before)
        asks = known.where("nn is null").select("id", F.lit(True).alias("asks"))
        if asking:
            placed = state.withColumn("asks", F.lit(True)) if asking == n else state.join(asks, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
            found = lists(placed, cells_of(state, pivots, most), width, n, asking, near, True, most).where("id is not null")
            found = found.select("id", F.arrays_zip("cost", "other").alias("__near"), (F.size("other") == near).alias("__full"))
            first, last = F.element_at("__near", 1), F.element_at("__near", -1)
            bound = F.when(F.col("__near").isNull(), F.col("bound")).when(F.col("__full"), last["cost"]).otherwise(F.lit(float("inf")))
            before, known = known, written(known.join(found, "id", "left").select("id", "w", "h", F.coalesce("nn", first["other"]).alias("nn"), F.coalesce("cost", first["cost"]).alias("cost"), F.coalesce("__near", "near").alias("near"), bound.alias("bound")))
            forget(before)
        other = known.select(F.col("id").alias("nn"), F.col("nn").alias("back"), F.col("w").alias("w2"), F.col("h").alias("h2"))
        pairs = known.select("id", "nn", "cost", "w", "h").join(other, "nn").where("back = id and id < nn")
        pairs = written(pairs.select("id", "nn", "cost", "w", "w2", F.greatest("cost", "h", "h2").alias("height"), F.xxhash64("id", "nn", F.lit(rounds)).alias("parent"), F.lit(rounds).alias("round")))
        merges.append(pairs)
        one, two = F.struct("id", F.col("w").alias("own"), F.col("w2").alias("mate")), F.struct(F.col("nn").alias("id"), F.col("w2").alias("own"), F.col("w").alias("mate"))
        joined = pairs.select(F.explode(F.array(one, two)).alias("x"), "parent", F.col("cost").alias("d")).select("x.*", "parent", "d")
        gone = joined.select("id")

        # the unions' centres; a and b are added, so that their order doesn't matter
        both = state.join(joined.select("id", "parent"), "id").groupBy("parent").agg(F.collect_list(F.struct("v", "w")).alias("x"))
        a, b = F.col("x")[0], F.col("x")[1]
        total = a["w"] + b["w"]
        born = both.select(F.col("parent").alias("id"), F.zip_with(a["v"], b["v"], lambda p, q: (p * a["w"] + q * b["w"]) / total).alias("v"), total.alias("w"))
        before, state = state, written(state.join(gone, "id", "left_anti").unionByName(with_cells(born, pivots)))
        forget(before)

        # what is left of each list, and the least that the unions of its neighbours can cost
        stay = known.join(gone, "id", "left_anti")
        listed = stay.select(F.col("id").alias("x"), F.col("w").alias("wx"), "bound", F.explode("near").alias("e")).select("x", "wx", "bound", F.col("e.other").alias("id"), F.col("e.cost").alias("c"))
        hit = listed.join(joined, "id").groupBy("x", "parent", "wx", "bound", "d").agg(F.sum(F.expr("(own + wx) * c")).alias("s"), F.count(F.lit(1)).alias("n"), F.first("own").alias("own"), F.first("mate").alias("mate"), F.collect_list("id").alias("gone"))
        least = F.expr("(s + if(n = 1, (mate + wx) * bound, 0d) - wx * d) / (own + mate + wx)") * (1 - 1e-9)  # for rounding
        hit = hit.select("x", least.alias("least"), "gone").groupBy("x").agg(F.min("least").alias("least"), F.flatten(F.collect_list("gone")).alias("gone"))
        stay = stay.join(hit.withColumnRenamed("x", "id"), "id", "left")
        stay = stay.withColumn("near", F.expr("if(gone is null, near, filter(near, e -> not array_contains(gone, e.other)))")).withColumn("bound", F.least("bound", "least"))
        kept = F.expr("gone is null or not array_contains(gone, nn)")
        next_ = F.get("near", F.lit(0))
        nearer = next_["cost"] < F.col("bound")
        stay = stay.select("id", "w", "h", *[F.when(kept, F.col(x)).when(nearer, next_[y]).alias(x) for x, y in (("nn", "other"), ("cost", "cost"))], "near", "bound")
        new = pairs.select(F.col("parent").alias("id"), F.expr("w + w2").alias("w"), F.col("height").alias("h"), *[c.alias(x) for x, c in unknown.items()])
        before, known = known, written(stay.unionByName(new))
        forget(before)
        had, rounds = n, rounds + 1
        n, asking = known.agg(F.count(F.lit(1)), F.count_if(F.col("nn").isNull())).first()
        if n == had:  # no pair, which needs ties between clusters of several rounds: all ask again
            before, known, asking = known, written(known.select("id", "w", "h", *[c.alias(x) for x, c in unknown.items()])), n
            forget(before)

    def finish(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        now, h = t.column("id").to_numpy().copy(), t.column("h").to_numpy().copy()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, width)
        rows = []
        for n, (i, j, cost) in enumerate(in_rounds(v, t.column("w").to_numpy())):
            h[i] = max(cost, h[i], h[j])
            # small numbers, which hashes of 64 bits aren't
            rows += [(x, n, h[i], rounds + n) for x in (int(now[i]), int(now[j]))]
            now[i] = n
        return pa.table([pa.array(list(c), x) for c, x in zip(list(zip(*rows, strict=True)) or [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["node", "parent", "height", "round"])

    last = written(state.select("id", "v", "w").join(known.select("id", "h"), "id").groupBy(F.lit(0).alias("__last")).applyInArrow(finish, MERGES))
    if not merges:
        return last
    pairs = points.sparkSession.read.schema(merges[0].schema).parquet(*[x.written_at for x in merges])
    return pairs.select(F.explode(F.array("id", "nn")).alias("node"), "parent", "height", "round").unionByName(last)


def heterogeneous_clusters(df: DataFrame, id_column: str, k: int, features: list[str] | None = None, few: int = 16_384, **search: int) -> DataFrame:
    """(id, cluster) for each row; clusters are numbered from 1, in the order of each cluster's smallest id.

    Ward's method exactly, whatever the number of rows: equal rows are one point with their count as weight, and merges come
    in rounds of ward_merges(). With at most k different rows each is a cluster. Rows with a null or a value that isn't
    finite in a feature that varies have a null cluster. An empty table gives no rows.
    """
    features = features or [c for c, t in df.dtypes if c != id_column and t in ("int", "bigint", "float", "double")]
    rows = zscore(df.select(id_column, *[F.col(f).cast("double").alias(f) for f in features]), features)
    kept = [c for c in features if c in rows.columns]
    v = F.array(*[F.col(f) + 0.0 for f in kept]) if kept else F.array(F.lit(0.0))  # -0.0 becomes 0.0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(id_column, v.alias("v"))
    rows = written(rows.select(id_column, F.when(fine, F.col("v")).alias("v"), F.xxhash64("v").alias("node")))
    points = written(rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("w"), F.first("node").alias("node")))
    if points.groupBy("node").count().where("count > 1").take(1):
        raise ValueError("two different rows have one hash")
    up = ward_merges(points, max(1, len(kept)), few, **search)
    # the k - 1 highest merges are undone; of equal heights the later ones, which are above the others
    undone = up.select("parent", "height", "round").distinct().orderBy(F.col("height").desc(), F.col("round").desc(), "parent").limit(k - 1).select("parent")
    up = written(up.join(undone, "parent", "left_anti").select("node", "parent"))
    while True:  # to the parents' parents, until all stand at the top
        above = up.select(F.col("node").alias("parent"), F.col("parent").alias("__top"))
        before, up = up, written(up.join(above, "parent", "left").select("node", F.coalesce("__top", "parent").alias("parent"), F.col("__top").isNotNull().alias("moved")))
        forget(before)
        if not up.where("moved").take(1):
            break
    own = rows.join(up.select("node", "parent"), "node", "left").select(id_column, F.when(F.col("v").isNotNull(), F.coalesce("parent", "node")).alias("top"))
    first = own.where("top is not null").groupBy("top").agg(F.min(id_column).alias("first"))  # k rows
    number = first.select("top", F.row_number().over(W.orderBy("first", "top")).alias("cluster"))
    return own.join(F.broadcast(number), "top", "left").select(id_column, "cluster")


def cluster_members(clusters: DataFrame, id_column: str) -> DataFrame:
    """(cluster, members): the ids of each cluster, sorted, for reports on small populations."""
    return clusters.groupBy("cluster").agg(F.sort_array(F.collect_list(id_column)).alias("members"))


def numbered_in_cluster(clusters: DataFrame, id_column: str) -> DataFrame:
    """Long form of the members' matrix: cluster, place, id."""
    return clusters.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(id_column)))
