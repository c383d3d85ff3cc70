"""Operator 10, approximate nearest neighbours: hash-prefix forest (Bawa, Condie and Ganesan 2005).

Each tree gives every vector a long string of bits, the signs of random projections; a tree is the sorted array of its
strings. A query descends every tree to its longest matching prefix and then ascends all trees together until the vectors
below it are enough; these it compares exactly. The arrays are cut at a short common prefix, the deepest that still leaves
about `per_cell` vectors to a cell, so that each cell is one sorted array in one task; cells with more vectors, however alike
their strings, are split further, and so are the queries of a cell that many visit. A query whose cells hold too few
ascends past their border, by the cells' counted sizes, and visits all cells below the shorter prefix.

How many are enough depends on the data: a pilot, a bounded number of vectors that are no queries, is compared with every
vector, and the smallest number is taken with which the forest finds the wanted share of the pilot's neighbours. Vectors in
clusters need a small part of the table, those that stand alone, whose neighbours are hardly nearer than all others, most of it.
So the pilot is sorted by how deep a vector has company in the trees, and each group of it gives the number for queries alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, runs_of_groups, slices
from .embeddings import by_length, hashed, matrix

BITS = 48
_CELL = ["dim", "tree", "cell"]


def strings(v: np.ndarray, trees: int, seed: int = 9) -> np.ndarray:
    """(vectors, trees) int64: BITS signs of projections each, the first bit highest."""
    dim = v.shape[1]
    along = np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS))
    signs = (v @ along >= 0).reshape(len(v), trees, BITS)
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits strings share."""
    return BITS - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64)  # exact below 2**48


def choose(counts: np.ndarray, shared: np.ndarray, of: np.ndarray, recall: float) -> tuple[int, int]:
    """(enough, first): the cheapest ascent that finds `recall` of the pilot's neighbours.

    counts: (queries, trees, depths from 0 to BITS) vectors below each depth; shared: (neighbours, trees) bits that a
    neighbour shares with its query, of[i]. A query's depth is the deepest with `enough` vectors in all trees together; the
    trees from number `first` on stay one bit deeper, which lets the last step be a part of one.
    """
    queries, trees, _ = counts.shape
    total = counts.sum(axis=1)
    rows = np.arange(queries)[:, None]
    best = (np.inf, int(total[:, 0].max(initial=1)), trees)
    for enough in np.unique(np.geomspace(1, max(2, best[1]), 80).astype(np.int64)):
        depth = (total >= enough).sum(axis=1).clip(1) - 1
        for first in range(1, trees + 1):
            own = np.minimum(depth[:, None] + (np.arange(trees) >= first), BITS)
            cost = counts[rows, np.arange(trees), own].sum()
            if cost < best[0] and (shared >= own[of]).any(axis=1).mean() >= recall:
                best = (cost, int(enough), first)
    return best[1:]


def rules(counts: np.ndarray, shared: np.ndarray, of: np.ndarray, recall: float, company: int, group: int = 16) -> list[tuple[int, int, int]]:
    """[(from which depth of company on, enough, first)], by rising depth: choose() for groups of about `group` of the pilot.
    The depth of company is the deepest at which all trees together hold `company` vectors."""
    deep = (counts.sum(axis=1) >= company).sum(axis=1).clip(1) - 1
    parts = np.array_split(np.argsort(deep, kind="stable"), max(1, len(deep) // group))
    starts = sorted({int(deep[p[0]]) for p in parts})
    number = np.searchsorted(starts, deep, side="right") - 1
    out = []
    for i, start in enumerate(starts):
        own = np.flatnonzero(number == i)
        mine = np.isin(of, own)
        out.append((start if i else 0, *choose(counts[own], shared[mine], np.searchsorted(own, of[mine]), recall)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 16, recall: float = 0.94, pilot: int = 128, share: float | None = None, per_cell: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` with the largest inner product
    that were found, best first, ties to the smaller vec_id, the query's own vec_id left out. Queries are rows of `vectors`;
    others are left out.

    pilot: so many different vectors that are no queries (queries where all are), those with the lowest hashes, are compared with
    all vectors to learn how far queries must ascend for `recall`. share: instead, ascend until the trees hold share * number of different vectors together,
    counted once in each tree (with share = trees, to the roots: exact).

    Vectors of another length than a query's are no candidates. Those that are null, zero or hold null or non-finite
    components, and rows without vec_id, take no part on either side. Equal vectors are one point, which keeps the k + 1
    smallest of its ids; so no number of copies makes a cell large or costs a result.
    """
    rows = cut(hashed(vectors, vec_id, embedding))
    first = W.partitionBy("f1", "f2").orderBy("vec_id")
    few = rows.select("vec_id", "f1", "f2").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = few.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = cut(classes)
    reps = rows.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).where("vec_id = rep").dropDuplicates(["f1", "f2"])
    kind = rows.schema["v"].dataType.simpleString()

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            s, dim = np.empty((b.num_rows, trees), dtype=np.int64), np.empty(b.num_rows, dtype=np.int32)
            for own, v in by_length(b.column(1)):
                s[own], dim[own] = strings(v, trees), v.shape[1]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, trees), pa.int32()), pa.array(s.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), keys], ["id", "v", "dim", "keys"])

    points = cut(reps.select(F.col("rep").alias("id"), "v").mapInArrow(hash_, f"id long, v {kind}, dim int, keys array<long>"))
    n = points.count()
    prefix = max(0, math.ceil(math.log2(n / per_cell))) if n else 0
    asked = hashed(queries, vec_id, embedding).select(F.col("vec_id").alias("query_id"), "f1", "f2")
    asked = cut(asked.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]))
    # equal queries are one; those that aren't rows of `vectors` are left out with this join
    asking = cut(points.join(asked.select(F.col("rep").alias("id")).distinct(), "id").select("id", "dim", "keys"))

    def in_trees(df: DataFrame) -> DataFrame:
        cell = F.shiftright("key", BITS - prefix) if prefix else F.lit(0).cast("long")
        return df.select("id", "dim", F.posexplode("keys").alias("tree", "key")).withColumn("cell", cell)

    place = in_trees(points)
    sizes = place.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("held"))
    sizes = cut(sizes.withColumn("parts", F.ceil(F.col("held") / (2.0 * per_cell)).cast("int")))
    # every cell below each of its shorter prefixes: queries whose cells hold too few ascend past the cell's border
    ladder = sizes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(prefix)))).withColumn("above", F.expr(f"shiftright(cell, {prefix} - level)"))
    totals = ladder.groupBy("dim", "tree", "level", "above").agg(F.sum("held").alias("total"))
    totals = ladder.join(totals, ["dim", "tree", "level", "above"]).groupBy(*_CELL).agg(*[F.max(F.when(F.col("level") == d, F.col("total"))).alias(f"d{d}") for d in range(prefix + 1)])
    place = place.join(sizes.drop("held"), _CELL).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    place = cut(place.select(*_CELL, "part", "id", "key"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    depths = list(range(prefix + 1, BITS + 1))

    def arrays(held: DataFrame, visits: DataFrame) -> DataFrame:
        """What is held and who visits, cell by cell; the visits of a cell are dealt into turns of about `per_cell`."""
        turns = visits.groupBy(*_CELL, "part").agg(F.ceil(F.count(F.lit(1)) / float(per_cell)).cast("int").alias("turns"))
        visits = visits.join(turns, [*_CELL, "part"]).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(5)), F.col("turns")).cast("int")).drop("turns")
        held = held.join(turns, [*_CELL, "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        both = held.withColumn("asks", F.lit(0)).unionByName(visits.withColumn("asks", F.lit(1)), allowMissingColumns=True)
        return both.repartition(*_CELL, "part", "turn").sortWithinPartitions(*_CELL, "part", "turn", "asks", "key", "id")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of_groups(batches, [*_CELL, "part", "turn"]):
            asks, key, ids, tree = (table.column(c).to_numpy() for c in ("asks", "key", "id", "tree"))
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                m = i + int(np.searchsorted(asks[i:j], 1))
                if m == j:
                    continue
                below = np.empty((j - m, len(depths)), dtype=np.int64)
                for c, d in enumerate(depths):
                    s, q = key[i:m] >> (BITS - d), key[m:j] >> (BITS - d)
                    below[:, c] = np.searchsorted(s, q, side="right") - np.searchsorted(s, q, side="left")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, below.size + 1, len(depths)), pa.int32()), pa.array(below.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[m:j]), pa.array(tree[m:j]), lists], ["id", "tree", "below"])

    def counts(who: DataFrame, *by: str) -> DataFrame:
        """id (and tree), d0..d48: vectors below each depth, in all trees together (or in each)."""
        own = in_trees(who)
        visits = own.join(sizes, _CELL).select(*_CELL, part, "id", "key")
        below = arrays(place, visits).mapInArrow(descend, "id long, tree int, below array<long>")
        below = below.groupBy("id", *by).agg(*[F.sum(F.col("below")[c]).alias(f"d{d}") for c, d in enumerate(depths)])
        above = own.join(totals, _CELL).groupBy("id", *by).agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(prefix + 1)])
        return below.join(above, ["id", *by])

    learnt, company = [(0, 1 if share is None else max(1, math.ceil(share * n)), trees)], 16 * k
    if share is None and n:
        others = points.select("id").join(asking.select("id"), "id", "left_anti")
        others = others if others.take(1) else asking.select("id")
        some = cut(points.join(others.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(pilot), "id"))
        learnt = _fit(points, some, counts(some.select("id", "dim", "keys"), "tree"), k, trees, recall, company)

    def deepest(least: Column | int) -> Column:
        return F.coalesce(*[F.when(F.col(f"d{d}") >= least, F.lit(d)) for d in reversed(range(BITS + 1))], F.lit(0))

    rule = F.coalesce(*[F.when(F.col("deep") >= start, F.struct(F.lit(e).cast("long").alias("enough"), F.lit(s).alias("shallow"))) for start, e, s in reversed(learnt)])
    depth = counts(asking).withColumn("deep", deepest(company)).withColumn("rule", rule)
    depth = depth.select("id", deepest(F.col("rule.enough")).alias("all"), "rule.shallow")
    visits = in_trees(asking).join(depth, "id").withColumn("depth", F.least(F.col("all") + (F.col("tree") >= F.col("shallow")).cast("int"), F.lit(BITS)))
    visits = visits.withColumn("level", F.least("depth", F.lit(prefix))).withColumn("above", F.expr(f"shiftright(cell, {prefix} - level)"))
    visits = cut(visits.drop("cell", "all", "shallow").join(ladder, ["dim", "tree", "level", "above"]).select(*_CELL, part, "id", "key", "depth"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of_groups(batches, [*_CELL, "part", "turn"]):
            asks, key, ids = (table.column(c).to_numpy() for c in ("asks", "key", "id"))
            depth = table.column("depth").fill_null(0).to_numpy()
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                m = i + int(np.searchsorted(asks[i:j], 1))
                if m in (i, j):
                    continue
                v = matrix(table.column("v").slice(i, j - i))
                shift = BITS - depth[m:j]
                lo = np.searchsorted(key[i:m], key[m:j] >> shift << shift)
                hi = np.searchsorted(key[i:m], (key[m:j] >> shift) + 1 << shift)
                order = np.lexsort((hi, lo))  # queries below the same prefix share their candidates
                order = order[hi[order] > lo[order]]
                new = np.flatnonzero(np.diff(lo[order], prepend=-1) | np.diff(hi[order], prepend=-1))
                out: list[tuple] = []
                for a, b in zip(new, [*new[1:], len(order)], strict=True):
                    low, high = int(lo[order[a]]), int(hi[order[a]])
                    step = max(1, 2_000_000 // (high - low))
                    for p in range(a, b, step):
                        some = order[p : min(b, p + step)]
                        score = v[m - i + some] @ v[low:high].T
                        if high - low > k + 1:
                            border = np.partition(score, high - low - k - 1, axis=1)[:, high - low - k - 1]
                            q, c = np.nonzero(score >= border[:, None])
                        else:
                            q, c = np.divmod(np.arange(score.size), high - low)
                        s, found = score[q, c], ids[i + low + c]
                        o = np.lexsort((found, -s, q))
                        q, s, found = q[o], s[o], found[o]
                        best = np.arange(len(q)) - np.searchsorted(q, q) <= k
                        out.append((ids[m + some[q[best]]], found[best], s[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "found", "score"])

    vs = points.select("id", "v")
    hits = arrays(place.join(vs, "id"), visits.join(vs, "id")).mapInArrow(search, "id long, found long, score double")
    hits = hits.groupBy("id", "found").agg(F.max("score").alias("score"))
    order = W.partitionBy("id").orderBy(F.col("score").desc(), "found")
    hits = cut(hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("id", "found", "score"))
    wide = hits.join(classes.select(F.col("rep").alias("found"), "ids"), "found").select("id", "score", F.explode("ids").alias("vec_id"))
    out = asked.select("query_id", F.col("rep").alias("id")).join(wide, "id").where("vec_id != query_id")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _fit(points: DataFrame, some: DataFrame, counted: DataFrame, k: int, trees: int, recall: float, company: int) -> list[tuple[int, int, int]]:
    """rules() from the pilot `some`; what reaches the driver is bounded by its number."""
    mine = sorted(some.select("id", "dim", "keys", "v").collect(), key=lambda r: r["id"])
    if not mine:
        return [(0, 1, trees)]
    at = {r["id"]: i for i, r in enumerate(mine)}
    lengths = {d: [r for r in mine if r["dim"] == d] for d in {r["dim"] for r in mine}}
    asked = points.sparkSession.sparkContext.broadcast({d: (np.array([r["id"] for r in own]), np.array([r["v"] for r in own], dtype=np.float64)) for d, own in lengths.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            ids = b.column(0).to_numpy()
            for own, v in by_length(b.column(1)):
                if v.shape[1] not in asked.value:
                    continue
                q, w = asked.value[v.shape[1]]
                score = np.where(q[:, None] == ids[own][None], -np.inf, w @ v.T)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(q)), best.shape[1])
                keys = b.column(2).take(pa.array(own[best.reshape(-1)]))
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(score[row, best.reshape(-1)]), pa.array(ids[own[best.reshape(-1)]]), keys], ["q", "score", "id", "keys"])

    near = points.select("id", "v", "keys").mapInArrow(scan, "q long, score double, id long, keys array<long>").where("score > double('-Infinity')")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= k).select("q", "keys").collect()
    own = np.array([r["keys"] for r in mine], dtype=np.int64)
    below = np.zeros((len(mine), trees, BITS + 1), dtype=np.int64)
    for r in counted.collect():
        below[at[r["id"]], r["tree"]] = [r[f"d{d}"] for d in range(BITS + 1)]
    of = np.array([at[r["q"]] for r in near], dtype=np.int64)
    shared = common_prefix(np.array([r["keys"] for r in near], dtype=np.int64).reshape(-1, trees), own[of])
    return rules(below, shared, of, recall, company) if len(of) else [(0, 1, trees)]
