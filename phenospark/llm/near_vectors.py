"""Operator 2, embedding near-dedup: Euclidean p-stable hashing.

Vectors are normalised, where a cosine of at least c is a Euclidean distance of at most sqrt(2 - 2c). Each table
quantises `projections` Gaussian projections into cells of `width`; vectors of one cell are candidates, whose
cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of_groups, cut, mix64, runs_of_groups, slices
from .embeddings import by_length, hashed, takes_part
from .graph import components


def cells(unit: np.ndarray, tables: int, projections: int, width: float, seed: int = 5) -> np.ndarray:
    """(vectors, tables) int32: a hash of each vector's cell in each table."""
    dim = unit.shape[1]
    draw = np.random.default_rng([seed, dim])
    along, shift = draw.standard_normal((dim, tables * projections)), draw.uniform(0, width, tables * projections)
    q = np.floor((unit @ along + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    h = np.full((len(unit), tables), dim, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(1 << 20)
    for i in range(projections):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + q[:, :, i])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def apart(keys: np.ndarray, least: int = 64) -> np.ndarray:
    """The members of a block that needn't be together in one and the same earlier table; keys: their cells in these. The
    others, the largest group that one earlier table has together, are compared there."""
    n = len(keys)
    best = np.arange(n)
    for column in keys.T if n >= least else ():
        cell, of, size = np.unique(column, return_inverse=True, return_counts=True)
        if n - size.max() < len(best):
            best = np.flatnonzero(of != size.argmax())
            if not len(best):
                break
    return best


def same_cell(distance: float, width: float) -> float:
    """The chance that one quantised projection puts two points at this distance into one cell (Datar et al. 2004)."""
    if distance == 0:
        return 1.0
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def parameters(n: int, cosine: float, width: float, miss: float) -> tuple[int, int]:
    """(tables, projections) for n different vectors: so many tables that a pair at the cosine itself shares a cell of none
    with a chance of `miss` at most; and as many projections as make the work least.

    The work for a vector in a table: one row dealt, about four times that and its keys' size for one that has company and so
    moves as a whole, and a twentieth for each unrelated vector (at a right angle) in its cell.
    """
    near, far = (same_cell(math.sqrt(2 - 2 * c), width) for c in (cosine, 0.0))
    best = (math.inf, 1, 1)
    for k in range(1, 65):
        others = n * far**k
        tables = math.ceil(math.log(miss) / math.log1p(-(near**k))) if near < 1 else 1
        best = min(best, (tables * (1 + (4 + tables / 40) * min(1.0, others) + others / 20), tables, k))
    return best[1:]


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, miss: float = 0.001, width: float = 2.0, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`; other columns are left aside.

    n_links: other vectors with a cosine of at least `cosine` that were found; component_id: the smallest vec_id
    reachable by links; kept: whether that is the row's own. Equal vectors are one class, compared once and counted as
    often as they come. Vectors of different lengths don't meet. Vectors that are null, zero or hold null or
    non-finite components, and rows without vec_id, have no links (component_id is their own vec_id, kept is true).

    miss: the chance to lose a pair at the cosine itself; a closer one is lost more rarely (at 0.95 with 1e-6 or less). Tables
    and projections follow from it and from the counted number of different vectors. A pair is counted in the first table
    that brings it together, so no list of pairs is made: each block of a cell gives one count and one link for each
    member. Cells of any size are dealt into pairs of blocks of `block` members; members of a block that an earlier table
    has together too, as most of a group of near copies are, aren't compared again.
    """
    rows = cut(hashed(vectors, vec_id, embedding))
    classes = rows.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes)
    tables, projections = parameters(classes.count(), cosine, width, miss)
    reps = rows.join(classes, ["f1", "f2"]).where("vec_id = rep").dropDuplicates(["f1", "f2"])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            got = np.empty((b.num_rows, tables), dtype=np.int32)
            for own, v in by_length(b.column(2)):
                v /= np.abs(v).max(axis=1, keepdims=True)  # keeps squares finite
                got[own] = cells(v / np.linalg.norm(v, axis=1, keepdims=True), tables, projections, width)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, tables), pa.int32()), pa.array(got.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, keys], ["rep", "copies", "v", "keys"])

    kind = rows.schema["v"].dataType.simpleString()
    reps = cut(reps.select("rep", "copies", "v").mapInArrow(hash_, f"rep long, copies long, v {kind}, keys array<int>"))
    members = reps.select("rep", F.posexplode("keys").alias("t", "key"))
    dealt = blocks_of_groups(members, ["t", "key"], "rep", block).join(reps, "rep")
    dealt = dealt.select("t", "key", "lo", "hi", "own", "rep", "copies", "v", F.slice("keys", 1, F.col("t")).alias("keys"), F.size("v").alias("dim"))  # of the keys those of earlier tables
    # vectors of another length are in another cell but for a chance of 2**-32; the sort keeps them apart
    dealt = dealt.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "dim", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of_groups(batches, ["t", "key", "lo", "hi", "dim"]):
            t, lo, hi, own, rep, copies, dim = (table.column(c).to_numpy() for c in ("t", "lo", "hi", "own", "rep", "copies", "dim"))
            flat_keys = table.column("keys").combine_chunks().flatten().to_numpy()
            first = np.cumsum(t) - t
            flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(dim)
            members, counts, roots = [], [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j - i < 2:
                    continue
                v = flat[ends[i] - dim[i] : ends[j - 1]].reshape(j - i, -1)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                keys = flat_keys[first[i] : first[i] + (j - i) * t[i]].reshape(j - i, t[i])
                ask = apart(keys)
                near = v[ask] @ v.T >= cosine
                near[np.arange(len(ask)), ask] = False
                if lo[i] != hi[i]:
                    near &= own[i + ask, None] != own[None, i:j]
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                x = ask[x]
                once = np.ones(j - i, dtype=bool)
                once[ask] = False
                once = once[y]  # pairs seen from one side only
                x, y = np.concatenate([x, y[once]]), np.concatenate([y, x[once]])
                new = np.ones(len(x), dtype=bool)
                for e in range(t[i]):
                    new &= keys[x, e] != keys[y, e]
                count = np.bincount(x[new], weights=copies[i + y[new]], minlength=j - i).astype(np.int64)
                root = np.arange(j - i)
                while True:  # smallest number that links reach inside the block
                    least = root.copy()
                    np.minimum.at(least, x, root[y])
                    least = least[least]
                    if (least == root).all():
                        break
                    root = least
                told = np.flatnonzero((count > 0) | (root != np.arange(j - i)))
                members.append(rep[i + told])
                counts.append(count[told])
                roots.append(rep[i + root[told]])
            if members:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (members, counts, roots)], ["rep", "n", "root"])

    found = cut(dealt.mapInArrow(compare, "rep long, n long, root long"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of = classes.join(counted, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("f1", "f2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    known = rows.select("vec_id", "f1", "f2").join(of, ["f1", "f2"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = vectors.where(~(takes_part(embedding) & F.col(vec_id).isNotNull())).select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"))
    return known.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
