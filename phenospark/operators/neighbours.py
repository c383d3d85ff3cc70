"""Exact nearest neighbours of every row, by cells around pivots and the triangle inequality.

A few rows are pivots; every row belongs to the cell of the pivot nearest to it and knows how far that is. A cell's rows lie
between two distances from its pivot, so a row that is d from the pivot is at least d minus the larger and the smaller minus
d away from all of them. Cells that lie together form blocks of bounded size, and blocks that lie together form places. A row
first looks in its own block; the k-th best found there then says which places, and which cells of them, can hold anything
as near. Where rows form no clusters nothing is pruned: shares of the rows that ask meet every place, each pair in a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import written

#: Bounds of what reaches the driver: pivots, and a row of bounds for each block and cell.
MOST_PIVOTS = 1024
#: A place has as many blocks at most, and so many blocks' rows ask there in one task.
WIDE, SHARE = 8, 12
#: Distances are looked through in tables of as many columns and numbers.
COLUMNS, TABLE = 2048, 1 << 20

FOUND = "id long, rank int, other long, cost double, computed long"
LISTS = "id long, other array<long>, cost array<double>, computed long"


@dataclass
class Cells:
    """Pivots; for each cell its rows' smallest and largest distance from the pivot and smallest weight, its block and its place;
    and in how many parts each block and each place is split."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    light: np.ndarray
    block: np.ndarray
    parts: np.ndarray
    place: np.ndarray
    place_parts: np.ndarray


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of `width` numbers; nulls are NaN."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature, so that both rows of a pair get the same; not a number counts as the largest."""
    d = np.zeros((len(a), len(b)))
    step = max(1, 16_384 // max(1, len(b)))  # what fits a core's own memory
    gap = np.empty((step, len(b)))
    for lo in range(0, len(a), step):
        some = d[lo : lo + step]
        g = gap[: len(some)]
        for f in range(a.shape[1]):
            np.subtract(a[lo : lo + step, f, None], b[None, :, f], out=g)
            np.multiply(g, g, out=g)
            np.add(some, g, out=some)
    return np.nan_to_num(d, copy=False, nan=np.finfo(float).max, posinf=np.finfo(float).max)


def squared_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """squared() of the rows of two tables one by one, to the last bit."""
    d = np.zeros(len(a))
    for f in range(a.shape[1]):
        d += (a[:, f] - b[:, f]) ** 2
    return np.nan_to_num(d, copy=False, nan=np.finfo(float).max, posinf=np.finfo(float).max)


def roughly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(squared distances by one product of matrices, for each row of a how far they can be from squared() at most); None where
    numbers are too large or no numbers. Both tables are moved to where b is, so that the error goes with the rows' spread."""
    if not (len(a) and len(b) and a.shape[1]):
        return None
    with np.errstate(invalid="ignore", over="ignore"):
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        if not max(aa.max(), bb.max()) < 1e150:
            return None
    d = a @ b.T
    d *= -2
    d += aa[:, None]
    d += bb[None]
    return d, 16 * (a.shape[1] + 8) * np.finfo(float).eps * (aa + bb.max()) + np.finfo(float).tiny


def factor(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """What a squared distance counts for two weights: the rise of the sum of squares when both are joined."""
    return a * b / (a + b)


def _nearest_pivot(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, far = np.zeros(len(v), dtype=np.int64), np.zeros(len(v))
    for lo in range(0, len(v), step := max(1, 2_000_000 // max(1, len(pivots)))):
        some = v[lo : lo + step]
        near = roughly(some, pivots)
        cell[lo : lo + step] = (squared(some, pivots) if near is None else near[0]).argmin(axis=1)
        far[lo : lo + step] = np.sqrt(squared_pairs(some, pivots[cell[lo : lo + step]]))
    return cell, far


def _blocks(centres: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """A block for each cell: all cells, halved across the direction in which they spread most until a half has `most` rows."""
    block, todo, n = np.zeros(len(rows), dtype=np.int64), [np.arange(len(rows))], 0
    while todo:
        own = todo.pop()
        if len(own) > 1 and rows[own].sum() > most:
            order = own[np.argsort(centres[own, np.nan_to_num(centres[own]).var(axis=0).argmax()], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(rows[order]), rows[own].sum() / 2), 1, len(own) - 1))
            todo += [order[:half], order[half:]]
        else:
            block[own], n = n, n + 1
    return block


def pivots_of(points: DataFrame, width: int, n: int, per_cell: int) -> np.ndarray:
    """Rows with the lowest hashes of their ids, at most MOST_PIVOTS; they say only where rows are looked for."""
    wanted = int(min(MOST_PIVOTS, max(1, n // per_cell)))
    rows = points.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 4.0 * wanted / max(1, n)))) if wanted < n else points
    picked = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(wanted).select("v").toArrow()
    pivots = matrix(picked.column(0), width) if picked.num_rows else np.zeros((1, width))
    pivots = pivots[np.isfinite(pivots).all(axis=1)]
    return pivots if len(pivots) else np.zeros((1, width))


def with_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The points with __cell, the number of the nearest pivot, and __far, how far that is."""
    width = pivots.shape[1]

    @F.pandas_udf("struct<cell:int,far:double>")
    def at(v: pd.Series) -> pd.DataFrame:
        cell, far = _nearest_pivot(np.array([np.asarray(x, dtype=float) for x in v]).reshape(len(v), width), pivots)
        return pd.DataFrame({"cell": cell.astype(np.int32), "far": far})

    return points.withColumn("__at", at("v")).select("*", F.col("__at.cell").alias("__cell"), F.col("__at.far").alias("__far")).drop("__at")


def cells_of(placed: DataFrame, pivots: np.ndarray, most: int) -> Cells:
    """The cells of with_cells(), with blocks of about `most` rows; a place is a twelfth of the rows, one block at least and WIDE at most."""
    stats = placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.min("__far").alias("near"), F.max("__far").alias("far"), F.min("w").alias("light")).collect()
    k = len(pivots)
    rows, near, far, light = np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf), np.ones(k)
    for r in stats:
        c = r["__cell"]
        rows[c], near[c], far[c], light[c] = r["n"], r["near"], r["far"], r["light"]
    block = _blocks(pivots, rows, most)
    in_block = np.bincount(block, weights=rows)
    wide = min(max(rows.sum() / 12, most), WIDE * most)
    place, n, held = np.zeros(len(in_block), dtype=np.int64), 0, 0.0
    for b, more in enumerate(in_block):  # blocks of neighbouring numbers lie together
        n, held = (n + 1, more) if held and held + more > wide else (n, held + more)
        place[b] = n
    parts = np.maximum(1, np.ceil(in_block / most)).astype(int)
    place_parts = np.maximum(1, np.ceil(np.bincount(place, weights=in_block) / wide)).astype(int)
    return Cells(pivots, near, far, light, block, parts, place[block], place_parts)


def _hits(found: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of a table with few hits, eight places at a time."""
    flat = np.ascontiguousarray(found).ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    row, at = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[row] * 8 + at, whole + np.flatnonzero(flat[whole:])])


def _away(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances from pivots, no farther apart than rounding."""
    near = roughly(v, pivots)
    if near is None:
        exact = np.sqrt(squared(v, pivots))
        return exact, exact
    d, off = near
    return np.sqrt(np.maximum(d - off[:, None], 0)), np.sqrt(np.maximum(d + off[:, None], 0))


class _Shown:
    """Points that rows are compared with, moved to where they are, so that the error of a rough distance goes with their spread."""

    def __init__(self, v: np.ndarray, middle: np.ndarray | float):
        self.v, self.middle, self.free = v, middle, None
        with np.errstate(invalid="ignore", over="ignore"):
            self.b = v - middle
            self.bb = np.einsum("ij,ij->i", self.b, self.b)
        self.largest = self.bb.max() if len(v) else np.inf
        self.small = np.column_stack([self.b, self.bb, np.ones(len(v))]).astype(np.float32).T if self.largest < 1e30 else None

    def table(self, asks: np.ndarray) -> _Table:
        return _Table(self, asks)

    def room(self, rows: int, columns: int) -> np.ndarray:
        """Room for a table, the same for each."""
        if self.free is None or self.free.size < rows * columns:
            self.free = np.empty(rows * columns, dtype=np.float32)
        return self.free[: rows * columns].reshape(rows, columns)


class _Table:
    """Squared distances between rows and shown points, by one product of matrices in single precision where numbers allow it."""

    def __init__(self, shown: _Shown, asks: np.ndarray):
        self.shown, self.asks = shown, asks
        with np.errstate(invalid="ignore", over="ignore"):
            self.a = asks - shown.middle
            self.aa = np.einsum("ij,ij->i", self.a, self.a)
        largest = np.maximum(shown.largest, self.aa.max()) if len(asks) else np.inf  # which keeps what is no number
        #: whether distances() sums, or multiplies in double precision, whatever is asked of it
        self.exact = not 1e-20 < largest < 1e30
        self.small = None if self.exact else np.column_stack([-2 * self.a, np.ones(len(asks)), self.aa]).astype(np.float32)
        self.rough = largest < 1e150

    def distances(self, lo: int, hi: int, exact: bool) -> tuple[np.ndarray, np.ndarray, float]:
        """(squared distances from points lo to hi, for each row how far they can be from squared() at most, the precision)."""
        if self.small is not None and not exact:
            eps = float(np.finfo(np.float32).eps)
            d = self.shown.room(len(self.asks), hi - lo)
            return np.matmul(self.small, self.shown.small[:, lo:hi], out=d), 4 * (self.a.shape[1] + 8) * eps * (self.aa + self.shown.largest), eps
        eps = float(np.finfo(float).eps)
        if not self.rough:
            return squared(self.asks, self.shown.v[lo:hi]), np.zeros(len(self.asks)), eps
        d = self.a @ self.shown.b[lo:hi].T
        d *= -2
        d += self.aa[:, None]
        d += self.shown.bb[None, lo:hi]
        return d, 16 * (self.a.shape[1] + 8) * eps * (self.aa + self.shown.largest) + np.finfo(float).tiny, eps


class _Search:
    """The k best for some rows, as blocks come by."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, w: np.ndarray, k: int, weighted: bool, cost: np.ndarray | None = None):
        self.ids, self.v, self.w, self.k, self.weighted = ids, v, w, k, weighted
        self.cost = np.full((len(ids), k), np.inf)
        self.other = np.zeros((len(ids), k), dtype=np.int64)
        self.limit = np.full(len(ids), np.inf) if cost is None else cost.copy()
        self.computed = 0

    def least(self, to_pivot: np.ndarray, at_most: np.ndarray, near: float, far: float, light: float) -> np.ndarray:
        """The least that any row between two distances from a pivot can cost rows that are to_pivot, or up to at_most, away from it."""
        with np.errstate(invalid="ignore", over="ignore"):
            # rounding of the distances must not prune what is just as near
            d = np.maximum(np.maximum(to_pivot - far, near - at_most) - 1e-9 * (at_most + far), 0) ** 2
            d = np.where(np.isfinite(at_most) & (at_most < 1e150) & (far < 1e150), d, 0.0)
        return d * factor(self.w, light) if self.weighted else d

    def see(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """Compare the rows of these numbers with all points of a cell. ids must be in order."""
        middle = v.mean(axis=0) if len(v) else 0.0
        shown = _Shown(v, middle)
        opened = not np.isfinite(self.limit[rows]).all()
        columns = max(1, len(ids) if opened else min(len(ids), COLUMNS))
        for lo in range(0, len(rows), step := max(1, TABLE // columns)):
            own = rows[lo : lo + step]
            self.computed += len(own) * len(ids)
            asks = self.v[own]
            table = shown.table(asks)
            same = np.minimum(np.searchsorted(ids, self.ids[own]), len(ids) - 1)
            mine = np.flatnonzero(ids[same] == self.ids[own])
            some = [self._candidates(own, table, mine, same[mine], w, c, min(c + columns, len(ids))) for c in range(0, len(ids), columns)]
            r, at = (np.concatenate(x) for x in zip(*some, strict=True))
            # rough distances have only left out what can't be among the k best
            cost = squared_pairs(asks[r], v[at])
            if self.weighted:
                cost *= factor(self.w[own[r]], w[at])
            keep = cost <= self.limit[own[r]]
            r, at, cost = r[keep], at[keep], cost[keep]
            if len(r) == 0:
                continue
            touched = np.unique(r)
            old = own[touched]
            cost = np.concatenate([self.cost[old].ravel(), cost])
            other = np.concatenate([self.other[old].ravel(), ids[at]])
            of = np.concatenate([np.repeat(touched, self.k), r])
            order = np.lexsort((other, cost, of))
            cost, other, of = cost[order], other[order], of[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            keep = place < self.k
            self.cost[own[of[keep]], place[keep]], self.other[own[of[keep]], place[keep]] = cost[keep], other[keep]
            self.limit[old] = np.minimum(self.limit[old], self.cost[old, self.k - 1])

    def _candidates(self, own: np.ndarray, table: _Table, mine: np.ndarray, same: np.ndarray, w: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of own, point) of all pairs of points lo to hi that can be among the k best, and of few others. mine: rows of own which
        are the points `same` themselves."""
        wa, wb = self.w[own], w[lo:hi]
        alike = not self.weighted or wb.min() == wb.max()
        for exact in (False, True):
            d, off, eps = table.distances(lo, hi, exact)
            limit = self.limit[own]
            if self.weighted and alike:
                limit = limit / factor(wa, wb[0])
            elif self.weighted:
                d /= np.add.outer((1 / wa).astype(d.dtype), (1 / wb).astype(d.dtype))
                off = off * factor(wa, wb.max())  # a factor grows with both weights
            inside = (same >= lo) & (same < hi)
            d[mine[inside], same[inside] - lo] = np.inf
            opened = ~np.isfinite(limit)
            if opened.any():
                k = min(self.k, hi - lo)
                limit = limit.copy()
                limit[opened] = np.partition(d[opened], k - 1, axis=1)[:, k - 1] + off[opened]
            most = float(np.finfo(d.dtype).max)
            with np.errstate(over="ignore"):
                limit = np.minimum((limit + off) * (1 + 16 * eps), most).astype(d.dtype)
            hit = _hits(d <= limit[:, None])
            if exact or table.exact or len(hit) <= 4096 + 4 * self.k * len(own):
                break  # else the table's numbers are too rough for how near these rows lie
        r, at = np.divmod(hit, hi - lo)
        return r, at + lo

    def found(self) -> pa.Table:
        """LISTS, a row for each row that has found anything; `computed` stands in the first alone, with a null id if need be."""
        n = np.isfinite(self.cost).sum(axis=1)
        r = np.flatnonzero(n)
        ids = pa.array(self.ids[r], pa.int64())
        if len(r) == 0:
            if not self.computed:
                return nothing(LISTS)
            ids, n, r = pa.array([None], pa.int64()), np.zeros(1, dtype=np.int64), np.zeros(0 if len(self.ids) == 0 else 1, dtype=np.int64)
        else:
            n = n[r]
        keep = np.isfinite(self.cost[r])
        computed = np.zeros(len(ids), dtype=np.int64)
        computed[:1] = self.computed
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pa.table([ids, pa.ListArray.from_arrays(ends, pa.array(self.other[r][keep], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(self.cost[r][keep])), pa.array(computed)], ["id", "other", "cost", "computed"])


def _of(numbers: np.ndarray, at: Column) -> Column:
    """numbers[at], for a column of places."""
    return F.element_at(F.expr(f"array({', '.join(map(str, numbers.tolist()))})"), at + 1)


def nothing(schema: str) -> pa.Table:
    return pa.table([pa.array([], {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[x.split()[1]]) for x in schema.split(", ")], [x.split()[0] for x in schema.split(", ")])


def _look(search: _Search, cells: Cells, ids: np.ndarray, v: np.ndarray, w: np.ndarray, cell: np.ndarray, seen: np.ndarray | None = None) -> None:
    """Show the points of a block or place to the search, cell by cell, the nearest cells of each group of rows first. seen: for each
    row of the search a cell that it knows."""
    order = np.lexsort((ids, cell))
    ids, v, w, cell = ids[order], v[order], w[order], cell[order]
    own, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    away, at_most = _away(search.v, cells.pivots[own])
    bounds = np.column_stack([search.least(away[:, j], at_most[:, j], cells.near[c], cells.far[c], cells.light[c]) for j, c in enumerate(own)])
    turn, i, together = np.argsort(bounds.min(axis=0), kind="stable"), 0, 1
    if seen is not None:
        bounds[seen[:, None] == own[None]] = np.nan
    sizes = ends - first
    while i < len(turn):
        # cells that nearly the same rows look into are shown at once, ever more of them as the limits come down
        some = turn[i : i + together]
        wanted = bounds[:, some] <= search.limit[:, None]
        asked = np.logical_or.accumulate(wanted, axis=1).sum(axis=0) * np.cumsum(sizes[some])
        close = np.cumsum(wanted.sum(axis=0) * sizes[some]) >= 0.9 * asked
        n = int(np.argmin(close)) if not close.all() else len(some)
        n = max(n, 1)
        if seen is None:
            rows, hide = np.flatnonzero(wanted[:, :n].any(axis=1)), None
        else:  # rows that know one of the cells must not see it again
            known = np.isin(seen, own[some[:n]])
            rows, hide = np.flatnonzero(wanted[:, :n].any(axis=1) & ~known), np.flatnonzero(wanted[:, :n].any(axis=1) & known)
        shown = np.concatenate([np.arange(first[j], ends[j]) for j in some[:n]])
        if len(rows):
            at = shown[np.argsort(ids[shown])] if n > 1 else shown
            search.see(rows, ids[at], v[at], w[at])
        if hide is not None and len(hide) and n > 1:
            for c in np.unique(seen[hide]):
                at = shown[cell[shown] != c]
                at = at[np.argsort(ids[at])]
                search.see(hide[seen[hide] == c], ids[at], v[at], w[at])
        i, together = i + n, min(32, 2 * together)


def lists(placed: DataFrame, cells: Cells, width: int, n: int, asking: int, k: int, weighted: bool, most: int) -> DataFrame:
    """LISTS: for each of the n points (id, v, w, asks, __cell, __far) with `asks`, `asking` at most, its k nearest others, nearest
    first, ties by smaller id. A point without others has no row; rows with a null id hold but `computed`."""
    block = _of(cells.block, F.col("__cell"))
    placed = placed.select("id", "v", "w", "asks", "__cell", block.alias("__block"))
    part = F.pmod(F.xxhash64("id", F.lit(6)), _of(cells.parts, F.col("__block"))).cast("int")

    def inside(t: pa.Table) -> _Search | None:
        ids, v, w, cell = t.column("id").to_numpy(), matrix(t.column("v"), width), t.column("w").to_numpy(), t.column("__cell").to_numpy()
        own = np.flatnonzero(t.column("asks").to_numpy(zero_copy_only=False).astype(bool))
        if len(own) == 0:
            return None
        search = _Search(ids[own], v[own], w[own], k, weighted)
        for c in np.unique(cell[own]):
            mine = np.flatnonzero(cell == c)
            mine = mine[np.argsort(ids[mine])]
            search.see(np.flatnonzero(cell[own] == c), ids[mine], v[mine], w[mine])
        _look(search, cells, ids, v, w, cell, cell[own])
        return search

    in_block = placed.withColumn("__part", part).groupBy("__block", "__part")
    if len(cells.parts) == 1 and cells.parts[0] == 1:
        return in_block.applyInArrow(lambda t: s.found() if (s := inside(t)) else nothing(LISTS), LISTS)

    limited = "id long, v array<double>, w double, limit double, computed long"

    def limits(t: pa.Table) -> pa.Table:
        search = inside(t)
        if search is None:
            return t.select(["id", "v", "w"]).slice(0, 0).append_column("limit", pa.array([], pa.float64())).append_column("computed", pa.array([], pa.int64()))
        t = t.filter(t.column("asks")).select(["id", "v", "w"])
        computed = np.zeros(t.num_rows, dtype=np.int64)
        computed[:1] = search.computed
        return t.append_column("limit", pa.array(search.limit)).append_column("computed", pa.array(computed))

    asks = in_block.applyInArrow(limits, limited)
    first = np.concatenate([[0], np.cumsum(cells.place_parts)])

    @F.pandas_udf("array<int>")
    def where(v: pd.Series, w: pd.Series, limit: pd.Series) -> pd.Series:
        v, limit = np.array([np.asarray(x, dtype=float) for x in v]).reshape(len(w), width), limit.to_numpy(dtype=float)
        search = _Search(np.arange(len(w)), v, w.to_numpy(dtype=float), k, weighted)
        away, at_most = _away(v, cells.pivots)
        bounds = np.full((len(w), len(cells.place_parts)), np.inf)
        for c in np.flatnonzero(cells.far >= 0):
            bounds[:, cells.place[c]] = np.minimum(bounds[:, cells.place[c]], search.least(away[:, c], at_most[:, c], cells.near[c], cells.far[c], cells.light[c]))
        visit = np.repeat(bounds <= limit[:, None], cells.place_parts, axis=1)
        return pd.Series([np.flatnonzero(x).astype(np.int32) for x in visit])

    shares = max(1, -(-asking // (SHARE * most)))
    share = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(shares)).cast("int")
    asks = asks.select("id", "v", "w", "limit", "computed", share.alias("__share"), F.posexplode(where("v", "w", "limit")).alias("__n", "__to"))
    asks = asks.withColumn("computed", F.when(F.col("__n") == 0, F.col("computed")).otherwise(0)).drop("__n")
    place = _of(cells.place, F.col("__cell"))
    to = _of(first, place) + F.pmod(F.xxhash64("id", F.lit(7)), _of(cells.place_parts, place))
    held = placed.select("id", "v", "w", "__cell", to.cast("int").alias("__to"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__share"))

    def outside(asks: pa.Table, held: pa.Table) -> pa.Table:
        if asks.num_rows == 0 or held.num_rows == 0:
            return nothing(LISTS)
        search = _Search(asks.column("id").to_numpy(), matrix(asks.column("v"), width), asks.column("w").to_numpy(), k, weighted, asks.column("limit").to_numpy())
        search.computed = int(asks.column("computed").to_numpy().sum())
        _look(search, cells, held.column("id").to_numpy(), matrix(held.column("v"), width), held.column("w").to_numpy(), held.column("__cell").to_numpy())
        return search.found()

    found = asks.groupBy("__to", "__share").cogroup(held.groupBy("__to", "__share")).applyInArrow(outside, LISTS)
    # each place has given its k best; of these the k best of all
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("cost", "other")))), 1, k)
    return found.groupBy("id").agg(best.alias("b"), F.sum("computed").alias("computed")).select("id", F.col("b.other").alias("other"), F.col("b.cost").alias("cost"), "computed")


def nearest(points: DataFrame, width: int, k: int = 1, weighted: bool = False, per_cell: int = 64, most: int = 8192) -> DataFrame:
    """FOUND: for each of the points (id, v, w, asks) with `asks` its k nearest others, rank from 0, ties by smaller id.

    v: array of `width` doubles; those that aren't numbers make a distance the largest. Ids differ. weighted: cost is the
    squared distance times factor() of both weights, else the squared distance alone. computed: its sum over all rows (rows
    with a null id among them) is how many distances were looked at. A point without others has no row. Exact at every
    size; blocks of about `most` rows.
    """
    points = written(points.select("id", "v", F.col("w").cast("double").alias("w"), "asks"))
    n = points.count()
    pivots = pivots_of(points, width, n, per_cell)
    placed = written(with_cells(points, pivots))
    found = lists(placed, cells_of(placed, pivots, most), width, n, n, k, weighted, most)
    one = F.posexplode_outer(F.arrays_zip("other", "cost")).alias("rank", "x")
    rows = found.select("id", one, "computed")
    return rows.select("id", "rank", F.col("x.other").alias("other"), F.col("x.cost").alias("cost"), F.when(F.coalesce("rank", F.lit(0)) == 0, F.col("computed")).otherwise(F.lit(0)).cast("long").alias("computed"))
