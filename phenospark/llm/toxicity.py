"""Operator 3, toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams, each multiplied by the log of the ratio of its smoothed document rates in the
two classes; logistic regression on these (Wang and Manning 2012). The model is fitted on a bounded sample of labelled
rows; its size depends on the number of hash buckets alone. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices


@dataclass(frozen=True)
class Features:
    """Hashed n-grams of the lower-cased text, white space runs as one blank."""

    shortest: int = 3
    longest: int = 5
    bits: int = 18

    def of(self, text: str | None, seen: np.ndarray) -> np.ndarray:
        """The distinct bucket numbers of one whole text. seen: an int32 array of 2**bits entries, reused."""
        s = " " + " ".join((text or "").lower().split()) + " "
        c = np.frombuffer(s.encode("utf-32-le"), dtype="<u4")
        h, found = c.astype(np.uint32), []
        for n in range(2, self.longest + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
            if n >= self.shortest:
                x = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
                x = x * np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(13)
                x = x * np.uint32(0xC2B2AE35)
                found.append(x >> np.uint32(32 - self.bits))
        if not found:
            return np.empty(0, dtype=np.uint32)
        f = np.concatenate(found)
        place = np.arange(len(f), dtype=np.int32)
        seen[f] = place
        return f[seen[f] == place]


@dataclass(frozen=True)
class Model:
    """Weights of the buckets (already times their ratios) and intercept."""

    features: Features
    weights: np.ndarray
    bias: float


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int]) -> DataFrame:
    """(text, y, n0, n1, place) of at most per_class[k] rows of each class k, those with the lowest hashes of doc_id, then of text.

    labels: doc_id and `label` (0 or 1; others and nulls are left out; of several labels of one document the largest
    holds). n0, n1: how many labelled documents there are of each class; place: a hash to order by. Rows that agree in doc_id and text count once. As
    the sample is bounded by `per_class`, however many rows share a doc_id, it may be broadcast, which keeps the texts in place.
    """
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    one = cut(one.withColumn("h", F.xxhash64("doc_id", F.lit(11))))
    n = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def lowest(rows: DataFrame, *order: str) -> DataFrame:
        picked = [rows.where(F.col("y") == k).orderBy(*order).limit(per_class[k]) for k in (0, 1)]
        return cut(picked[0].unionByName(picked[1]))

    def likely(k: int) -> Column:  # leaves the sort few rows to look at
        return (F.col("y") != k) | (F.pmod(F.col("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * per_class[k] / max(1, n.get(k, 0)))))

    ids = lowest(one.where(likely(0) & likely(1)), "h", "doc_id")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    texts = own.select("doc_id", "t").join(F.broadcast(ids), "doc_id").distinct()
    texts = lowest(texts, "h", "doc_id", "t").select("doc_id", "t", "y")
    rows = own.join(F.broadcast(texts), ["doc_id", "t"]).groupBy("doc_id", "t", "y").agg(F.first("text").alias("text"))
    return rows.select("text", "y", F.lit(n.get(0, 0)).cast("long").alias("n0"), F.lit(n.get(1, 0)).cast("long").alias("n1"), F.xxhash64("doc_id", "t").alias("place"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = (4000, 2000), features: Features = Features(), least_rows: int = 3, penalty: float = 3.0) -> Model:
    """Fit on a sample of `labels`, at most per_class[0] rows of class 0 and per_class[1] of class 1 (a documented
    bound; which rows depends on hashes of doc_id and text alone). Sampling one class more thinly than the other is made up
    for in the intercept. Without labelled rows of both classes the model is constant: the share of class 1, or 0.
    The fit runs in one task, on the distinct buckets of so many texts: 4 bytes for each, at most 2**bits for a text.
    """
    sample = training_sample(docs, labels, label, per_class)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << features.bits, dtype=np.int32)
        for b in slices(batches):
            ids = [zlib.compress(np.diff(np.sort(features.of(x, seen)).astype("<u4"), prepend=np.uint32(0)).tobytes(), 1) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *b.columns[1:]], ["ids", "y", "n0", "n1", "place"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, y, known = [], [], (0, 0)
        for b in slices(batches):
            rows_ = [np.cumsum(np.frombuffer(zlib.decompress(x), "<u4"), dtype=np.int32) for x in b.column(0).to_pylist()]
            chunks.append((np.concatenate(rows_), np.array([len(r) for r in rows_])))
            y.append(b.column(1).to_numpy().astype(np.float64))
            known = (b.column(2)[0].as_py(), b.column(3)[0].as_py())
        y = np.concatenate([np.empty(0), *y])
        w, bias = regress(chunks, y, 1 << features.bits, least_rows, penalty)
        (n0, n1), m1 = known, int(y.sum())
        m0 = len(y) - m1
        bias += np.log(n1 * max(m0, 1) / (max(n0, 1) * max(m1, 1))) if n0 and n1 and m0 and m1 else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()]), pa.array([float(bias)])], ["w", "bias"])

    rows = sample.mapInArrow(extract, "ids binary, y int, n0 long, n1 long, place long")
    # the same fit in whatever order rows arrive
    model = rows.repartition(1).sortWithinPartitions("y", "place").mapInArrow(solve, "w binary, bias double").first()
    if model is None:
        return Model(features, np.zeros(1 << features.bits, dtype=np.float32), -30.0)
    return Model(features, np.frombuffer(model["w"], dtype="<f4"), model["bias"])


def regress(chunks: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, least_rows: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights on ratio-scaled presence, multiplied out, and intercept; by L-BFGS until it converges.

    chunks: of some rows each, in the order of y, their distinct buckets one behind the other (int32, overwritten), and how many
    each has. Buckets in fewer than least_rows rows get no weight; all others are scaled by their log-count ratio.
    """
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
        return np.zeros(width), float(np.log(share / (1 - share)))
    first = np.cumsum([0, *(len(n) for _, n in chunks)])
    counts = np.zeros((2, width))
    for (ids, n), i in zip(chunks, first, strict=False):
        ones = np.repeat(y[i : i + len(n)], n)
        counts[1] += np.bincount(ids, weights=ones, minlength=width)
        counts[0] += np.bincount(ids, weights=1 - ones, minlength=width)
    ratio = np.log((counts[1] + 1.0) / (y.sum() + 2.0)) - np.log((counts[0] + 1.0) / (len(y) - y.sum() + 2.0))
    ratio[counts.sum(axis=0) < least_rows] = 0.0
    used = np.flatnonzero(ratio)
    r, number = ratio[used], np.full(width, -1, dtype=np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    kept = []
    for ids, n in chunks:
        ids[:] = number[ids]
        fine = ids >= 0
        kept.append((ids[fine], np.diff(np.concatenate([[0], np.cumsum(fine)])[np.concatenate([[0], np.cumsum(n)])])))
    chunks.clear()

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[:-1], v[-1]
        wr, g, value, total = w * r, np.zeros(len(used)), 0.5 * penalty * w @ w, 0.0
        for (ids, n), i in zip(kept, first, strict=False):
            own = y[i : i + len(n)]
            z = b + np.diff(np.concatenate([[0.0], np.cumsum(wr[ids])])[np.concatenate([[0], np.cumsum(n)])])
            e = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - own
            g += np.bincount(ids, weights=np.repeat(e, n), minlength=len(used))
            value, total = value + np.sum(np.logaddexp(0.0, z) - own * z), total + e.sum()
        return value, np.append(r * g + penalty * w, total)

    v = lbfgs(loss, np.append(np.zeros(len(used)), np.log(y.mean() / (1 - y.mean()))))
    out = np.zeros(width)
    out[used] = v[:-1] * r
    return out, float(v[-1])


def lbfgs(loss, x: np.ndarray, steps: int = 1000, memory: int = 8) -> np.ndarray:
    """Minimise a smooth function that returns its value and gradient."""
    f, g = loss(x)
    s, t = [], []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for a, b in zip(reversed(s), reversed(t), strict=True):
            alphas.append((a @ d) / (a @ b))
            d -= alphas[-1] * b
        d *= (s[-1] @ t[-1]) / (t[-1] @ t[-1]) if s else 1.0 / max(1.0, np.linalg.norm(g))
        for a, b, k in zip(s, t, reversed(alphas), strict=True):
            d += a * (k - (b @ d) / (a @ b))
        size, slope = 1.0, g @ d
        if slope <= 1e-9 * max(1.0, abs(f)):
            break
        for _ in range(25):
            f2, g2 = loss(x - size * d)
            if f2 <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (g2 - g) @ (-size * d) > 1e-12:
            s, t = [*s, -size * d][-memory:], [*t, g2 - g][-memory:]
        done = f - f2 <= 1e-8 * max(1.0, abs(f))
        x, f, g = x - size * d, f2, g2
        if done:
            break
    return x


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds `out`, from 0 to 1, higher where class 1 is likelier, for every whole text; null and empty texts are scored
    by the intercept. Nothing but the text goes into it, and only the score comes back from Python. `keep`: the columns
    that go along (all, unless given); a column of the name `out` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, w, bias = shared.value
        seen = np.zeros(1 << features.bits, dtype=np.int32)
        for b in batches:
            z = np.empty(len(b))
            for i in range(len(b)):  # one text at a time is a Python object
                z[i] = bias + w[features.of(b[i].as_py(), seen)].sum(dtype=np.float64)
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))

    return docs.select(*kept, scores(F.col(text)).alias(out))
