"""What operators 2 and 10 share: which vectors take part, and classes of equal vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(v: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def hashed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, f1, f2): the vectors that take part, as doubles, with a 128-bit fingerprint."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double") + 0.0)  # -0.0 becomes 0.0
    rows = vectors.where(takes_part(embedding) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), v.alias("d"))
    return rows.select("vec_id", "v", F.xxhash64("d").alias("f1"), F.xxhash64(F.lit(7), "d", F.size("d")).alias("f2"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 0)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the lists of each length."""
    lengths = column.value_lengths().to_numpy()
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        yield own, matrix(column.take(pa.array(own)))
