"""Whole groups of rows that reach a task sorted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, and the number of rows; nulls are equal."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def runs_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of these; a group that goes on in the next batch is held back until then."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and all(held[0].column(k)[0].as_py() == batch.column(k)[batch.num_rows - 1].as_py() for k in keys):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = bounds(table, keys)
        last = int(at[-2])
        if last:
            yield table.slice(0, last).combine_chunks(), at[:-1]
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table, keys)
