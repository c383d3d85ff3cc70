"""Operator 5, substring dedup: difference-cover anchors.

Whether a window of `length` words occurs twice is asked of few positions first. With a difference cover D of the
period v, any two positions p and q have a shift d < v for which p + d and q + d are both, modulo v, in D. So two equal
windows, wherever they stand in their documents, hold an equal anchor, length - v + 1 words long, that begins at a cover
position in both. Only anchors at cover positions (5 of 21) are hashed and brought together; positions whose anchors
recur are extended to the windows around them, and only those windows are compared as wholes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, cut, mix64, row_hash, slices

#: Perfect difference sets: every non-zero residue is one difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOCAL = np.uint32(0xFFFFFFFF)
_ROWS = "kind byte, bucket int, batch long, keys binary, more binary, at binary"


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            ones = np.ones(self.n, dtype=np.uint64)
            ones[1:] = _BASE
            self.up = np.cumprod(ones)
            ones[1:] = _BACK
            self.down = np.cumprod(ones)
        return self.up, self.down


_powers = _Powers()


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` values from each position on (polynomial modulo 2**64)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return mix64((total[length:] - total[:-length]) * down[:n])


def _emit(keys: np.ndarray, more: np.ndarray | None, at: np.ndarray, rids: np.ndarray, starts: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of one batch of documents, each key at most once.

    kind 0: keys of a bucket with the places that have them, or _LOCAL for a key that this batch has twice itself;
    kind 1: the places of such keys; kind 2: which documents the places belong to.
    """
    batch = int.from_bytes(hashlib.blake2b(rids.tobytes() + starts.tobytes() + at[:64].tobytes(), digest_size=8).digest(), "little", signed=True)
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    key = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    order = np.argsort(key, kind="stable") if more is None else np.lexsort((more, key))
    key, at = key[order], at[order].astype(np.uint32)
    more = None if more is None else more[order].astype(np.uint32)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    if more is not None:
        first[1:] |= more[1:] != more[:-1]
    group = np.cumsum(first) - 1
    twice = np.bincount(group, minlength=1)[group] > 1 if len(key) else first
    if twice.any():
        yield 1, batch % buckets, batch, b"", b"", at[twice].tobytes()
    at = np.where(twice, _LOCAL, at)[first]
    key, more = key[first], None if more is None else more[first]
    of = (key >> np.uint64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else [], len(of)).astype(np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield 0, int(of[lo]), batch, (key[lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), b"" if more is None else more[lo:hi].astype("<u4").tobytes(), at[lo:hi].tobytes()
    if len(key):
        yield 2, batch % buckets, batch, rids.astype("<i8").tobytes(), b"", starts.astype("<u4").tobytes()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "bucket", "batch", "keys", "more", "at"])


def runs(at: np.ndarray, before: int) -> np.ndarray:
    """The positions from `before` ahead of each of `at` (ascending) up to it, as (first, last + 1) of each run."""
    first, last = np.maximum(at - before, 0), at + 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = first[1:] > last[:-1]
    return np.column_stack([first[new], last[np.append(new[1:], True)]])


def marked(found: bytes, n: int, more: int) -> np.ndarray:
    """Which of n words lie in runs that are lengthened by `more`."""
    edge = np.zeros(n + 1, dtype=np.int32)
    r = np.frombuffer(found, "<u4").astype(np.int64).reshape(-1, 2)
    np.add.at(edge, np.minimum(r[:, 0], n), 1)
    np.add.at(edge, np.minimum(r[:, 1] + more, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _recurring(emitted: DataFrame, before: int) -> DataFrame:
    """(rid, found): for each document the word positions whose keys occur at least twice anywhere, as runs (uint32 pairs),
    each with the `before` positions ahead of it."""

    def compare(table: pa.Table) -> pa.Table:
        kind, batch = table.column("kind").to_numpy(), table.column("batch").to_numpy()
        keys, more, at = (table.column(c).to_pylist() for c in ("keys", "more", "at"))
        out = [(int(k), int(b), x, y) for k, b, x, y in zip(kind, batch, keys, at, strict=True) if k]
        own = np.flatnonzero(kind == 0)
        if len(own):
            k = np.concatenate([np.frombuffer(keys[i], "<u4") for i in own])
            p = np.concatenate([np.frombuffer(at[i], "<u4") for i in own])
            b = np.repeat(own, [len(at[i]) // 4 for i in own])
            if any(more[i] for i in own):
                m = np.concatenate([np.frombuffer(more[i], "<u4") for i in own])
                order = np.lexsort((m, k))
                m = m[order]
            else:
                m, order = None, np.argsort(k, kind="stable")
            k, p, b = k[order], p[order], b[order]
            same = np.zeros(len(k) + 1, dtype=bool)
            same[1:-1] = k[1:] == k[:-1] if m is None else (k[1:] == k[:-1]) & (m[1:] == m[:-1])
            group = np.cumsum(~same[:-1]) - 1
            local = np.zeros(group[-1] + 1, dtype=bool)
            local[group[p == _LOCAL]] = True
            found = (same[:-1] | same[1:] | local[group]) & (p != _LOCAL)
            p, b = p[found], b[found]
            order = np.argsort(b, kind="stable")
            p, b = p[order], b[order]
            edges = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b)) if len(b) else np.zeros(1, int)
            out += [(1, int(batch[b[lo]]), b"", p[lo:hi].tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int8(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "batch", "keys", "at"])

    def gather(table: pa.Table) -> pa.Table:
        kind, keys, at = (table.column(c).to_pylist() for c in ("kind", "keys", "at"))
        places = [np.frombuffer(a, "<u4") for k, a in zip(kind, at, strict=True) if k == 1]
        names = next(((np.frombuffer(x, "<i8"), np.frombuffer(a, "<u4")) for k, x, a in zip(kind, keys, at, strict=True) if k == 2), None)
        rid, out = [], []
        if places and names:
            p = np.unique(np.concatenate(places))
            of = np.searchsorted(names[1], p, side="right") - 1
            edges = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(p))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rid.append(int(names[0][of[lo]]))
                out.append(runs(p[lo:hi].astype(np.int64) - int(names[1][of[lo]]), before).astype("<u4").tobytes())
        return pa.table([pa.array(rid, pa.int64()), pa.array(out, pa.binary())], ["rid", "found"])

    compared = emitted.groupBy("bucket").applyInArrow(compare, "kind byte, batch long, keys binary, at binary")
    found = compared.groupBy("batch").applyInArrow(gather, "rid long, found binary")
    # rows that repeat have one rid and the same runs
    return found.groupBy("rid").agg(F.min("found").alias("found"))


def repeated_windows(docs: DataFrame, length: int = 35, period: int = 21, batch_words: int = 1 << 19, per_bucket: int = 1 << 20) -> DataFrame:
    """(rid, found): the starts of all windows of `length` words that start anywhere else too, as runs (uint32 pairs).

    docs: __rid, __text (bytes) and whatever else, read from files (a task that runs again must see its rows in the same
    order). Compares anchors by 32 bits inside their bucket (what they let through by chance is only compared again), and
    windows by 64 bits inside theirs. A passage of a third of all documents is one key of its bucket, sent
    once by each batch of about `batch_words` words. Keys are dealt into as many buckets as hold `per_bucket` each on
    average. Memory of a task: one batch, or one bucket.
    """
    if period not in COVERS or length < period:
        raise ValueError(f"the period must be one of {sorted(COVERS)} and not above {length}")
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS[period])] = True
    anchor = length - period + 1
    chars = docs.agg(F.sum(F.octet_length("__text")).alias("n")).first()["n"] or 0
    buckets = max(32, int(chars / 6 * len(COVERS[period]) / period / per_bucket) + 1)

    def batches_of(batches: Iterator[pa.RecordBatch], second: bool, *columns: str) -> Iterator[list]:
        hashes = WordHashes(second=second)
        held, size = [], 0
        for b in slices(batches):
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                words = (row[1] or b"").split()
                if len(words) >= length:
                    held.append((row[0], hashes(words), *row[2:]))
                    size += len(words)
                if size >= batch_words:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def starts_of(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([x[1].shape[-1] for x in held])
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        left = np.repeat(sizes, sizes) - inside  # words from here to the end of the document
        return np.array([x[0] for x in held], dtype=np.int64), starts, inside, left

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches, False, "__rid", "__text"):
            rids, starts, inside, left = starts_of(held)
            at = np.flatnonzero(cover[inside % period] & (left >= anchor))
            keys = window_hashes(np.concatenate([x[1] for x in held]), anchor)[at]
            yield _record(list(_emit(keys, None, at, rids, starts, buckets)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches, True, "__rid", "__text", "__found"):
            rids, starts, inside, left = starts_of(held)
            possible = np.concatenate([marked(x[2], x[1].shape[-1], 0) for x in held])
            at = np.flatnonzero(possible & (left >= length))
            if len(at):
                both = [window_hashes(np.concatenate([x[1][i] for x in held]), length)[at] for i in (0, 1)]
                yield _record(list(_emit(*both, at, rids, starts, buckets)))

    candidates = cut(_recurring(docs.select("__rid", "__text").mapInArrow(anchors, _ROWS), length - anchor))
    # a merge join hands rows over sorted by rid: a task that runs again forms the same batches
    rows = docs.join(candidates.select(F.col("rid").alias("__rid"), F.col("found").alias("__found")).hint("merge"), "__rid").mapInArrow(windows, _ROWS)
    return _recurring(rows, 0)


def dedup_substrings(docs: DataFrame, length: int = 35, period: int = 21, text: str = "text", kept: str = "kept_text") -> DataFrame:
    """Adds n_words, n_removed and `kept` to each row: the text without the words of windows that start elsewhere too.

    Words are whatever stands between blanks, tabs, line ends, vertical tabs and form feeds, taken unchanged; kept words
    are joined by one blank. Windows are judged on the texts as given, and the same document counts as elsewhere. Null
    and empty texts have no words; texts of fewer than `length` words lose none; rows that repeat all lose what they
    share. A 64-bit hash of doc_id and text stands for a row. Columns of these names in the input are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", kept)]
    rows = docs.select(*rest, F.coalesce(text, F.lit("")).cast("binary").alias("__text"), row_hash("doc_id", text).alias("__rid"))
    # both joins of the texts ask for the same columns dealt by the same key, so that the texts are shuffled once
    found = repeated_windows(rows, length, period).select(F.col("rid").alias("__rid"), F.col("found").alias("__found"))
    rows = rows.join(found.hint("shuffle_hash"), "__rid", "left").select(*rest, "__text", "__rid", "__found")
    names = [*rest, "n_words", "n_removed", kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, removed, left = [], [], []
            for x, found in zip(b.column("__text").to_pylist(), b.column("__found").to_pylist(), strict=True):
                words = x.split()
                n.append(len(words))
                if found:
                    gone = marked(found, len(words), length - 1)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                left.append(b" ".join(words))
            arrays = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *arrays], names)

    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(kept, T.StringType())])
    return rows.mapInArrow(run, schema)
