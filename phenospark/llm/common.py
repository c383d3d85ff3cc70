"""What the operators share: cutting lineage, reading words, splitting large groups into blocks."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six; bytes.split() without an argument splits at exactly them.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; only a local session may get its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="phenospark-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute once, into the shared checkpoint folder: later jobs neither repeat the work nor depend on an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def row_hash(*cols: str):
    """64-bit identity of a row; rows that agree in these columns share it, and share every result below."""
    return F.xxhash64(*[F.col(c) for c in cols])


def give_back() -> None:
    """Return what earlier tasks of this worker freed to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that few texts are Python objects at a time."""
    give_back()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class WordHashes:
    """64-bit hashes of words (bytes), remembered for as many distinct words as fit in `room`."""

    def __init__(self, room: int = 300_000, second: bool = False):
        self.room, self.second = room, second
        self._of: dict[bytes, int] = _Codes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """One hash for each word; with `second`, a second independent row."""
        if len(self._of) > self.room:
            self._of = _Codes()
        codes = np.fromiter(map(self._of.__getitem__, words), dtype=np.int64, count=len(words))
        table = self._of.table(self.second)
        return table[:, codes] if self.second else table[0, codes]


class _Codes(dict):
    """Word to the number of its column in a table of hashes."""

    def __init__(self):
        super().__init__()
        self._digests: list[bytes] = []
        self._table = np.empty((2, 0), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        self._digests.append(hashlib.blake2b(word, digest_size=16).digest())
        self[word] = code = len(self._digests) - 1
        return code

    def table(self, second: bool) -> np.ndarray:
        have = self._table.shape[1]
        if have < len(self._digests):
            new = np.frombuffer(b"".join(self._digests[have:]), dtype="<u8").reshape(-1, 2).T
            grown = np.empty((2, max(1024, len(self._digests) * 3 // 2)), dtype=np.uint64)
            if not hasattr(self, "_room") or self._room.shape[1] < len(self._digests):
                grown[:, :have] = self._table
                self._room = grown
            self._room[:, have : len(self._digests)] = new
            self._table = self._room[:, : len(self._digests)]
        return self._table


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def blocks_of_groups(members: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Deal groups of any size into pairs of blocks.

    A group of up to `block` members stays one block. A larger one is split by a hash of the member into
    b = ceil(size / block) blocks, and each member goes to the b block pairs that it is part of, so that every
    pair of members meets in exactly one (lo, hi). Groups of one member are left out.
    Adds: lo, hi, own (the member's block).
    """
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    parts = F.ceil(F.col("_size") / F.lit(float(block))).cast("int")
    out = members.join(size, keys).withColumn("_parts", parts)
    out = out.withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(77)), F.col("_parts")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return out.select("*", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi")).drop("_size", "_parts", "_other")


def runs_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that arrive sorted by `keys`: a table, and the bounds of its groups.

    A group that goes on in the next batch is held back until it is complete.
    """
    give_back()
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, dtype=bool)
        change[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    def join(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            held.append(batch)
            continue
        table = join([*held, batch])
        at = bounds(table)
        last = int(at[-2])
        if last:
            yield table.slice(0, last), at[:-1]
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = join(held)
        yield table, bounds(table)


class Forest:
    """Union-find over the numbers 0..n-1 (for the members of one block)."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() named, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
