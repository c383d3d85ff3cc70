"""Operator 6, token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file is a series of blocks. A block holds the ids of consecutive documents as one array and the documents' ends as
an Elias-Fano sequence: the lower bits of each end packed, the upper bits as a bit set of unary gaps, and the place of
every 64th one stored, so that select looks at a short stretch only. That takes about 2.5 + log2(ids / documents)
bits for a document instead of 64. Readers get offsets by select, of one document or of a range of them. Blocks are self-contained bytes; Spark's writer puts them into Parquet files, which
any store that Spark reaches can take, and which a lost task simply writes again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

MAGIC, SAMPLE = b"IDE2", 64
_HEAD = struct.Struct("<4sBBxxQQQ")  # magic, bytes of an id, lower bits of an end, documents, ids, bytes of upper bits


class EliasFano:
    """A non-decreasing sequence of numbers in near-minimal space, with select.

    samples: the place in the upper bits of every 64th one bit, 32 bits each, so half a bit for a number.
    """

    def __init__(self, low_bits: int, n: int, low: bytes, high: bytes, samples: bytes):
        self.low_bits, self.n = low_bits, n
        self.low, self.high, self.samples = (np.frombuffer(x, dtype=t) for x, t in ((low, np.uint8), (high, np.uint8), (samples, "<u4")))

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """Lower bits' width, lower bits, upper bits, samples."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).reshape(-1)
        high = np.zeros((top >> width) + n + 1, dtype=np.uint8)
        ones = (values >> width) + np.arange(n)
        high[ones] = 1
        return width, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """The value number i, from the sample before its one bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        bits = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := bits.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        at, value = i * self.low_bits, 8 * byte + (bits & -bits).bit_length() - 1 - i << self.low_bits
        for k in range(self.low_bits):
            value |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return value

    def between(self, lo: int, hi: int) -> np.ndarray:
        """The values from number lo up to hi; only their stretch is unpacked, from the sample before it to the one behind."""
        if hi <= lo:
            return np.empty(0, dtype=np.int64)
        first, behind = lo // SAMPLE, -(-hi // SAMPLE)
        start = int(self.samples[first]) >> 3
        end = (int(self.samples[behind]) >> 3) + 1 if behind < len(self.samples) else len(self.high)
        skip = int(self.samples[first]) & 7
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")[skip:])[lo - first * SAMPLE : hi - first * SAMPLE] + 8 * start + skip
        at = lo * self.low_bits
        bits = np.unpackbits(self.low[at >> 3 : -(-hi * self.low_bits // 8)], bitorder="little")[at & 7 :][: (hi - lo) * self.low_bits]
        low = bits.reshape(hi - lo, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (ones - np.arange(lo, hi) << self.low_bits) + low


def to_block(documents: list[bytes], id_bytes: int) -> bytes:
    """One block from the documents' ids (little-endian uint32 each)."""
    ends = np.cumsum([len(d) // 4 for d in documents], dtype=np.int64)
    width, low, high, samples = EliasFano.encode(ends)
    ids = np.frombuffer(b"".join(documents), dtype="<u4").astype(f"<u{id_bytes}").tobytes()
    return _HEAD.pack(MAGIC, id_bytes, width, len(documents), int(ends[-1]) if len(ends) else 0, len(high)) + samples + low + high + ids


class Block:
    """A block read back: document i is ids[start(i) : start(i + 1)]."""

    def __init__(self, data: bytes):
        magic, id_bytes, width, n, total, high = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        sizes = (4 * -(-n // SAMPLE), -(-n * width // 8), high)
        at = np.cumsum([_HEAD.size, *sizes]).tolist()
        samples, low, upper = (data[i:j] for i, j in zip(at[:-1], at[1:], strict=True))
        self.ends = EliasFano(width, n, low, upper, samples)
        self.ids = np.frombuffer(data, dtype=f"<u{id_bytes}", count=total, offset=at[-1])

    def __len__(self) -> int:
        return self.ends.n

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def starts(self, lo: int, hi: int) -> np.ndarray:
        """Where the documents lo..hi - 1 start, and where the last of them ends."""
        return self.ends.between(lo - 1, hi) if lo else np.concatenate([[0], self.ends.between(0, hi)])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.start(i + 1)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, pattern: str, end: int = 2, id_bytes: int = 2, block_ids: int = 1 << 18, per_file: int = 32 << 20, parts: int | None = None) -> None:
    """Encode every whole text, append the id `end`, and write the ids in ascending doc_id order.

    Null texts are empty; null doc_ids come first; rows of one doc_id are ordered by their text. Rows are dealt by ranges
    of (doc_id, a hash of the text), so that many rows of one doc_id spread too, into `parts` files: unless given, as many
    as bring about `per_file` bytes of text to each, and not fewer than the session's cores. A block is closed at the first
    document end at or after `block_ids` ids: a very long document has a block to itself. id_bytes: 2 suits vocabularies of
    up to 65,536 ids, 4 all others.
    """
    n = parts or max(docs.sparkSession.sparkContext.defaultParallelism, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // per_file))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer, pattern), np.array([end], dtype="<u4").tobytes()
        part, number, base, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            values = ([part], [number], [base], [size], [names[0]], [names[-1]], [names], [to_block(held, id_bytes)])
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "base", "n_ids", "first_doc", "last_doc", "doc_ids", "data"])

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(encode(text) + last)
                names.append(doc)
                size += len(held[-1]) // 4
                if size >= block_ids:
                    yield close()
                    number, base, size, held, names = number + 1, base + size, 0, [], []
        if held:
            yield close()

    schema = "part int, block int, base long, n_ids long, first_doc long, last_doc long, doc_ids array<long>, data binary"
    rows.mapInArrow(run, schema).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `first`, the ids before their file: totals by file, one row for each, are added up."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return blocks.join(F.broadcast(first), "part")


_READ = "doc_id long, start long, n_tokens long, ids binary"


def _documents(row: dict, block: Block, starts: np.ndarray, names: list) -> pa.RecordBatch:
    ids = [block.ids[i:j].astype("<u4").tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    columns = (names, starts[:-1] + row["base"] + row["first"], np.diff(starts))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) for each document of the files: start counts the ids of all documents before it.

    A block is read in ranges of documents, each selected by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(c)[0].as_py() for c in ("doc_ids", "base", "first", "data")}
            block = Block(row["data"])
            for lo in range(0, len(block), 512):
                hi = min(lo + 512, len(block))
                yield _documents(row, block, block.starts(lo, hi), row["doc_ids"][lo:hi])

    return _blocks(spark, path).mapInArrow(run, _READ)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The same for a few documents by their ids: blocks are pruned by the least and greatest doc_id in them, and of those
    that are read only the documents asked for are selected. Ids that aren't there give no row; repeated ones give each."""
    wanted = sorted(set(doc_ids))
    within = [(F.col("first_doc") <= x) & (F.col("last_doc") >= x) for x in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(c)[0].as_py() for c in ("doc_ids", "base", "first", "data")}
            block, asked = Block(row["data"]), set(wanted)
            for i, name in enumerate(row["doc_ids"]):
                if name in asked:
                    yield _documents(row, block, np.array([block.start(i), block.start(i + 1)]), [name])

    return _blocks(spark, path).where(reduce(or_, within, F.lit(False))).mapInArrow(run, _READ)


def crc32(ids: str = "ids"):
    """Unsigned crc32 of the ids' bytes."""
    return F.crc32(F.col(ids))


def checksum(ids: bytes) -> int:
    """The same outside Spark."""
    return zlib.crc32(ids)
