"""Operator 8, MinHash near-dedup with odd sketches.

Documents with one word sequence form a class and are compared once. MinHash samples of each class's shingles give
band keys; for those that share a band, more samples are folded into an odd sketch, a bitmap of parities. The population
count of the XOR of two sketches tells how many samples differ, which drops the dissimilar; whole shingle sets then
confirm the rest. Within a band, members are first tried against its smallest one alone. Where that leaves a band with
more than one component, the members that a sketch gives hope of a link to another component are compared by their whole
sets in blocks, and a block tells only the links that join its components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, WordHashes, blocks_of_groups, cut, mix64, runs_of_groups, slices
from .graph import components
from .substrings import window_hashes


def shingle_hashes(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """The set of shingles of k words as sorted distinct 64-bit hashes; the whole sequence if it is shorter."""
    return np.unique(window_hashes(hashes(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


class Sampler:
    """MinHash samples of sets of 64-bit hashes; band keys and odd sketches made of them."""

    def __init__(self, n: int):
        draw = np.random.default_rng(20240501)
        self.flip = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.times = (draw.integers(0, 1 << 32, n, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.tag = mix64(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """One number for each sample: its least value, mixed with the sample's own number."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, ((x[None, i : i + 1024] ^ self.flip) * self.times).min(axis=1), out=least)
        return mix64(least.astype(np.uint64) ^ self.tag)


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band (int64), from consecutive samples."""
    keys = np.zeros(bands, dtype=np.uint64)
    for column in samples.reshape(bands, -1).T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """The parities of how many samples fall on each bit (as int64 words)."""
    parity = np.bincount((samples % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block's sets: a matrix product over shingles that two of them have."""
    values, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.cumsum(n > 1) - 1
    use = n[of] > 1
    rows, columns = rows[use], column[of[use]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int((n > 1).sum()), 4096):
        i, j = np.searchsorted(columns, (lo, lo + 4096))
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[rows[i:j], columns[i:j] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def most_odd_bits(similarity: float, samples: int, bits: int, deviations: float = 5.5) -> int:
    """Odd bits between two sketches that sets of at least this similarity exceed only by chance of about 1e-7.

    Of the samples 1 - similarity differ on average, up to `deviations` standard deviations more; each adds two
    elements to the symmetric difference, d elements of which make bits * (1 - (1 - 2 / bits)**d) / 2 odd bits.
    """
    differ = samples * (1 - similarity) + deviations * math.sqrt(samples * similarity * (1 - similarity))
    odd = bits * (1 - (1 - 2 / bits) ** (2 * min(differ, samples))) / 2
    return int(odd + 3 * math.sqrt(bits) / 2)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys) for each row; f1 and f2 are a fingerprint of the word sequence.

    keys is null for texts without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sample = WordHashes(), Sampler(bands * rows)
        for b in slices(batches):
            out: list[list] = [[] for _ in range(4)]
            for text in b.column(1).to_pylist():
                words = (text or b"").lower().split()  # lower-cases A-Z alone
                s = shingle_hashes(words, hashes, shingle)
                f = np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), "<i8")
                for column, x in zip(out, (len(s), f[0], f[1], band_keys(sample(s), bands) if len(s) else None), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    schema = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, shingle: int, samples: int, sketch_bits: int) -> DataFrame:
    """(doc_id, shingles array<long>, sketch array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sample = WordHashes(), Sampler(samples)
        for b in slices(batches, 64):
            sets = [shingle_hashes((x or b"").lower().split(), hashes, shingle) for x in b.column(1).to_pylist()]
            columns = [[s.view(np.int64) for s in sets], [odd_sketch(sample(s), sketch_bits) for s in sets]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], ["doc_id", "shingles", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, shingles array<long>, sketch array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, samples: int = 512, sketch_bits: int = 2048, block: int = 512, spokes: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words at blanks, tabs, line ends, vertical tabs and form feeds. Linked are
    texts whose sets of shingles of `shingle` words have 100 * intersection >= percent * union; a text of fewer words
    is one shingle; without words, or null, it links with nothing. component_id: the smallest doc_id reachable by links;
    kept: whether that is the row's own. Rows of one doc_id are one node, whatever their texts; a row without doc_id links
    with nothing and has a null component_id and kept = true.

    Two texts of similarity 0.8 share none of 32 bands of 4 rows with a chance of 5e-8. No list of pairs is made for copies
    or within a component: see the module. Groups of any size are dealt into pairs of blocks of `block` members, and what
    a block tells is one row for each member at most.
    """
    spread = most_odd_bits(percent / 100, samples, sketch_bits)
    sig = cut(signatures(docs, shingle, bands, rows))
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    reps = some.join(classes, ["f1", "f2"]).where("doc_id = rep")
    banded = reps.select("rep", F.explode("keys").alias("key"))
    hubs = cut(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("n")).where("hub < top").select("key", "hub", "n"))
    banded = cut(banded.join(hubs, "key").distinct())  # members of bands that have several
    sets = shingle_sets(docs.join(banded.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle, samples, sketch_bits)
    sets = cut(sets.dropDuplicates(["doc_id", "shingles"]))

    stars = banded.where("rep != hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n"))
    # a hub of many is there once for each `spokes` of them, so that these are in several tasks
    stars = stars.select("a", "b", F.pmod(F.xxhash64("b", F.lit(3)), F.ceil(F.col("n") / float(spokes))).cast("int").alias("salt"))
    ends = {x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab"}
    stars = stars.join(ends["b"], "b").join(stars.select("a", "salt").distinct().join(ends["a"], "a"), ["a", "salt"])
    odd = F.aggregate(F.zip_with("ka", "kb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = F.when(odd <= spread, 100 * shared >= percent * (F.size("sa") + F.size("sb") - shared))
    links = cut(stars.where(alike).select("a", "b"))
    first = components(links)

    members = banded.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    dealt = cut(blocks_of_groups(members.join(mixed, "key"), ["key"], "rep", block))
    order = ["key", "lo", "hi"]
    sketched = dealt.join(sets.select(F.col("doc_id").alias("rep"), "sketch"), "rep").select(*order, "own", "rep", "component", "sketch")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of_groups(batches, order):
            key, lo, hi, own, rep, comp = (table.column(c).to_numpy() for c in (*order, "own", "rep", "component"))
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).view(np.uint64)
            keep = np.zeros(table.num_rows, dtype=bool)
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                for p in range(i, j, 64):
                    q = min(j, p + 64)
                    hit = (comp[p:q, None] != comp[None, i:j]) & ((own[p:q, None] != own[None, i:j]) | (lo[i] == hi[i]))
                    if hit.any():
                        hit &= np.bitwise_count(sketch[p:q, None] ^ sketch[None, i:j]).sum(axis=2, dtype=np.int64) <= spread
                        keep[p:q] |= hit.any(axis=1)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, lo, hi, own, rep, comp)], [*order, "own", "rep", "component"])

    left = sketched.repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(hopeful, "key long, lo int, hi int, own int, rep long, component long")
    whole = left.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep").select(*order, "own", "rep", "component", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of_groups(batches, order):
            lo, hi, own, rep, comp = (table.column(c).to_numpy() for c in ("lo", "hi", "own", "rep", "component"))
            column = table.column("shingles").combine_chunks()
            flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                both = shared_shingles([flat[at[m] : at[m + 1]] for m in range(i, j)])
                size = np.diff(at[i : j + 1])
                alike = 100 * both >= percent * (size[:, None] + size[None] - both)
                alike &= comp[i:j, None] != comp[None, i:j]
                if lo[i] != hi[i]:
                    alike &= own[i:j, None] != own[None, i:j]
                x, y = np.nonzero(np.triu(alike, 1))
                if not len(x):
                    continue
                name, number = np.unique(comp[i:j], return_inverse=True)
                tree = Forest(len(name))  # of the components that meet here: one link each is enough
                new = [k for k, (p, q) in enumerate(zip(number[x].tolist(), number[y].tolist(), strict=True)) if tree.link(p, q)]
                yield pa.RecordBatch.from_arrays([pa.array(rep[i + x[new]]), pa.array(rep[i + y[new]])], ["a", "b"])

    more = whole.repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(compare, "a long, b long")
    # rows of one doc_id whose texts differ are in several classes: they tie these together
    same = some.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    linked = components(links.unionByName(more).unionByName(same.where("a != b").select("a", "b")))
    of = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("linked"))
    out = sig.select("doc_id", "n_shingles", "f1", "f2").join(of, ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("linked")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
