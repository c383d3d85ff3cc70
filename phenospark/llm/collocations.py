"""Operator 12, phrases of words that go together, by count tries.

Every task counts the phrases of its texts in tries of limited depth, one for each language and about `shard_words` words
(a shard). A trie is written sorted: its words in byte order, its nodes in the order of their phrases. The phrases are cut
into ranges, by sampled phrases that only say where ranges begin; each shard's slice of a range goes to one task, which
merges the sorted slices of all shards. Walking a merged range gives each phrase the count of its first part, which is
its own ancestor; where an ancestor stands in an earlier range, and for the rest of a phrase, its suffix link, a join with
the phrases that are frequent finds it: whatever is part of a frequent phrase is frequent itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices

#: Bytes of a text before it is split: A-Z lower-cased, tabs as blanks, the ends of pieces as a byte that UTF-8 never has.
_END = b"\xff"
_BYTES = bytes(0xFF if i in b".,;:!?\n\v\f\r" else 0x20 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
MARK_EVERY = 8192
MOST_MARKS = 100_000


class _Codes(dict):
    """Numbers for words in the order they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack(words: list[bytes], arrays: list[np.ndarray]) -> tuple[int, bytes]:
    """(size, bytes): words, which hold no blank, and arrays of numbers, compressed."""
    text = b" ".join(words)
    head = np.array([len(text), *map(len, arrays)], dtype="<i8").tobytes()
    raw = head + b"".join(a.astype("<i4").tobytes() for a in arrays) + text
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(size: int, packed: bytes, arrays: int) -> tuple[list[bytes], list[np.ndarray]]:
    """What pack() was given."""
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    lengths = np.frombuffer(raw, "<i8", arrays + 1)
    at, out = 8 * (arrays + 1), []
    for n in lengths[1:]:
        out.append(np.frombuffer(raw, "<i4", int(n), at))
        at += 4 * int(n)
    return raw[at : at + int(lengths[0])].split(b" ") if lengths[0] else [], out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their counts added up; keys that come as sorted runs are merged, not sorted anew."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def trie_of(codes: _Codes, seen: list[np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
    """Sorted words, and the nodes of depth 1, 2 and 3: counts of words; pairs (two words, count); triples (number of the
    pair, third word, count)."""
    words = sorted(w for w in codes if w != _END)
    rank = np.full(len(codes), -1, dtype=np.int64)
    rank[[codes[w] for w in words]] = np.arange(len(words))
    c, v = rank[np.concatenate(seen)], max(1, len(words))
    ones = np.bincount(c[c >= 0], minlength=len(words))
    at = np.flatnonzero((c[:-1] >= 0) & (c[1:] >= 0))
    pairs, number, twos = np.unique(c[at] * v + c[at + 1], return_inverse=True, return_counts=True)
    of = np.full(len(c), -1, dtype=np.int64)
    of[at] = number
    at = at[at + 2 < len(c)]
    at = at[c[at + 2] >= 0]
    triples, threes = np.unique(of[at] * v + c[at + 2], return_counts=True)
    return words, [ones, pairs // v, pairs % v, twos, triples // v, triples % v, threes]


def shard_tries(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = 1_000_000) -> DataFrame:
    """(lang, n_words, n_nodes, marks, size, trie): the tries of all whole texts, null ones empty, a null lang as `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (codes, seen) in open_.items():
                words, arrays = trie_of(codes, seen)
                ones, p1, p2, _, t, t3, _ = arrays
                # every MARK_EVERY-th triple, from a place that differs between shards
                first = zlib.crc32(words[len(words) // 2]) % MARK_EVERY if words else 0
                marks = [b" ".join((words[p1[t[i]]], words[p2[t[i]]], words[t3[i]])).decode() for i in range(first, len(t), MARK_EVERY)]
                size, packed = pack(words, arrays)
                row = [[name], [int(ones.sum())], [len(words) + len(p1) + len(t)], [marks], [size], [packed]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.binary()), strict=True)], ["lang", "n_words", "n_nodes", "marks", "size", "trie"])
            open_.clear()

        for b in slices(batches):
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode().translate(_BYTES)
                name = b.column(0)[i].as_py()
                codes, seen = open_.setdefault(name, (_Codes(), []))
                found = raw.replace(_END, b" \xff ").split()
                found.append(_END)
                seen.append(np.fromiter(map(codes.__getitem__, found), dtype=np.int32, count=len(found)))
                held += len(found)
                if held >= shard_words:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(run, "lang string, n_words long, n_nodes long, marks array<string>, size long, trie binary"))


def range_starts(tries: DataFrame, per_range: int) -> list[tuple[str, list[bytes]]]:
    """(lang, phrase) where ranges of about per_range nodes begin, in order. The marks that come to the driver are thinned to
    about MOST_MARKS, whatever the number of shards."""
    nodes, marks = tries.agg(F.coalesce(F.sum("n_nodes"), F.lit(0)), F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()
    wanted = -(-nodes // per_range) - 1
    if wanted <= 0 or not marks:
        return []
    thin = -(-marks // MOST_MARKS)
    rows = tries.select("lang", F.explode("marks").alias("m")).where(F.pmod(F.xxhash64("lang", "m"), F.lit(thin)) == 0).collect()
    ordered = sorted({(r["lang"].encode(), tuple(r["m"].encode().split(b" "))) for r in rows})
    picked = sorted({len(ordered) * (i + 1) // (wanted + 1) for i in range(wanted)})
    return [(ordered[i][0].decode(), list(ordered[i][1])) for i in picked if i < len(ordered)]


def cuts_of(words: list[bytes], key2: np.ndarray, first3: np.ndarray, t3: np.ndarray, phrase: list[bytes]) -> tuple[int, int, int]:
    """How many nodes of depth 1, 2 and 3 of a sorted trie stand before a phrase of three words. A node stands before what
    goes on from it."""
    v = max(1, len(words))
    a, b, c = phrase
    x = bisect_left(words, a)
    if x == len(words) or words[x] != a:
        p = int(np.searchsorted(key2, x * v))
        return x, p, int(first3[p])
    y = bisect_left(words, b)
    p = int(np.searchsorted(key2, x * v + y))
    if p == len(key2) or key2[p] != x * v + y or y == len(words) or words[y] != b:
        return x + 1, p, int(first3[p])
    lo, hi = int(first3[p]), int(first3[p + 1])
    return x + 1, p + 1, lo + int(np.searchsorted(t3[lo:hi], bisect_left(words, c)))


def sliced(tries: DataFrame, starts: list[tuple[str, list[bytes]]]) -> DataFrame:
    """(range, lang, size, slice): each trie cut where ranges begin."""
    shared = tries.sparkSession.sparkContext.broadcast([(lang.encode(), phrase) for lang, phrase in starts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        langs = [s[0] for s in starts]
        for b in slices(batches, 1):
            name, size, packed = (b.column(i)[0].as_py() for i in range(3))
            words, (n1, p1, p2, n2, t, t3, n3) = unpack(size, packed, 7)
            v = max(1, len(words))
            key2 = p1.astype(np.int64) * v + p2
            first3 = np.searchsorted(t, np.arange(len(p1) + 1))
            lo, hi = bisect_left(langs, name.encode()), bisect_right(langs, name.encode())
            at = [(0, 0, 0), *(cuts_of(words, key2, first3, t3, starts[i][1]) for i in range(lo, hi)), (len(words), len(p1), len(t))]
            out = []
            for number, (i, j) in enumerate(zip(at, at[1:], strict=False), lo):
                if i == j:
                    continue
                ones, two, three = slice(i[0], j[0]), slice(i[1], j[1]), slice(i[2], j[2])
                own = [np.arange(i[0], j[0]), p1[two], p2[two], p1[t[three]], p2[t[three]], t3[three]]
                used = np.unique(np.concatenate(own))
                own = [np.searchsorted(used, x) for x in own]
                out.append((number, name, *pack([words[w] for w in used], [own[0], n1[ones], own[1], own[2], n2[two], own[3], own[4], own[5], n3[three]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["range", "lang", "size", "slice"])

    return tries.select("lang", "size", "trie").mapInArrow(run, "range int, lang string, size long, slice binary")


def merged(cut_tries: DataFrame, least: int) -> DataFrame:
    """(lang, words, a, l1, l2): phrases of one to three words that occur at least `least` times. l1 and l2: counts of the first
    word and the first two, where these are shorter than the phrase and stand in the same range."""

    def run(t: pa.Table) -> pa.Table:
        codes, parts = _Codes(), []
        for size, packed in zip(t.column("size"), t.column("slice"), strict=True):
            words, arrays = unpack(size.as_py(), packed.as_py(), 9)
            to = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
            parts.append([to[x] if i in (0, 2, 3, 5, 6, 7) else x.astype(np.int64) for i, x in enumerate(arrays)])
        words = sorted(w for w in codes if w != _END)
        rank = np.zeros(len(codes), dtype=np.int64)
        rank[[codes[w] for w in words]] = np.arange(len(words))
        v = max(1, len(words))
        w1, n1, p1, p2, n2, t1, t2, t3, n3 = (np.concatenate([p[i] for p in parts]) for i in range(9))
        parts.clear()
        ones = np.zeros(v, dtype=np.int64)
        np.add.at(ones, rank[w1], n1)
        pairs, twos = added(rank[p1] * v + rank[p2], n2)
        above = rank[t1] * v + rank[t2]
        all_pairs = np.unique(np.concatenate([pairs, above]))
        triples, threes = added(np.searchsorted(all_pairs, above) * v + rank[t3], n3)
        here = np.zeros(len(all_pairs), dtype=np.int64)
        here[np.searchsorted(all_pairs, pairs)] = twos

        one = np.flatnonzero(ones >= least)
        two = np.flatnonzero(twos >= least)
        three = np.flatnonzero(threes >= least)
        a, b = pairs[two] // v, pairs[two] % v
        above, c = triples[three] // v, triples[three] % v
        x, y = all_pairs[above] // v, all_pairs[above] % v
        phrases = [[words[i]] for i in one] + [[words[i], words[j]] for i, j in zip(a, b, strict=True)] + [[words[i], words[j], words[k]] for i, j, k in zip(x, y, c, strict=True)]
        n = len(phrases)
        l1, l2 = np.concatenate([0 * one, ones[a], ones[x]]), np.concatenate([0 * one, 0 * two, here[above]])
        return pa.table(
            [
                pa.array([t.column("lang")[0].as_py()] * n, pa.string()),
                pa.array([[w.decode() for w in p] for p in phrases], pa.list_(pa.string())),
                pa.array(np.concatenate([ones[one], twos[two], threes[three]]), pa.int64()),
                pa.array(l1, pa.int64(), mask=l1 == 0),
                pa.array(l2, pa.int64(), mask=l2 == 0),
            ],
            ["lang", "words", "a", "l1", "l2"],
        )

    return cut_tries.groupBy("range", "lang").applyInArrow(run, "lang string, words array<string>, a long, l1 long, l2 long")


def decimals() -> dict[str, Column]:
    """a, l and r as whole decimals: 38 digits hold 10^6 a a for counts up to 10^15."""
    return {f"{c}_": F.col(c).cast("decimal(19,0)") for c in "alr"}


def floored_score() -> Column:
    """floor(1000000 a a / (l r)) of decimals(), exactly."""
    return F.expr("(cast(a_ * a_ as decimal(31,0)) * 1000000BD) div cast(l_ * r_ as decimal(38,0))")


def collocations(docs: DataFrame, least: int = 10, within: int = 50, top: int = 2000, shard_words: int = 1_000_000, per_range: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of two and three words by score, then count,
    then bytes.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs. a:
    all occurrences of the phrase in pieces, at least `least`. A cut after k words has l = count of the first part, r = count
    of the rest and the score floor(1000000 a a / (l r)), in decimals; the lowest counts, of equal ones that of the
    smallest k. n: all words of the language. Pairs inside a triple (itself frequent) that has at least `within` percent of
    their count are left out. Null and empty texts have no words, a null lang is `und`, rows that repeat count again,
    other columns are left aside. An empty table gives no rows.
    """
    tries = shard_tries(docs, shard_words=shard_words)
    sizes = tries.groupBy("lang").agg(F.sum("n_words").alias("n"))
    frequent = cut(merged(sliced(tries, range_starts(tries, per_range)), least))
    frequent = frequent.withColumn("phrase", F.array_join("words", " "))
    counts = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("of_part"))

    def part(first: int, length: Column | int) -> Column:
        return F.array_join(F.slice("words", first, length), " ")

    longer = F.size("words") == 3
    cuts = F.array(
        F.struct(F.lit(1).alias("k"), F.col("l1").alias("l"), part(1, 1).alias("left"), part(2, F.size("words") - 1).alias("right")),
        F.when(longer, F.struct(F.lit(2).alias("k"), F.col("l2").alias("l"), part(1, 2).alias("left"), part(3, 1).alias("right"))),
    )
    asked = frequent.where(F.size("words") > 1).select("lang", "phrase", "a", F.explode(F.array_compact(cuts)).alias("c")).select("lang", "phrase", "a", "c.*")
    asked = asked.join(counts.withColumnsRenamed({"part": "right", "of_part": "r"}), ["lang", "right"])
    elsewhere = asked.where("l is null").drop("l").join(counts.withColumnsRenamed({"part": "left", "of_part": "l"}), ["lang", "left"])
    asked = asked.where("l is not null").unionByName(elsewhere)
    scored = asked.withColumns(decimals()).withColumn("score", floored_score())
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inside = frequent.where(longer).select("lang", "a", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * within)).drop("most")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of each part of a language, then of these the first of the language: no task ranks a whole language
    kept = kept.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
