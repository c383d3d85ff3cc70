"""Operator 9, best-fit packing: bin completion branch-and-bound on the numbers of pieces of each length.

Pieces differ, for packing, in their length alone, and there are at most `room` lengths. So the plan is made from the
histogram of lengths, which has at most `room` rows however large the corpus: a list of patterns (the lengths of one
sequence) with the number of sequences each fills. The pieces then find their places by their rank among the pieces of
their length. A sequence of the plan is thus packed from the whole corpus, not from one partition of it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import encoder

#: One pattern: the lengths in a sequence, largest first, and how many sequences are filled so.
Pattern = tuple[tuple[int, ...], int]


def pieces_of(docs: DataFrame, tokenizer: str, pattern: str, room: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each document: its ids and the id `end`, and only where
    these are more than `room`, cut into pieces of `room`, of which the first takes what is over.

    A null or empty text is the id `end` alone. Rows that repeat are packed as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer, pattern), np.array([end], dtype="<u4").tobytes()
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text) + last)
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % room + 1, n + 1, room)]
                for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own = ids[4 * lo : 4 * hi]
                    for column, x in zip(out, (doc, k, lo, hi - lo, zlib.crc32(own), bytes(own) if with_ids else None), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out[: 5 + with_ids], kinds, strict=False)], names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, room: int) -> int:
    """Sequences that are needed at least (Martello and Toth 1990): for each k, lengths above room - k stand without any of k
    or more, two above half the room never share one, and what of the lengths from k to half the room doesn't fit beside these
    needs more. k = 0 is the waste bound, tokens over room."""
    lengths = np.arange(room + 1)
    n, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])  # of lengths below i
    half = room // 2 + 1  # lengths from here on never share a sequence
    k = np.arange(half)
    high = np.maximum(room - k + 1, half)
    alone, wide = n[-1] - n[high], n[high] - n[half]
    free = wide * room - (total[high] - total[half])
    return int((alone + wide + np.maximum(0, -(-(total[half] - total[k] - free) // room))).max())


def completions(rest: int, counts: np.ndarray, largest: int, limit: int = 12, tries: int = 200) -> list[tuple[int, ...]]:
    """Fillings of `rest` by lengths up to `largest` that are left, least waste first; dominated ones are left out.

    A filling to which another length could be added, or one of whose lengths could be replaced by a larger one that is
    left, is dominated: the better filling leaves no less to the other sequences. The search stops at `limit` fillings or
    after `tries` steps.
    """
    have = [int(s) for s in np.flatnonzero(counts[: largest + 1])[::-1] if 0 < s <= rest]
    rising = have[::-1]
    found: dict[tuple[int, ...], int] = {}
    spent = 0

    def left_over(at: int, top: int, used: dict[int, int]) -> bool:
        """Whether some length from rising[at] on, up to `top`, isn't used up."""
        while at < len(rising) and rising[at] <= top:
            if counts[rising[at]] > used.get(rising[at], 0):
                return True
            at += 1
        return False

    def grow(begin: int, room: int, used: dict[int, int]) -> None:
        nonlocal spent
        spent += 1
        for i in range(max(begin, len(have) - bisect_right(rising, room)), len(have)):
            s = have[i]
            for m in range(min(room // s, int(counts[s])), 0, -1):
                if len(found) >= limit or spent >= tries:
                    return
                grow(i + 1, room - m * s, used | {s: m})
        if not left_over(0, room, used) and not any(left_over(bisect_right(rising, x), x + room, used) for x in used):
            found[tuple(s for s, m in used.items() for _ in range(m))] = room

    grow(0, rest, {})
    return sorted(found, key=lambda c: (found[c], len(c), tuple(-x for x in c)))[:limit] or [()]


def best_fit(counts: np.ndarray, room: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram, the first incumbent: every length, largest first, goes to the open
    sequences with the least room that still holds it; equal sequences are kept together with their number.
    """
    open_: dict[int, list[list]] = {}  # room left: [lengths, how many]
    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        while n:
            left = next((x for x in range(s, room) if open_.get(x)), room)
            if left == room:
                many = room // s  # of one length, so many to a sequence
                full, over = divmod(n, many)
                for k, take in ((many, full), (over, 1)):
                    if k and take:
                        open_.setdefault(room - k * s, []).append([(s,) * k, take])
                n = 0
            else:
                lengths, have = open_[left].pop()
                take = min(have, n)
                if have > take:
                    open_[left].append([lengths, have - take])
                open_.setdefault(left - s, []).append([(*lengths, s), take])
                n -= take
    return [(tuple(a), b) for group in open_.values() for a, b in group]


def by_number(counts: np.ndarray, room: int, m: int) -> list[Pattern]:
    """Sequences of m pieces: the largest left, the m - 2 smallest, and the best fit for what is then free; largest pieces that no
    such sequence holds are packed by best fit."""
    left, aside, out = counts.copy(), np.zeros_like(counts), []
    while left.any():
        have = np.flatnonzero(left)
        top, without = int(have[-1]), left.copy()
        without[top] -= 1
        small, at = [], 0
        while len(small) < m - 2 and at < len(have):  # the smallest, each as often as there are
            take = min(m - 2 - len(small), int(without[have[at]]))
            small += [int(have[at])] * take
            without[have[at]] -= take
            at += 1
        free = room - top - sum(small)
        last = np.flatnonzero(without[: free + 1]) if free > 0 and len(small) == m - 2 else ()
        if len(last) == 0:
            aside[top] += left[top]
            left[top] = 0
            continue
        own = (top, *small, int(last[-1]))
        k = _times(own, left)
        left = _less(left, own, k)
        out.append((tuple(sorted(own, reverse=True)), k))
    return out + best_fit(aside, room)


def by_two_numbers(counts: np.ndarray, room: int, most: int = 8, tried: int = 24) -> list[Pattern]:
    """The best of plans in which lengths from some border on stand m - 1 to a sequence and shorter ones m, for every m up to
    `most` and borders tried first far apart, then close. Where a few pieces of much the same length fill a sequence, this is better than
    to fit each piece by itself."""
    have = np.flatnonzero(counts)
    best: tuple[int, list[Pattern]] = (int(counts.sum()) + 1, [])

    def attempt(m: int, border: int) -> int:
        nonlocal best
        low, high = counts.copy(), counts.copy()
        low[border:], high[:border] = 0, 0
        found = by_number(low, room, m) + (by_number(high, room, m - 1) if m > 2 else best_fit(high, room))
        n = sum(k for _, k in found)
        best = min(best, (n, found), key=lambda x: x[0])
        return n

    for m in range(2, min(most, room // max(1, int(have[0])) + 1) + 1):
        coarse = sorted({int(have[i * (len(have) - 1) // tried]) for i in range(tried + 1)} | {room + 1})
        numbers = [attempt(m, b) for b in coarse]
        i = int(np.argmin(numbers))
        lo, hi = coarse[max(0, i - 1)], coarse[min(len(coarse) - 1, i + 1)]
        for b in range(lo + 1, hi, max(1, (hi - lo) // tried)):
            attempt(m, b)
    return best[1]


def plan(counts: np.ndarray, room: int, limit: int = 12, tries: int = 200, nodes: int = 400) -> list[Pattern]:
    """Patterns that use up `counts` (counts[s]: pieces of length s) in as few sequences as were found.

    Branch and bound: a node is what is left; its branches are the undominated completions of the largest length left,
    each filled as often as the counts allow at once. Best-fit solutions of what is left are the incumbents, and at the beginning, where
    best fit is more than a hundredth above the bound, by_two_numbers(); a branch
    is cut when its sequences so far and the lower bound of the rest don't beat the best. The first branch (least waste) is
    followed to its end, then others are tried, those that leave it earliest last; it stops as soon as the best meets the
    bound. limit, tries (see completions) and nodes bound the effort, never what is packed: all pieces are in every plan. The work
    depends on the number of lengths, not on the number of pieces.
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    bound = lower_bound(counts, room)
    best = best_fit(counts, room)
    best_n = sum(k for _, k in best)
    if best_n - bound > bound / 100:  # pieces fit badly: another kind of incumbent may do better
        other = by_two_numbers(counts, room)
        if (n := sum(k for _, k in other)) < best_n:
            best, best_n = other, n
    stack: list[tuple[np.ndarray, tuple[Pattern, ...], int]] = [(counts, (), 0)]
    spent = 0
    while stack and best_n > bound and spent < nodes + 4 * room:
        left, done, used = stack.pop()
        here: list[Pattern] = list(done)
        while True:
            spent += 1
            if used + lower_bound(left, room) >= best_n:
                break
            if not left.any():
                best, best_n = here, used
                break
            top = int(np.flatnonzero(left)[-1])
            without = left.copy()
            without[top] -= 1
            first, *others = completions(room - top, without, top, limit, tries)
            for other in others if spent < nodes else ():
                k = _times((top, *other), left)
                stack.append((_less(left, (top, *other), k), (*here, ((top, *other), k)), used + k))
            k = _times((top, *first), left)
            left, used = _less(left, (top, *first), k), used + k
            here.append(((top, *first), k))
            if spent % 64 == 0:  # a best-fit end of this branch may already win
                rest = best_fit(left, room)
                if used + sum(n for _, n in rest) < best_n:
                    best, best_n = [*here, *rest], used + sum(n for _, n in rest)
                    if best_n <= bound:
                        break
    return best


def _times(lengths: tuple[int, ...], counts: np.ndarray) -> int:
    return min(int(counts[s]) // lengths.count(s) for s in set(lengths))


def _less(counts: np.ndarray, lengths: tuple[int, ...], k: int) -> np.ndarray:
    out = counts.copy()
    for s in lengths:
        out[s] -= k
    return out


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, which ranks go where: rows (length, rank from, sequence of that rank, offset), sorted."""
    rows, first, rank = [], 0, {}
    for lengths, k in patterns:
        at = 0
        for s in lengths:
            rows.append((s, rank.get(s, 0), first, at))
            rank[s] = rank.get(s, 0) + k
            at += s
        first += k
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def pack(pieces: DataFrame, room: int = 1024, per_range: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `room`, and whatever other columns.

    Ranks within a length are distributed: a hash of the row gives it a range among those of its length (a length that a
    third of all rows have has as many more ranges), ranges are counted, and rows are numbered inside their range.
    What the driver sees is the histogram, at most `room` rows, and the plan made from it. Columns sequence_id and
    offset of the input are replaced. Without rows the result is empty.
    """
    rest = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = cut(pieces.select(*rest, F.pmod(F.xxhash64(*rest), F.lit(1 << 30)).alias("__h")))
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(room + 1, dtype=np.int64)
    for r in histogram:
        if not 1 <= (r["length"] or 0) <= room:
            raise ValueError(f"length {r['length']} isn't from 1 to {room}")
        counts[r["length"]] = r["n"]
    to = places(plan(counts, room))
    spark = pieces.sparkSession
    ranges = spark.createDataFrame([(int(s), int(-(-n // per_range))) for s, n in enumerate(counts) if n], "length long, __ranges long")
    rows = rows.join(F.broadcast(ranges), "length")  # at most `room` rows
    rows = rows.withColumn("__range", F.shiftright(F.col("__h") * F.col("__ranges"), 30))
    per = rows.groupBy("length", "__range").agg(F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("length").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("length", "__range", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("__base"))
    inside = W.partitionBy("length", "__range").orderBy("__h", *[c for c in rest if c in ("doc_id", "piece", "start")])
    rows = rows.join(per, ["length", "__range"]).withColumn("__rank", F.col("__base") + F.row_number().over(inside) - 1)
    names = [*rest, "sequence_id", "offset"]
    shared = spark.sparkContext.broadcast(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        key = where["length"].astype(np.float64) * 2.0**40 + where["rank"]  # exact: lengths and ranks are below 2**13 and 2**40
        for b in batches:
            s, r = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            i = np.searchsorted(key, s.astype(np.float64) * 2.0**40 + r, side="right") - 1
            columns = [b.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where["sequence"][i] + r - where["rank"][i]), pa.array(where["offset"][i])], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*rest).schema.fields) + ", sequence_id long, offset long"
    return rows.select(*rest, "__rank").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with their ids: the packed training sequences, little-endian uint32."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `room` pieces
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
