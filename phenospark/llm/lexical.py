"""Operator 13, ranked lexical search: MaxScore inside shards of an inverted index.

The queries come in blocks of bounded size. For a block every task makes shards of its documents: lengths, and for each
query term the postings (document, occurrences). The shards are written once; counts over all of them weigh the
terms. Then each shard ranks its documents for each query. A term's upper bound in a shard is the largest share that it
adds to any document there. Terms in the order of their bounds are split in two: those whose bounds together can't reach
the lowest score still ranked are non-essential. Only documents with an essential term are looked at, and the non-essential
postings of a document are probed, from the largest bound down, only while it can still qualify. The best of all shards
are merged by query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices

#: ASCII letters (lower-cased) and digits, and all bytes of other characters, are parts of terms; other bytes are blanks.
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 0x80 or 48 <= i <= 57 or 97 <= i <= 122 else 0x20 for i in range(256))
#: The same of lower-cased texts, as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD = "doc_ids array<bigint>, lengths binary, terms binary, counts binary, docs binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_BYTES).split()


class _Numbers(dict):
    """-1 for what isn't there."""

    def __missing__(self, term: bytes) -> int:
        return -1


def shards(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text", most_docs: int = 65_536, most_postings: int = 3_000_000) -> DataFrame:
    """Postings of the terms of `vocabulary` (by number) in all whole texts, as shards of bounded size. Documents without any
    term have no length and no postings."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers({t: i for i, t in enumerate(shared.value)})
        ids, lengths, found, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            doc = np.repeat(np.arange(len(found), dtype=np.int64), [len(f[0]) for f in found])
            term, tf = (np.concatenate([np.empty(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))
            order = np.argsort(term, kind="stable")
            own, counts = np.unique(term, return_counts=True)
            blobs = [np.array(lengths, "<i8"), own.astype("<i4"), counts.astype("<i4"), doc[order].astype("<i4"), tf[order].astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["doc_ids", "lengths", "terms", "counts", "docs", "tfs"])

        for b in slices(batches):
            for i in range(b.num_rows):
                words = terms_of(b.column(1)[i].as_py())
                if not words:
                    continue
                codes = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                ids.append(b.column(0)[i].as_py())
                lengths.append(len(words))
                found.append(np.unique(codes[codes >= 0], return_counts=True))
                held += len(found[-1][0])
                if len(ids) >= most_docs or held >= most_postings:
                    yield flush()
                    ids, lengths, found, held = [], [], [], 0
        if ids:
            yield flush()

    return cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SHARD))


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """(documents with a term, all terms, documents that hold each term), from all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            lengths, own, counts = (np.frombuffer(b.column(i)[0].as_py(), k) for i, k in ((0, "<i8"), (1, "<i4"), (2, "<i4")))
            # under -1 the documents, under -2 the terms
            term = np.concatenate([[-1, -2], own])
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(np.concatenate([[len(lengths), lengths.sum()], counts]), pa.int64())], ["term", "n"])

    rows = index.select("lengths", "terms", "counts").mapInArrow(run, "term int, n long")
    found = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(-1, 0), found.pop(-2, 0), found


def weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """One shard's postings, with what each adds to its document's score for one occurrence of the term in a query."""

    BLOCK = 4096

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        m = 100 - 25 + (25 * lengths * n_docs) // max(1, n_terms)
        tf = tfs.astype(np.int64)
        gain = np.repeat(weights[terms], counts) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        ends = np.cumsum(counts)
        self.of = {int(t): (docs[e - n : e], gain[e - n : e], int(gain[e - n : e].max())) for t, n, e in zip(terms, counts, ends, strict=True)}

    def best(self, query: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of the k best with a score above 0, best first, ties by smaller id."""
        lists = sorted(((q * self.of[t][2], q, *self.of[t][:2]) for t, q in query.items() if t in self.of), key=lambda x: x[0])
        bound = np.cumsum([0, *[x[0] for x in lists]])  # of the first j lists together
        blocks = np.arange(0, len(self.ids) + self.BLOCK, self.BLOCK)
        at = [np.searchsorted(x[2], blocks) for x in lists]
        top, scores, theta = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1  # only scores above 0 count
        for i, lo in enumerate(blocks[:-1]):
            essential = int(np.searchsorted(bound[1:], theta))  # lists before it can't reach theta together
            if essential == len(lists):
                break
            sums = np.zeros(self.BLOCK, dtype=np.int64)
            for (_, q, docs, gain), a in zip(lists[essential:], at[essential:], strict=True):
                sums[docs[a[i] : a[i + 1]] - lo] += q * gain[a[i] : a[i + 1]]
            own = np.flatnonzero(sums)
            for j in range(essential - 1, -1, -1):
                own = own[sums[own] + bound[j + 1] >= theta]
                if len(own) == 0:
                    break
                _, q, docs, gain = lists[j]
                docs, gain = docs[at[j][i] : at[j][i + 1]] - lo, gain[at[j][i] : at[j][i + 1]]
                place = np.searchsorted(docs, own)
                hit = np.flatnonzero(place < len(docs))
                hit = hit[docs[place[hit]] == own[hit]]
                sums[own[hit]] += q * gain[place[hit]]
            own = own[sums[own] >= theta]
            if len(own):
                top, scores = np.concatenate([top, own + lo]), np.concatenate([scores, sums[own]])
                order = np.lexsort((self.ids[top], -scores))[:k]
                top, scores = top[order], scores[order]
                if len(top) == k:
                    theta = max(theta, int(scores[-1]))
        return top, scores


def rank_block(docs: DataFrame, items: list[tuple[int, str | None]], k: int, **sizes: int) -> DataFrame:
    """(number, item_id, doc_id, score): each shard's k best for each of `items`, numbered in their order."""
    queries = [Counter(terms_of(text)) for _, text in items]
    vocabulary = sorted({t for q in queries for t in q})
    number = {t: i for i, t in enumerate(vocabulary)}
    index = shards(docs, vocabulary, **sizes)
    n_docs, n_terms, df = statistics(index)
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((weights, [{number[t]: c for t, c in q.items()} for q in queries], [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries, names = shared.value
        for b in slices(batches, 1):
            ids = b.column(0)[0].values
            none = ids.is_null().to_numpy(zero_copy_only=False)  # these come last among equals
            ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            parts = [np.frombuffer(b.column(i + 1)[0].as_py(), t) for i, t in enumerate(("<i8", "<i4", "<i4", "<i4", "<i4"))]
            shard = Shard(ids, *parts, weights, n_docs, n_terms)
            for i, query in enumerate(queries):
                top, scores = shard.best(query, k)
                if len(top):
                    columns = [pa.array([i] * len(top), pa.int64()), pa.array([names[i]] * len(top), pa.int64()), pa.array(ids[top], pa.int64(), mask=none[top]), pa.array(scores, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["number", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "number long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 8 << 20, **sizes: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text) with a score above 0.

    Scores are integers as the module's formula has them: the sum over the item's terms, repeats included, of w times
    (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, w = weight(N, df). Equal scores by ascending doc_id, null ids
    last. Null and empty texts have no terms: such documents are never found, such items find nothing. Rows that repeat are
    ranked each; items that repeat with the same text count once. Other columns are left aside. Items reach the driver in
    blocks of about block_bytes, each of which is searched in all documents.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()
    out, block, held = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"] or "") + 64
        if held >= block_bytes:
            out.append(rank_block(docs, block, k, **sizes).withColumn("block", F.lit(len(out))))
            block, held = [], 0
    if block or not out:
        out.append(rank_block(docs, block, k, **sizes).withColumn("block", F.lit(len(out))))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = W.partitionBy("block", "number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
