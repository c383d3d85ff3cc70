"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next.

Part of the subpackage phenospark.llm. Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and but for the last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.llm import common, minhash, mixing, packing, substrings, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the model is fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="__score")
    return scored.where("__score < 0.3").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; shingles of five words, similarity 0.8.

    Rows that repeat a doc_id stay if that doc_id stays. Only the doc_ids that go, not the texts, move."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(common.cut(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 35 that occur again; other texts stay as they are, and n_chars follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # under a name of its own, so that none clashes
    out = substrings.dedup_substrings(docs.select("doc_id", "text", F.struct(*rest).alias("__rest")), kept="__kept")
    shorter = F.col("n_removed") > 0
    own = {"doc_id": F.col("doc_id"), "text": F.when(shorter, F.col("__kept")).otherwise(F.col("text"))}
    own |= {c: F.col(f"__rest.`{c}`") for c in rest}
    if "n_chars" in own:
        own["n_chars"] = F.when(shorter, F.length("__kept")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[own[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, room=1024, end=2), room=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
