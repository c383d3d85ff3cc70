"""Operator 1, mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Within its source the keys are cut into ranges of equal width, about `per_range`
rows each; sums of the ranges, added up along the source, and a running sum inside each range give every row its exact
prefix of words without a global sort. A row is taken once for each whole epoch of its source's budget, and once more
as far as the rest of the budget reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, n_rows, source_size, target) from (source, n_rows, source_size), one row for each source.

    Sources in order of code points, null last, weigh `weights`, repeating, and share the sum of all sizes. No target
    exceeds `most` times its source's size; what is above is shared again by weight. Whoever is stopped has the
    smallest room for its weight, so one pass in that order finds them all: everything below concerns one row for
    each source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    room = sizes.withColumn("weight", weight).withColumn("room", F.col("source_size") * most)
    before = W.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = room.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    stopped = F.col("room") * F.col("weight_left") <= F.col("words_left") * F.col("weight")
    left = left.withColumn("stopped", stopped)
    # the first that isn't stopped has the share of all that aren't
    words = F.max(F.when(~F.col("stopped"), F.col("words_left"))).over(everything)
    weigh = F.max(F.when(~F.col("stopped"), F.col("weight_left"))).over(everything)
    target = F.when(F.col("stopped"), F.col("room").cast("double")).otherwise(F.col("weight") * words.cast("double") / weigh)
    return left.select("source", "n_rows", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", per_range: int = 4096) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, key, prefix, epochs, taken.

    `docs` needs doc_id, text and source; other columns, also of these new names, are left aside. size: words of the
    text, 0 if null or empty. taken: epochs * size and, of the row on which the rest of the budget ends, its first words.
    Rows that agree in doc_id, text and source have one key, share what is taken of them evenly (rounded down), and so
    give the same result in every run. A null source is a source of its own. An empty table gives no rows.
    No source lands in one task: a source with a third of all rows has as many more ranges.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))), 1, 15), 16, 10).cast("long")
    rows = cut(docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("key")))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    budget = source_targets(sizes, weights, most).withColumn("ranges", F.ceil(F.col("n_rows") / float(per_range)))
    budget = cut(budget.withColumnRenamed("source", "of"))
    rows = rows.join(budget, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # 60 random bits; the upper 30 times the number of ranges, shifted, rise with the key
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30))
    sums = rows.groupBy(F.col("source").alias("of"), F.col("range").alias("part")).agg(F.sum("size").alias("words"))
    along = W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("of", "part", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("base"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("part")))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    equal = F.count(F.lit(1)).over(inside.rangeBetween(W.currentRow, W.currentRow))
    upto = F.sum("size").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.select("*", equal.alias("equal"), (F.col("base") + upto).alias("upto"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", F.least(epochs, F.lit(most).cast("long")))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = rows.withColumn("prefix", F.col("upto") - F.col("equal") * F.col("size"))
    share = F.floor(F.greatest(F.lit(0), F.least(rest - F.col("prefix"), F.col("equal") * F.col("size"))) / F.col("equal"))
    taken = (F.col("epochs") * F.col("size") + share).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "key", "prefix", "epochs", taken.alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed documents, with the columns of `docs`: each row as often as whole epochs take it, and the row on which
    a source's budget ends once more, cut after the words that are taken (joined by one blank).

    The texts aren't shuffled: the rows with something left over or nothing taken are told from the others by the
    place of each source's cut, one row for each source, which joins the documents.
    """
    plan = mix_plan(docs, weights, most, seed)
    # the cut of a source: the first key, doc_id and size of which less than the whole is taken in the last epoch
    more = F.col("taken") - F.col("epochs") * F.col("size")
    at = plan.groupBy(F.col("source").alias("of")).agg(
        F.max("epochs").alias("epochs"),
        F.min(F.when((F.col("size") > 0) & (more < F.col("size")), F.struct("key", "doc_id", "size", more.alias("more")))).alias("at"),
    )
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))), 1, 15), 16, 10).cast("long")
    own = [F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.struct(key.alias("key"), "doc_id", word_count("text").alias("size")).alias("place"), "source")
    rows = rows.join(at, F.col("source").eqNullSafe(F.col("of")))
    end = F.struct("at.key", "at.doc_id", "at.size")
    part = F.when(F.col("at").isNull() | (F.col("place") < end), F.col("place.size")).when(F.col("place") == end, F.col("at.more")).otherwise(F.lit(0))
    rows = rows.select("row", F.col("place.size").alias("size"), "epochs", part.alias("part"))
    copies = F.concat(
        F.when(F.col("epochs") > 0, F.array_repeat(F.col("size"), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("part") > 0, F.array(F.col("part").cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.select("row", "size", F.explode(copies).alias("n"))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("n").cast("int")), " "))
    out = [text.alias(c) if c == "text" else F.when(F.col("n") < F.col("size"), F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*out)
