"""Operator 11, licence scans by a positional index of rare licence words, in DataFrame functions only.

Notices (short texts of licences, and bare phrases) are cut into words. A notice posts its `depth` rarest words, by their
document frequencies in the scanned corpus, with their places. Every file looks up those of its words that are posted; a
posting's place taken from the word's place in the file says where the notice would begin, and postings that agree on a
beginning meet in one group. There the notice's mandatory phrases must stand too, word by word at their places; these are
found at each phrase's rarest word. Texts never move: a file sends the few places of posted words.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of lower-cased texts, and the same before lower-casing.
LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Notice:
    """A licence's text or phrase; `keys` are the phrases of it that must stand at their place. Of a base notice the
    phrase alone counts, and all its places are reported."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(LOWERED, self.text.translate(_LOWER))

    def places(self) -> list[tuple[tuple[str, ...], int]]:
        """Each mandatory phrase with its first place in the text."""
        own, out = self.words, []
        for key in self.keys:
            k = tuple(re.findall(LOWERED, key.translate(_LOWER)))
            out.append((k, next(i for i in range(len(own)) if tuple(own[i : i + len(k)]) == k)))
        return out


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

#: The phrases that every scan reports.
BASE = (
    Notice("cc-by", "cc by", ("cc by",), True),
    Notice("gpl", "general public license", ("general public license",), True),
    Notice("reserved", "all rights reserved", ("all rights reserved",), True),
)

#: Sentences of widely used licences and of the lines that refer to them.
NOTICES = BASE + (
    Notice("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Notice("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Notice("cc-by", "licensed under the Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Notice("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Notice("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Notice("cc0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal", ("creative commons cc0",)),
    Notice("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Notice("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee")),
    Notice("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Notice("mit", "Released under the MIT License", ("mit license",)),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "any person obtaining a copy")),
    Notice("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def lowered(c: str | Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How many documents hold each word of `vocabulary`, and under "" how many hold any word. All whole texts are read; one
    row for each word of the vocabulary reaches the driver."""
    # lower() is quick, but makes ASCII letters of some others: what it lets through is lower-cased again, A-Z only
    own = docs.select(_words(text).alias("w")).where(F.size("w") > 0)
    found = F.array_distinct(F.transform(F.filter("w", lambda w: F.lower(w).isin(vocabulary)), lowered))
    held = own.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    known = {*vocabulary, ""}
    return {r["w"]: r["n"] for r in held.collect() if r["w"] in known}


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, depth: int = 6, share: float = 0.6, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` with n_words, n_base, first_word, last_word, base_labels, labels, score and places, a row for each document.

    n_base: places of base phrases, overlaps and all; first_word and last_word: where the first and the last of them
    begin (words from 0; null without any). labels: base_labels and those of notices whose mandatory phrases all stand in
    place and of whose rare words' weight at least `share` stands in place; both sorted, joined by commas, "" without any.
    score: the largest such share of a notice that is reported, 0 without any. places: (start, words, label, share) of all.
    A word weighs ln((N + 1) / (df + 0.5)), N and df counted over all documents.

    Null and empty texts have no words and no labels. Rows that repeat are scanned each for itself. Other columns are left
    aside, so none can clash. An empty table gives an empty table.
    """
    if len(notices) > 10_000:
        raise ValueError("the notices are broadcast: at most 10,000")
    spark = docs.sparkSession
    vocabulary = sorted({w for n in notices for w in n.words})
    df = word_frequencies(docs, vocabulary, text)
    total = df.get("", 0)
    phrases = sorted({k for n in notices for k, _ in n.places()})
    code = {w: i for i, w in enumerate(vocabulary)} | {p: len(vocabulary) + i for i, p in enumerate(phrases)}
    index = []  # code, notice, place, weight, key; the notice's label, base, words, keys and weight
    for t, n in enumerate(notices):
        rare = sorted(enumerate(n.words), key=lambda x: (df.get(x[1], 0), x[0]))[:depth]
        weights = [math.log((total + 1) / (df.get(w, 0) + 0.5)) for _, w in rare]
        meta = (n.label, n.base, len(n.words), len(n.keys), float(sum(weights)))
        index += [(code[w], t, p, x, 0, *meta) for (p, w), x in zip(rare, weights, strict=True)]
        index += [(code[k], t, p, 0.0, 1, *meta) for k, p in n.places()]
    posted = sorted({vocabulary[i[0]] for i in index if i[0] < len(vocabulary)})
    at_word: dict[str, list[tuple[int, int, tuple[str, ...]]]] = {}
    for p in phrases:
        at = min(range(len(p)), key=lambda i: (df.get(p[i], 0), i))
        at_word.setdefault(p[at], []).append((code[p], at, p))

    of_word = F.create_map(*[x for w in posted for x in (F.lit(w), F.lit(code[w]))])
    of_anchor = F.create_map(*[x for w, ps in at_word.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(c).alias("code"), F.lit(at).alias("at"), F.array(*map(F.lit, p)).alias("words")) for c, at, p in ps]))])
    wanted = sorted({*posted, *at_word})
    seen = F.filter(F.transform("w", lambda w, i: F.when(F.lower(w).isin(wanted), F.struct(lowered(w).alias("w"), i.alias("i")))), lambda o: o.isNotNull())
    rare_words = F.filter(F.transform("seen", lambda o: F.struct(F.try_element_at(of_word, o["w"]).alias("code"), o["i"].alias("at"))), lambda x: x["code"].isNotNull())

    def stands(o: Column, p: Column) -> Column:
        here = F.transform(F.slice("w", o["i"] - p["at"] + 1, F.size(p["words"])), lowered)
        return F.when(o["i"] >= p["at"], here == p["words"]).otherwise(F.lit(False))

    none = F.array().cast("array<struct<code:int,at:int,words:array<string>>>")
    whole = F.flatten(F.transform("seen", lambda o: F.transform(F.filter(F.coalesce(F.try_element_at(of_anchor, o["w"]), none), lambda p: stands(o, p)), lambda p: F.struct(p["code"].alias("code"), (o["i"] - p["at"]).alias("at")))))
    rows = docs.select(*keep, _words(text).alias("w")).select(*keep, "w", F.size("w").cast("long").alias("n_words"), seen.alias("seen"))
    rows = cut(rows.select(*keep, "n_words", F.concat(rare_words, whole).alias("__items")))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())  # of the checkpoint, whose rows keep their order

    schema = "code int, t int, p int, weight double, key int, label string, base boolean, words int, need int, total double"
    postings = F.broadcast(spark.createDataFrame(index, schema))
    looked = rows.select("__row", F.explode("__items").alias("x")).select("__row", "x.code", "x.at").join(postings, "code")
    start = (F.col("at") - F.col("p")).alias("start")
    groups = looked.groupBy("__row", "t", start, "label", "base", "words", "need", "total").agg(F.sum("weight").alias("weight"), F.sum("key").alias("keys"))
    groups = groups.withColumn("share", F.when(F.col("total") > 0, F.least(F.col("weight") / F.col("total"), F.lit(1.0))).otherwise(F.lit(0.0)))
    found = groups.where((F.col("keys") == F.col("need")) & (F.col("base") | (F.col("share") >= share)))

    def joined(label: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(label)), ",")

    own = found.groupBy("__row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "words", "label", "share"))).alias("places"),
    )
    out = rows.drop("__items").join(own, "__row", "left").drop("__row")
    return out.select(
        *keep,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")],
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("places", F.array().cast(own.schema["places"].dataType)).alias("places"),
    )
