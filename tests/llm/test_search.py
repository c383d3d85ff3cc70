"""Licence scans, collocations and lexical search on small tables with every odd case, against brute force and SQL."""

import collections
import math
import os
import random
import re
import string

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from phenospark.llm import collocations, lexical, licences

DOCS = "doc_id long, text string, lang string, source string, n_words long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
draw = random.Random(11)


def some(n, of=60):
    return " ".join(f"w{int(draw.paretovariate(0.9)) % of}" + draw.choice(["", "", "", "", ",", ".", "\n", " \t"]) for _ in range(n))


def table(spark, texts, langs=("en", None, "de")):
    """Texts with a clashing column; one row repeats, one has no id."""
    rows = [(i, t, langs[i % len(langs)], "s", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "general public license w1 w2", "en", None, None)], DOCS)


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \t\n", "cc", "CC BY", "CC-by nc 4.0 Licensed under CC BY-NC 4.0.", "All rights reserved. all rights reserved", "ALL RIGHTS", "licensed under the GNU General Public License, version 3."]
    out += ["Released under the MIT License.", "the MİT licenKe, MIT licenſe; K license", "cc by cc by cc by", "general public license " * 30, "reserved rights all rights reserved by cc by"]
    out += ["Redistribution and use in source and binary forms, with or without modification, are permitted", "über.cc by;große ALL\nRIGHTS\nRESERVED"]
    out += [some(40) + " Licensed under the Apache License, Version 2.0. " + some(5), some(3000), some(6000, 5), "東京 w1 w2 東京 w1 w2", "a b " * 200, "x" * 5000]
    return out + [some(draw.randrange(1, 150)) for _ in range(60)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_brute_force(texts, notices, depth, share):
    cut = [re.findall(licences.LOWERED, (t or "").translate(LOWER)) for t in texts]
    df = collections.Counter(w for ws in cut for w in set(ws))
    n = sum(1 for ws in cut if ws)
    out = []
    for ws in cut:
        found = []
        for x in notices:
            rare = sorted(enumerate(x.words), key=lambda p: (df[p[1]], p[0]))[:depth]
            weight = {p: math.log((n + 1) / (df[w] + 0.5)) for p, w in rare}
            for at in range(-len(x.words), len(ws)):
                stands = lambda p, w: 0 <= at + p < len(ws) and ws[at + p] == w  # noqa: B023, E731
                if all(stands(p + i, w) for k, p in x.places() for i, w in enumerate(k)):
                    own = sum(v for p, v in weight.items() if stands(p, x.words[p])) / sum(weight.values())
                    if x.base or own >= share:
                        found.append((at, x, own))
        base = [at for at, x, _ in found if x.base]
        labels = [",".join(sorted({x.label for _, x, _ in found if b <= x.base})) for b in (True, False)]
        out.append((len(ws), len(base), min(base, default=None), max(base, default=None), *labels, round(max([0.0, *(s for _, _, s in found)]), 6), sorted((at, len(x.words), x.label) for at, x, _ in found)))
    return out


def test_licence_scan(spark, texts):
    docs = table(spark, texts)
    got = licences.scan(docs).collect()
    flat = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 6), sorted((p["start"], p["words"], p["label"]) for p in r["places"])) for r in got]
    held = docs.select("doc_id", "text").collect()
    want = [(d, *w) for (d, _), w in zip(held, by_brute_force([t for _, t in held], licences.NOTICES, 6, 0.6), strict=True)]
    assert sorted(flat, key=repr) == sorted(want, key=repr)
    assert licences.scan(docs.limit(0)).count() == 0
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[5]["base_labels"], by_id[5]["labels"]) == ("cc-by", "cc-by,cc-by-nc")
    assert by_id[8]["labels"] == "gpl,gpl-3.0" and by_id[9]["labels"] == "mit" and by_id[9]["n_base"] == 0
    assert by_id[10]["labels"] == "" and by_id[12]["n_base"] == 30


def phrases_by_brute_force(rows, least, within, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_words,per_range,marks,top", [(1_000_000, 1_000_000, 8192, 2000), (500, 200, 7, 2000), (2000, 50, 3, 15)])
def test_collocations(spark, texts, monkeypatch, shard_words, per_range, marks, top):
    monkeypatch.setattr(collocations, "MARK_EVERY", marks)
    docs = table(spark, texts).repartition(5)
    got = collocations.collocations(docs, least=10, within=50, top=top, shard_words=shard_words, per_range=per_range)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_by_brute_force([tuple(r) for r in docs.select("lang", "text").collect()], 10, 50, top)
    assert rows_of(got) == want and len(want) > 30


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 0), (2, "a b", "x", None, 0)], DOCS)).count() == 0


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits."""
    a, big = 3_000_000_019, 3_000_000_021
    one = spark.createDataFrame([(a, big, a + 5)], "a long, l long, r long")
    got = one.withColumns(collocations.decimals()).select(collocations.floored_score()).first()[0]
    assert got == 1000000 * a * a // (big * (a + 5))


def test_tries_survive_packing():
    words = [b"a", "東".encode(), b"\x01"]
    arrays = [np.array([], dtype=np.int64), np.arange(5)]
    got, back = collocations.unpack(*collocations.pack(words, arrays), 2)
    assert got == words and [x.tolist() for x in back] == [[], [0, 1, 2, 3, 4]]
    assert collocations.unpack(*collocations.pack([], arrays), 2)[0] == []


def ranked_by_brute_force(docs, items, k):
    cut = [(d, collections.Counter(re.findall(lexical.TERM, (t or "").translate(LOWER)))) for d, t in docs]
    cut = [(d, c, sum(c.values())) for d, c in cut if c]
    n, total = len(cut), sum(x for _, _, x in cut)
    df = collections.Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        q = collections.Counter(re.findall(lexical.TERM, (text or "").translate(LOWER)))
        found = []
        for d, c, x in cut:
            m = 100 - 25 + (25 * x * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"most_docs": 9}, {"most_postings": 40, "block_bytes": 150}])
def test_lexical_search(spark, texts, monkeypatch, sizes):
    monkeypatch.setattr(lexical.Shard, "BLOCK", 16)
    docs = table(spark, texts)
    asked = [(1, "w1 w2 w3 w1"), (2, None), (3, ""), (4, "nothing-like this"), (5, "GENERAL public, license w1"), (6, "東京 Große"), (7, some(40)), (8, some(80)), (9, "w1"), (10, "a"), (10, "b")]
    items = spark.createDataFrame([*asked, asked[0]], "item_id long, text string")
    got = lexical.search(docs, items, k=6, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], asked, 6)
    assert rows_of(got) == want
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_shard_against_all_scores():
    """Many documents with equal scores, so that bounds meet the threshold exactly."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, terms = 3000, 12
        lengths, weights = rng.integers(1, 4, n), rng.integers(0, 9, terms) * 100
        lists = [np.flatnonzero(rng.random(n) < p) for p in rng.random(terms) ** 3]
        kept = [t for t in range(terms) if len(lists[t])]
        ids = rng.permutation(n)
        tfs = [rng.integers(1, 3, len(lists[t])) for t in kept]
        shard = lexical.Shard(ids, lengths, np.array(kept), np.array([len(lists[t]) for t in kept]), np.concatenate([lists[t] for t in kept]), np.concatenate(tfs), weights, n, int(lengths.sum()))
        query = {int(t): int(rng.integers(1, 3)) for t in rng.choice(terms, 6, replace=False)}
        m = 75 + (25 * lengths * n) // lengths.sum()
        every = np.zeros(n, dtype=np.int64)
        for t, tf in zip(kept, tfs, strict=True):
            every[lists[t]] += query.get(t, 0) * weights[t] * ((10**9 * tf) // (1000 * tf + 12 * m[lists[t]]))
        order = np.lexsort((ids, -every))[:20]
        order = order[every[order] > 0]
        top, scores = shard.best(query, 20)
        assert top.tolist() == order.tolist() and scores.tolist() == every[order].tolist()


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", ["op11_licence_scan", "op12_collocations", "op13_lexical_search", "near_vectors_planted"])
def test_query_against_sql(spark, sf, tables, name):
    df = entry.queries()[name](spark, sf)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    rows = sorted((tuple(r) for r in want.select(*[f'"{c}"' for c in df.columns]).fetchall()), key=repr)
    assert rows_of(df) == rows and len(rows) > 0
