"""The ten operators on small tables with every odd case, against brute force."""

import collections
import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import pages
from phenospark.llm import common, graph, html, minhash, mixing, near_vectors, nearest, packing, substrings, token_counts, token_files, tokens, toxicity

BPE, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
draw = random.Random(4)


def words(n, of=400):
    return [f"w{draw.randrange(of)}" for _ in range(n)]


def table(spark, texts, sources=None):
    rows = [(i, t, None, sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    base = words(120)
    passage = words(60)
    near = base[:]
    near[5] = "changed"
    out = [" ".join(base), " ".join(base), " ".join(near), None, "", "  \t\n ", "one", "One", "a b", " ".join(words(90) + passage + words(40)), "\n".join(passage + words(10))]
    out += [" ".join(["same"] * 50), " ".join(words(5000)), "Crème brûlée – 東京 \U0001f600   three  blanks\r\n<|endoftext|> tail ", "x" * 3000]
    return out + [" ".join(words(draw.randrange(3, 200))) for _ in range(25)]


def set_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def smallest_reachable(n, edges):
    up = list(range(n))
    for _ in range(n):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), (3, 1), (None, 4)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 6: 5, 7: 5} | {i: 20 for i in range(21, 61)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_bring_each_pair_together_once(spark):
    members = spark.range(50).selectExpr("id", "id % 2 k")
    dealt = common.blocks_of_groups(members, ["k"], "id", 4).collect()
    pairs = collections.Counter()
    for _, group in itertools.groupby(sorted(dealt, key=lambda r: (r["k"], r["lo"], r["hi"])), key=lambda r: (r["k"], r["lo"], r["hi"])):
        for a, b in itertools.combinations(list(group), 2):
            if a["lo"] == a["hi"] or a["own"] != b["own"]:
                pairs[frozenset((a["id"], b["id"]))] += 1
    assert set(pairs.values()) == {1} and len(pairs) == 2 * 25 * 24 // 2


# 1

def brute_targets(size, weights=(5, 2, 1), most=3):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * size[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
        free -= over
    return target


def test_mix(spark):
    texts_ = [" ".join(words(draw.randrange(0, 60))) for _ in range(200)] + [None, ""]
    sources = [draw.choice(["a", "é", "Z", None, "b", "tiny"] if i % 40 == 0 else ["a", "a", "a", "é", "Z", None, "b"]) for i in range(202)]
    docs = table(spark, texts_, sources).withColumn("taken", F.lit("clash")).withColumn("key", F.lit(1))
    plan = mixing.mix_plan(docs, per_range=8).collect()
    again = mixing.mix_plan(docs.repartition(7), per_range=8).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in plan) == sorted((r["doc_id"], r["taken"]) for r in again)
    size, taken = collections.Counter(), collections.Counter()
    for r in plan:
        assert r["size"] == len((texts_[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    target = brute_targets(size)
    for r in plan:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - target[s]) < 1 for s in size)
    mixed = mixing.mix_documents(docs.drop("taken", "key"))
    got = collections.Counter()
    for r in mixed.collect():
        got[r["source"]] += len((r["text"] or "").split())
        assert r["text"] is None or (texts_[r["doc_id"]] or "").startswith(r["text"])
    assert all(abs(got[s] - taken[s]) == 0 for s in size) and mixed.columns == docs.drop("taken", "key").columns


def test_mix_of_repeated_rows_and_of_nothing(spark):
    docs = table(spark, ["a b c"] * 6).withColumn("doc_id", F.lit(1).cast("long"))
    taken = [r["taken"] for r in mixing.mix_plan(docs).collect()]
    assert len(set(taken)) == 1 and sum(taken) == 18
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_plan(table(spark, [None, ""])).collect()] == [0, 0]


# 2

def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 16))
    v[40:60] = v[0] + rng.normal(size=(20, 16)) * 0.15
    v[60:70] = v[1]
    v[70] = v[1] * 4
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [float("inf")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, []), (206, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block=8).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    component = smallest_reachable(150, list(zip(*np.nonzero(near), strict=True)))
    assert [got[i]["n_links"] for i in range(150)] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(150)] == component
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(200, 207)) and len(got) == 157
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vector_parameters_follow_the_rows():
    rng = np.random.default_rng(3)
    for distance in (0.3, 1.0):
        a = rng.normal(size=200_000) * distance
        assert near_vectors.same_cell(distance, 2.0) == pytest.approx((np.floor((a + (u := rng.uniform(0, 2, len(a)))) / 2) == np.floor(u / 2)).mean(), abs=0.01)
    before = (0, 0)
    for n in (1, 1000, 10**6, 10**9):
        now = near_vectors.parameters(n, 0.9, 2.0, 0.001)
        near = near_vectors.same_cell(0.2**0.5, 2.0) ** now[1]
        assert (1 - near) ** now[0] <= 0.001 and now >= before
        before = now


def test_members_that_were_together_before_are_asked_once():
    keys = np.array([[1, 5]] * 90 + [[1, 6]] * 9 + [[2, 5]], dtype=np.int32)
    assert near_vectors.apart(keys[:, :0]).tolist() == list(range(100)) and near_vectors.apart(keys).tolist() == [99]
    assert near_vectors.apart(keys[:99]).tolist() == [] and len(near_vectors.apart(keys[:20])) == 20


def test_near_vectors_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 16))
    v[100:] = v[0] + rng.normal(size=(600, 16)) * 0.25  # within and around the border
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block=128).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(700)])
    assert (have <= want).all() and have.sum() >= 0.999 * want.sum() and want.max() > 300
    assert [got[i]["component_id"] for i in range(700)] == smallest_reachable(700, list(zip(*np.nonzero(near), strict=True)))


# 3

def test_toxicity_learns_and_is_bounded(spark):
    rows = [(i, " ".join([*words(40), *(["awfulness"] if i % 5 == 0 else [])])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(0, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, per_class=(50, 30))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(200, 300)) and all(0 <= s <= 1 for s in got.values())
    assert model.weights.nbytes == 4 << 18
    assert toxicity.fit(docs.repartition(5), labels, per_class=(50, 30)).bias == pytest.approx(model.bias)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "awfulness " * 20000)], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] and scores[2] > 0.5
    for few in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.score(docs, toxicity.fit(docs, few)).select("score").distinct().collect()
        assert len(flat) == 1 and flat[0][0] < 0.01
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_bounds_rows_and_counts_equal_ones_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 40}") for i in range(200)] + [(2, "other"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.training_sample(docs, labels, "toxic", (30, 5)).collect()
    assert collections.Counter(r["y"] for r in rows) == {0: 30, 1: 2} and len({r["text"] for r in rows}) == 32
    assert (rows[0]["n0"], rows[0]["n1"]) == (1, 1)
    every = toxicity.training_sample(docs, labels, "toxic", (300, 5)).collect()
    assert sum(r["y"] == 0 for r in every) == 40


def test_held_out_labels_do_not_matter(spark, sf, tmp_path):
    from phenospark.llm import queries

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    one, two = ({r["doc_id"]: r for r in queries.op3_toxicity(spark, d).collect()} for d in (sf, str(tmp_path)))
    assert one == two and {r["predicted"] for r in one.values()} <= {0, 1}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for i, r in one.items())


def test_sampling_keeps_the_classes_apart():
    chunks = [(np.array([1, 2, 3] * n, dtype=np.int32), np.array([3] * n)) for n in (1, 3)]
    w, b = toxicity.regress(chunks, np.array([0.0, 0, 1, 1]), 8, 1, 1.0)
    assert np.allclose(w, 0) and b == pytest.approx(0, abs=1e-6)


# 4, 6, 9

def library_ids(texts_):
    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts_], add_special_tokens=False)]


HARD = ["a  b", "a   b", " a", "a ", "a \n b", "\n\n a\n", "it's we'll I'M", "\x1c x \x85 y", "x  y", "  z", "²³½ ª 1²", "日本 語", " ", "  ", "\t a", "'s 's", "a<|endoftext|> b<|endoftext|>"]


def test_encoder_and_counter_are_the_librarys():
    many = HARD + ["".join(draw.choice(" ab'sé1²\n\t! 日\x1c") for _ in range(draw.randrange(1, 40))) for _ in range(3000)]
    encode, count = tokens.Encoder(BPE, PATTERN), tokens.Counter(BPE, PATTERN, room=50)
    for text, ids in zip(many, library_ids(many), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids, repr(text)
        assert count(text) == len(ids), repr(text)


def test_encoder_proves_what_it_merges_itself():
    assert tokens.Encoder(BPE, PATTERN)._core is not None
    other = tokens.Encoder(BPE, r"\s+|\S+")  # not how this tokenizer splits
    assert other._core is None and not tokens.Counter(BPE, r"\s+|\S+").plain
    words_ = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.Encoder(words_, PATTERN)._core is None
    for text in HARD:
        assert np.frombuffer(other(text), "<u4").tolist() == library_ids([text])[0] and tokens.Counter(BPE, r"\s+|\S+")(text) == len(library_ids([text])[0])
        assert np.frombuffer(tokens.Encoder(words_, PATTERN)(text), "<u4").tolist() == Tokenizer.from_file(words_).encode(text, add_special_tokens=False).ids
    alike = tokens.SplitsAlike(Tokenizer.from_file(BPE), lambda text, starts: np.array([c.isalpha() for c in text[1::3]]))  # wrong for 1 and !
    assert not alike("a") and alike.others(0)


def test_whole_tokens_are_proved():
    c = tokens.Counter(BPE, PATTERN)
    assert len(c.whole) > 40_000
    some = draw.sample(sorted(c.whole), 2000)
    assert all(len(i) == 1 for i in library_ids(some))


def test_token_counts(spark, texts):
    docs = table(spark, texts + HARD).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, BPE, PATTERN).collect()}
    assert [got[i] for i in range(len(got))] == [len(i) for i in library_ids(texts + HARD)]
    assert token_counts.count_tokens(docs.limit(0), BPE, PATTERN).count() == 0


def test_elias_fano():
    for values in ([], [0], [5], [0, 0, 0], [1, 1, 70, 70, 5000], sorted(draw.randrange(1 << 40) for _ in range(1000)), list(range(700))):
        v = np.array(values, dtype=np.int64)
        width, low, high, samples = token_files.EliasFano.encode(v)
        ef = token_files.EliasFano(width, len(v), low, high, samples)
        assert values == [ef.select(i) for i in range(len(v))]
        for lo, hi in [(0, len(v)), (0, 0), *(sorted(draw.randrange(len(v) + 1) for _ in "ab") for _ in range(50))]:
            assert ef.between(lo, hi).tolist() == values[lo:hi]
        if len(v) > 500:
            assert len(low) + len(high) + len(samples) <= (2.5 + max(0, np.log2(v[-1] / len(v))) + 1) * len(v) / 8 + 16
    with pytest.raises(IndexError):
        ef.select(700)


def test_token_files_round_trip(spark, texts, tmp_path):
    everything = texts + HARD
    docs = table(spark, everything).withColumn("start", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, BPE, PATTERN, end=2, block_ids=500, parts=3)
    got = [r for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    ids = library_ids(everything)
    order = [0, *range(4), *range(3, len(everything))]
    at = 0
    assert [r["doc_id"] for r in got] == [None, *order[1:]]
    for r, i in zip(got, order, strict=True):
        own = np.array([*ids[i], 2], dtype="<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(own) // 4, own)
        at += len(own) // 4
    some = token_files.find_documents(spark, path, [3, 9, 3, 10**9]).orderBy("start").collect()
    assert some == [r for r in got if r["doc_id"] in (3, 9)] and token_files.find_documents(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        token_files.Block(b"\0" * 64)
    empty = str(tmp_path / "none")
    token_files.write_token_files(docs.limit(0), empty, BPE, PATTERN)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing(spark, texts):
    docs = table(spark, texts).withColumn("offset", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id < 4"))
    packed = packing.pack(packing.pieces_of(docs, BPE, PATTERN, room=64, end=2, with_ids=True), room=64, per_range=8)
    rows = packed.collect()
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 64 and len(at) <= -(-sum(at.values()) // 64) + 2
    for i, ids in enumerate(library_ids(texts)):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])[:: 2 if i < 4 else 1]
        assert b"".join(r["ids"] for r in own) == np.array([*ids, 2], dtype="<u4").tobytes()
        assert all(r["length"] == 64 for r in own[1:]) and (len(ids) >= 64 or len(own) == 1)
    whole = packing.sequences(packed).collect()
    assert sorted(len(r["ids"]) // 4 for r in whole) == sorted(at.values())
    assert packing.pack(packing.pieces_of(docs.limit(0), BPE, PATTERN)).count() == 0
    with pytest.raises(ValueError, match="1 to 8"):
        packing.pack(spark.createDataFrame([(9,)], "length long"), room=8)


def fewest(lengths, room):
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in sorted({*bins}):
            if b + lengths[i] <= room:
                rest = list(bins)
                rest.remove(b)
                put(i + 1, [*rest, b + lengths[i]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


def test_plan_is_optimal_on_small_cases_and_complete_on_large():
    for _ in range(60):
        lengths = sorted((draw.randrange(1, 21) for _ in range(draw.randrange(1, 10))), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        patterns = packing.plan(counts, 20)
        used = np.zeros(21, dtype=int)
        for p, k in patterns:
            assert sum(p) <= 20
            np.add.at(used, list(p), k)
        assert (used == counts).all() and sum(k for _, k in patterns) == fewest(lengths, 20)
        assert packing.lower_bound(counts, 20) <= fewest(lengths, 20)
    counts = np.random.default_rng(1).integers(0, 10**6, 1025)
    counts[0] = 0
    patterns = packing.plan(counts, 1024)
    total = -(-int(counts @ np.arange(1025)) // 1024)
    assert total <= sum(k for _, k in patterns) <= total * 1.02 and len(patterns) < 20_000


def test_completions_are_whole_and_undominated():
    for _ in range(40):
        counts = np.bincount([draw.randrange(1, 13) for _ in range(draw.randrange(1, 9))], minlength=21)
        rest = draw.randrange(1, 20)
        have = [s for s in range(1, rest + 1) for _ in range(counts[s])]
        every = {tuple(sorted(c, reverse=True)) for n in range(len(have) + 1) for c in itertools.combinations(have, n) if sum(c) <= rest}

        def better(c, rest=rest, counts=counts):
            left = counts - np.bincount(c, minlength=21) if c else counts
            waste = rest - sum(c)
            return any(left[y] and y <= waste for y in range(1, 21)) or any(left[y] and x < y <= x + waste for x in c for y in range(x + 1, 21))

        want = {c for c in every if not better(c)}
        assert set(packing.completions(rest, counts, 20, limit=10**6, tries=10**6)) == (want or {()})


def test_plans_meet_the_bound_where_large_pieces_decide():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.clip(rng.lognormal(5.9, 0.8, 20_000), 1, 1024).astype(int), minlength=1025)
    bound = packing.lower_bound(counts, 1024)
    assert bound >= -(-int(counts @ np.arange(1025)) // 1024)
    assert bound <= sum(k for _, k in packing.plan(counts, 1024)) <= bound * 1.001 + 1


# 5

@pytest.mark.parametrize(("length", "period"), [(35, 21), (13, 7), (13, 13)])
def test_substrings(spark, texts, length, period):
    docs = table(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("found", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id in (3, 12)"))
    every = [t for t in texts] + [texts[3], texts[12]]
    split = [(t or "").encode().split() for t in every]
    seen = collections.Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(docs, length, period).collect()}
    for i, w in enumerate(split[: len(texts)]):
        gone = np.zeros(len(w), dtype=bool)
        for j in range(len(w) - length + 1):
            if seen[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = True
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"].encode()) == (len(w), int(gone.sum()), left)
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_difference_covers():
    for v, cover in substrings.COVERS.items():
        for p, q in itertools.product(range(v), repeat=2):
            assert any((p + d) % v in cover and (q + d) % v in cover for d in range(v))
    with pytest.raises(ValueError):
        substrings.repeated_windows(None, 35, 5)


# 7

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="post">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please agree to all of them now.</div>
<article><h1>The &lt;title&gt;</h1><p><b>First&nbsp;words
 of   it.<br><p>Second caf&eacute; &#233;.</p><div class="ad">Buy this now, it is very cheap and very good.</div><p>See <a href="x">the link</a> here.</p>
<form><p>Your mail address goes in here, thanks.</p><input></form></article>
<aside><p>Related: another long story that one could also read.</p></aside><div id="comments"><p>Reader: I like this article very much indeed.</p></div>
<footer>&copy; site &middot; all rights reserved in every country.</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "The <title>\nFirst words of it.\nSecond café é.\nSee the link here."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == html.main_text("<script>x") == ""
    assert html.main_text("<main><p>Only text, with an end</main") == "Only text, with an end"
    assert html.main_text("<p>a < b and 3 > 2 is text that stays in place.</p>").startswith("a < b")


def test_names_and_attributes():
    assert html.named("comments") == (1, False) == html.named("comment-list") == html.named("siteFooter")[:1] + (False,)
    assert html.named("share-price-report")[0] < 0.5 and html.named("entry-content") == (0, True) and html.named("content-sidebar-wrap")[1] is False
    found = html.blocks('<p class="x" title="5" tall">First words.</p><p title=\'class="ad"\' data-x="a>b">Second.</p><p class="x>Third.')
    assert [b.text for b in found] == ["First words.", "Second.", "Third."] and not any(b.parent.bad for b in found)
    for kept in ("share-price-report", "tags-explained"):
        long = " ".join(["Some words that make up a sentence of an article."] * 6)
        assert html.main_text(f"<div class={kept}><p>{long}</p><p>{long}</p></div><div class=share>Share this on a page</div>") == f"{long}\n{long}"


LAYOUT_SEEDS = range(6)


def f1(weights, layouts, monkeypatch, **edges_):
    monkeypatch.setattr(html, "WEIGHTS", weights)
    right = given = due = flipped = 0
    for name in layouts:
        for seed in range(100, 103):
            page, content = pages.page(name, seed)
            found = html.blocks(page)
            both = html.costs(found)
            cut = html.min_cut([a for a, _ in both], [b for _, b in both], html.edges(found, **edges_))
            got = collections.Counter(b.text for b, c in zip(found, cut, strict=True) if c)
            right, given, due = right + (got & collections.Counter(content)).total(), given + got.total(), due + len(content)
            flipped += sum((a >= b) != c for (a, b), c in zip(both, cut, strict=True))
    return 2 * right / (given + due), flipped


def test_main_text_of_many_layouts(monkeypatch):
    fitted = html.fit([pages.page(name, seed) for name in pages.LAYOUTS for seed in LAYOUT_SEEDS])
    assert {k: round(v, 2) for k, v in fitted.items()} == pytest.approx(html.WEIGHTS, abs=0.02) and len(pages.LAYOUTS) >= 25
    for name in pages.LAYOUTS:
        page, content = pages.page(name, 50)
        assert html.main_text(page) == "\n".join(content), name


def test_layouts_that_were_left_out_and_what_the_cut_adds(monkeypatch):
    scores, lone, flips = [], [], 0
    for name in pages.LAYOUTS:
        weights = html.fit([pages.page(other, seed) for other in pages.LAYOUTS if other != name for seed in LAYOUT_SEEDS])
        score, flipped = f1(weights, [name], monkeypatch)
        scores.append(score)
        flips += flipped
        lone.append(f1(weights, [name], monkeypatch, adjacency=0, container=0, near=0)[0])
    assert np.mean(scores) >= 0.985 and np.mean(scores) > np.mean(lone) and flips > 0


def test_long_text_outweighs_odd_names_but_not_talk():
    long = " ".join(["Some words that make up a sentence of an article."] * 6)
    article = f"<p>{long} One.</p><p>{long} Two.</p><p>{long} Three.</p>"
    text = "\n".join(f"{long} {n}." for n in ("One", "Two", "Three"))
    for before, after in (("<div class=reader>", "</div>"), ("<div class=tag>", "</div>"), ("<form id=aspnetForm><div class=page>", "</div></form>"), ("<aside><div class='promo banner'>", "</div></aside>")):
        assert html.main_text(f"<div class=nav><a href=x>One</a></div>{before}{article}{after}<div class=footer>Some more words.</div>") == text
    for rest in (f"<div class=comments>{article}{article}</div>", f"<div id=q><h3>Comments</h3>{article}{article}</div>", "<div class=author-bio><p>This one writes for us now and then.</p></div>", "<div class=site-info><p>This is a site about some things.</p></div>", "<div><h4>More stories</h4><p>Another one of them is here to be read.</p></div>"):
        assert html.main_text(f"<div class=page><h1>Title of it</h1>{article}</div>{rest}") == f"Title of it\n{text}"
    assert html.main_text(f"<h1>Title of it</h1><p>{'words ' * 3000}cookie</p>").count("words") == 3000


HOSTILE = {
    "ends without beginnings": "<div>" * 60000 + "</x>" * 60000,
    "inline elements": "<b>" * 60000 + "<p>" * 60000,
    "ends that cannot be reached": "<i><p>" + "<b>" * 120000 + "</i>" * 120000,
    "headings in headers": "<nav>" * 60000 + "<h1>x" * 60000,
    "lists in lists": "<ul><li>some text " * 40000,
    "one block of many parts": "<b>x</b>" * 120000,
    "comments": "<!--" * 250000,
    "quotes": "<a b='" * 160000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_by_their_length(name):
    page = HOSTILE[name]

    def seconds(part):
        start = time.process_time()
        html.main_text(part)
        return time.process_time() - start

    seconds(page[: len(page) // 8])
    assert seconds(page) < 3 * 8 * seconds(page[: len(page) // 8]) + 1  # squares would take 64 times as long


def test_min_cut_is_minimal():
    for _ in range(80):
        n = draw.randrange(1, 8)
        content, boiler = ([draw.randrange(0, 9) / 2 for _ in range(n)] for _ in range(2))
        edges = [(i, i + 1, draw.randrange(0, 5) / 2) for i in range(n - 1)] + ([(0, n - 1, 0.5)] if n > 2 else [])

        def cost(labels, content=content, boiler=boiler, edges=edges):
            return sum(b if c else a for a, b, c in zip(content, boiler, labels, strict=True)) + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(html.min_cut(content, boiler, edges)) == pytest.approx(best)


def test_extract_text(spark):
    table_ = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", "<div>" * 3000 + "<p>deep words that are long enough to be kept.</p>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"]) for r in html.extract_text(table_).collect())
    assert [len(t) > 0 for _, t in got] == [True, True, False, True] and got[0] == got[1]
    assert html.extract_text(table_.limit(0)).count() == 0


# 8

@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(spark, texts, shingle):
    base = words(150)
    many = list(texts)
    for n in (1, 2, 3, 4, 6, 8, 10):
        for _ in range(6):
            copy = base[:]
            for at in draw.sample(range(150), n):
                copy[at] = f"edit{draw.randrange(10**9)}"
            many.append(" ".join(copy))
    docs = table(spark, many).withColumn("component_id", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = [r for r in minhash.near_duplicates(docs, shingle, block=8, spokes=3).collect()]
    sets = [set_of(t, shingle) for t in many]
    edges = [(i, j) for i, j in itertools.combinations(range(len(many)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    component = smallest_reachable(len(many), edges)
    known = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [known[i]["component_id"] for i in range(len(many))] == component
    assert [known[i]["n_shingles"] for i in range(len(many))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"]) for r in got) and len(got) == len(many) + 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_and_shared_shingles():
    rng = np.random.default_rng(0)
    sample = minhash.Sampler(512)
    for j in (0.8, 0.9, 0.97):
        n = 2000
        both = rng.integers(0, 1 << 63, int(n * j), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(n * (1 - j) / 2), dtype=np.uint64)])) for _ in range(2))
        odd = np.bitwise_count((minhash.odd_sketch(sample(a), 2048) ^ minhash.odd_sketch(sample(b), 2048)).view(np.uint64)).sum()
        assert odd <= minhash.most_odd_bits(j, 512, 2048) and abs(-2048 / 2 * np.log(1 - 2 * odd / 2048) / 1024 - (1 - j)) < 0.08
    sets = [np.unique(rng.integers(0, 6000, draw.randrange(1, 900)).astype(np.int64)) for _ in range(20)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = minhash.shared_shingles(sets)
    assert all(got[i][j] == want[i][j] for i, j in itertools.permutations(range(20), 2))


# 10

def test_nearest(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 12))
    v[100:160] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (520, [0.0] * 12), (540, [float("nan")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20, per_cell=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = total = 0
    for q in range(0, 400, 20):
        s = v @ v[q]
        order = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(x == pytest.approx(s[i], abs=1e-12) for i, x in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) or len({x for _, x in got[q]}) < 20
        found, total = found + len({i for i, _ in got[q]} & set(order)), total + 20
    assert found / total >= 0.9 and set(got) == set(range(0, 400, 20))
    assert nearest.nearest(df, df.where("vec_id < 0")).count() == 0
    few = df.where("vec_id < 5")
    assert nearest.nearest(few, few.where("vec_id = 0"), k=20).count() == 4
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_ascends_past_the_cells(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(640, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, asked, per_cell=16).collect():  # a prefix of 6: the 16 cells hold 0.25 of all
        got[r["query_id"]].append(r["vec_id"])
    true = {q: [int(i) for i in np.argsort(-(v @ v[q]), kind="stable") if i != q][:20] for q in range(0, 640, 20)}
    assert sum(len(set(got[q]) & set(true[q])) for q in true) / (20 * len(true)) >= 0.9
    whole = nearest.nearest(df, asked, share=16, per_cell=16).orderBy("query_id", "rank").collect()  # up to the root: exact
    assert [(r["query_id"], r["vec_id"]) for r in whole] == [(q, i) for q in sorted(true) for i in true[q]]

def test_nearest_of_clusters_looks_at_few_and_keeps_lengths_apart(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    v = centres[np.arange(3000) % 60] + 0.1 * rng.normal(size=(3000, 16))
    keys = nearest.strings(v, 16)
    asked = np.arange(0, 3000, 60)
    near = np.argsort(-(v[asked] @ v.T), axis=1)[:, :20]
    counts = np.array([[[((keys[:, t] ^ keys[q, t]) >> (nearest.BITS - d) == 0).sum() for d in range(nearest.BITS + 1)] for t in range(16)] for q in asked])
    shared = nearest.common_prefix(keys[near.reshape(-1)], keys[np.repeat(asked, 20)])
    enough, first = nearest.choose(counts, shared, np.repeat(np.arange(len(asked)), 20), 0.95)
    assert enough <= 0.4 * 3000 and 1 <= first <= 16
    odd = [(10_000 + i, x) for i, x in enumerate([[1.0] * 8, [2.0] * 8, [3.0] * 10, [0.5] * 14, [-1.0] * 14])]  # 10 + 14 is 2 * 12
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:300])] + odd, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.where("vec_id >= 10000"), per_cell=64).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(10000, 1, 10001, 16.0), (10001, 1, 10000, 16.0), (10003, 1, 10004, -7.0), (10004, 1, 10003, -7.0)]


def test_vectors_that_stand_alone_find_their_neighbours(spark):
    """Clusters and isolated vectors: the mean recall must not be bought from the isolated ones."""
    rng = np.random.default_rng(12)
    v = np.vstack([rng.normal(size=(60, 24))[rng.integers(0, 60, 2400)] + 0.15 * rng.normal(size=(2400, 24)), rng.normal(size=(300, 24))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v[rng.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nearest.nearest(df, df.where("vec_id % 10 = 0"), k=20, per_cell=256).collect():
        got[r["query_id"]].add(r["vec_id"])
    asked = np.arange(0, len(v), 10)
    products = v[asked] @ v.T
    products[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-products, axis=1)[:, :20]
    found = np.array([len(got[q] & set(n.tolist())) / 20 for q, n in zip(asked.tolist(), near, strict=True)])
    sparse = np.argsort(np.sort(products, axis=1)[:, -20])[: len(asked) // 10]
    assert found.mean() >= 0.9 and found[sparse].mean() >= 0.8


@pytest.mark.parametrize("low,high,n,most", [(300, 400, 20_000, 7_534), (250, 520, 50_000, 20_100), (200, 300, 20_000, 5_000)])
def test_pieces_of_much_the_same_length(low, high, n, most):
    """Where the number to a sequence matters: at most what a plain rule (largest, smallest and best third; the rest in pairs) needs."""
    counts = np.bincount(np.random.default_rng(1).integers(low, high, n), minlength=1025)
    found = packing.plan(counts, 1024)
    used = np.zeros_like(counts)
    for lengths, k in found:
        assert sum(lengths) <= 1024
        np.add.at(used, list(lengths), k)
    assert (used == counts).all() and packing.lower_bound(counts, 1024) <= sum(k for _, k in found) <= most


def buckets_by_hand(text, bits):
    """The hashed n-grams of a text, one at a time, in whole numbers."""
    s, mask, out = " " + " ".join((text or "").lower().split()) + " ", 2**32 - 1, set()
    for i in range(len(s)):
        h = ord(s[i])
        for n in range(2, 6):
            if i + n > len(s):
                break
            h = (h * 0x9E3779B1 + ord(s[i + n - 1])) & mask
            if n >= 3:
                x = h ^ (h >> 15) ^ (n * 0x3C6EF372 & mask)
                x = x * 0x85EBCA6B & mask
                x = (x ^ x >> 13) * 0xC2B2AE35 & mask
                out.add(x >> (32 - bits))
    return out


def test_toxicity_scores_are_those_of_the_method_by_hand(spark):
    bits, rng = 9, random.Random(6)
    texts_ = [" ".join(rng.choice(["calm", "kind", "word", "tree", "Böse", "vile", "mean"][: 4 if i % 3 else 7]) for _ in range(rng.randrange(0, 9))) for i in range(70)] + [None, ""]
    y = np.array([int(any(w in t for w in ("Böse", "vile", "mean"))) if t else i % 2 for i, t in enumerate(texts_)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int"), features=toxicity.Features(bits=bits))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}

    here = np.zeros((len(texts_), 2**bits))
    for i, t in enumerate(texts_):
        here[i, sorted(buckets_by_hand(t, bits))] = 1
    one, zero = here[y == 1].sum(0), here[y == 0].sum(0)
    ratio = np.log((one + 1) / ((y == 1).sum() + 2)) - np.log((zero + 1) / ((y == 0).sum() + 2))
    ratio[one + zero < 3] = 0
    x = np.column_stack([here * ratio, np.ones(len(y))])
    keep = np.append(np.full(2**bits, 3.0), 0.0)  # the intercept isn't held back
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep + 1e-12), x.T @ (p - y) + keep * w)
    want = 1 / (1 + np.exp(-x @ w))
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=2e-3)
    assert want[y == 1].mean() > want[y == 0].mean() + 0.3
