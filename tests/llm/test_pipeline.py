"""The queries of the subpackage and the pipeline on the smallest tables."""

import collections
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from phenospark.llm import mixing, packing, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, sf, name):
    tables = duckdb.connect()
    for table in ("documents", "embeddings"):
        tables.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = tables.sql(queries.oracle_sql()[name])
    got = entry.queries()[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def ids(sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: (t, e.ids) for (d, t), e in zip(texts.items(), tok.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


def test_token_queries_against_the_library(spark, sf, ids):
    counted = {r["doc_id"]: r for r in entry.queries()["op4_token_counts"](spark, sf).collect()}
    files = {r["doc_id"]: r for r in entry.queries()["op6_token_files"](spark, sf).collect()}
    at = 0
    for d in sorted(ids):
        text, own = ids[d]
        assert (counted[d]["n_bytes"], counted[d]["n_tokens"], counted[d]["over_limit"]) == (len(text.encode()), len(own), len(own) > 512)
        assert (files[d]["start"], files[d]["n_tokens"], files[d]["ids_crc32"]) == (at, len(own) + 1, crc([*own, 2]))
        at += len(own) + 1
    assert len(counted) == len(files) == len(ids)


def test_packing_query_is_whole_and_near_its_bound(spark, sf, ids):
    rows = entry.queries()["op9_best_fit_packing"](spark, sf).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, (_, own) in ids.items():
        own, at = [*own, 2], 0
        for n, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, crc(own[at : at + r["length"]]))
            at += r["length"]
        assert at == len(own) and len(by_doc[d]) == -(-len(own) // 1024)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=1025), 1024)
    assert bound <= len(by_sequence) <= bound + 1


def test_nearest_query_against_brute_force(spark, sf):
    table = duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    v = np.array([e for _, e in table])
    got = collections.defaultdict(list)
    for r in entry.queries()["op10_nearest_vectors"](spark, sf).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q in range(0, len(v), 20):
        s = v @ v[q]
        best = [int(i) for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(x == pytest.approx(s[i], abs=1e-9) for _, i, x in own)
        found += len({i for _, i, _ in own} & set(best))
    assert found / (20 * len(got)) >= 0.9 and set(got) == set(range(0, len(v), 20))


def test_html_query_gives_the_articles(spark, sf):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in entry.queries()["op7_html_main_text"](spark, sf).collect()}
    for page_id, page in pages:  # the one layout of these tables, cut out by hand
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", article)))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (got[page_id]["text"], got[page_id]["n_chars"]) == (want, len(want))
    assert len(got) == len(pages)


def test_each_operator_has_a_query():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages_on_small_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    before = None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = str(tmp_path / str(i))
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    lengths = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in lengths) <= 1024
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    words = before.agg({"text": "count"}).first()[0]
    assert words == before.where("text is not null").count()


def test_odd_rows_pass_all_stages(spark, sf, tmp_path):
    """Repeated rows, a null doc_id, null, empty and long texts, and extra columns whose names the stages use themselves."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    schema = plain.schema
    odd = [(None, "a text without an id " * 9, None, None, 1), (900, None, "en", None, 0), (901, "", "en", "web", 0), (902, "long words " * 30_000, "en", "web", 330_000)]
    docs = plain.unionByName(plain.where("doc_id < 10")).unionByName(spark.createDataFrame(odd, schema))
    for c in ("n_words", "n_removed", "found", "kept", "size", "taken", "key", "score", "component_id", "row"):
        docs = docs.withColumn(c, F.lit(c))
    columns, known = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert {r[0] for r in docs.select("doc_id").collect()} <= known
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.select("found", "n_words").distinct().collect() == [("found", "n_words")]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_the_whole_run_leaves_one_folder_and_repeats(spark, sf):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) for _ in range(2))
    assert one == two and len(one) > 0


def test_empty_documents_pass_all_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == 0
    assert mixing.mix_plan(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0
