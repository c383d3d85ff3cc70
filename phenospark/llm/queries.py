"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, html, lexical, licences, minhash, mixing, near_vectors, nearest, packing, substrings, token_counts, token_files, toxicity

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 5, 2, 1."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.9."""
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def near_vectors_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings and a near copy of each, linked at a cosine of 0.9."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    shift = F.transform("embedding", lambda x, i: x + F.lit(0.02) * (F.pmod((i + 1) * 7 + F.col("vec_id"), F.lit(5)) - 2))
    return near_vectors.near_vectors(rows.unionByName(rows.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), shift.alias("embedding"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that never saw the held-out labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path(BPE), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows of 35."""
    out = substrings.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids and read back."""
    path = common.scratch(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(BPE), public_tokenizers.PATTERN, end=2)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", token_files.crc32().alias("ids_crc32"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html.extract_text(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at a similarity of 0.8 on shingles of four words."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    pieces = packing.pieces_of(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), public_tokenizers.PATTERN, room=1024, end=2)
    return packing.pack(pieces, room=1024)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    own = [op1_mix_sources, op2_embedding_near_dedup, op3_toxicity, op4_token_counts, op5_substring_dedup, op6_token_files, op7_html_main_text, op8_minhash_near_dedup, op9_best_fit_packing, op10_nearest_vectors, op11_licence_scan, op12_collocations, op13_lexical_search, near_vectors_planted, pipeline]
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
room AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight, source_size * 3 AS room FROM sizes),
lefts AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(room) OVER b, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
  FROM room WINDOW b AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT *, room * weight_left <= words_left * weight AS stopped FROM lefts),
targets AS (
  SELECT source AS of, source_size, CASE WHEN stopped THEN room::DOUBLE
    ELSE weight * (max(CASE WHEN NOT stopped THEN words_left END) OVER ())::DOUBLE / (max(CASE WHEN NOT stopped THEN weight_left END) OVER ()) END AS target
  FROM stops),
placed AS (
  SELECT r.*, t.source_size, t.target, count(*) OVER (PARTITION BY source ORDER BY key, doc_id, size RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS equal,
         sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.of),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs, upto - equal * size AS prefix FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + floor(greatest(0, least(floor(target - epochs * source_size) - prefix, equal * size)) / equal))::BIGINT AS taken
FROM cut
"""


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""

OP5_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT rid, j, md5(array_to_string(ws[j:j + 34], ' ')) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS j FROM w WHERE len(ws) >= 35)),
again AS (SELECT rid, j FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(j, j + 35)) AS i FROM again),
words AS (SELECT rid, i, ws[i] AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[j:j + 3], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS j FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON w.doc_id = least.a
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def licence_sql(notices: tuple[licences.Notice, ...] = licences.NOTICES, depth: int = 6, share: float = 0.6) -> str:
    """The same by word places: every word of every document, joined with the words of the notices."""
    words = [(t, p, w) for t, n in enumerate(notices) for p, w in enumerate(n.words)]
    keys = [(t, at + i, w) for t, n in enumerate(notices) for k, at in n.places() for i, w in enumerate(k)]
    meta = [(t, n.label, n.base) for t, n in enumerate(notices)]
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '{licences.LOWERED}'), []) AS ws FROM documents),
n AS (SELECT count(*) FILTER (len(ws) > 0) AS n FROM d), words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
notice(t, p, w) AS (VALUES {_values(words)}), keyed(t, p, w) AS (VALUES {_values(keys)}), meta(t, label, base) AS (VALUES {_values(meta)}),
df AS (SELECT w, count(DISTINCT rid) AS df FROM words WHERE w IN (SELECT w FROM notice) GROUP BY w),
ranked AS (SELECT t, p, notice.w, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), p) AS r FROM notice LEFT JOIN df ON notice.w = df.w),
posts AS (SELECT t, p, w, ln((n + 1) / (df + 0.5)) AS weight FROM ranked, n WHERE r <= {depth}), total AS (SELECT t, sum(weight) AS total FROM posts GROUP BY t),
need AS (SELECT t, count(*) AS need FROM keyed GROUP BY t),
stand AS (SELECT rid, t, i - p AS start, count(*) AS k FROM words JOIN keyed USING (w) GROUP BY ALL),
light AS (SELECT rid, t, i - p AS start, sum(weight) AS weight FROM words JOIN posts USING (w) GROUP BY ALL),
found AS (SELECT rid, start, label, base, coalesce(weight, 0) / total AS share FROM stand JOIN need USING (t) JOIN total USING (t) JOIN meta USING (t) LEFT JOIN light USING (rid, t, start) WHERE k = need AND (base OR coalesce(weight, 0) / total >= {share})),
own AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS a, max(start) FILTER (base) AS b, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(least(share, 1)) AS score FROM found GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score FROM d LEFT JOIN own USING (rid)"""


OP12_SQL = rf"""
WITH pieces AS (SELECT row_number() OVER () AS rid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(ws[j:j + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM pieces, (VALUES (1), (2), (3)) s(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS l, array_to_string(ws[i + 1:], ' ') AS r FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, i, x.a AS l, y.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON cuts.lang = x.lang AND cuts.l = x.phrase JOIN f y ON cuts.lang = y.lang AND cuts.r = y.phrase),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '{lexical.TERM}'), []) AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{lexical.TERM}')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(ts) * n) // l) AS m FROM d, s WHERE len(ts) > 0),
scored AS (SELECT item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


PLANTED_SQL = OP2_SQL.replace("WITH RECURSIVE v AS", """WITH RECURSIVE planted AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000000, list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE + 0.02::DOUBLE * ((i * 7 + vec_id) % 5 - 2)) FROM embeddings),
v AS""").replace("FROM embeddings\n  WHERE len", "FROM planted\n  WHERE len").replace("FROM embeddings LEFT JOIN", "FROM planted LEFT JOIN")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express on whole tables."""
    return {"op1_mix_sources": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "near_vectors_planted": PLANTED_SQL, "op5_substring_dedup": OP5_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_licence_scan": licence_sql(), "op12_collocations": OP12_SQL, "op13_lexical_search": OP13_SQL}
