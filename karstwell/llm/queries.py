"""The queries of this subpackage: ``opN_<name>`` on the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.llm.knn import exact_topk, forest_search
from karstwell.llm.language import identify_languages
from karstwell.llm.lines import dedup_lines
from karstwell.llm.mixing import mix_sources
from karstwell.llm.neardup import near_duplicates
from karstwell.llm.packing import pack_documents
from karstwell.llm.pii import pseudonymise
from karstwell.llm.substrings import remove_repeats
from karstwell.llm.toxicity import score_toxicity

def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def held_out() -> Column:
    """Whether a document is in the fold that nothing is learned from; a null doc_id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = identify_languages(_read(spark, folder, "documents"), learn=~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"), shingle=3, percent=85)


def op3_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(_read(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_superkmer_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(_read(spark, folder, "documents"), _read(spark, folder, "labels"), learn=~held_out(), threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_read(spark, folder, "documents"))


def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """The key is for demonstration; in production it comes from a secret store."""
    return pseudonymise(_read(spark, folder, "documents"), key="demonstration key").select("doc_id", "text", "n_private")


def op8_forest_search(spark: SparkSession, folder: str) -> DataFrame:
    return forest_search(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_line_windows": op3_line_windows,
    "op4_superkmer_substrings": op4_superkmer_substrings,
    "op5_toxicity": op5_toxicity,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_forest_search": op8_forest_search,
    "op9_exact_topk": op9_exact_topk,
    "op10_mix_sources": op10_mix_sources,
}

SQL = {
    "op2_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
""",
    "op3_line_windows": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, array_to_string(ls[i:i + 2], chr(10)) AS g FROM l, unnest(range(1, len(ls) - 1)) AS t(i)),
n AS (
  SELECT *, row_number() OVER o AS nth, first_value(doc_id) OVER o AS first_id, count(*) OVER (PARTITION BY g) AS times
  FROM w WHERE regexp_matches(g, '\S') WINDOW o AS (PARTITION BY g ORDER BY doc_id NULLS LAST, pos)),
c AS (
  SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p, nth = 1 AS is_first, doc_id IS DISTINCT FROM first_id AS is_outside
  FROM n WHERE times > 1),
r AS (SELECT doc_id, p FROM c GROUP BY doc_id, p HAVING bool_or(is_outside) OR NOT bool_or(is_first)),
k AS (
  SELECT l.doc_id, string_agg(ls[i], chr(10) ORDER BY i) FILTER (WHERE r.p IS NULL) AS left_over, count(r.p) AS gone
  FROM l, unnest(range(1, len(ls) + 1)) AS t(i) LEFT JOIN r ON r.doc_id = l.doc_id AND r.p = i GROUP BY l.doc_id)
SELECT l.doc_id, CASE WHEN k.gone > 0 THEN coalesce(k.left_over, '') ELSE l.text END AS text,
  CAST(CASE WHEN coalesce(length(l.text), 0) = 0 THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN k USING (doc_id)
""",
    "op4_superkmer_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (s) WHERE least < doc_id),
k AS (
  SELECT w.doc_id, string_agg(ws[i], ' ' ORDER BY i) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS gone
  FROM w, unnest(range(1, len(ws) + 1)) AS t(i) LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = i GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
""",
    "op9_exact_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
""",
    "op10_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
-- Sources reach three times their size in the order of size by weight; each is full if its share of what is left is larger.
o AS (
  SELECT *, (SELECT sum(size) FROM d) - 3 * coalesce(sum(n) OVER before, 0) AS left_n,
    (SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0) AS left_w
  FROM s WINDOW before AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_n * w > 3 * n * left_w AS is_full FROM o),
p AS (
  SELECT (SELECT sum(size) FROM d) - 3 * coalesce(sum(n) FILTER (WHERE is_full), 0) AS left_n,
    (SELECT sum(w) FROM s) - coalesce(sum(w) FILTER (WHERE is_full), 0) AS left_w
  FROM f),
t AS (
  SELECT f.source, f.n, CASE WHEN is_full THEN CAST(3 * n AS DOUBLE) ELSE CAST(p.left_n * w AS DOUBLE) / CAST(p.left_w AS DOUBLE) END AS target
  FROM f, p),
k AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, CAST(floor(target / n) AS BIGINT)) END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS after FROM g)
SELECT d.doc_id, d.size, k.n AS source_size, k.target,
  CAST(d.size * (k.whole + CASE WHEN 2 * c.after - c.size < 2 * (k.target - k.whole * k.n) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
""",
}
