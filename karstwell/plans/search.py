"""Queries of filters, vector search and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karstwell import schemas
from karstwell.functions import paths as P
from karstwell.functions import vectors as V
from karstwell.operators import search as S
from karstwell.plans._register import query
from karstwell.sources import tables as T

R = "round({}, 6)"


def _vector(spark: SparkSession, folder: str, chunk_id: int) -> list[float]:
    row = T.embeddings(spark, folder).where(F.col("chunk_id") == chunk_id).select("embedding").first()
    return [float(x) for x in row[0]]


HIT = ["chunk_id", "path", "start_line", "code"]


@query("f1_regex_search", r"""SELECT chunk_id, path, start_line, code FROM chunks WHERE regexp_matches(code, '\b(idiot|scum|trash)\b') AND contains('/' || path, '/en/')
  ORDER BY path, start_line LIMIT 20 OFFSET 5""")
def f1(spark: SparkSession, folder: str) -> DataFrame:
    found = S.regex_search(T.chunks(spark, folder), r"\b(idiot|scum|trash)\b", path="en")
    return S.page(found.select(HIT), [F.col("path"), F.col("start_line")], 20, 5)


@query("f2_regex_search_unordered", r"""SELECT DISTINCT chunk_id, file_id FROM chunks WHERE regexp_matches(code, 'License') AND file_id IN (SELECT file_id FROM files WHERE contains('/'
  || path, '/src1/'))""")
def f2(spark, folder):
    inside = T.files(spark, folder).where(P.in_path(F.col("path"), "src1")).select("file_id")
    return T.chunks(spark, folder).where(F.col("code").rlike("License")).join(inside, "file_id", "left_semi").select("chunk_id", "file_id").dropDuplicates(["chunk_id"])


@query("f3_text_search", "SELECT chunk_id, path, start_line, code FROM chunks WHERE code LIKE '%moron%cl_wn%' OR symbol LIKE '%moron%cl_wn%' OR code LIKE '%pathetic%'")
def f3(spark, folder):
    c = T.chunks(spark, folder)
    return S.text_search(c, "moron%cl_wn").unionByName(S.text_search(c, "pathetic")).dropDuplicates(["chunk_id"]).select(HIT)


@query("f4_text_search_escaped", "SELECT chunk_id, path, start_line, code FROM chunks WHERE contains(code, '***') AND contains(code, '%%%')")
def f4(spark, folder):
    c = T.chunks(spark, folder)
    return S.text_search(c, "***", escaped=True).join(S.text_search(c, "%%%", escaped=True).select("chunk_id"), "chunk_id", "left_semi").select(HIT)


@query("f5_escape_like", r"SELECT doc_id, regexp_replace(text, '([\\%_\[])', '\\\1', 'g') AS escaped FROM documents", views=False)
def f5(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"([\\%_\[])", r"\\$1").alias("escaped"))


@query("f6_path_filter", r"""SELECT page_id, CASE WHEN regexp_matches(p, '\.\.|[~*?\[\]]') OR length(n) = 0 THEN NULL
  WHEN n LIKE '%/' OR contains(substr(split_part(n, '/', -1), 2), '.') THEN n ELSE n || '/' END AS path_filter
  FROM (SELECT page_id, p, regexp_replace(trim(p), '^/+', '') AS n FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS p FROM pages))""", views=False)
def f6(spark, folder):
    p = T.table(spark, folder, "pages").select("page_id", F.regexp_replace("url", "^https?:/", "").alias("p"))
    return p.select("page_id", P.normalize_filter_column(F.col("p")).alias("path_filter"))


@query("f7_component_path", "SELECT file_id, path FROM files WHERE '/' || path LIKE '%/de/%' OR '/' || path LIKE '%/doc\\_7.txt' ESCAPE '\\'")
def f7(spark, folder):
    return T.files(spark, folder).where(P.in_path(F.col("path"), "de") | P.in_path(F.col("path"), "doc_7.txt")).select("file_id", "path")


@query("f8_prefix_scope", "SELECT path FROM files WHERE path LIKE 'src1/%'")
def f8(spark, folder):
    return T.files(spark, folder).where(F.col("path").startswith("src1/")).select("path")


@query("f9_under_directory", "SELECT path FROM files WHERE path = 'src3/en' OR path LIKE 'src3/en/%' ORDER BY path")
def f9(spark, folder):
    return T.files(spark, folder).where(P.under_directory(F.col("path"), "src3/en")).select("path").orderBy("path")


@query("f10_file_lookup", "SELECT file_id, path, language, size, content_hash FROM files WHERE path = 'src5/en/doc_5.txt' OR file_id = 17")
def f10(spark, folder):
    f = T.files(spark, folder)
    return f.where((F.col("path") == "src5/en/doc_5.txt") | (F.col("file_id") == 17)).drop("text")


@query("f11_chunks_of_file", "SELECT chunk_id, start_line, end_line, code FROM chunks WHERE file_id = 12 ORDER BY start_line")
def f11(spark, folder):
    return T.chunks(spark, folder).where(F.col("file_id") == 12).select("chunk_id", "start_line", "end_line", "code").orderBy("start_line")


@query("f12_chunks_with_files", "SELECT c.chunk_id, c.start_line, c.chunk_type, f.path, f.language, f.size FROM chunks c JOIN files f USING (file_id)")
def f12(spark, folder):
    f = T.files(spark, folder).select("file_id", "path", "language", "size")
    return T.chunks(spark, folder).select("chunk_id", "file_id", "start_line", "chunk_type").join(f, "file_id").select("chunk_id", "start_line", "chunk_type", "path", "language", "size")


@query("f13_embedding_lookup", "SELECT chunk_id, provider, model, dims FROM embs WHERE chunk_id = 33 AND provider = 'fake'")
def f13(spark, folder):
    return T.embeddings(spark, folder).where((F.col("chunk_id") == 33) & (F.col("provider") == "fake")).select("chunk_id", "provider", "model", "dims")


@query("f14_raw_sql", "SELECT language, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM files WHERE size > 100 GROUP BY language")
def f14(spark, folder):
    return spark.sql("SELECT language, count(*) AS n, sum(size) AS size FROM {files} WHERE size > :least GROUP BY language", args={"least": 100}, files=T.files(spark, folder))


@query("f15_select_from_files", "SELECT path, size, CAST(NULL AS VARCHAR) AS unknown FROM files")
def f15(spark, folder):
    f = T.files(spark, folder)
    return f.select(*[F.col(c) if c in f.columns else F.lit(None).cast("string").alias(c) for c in ("path", "size", "unknown")])


@query("f16_valid_embeddings", "SELECT chunk_id FROM embs WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def f16(spark, folder):
    return T.embeddings(spark, folder).where(V.is_valid(F.col("embedding"))).select("chunk_id")


@query("f17_type_classes", "SELECT chunk_id, chunk_type IN ('namespace', 'function', 'block') AS is_code, chunk_type = 'comment' AS is_documentation FROM chunks")
def f17(spark, folder):
    t = F.col("chunk_type")
    return T.chunks(spark, folder).select("chunk_id", t.isin(*schemas.CODE_TYPES).alias("is_code"), t.isin(*schemas.DOCUMENTATION_TYPES).alias("is_documentation"))


@query("f18_size_predicates", """SELECT chunk_id, length(code) < 100 AS is_small, length(code) > 1000 AS is_large, start_line <= 3 AND 3 <= end_line
  AS has_line, NOT (end_line < 2 OR 4 < start_line) AS overlaps FROM chunks""")
def f18(spark, folder):
    s, e, n = F.col("start_line"), F.col("end_line"), F.length("code")
    return T.chunks(spark, folder).select("chunk_id", (n < 100).alias("is_small"), (n > 1000).alias("is_large"), ((s <= 3) & (e >= 3)).alias("has_line"), (~((e < 2) | (s > 4))).alias("overlaps"))


@query("f19_excluded_globs", """SELECT file_id FROM files WHERE NOT (list_contains(string_split(path, '/'), 'fr') OR path LIKE 'src1%' OR regexp_matches(path, '^src2/.*7\\.txt$'))""")
def f19(spark, folder):
    return T.files(spark, folder).where(~P.excluded(F.col("path"), ["**/fr/**", "src1*", "src2/*7.txt"])).select("file_id")


@query("f20_symbols", """SELECT DISTINCT symbol FROM chunks WHERE length(symbol) > 1 AND NOT regexp_matches(symbol, '^[0-9]+$')
  AND lower(symbol) NOT IN ('self', 'cls', 'this')""")
def f20(spark, folder):
    return T.chunks(spark, folder).where(S.useful_symbol(F.col("symbol"))).select("symbol").distinct()


@query("f21_row_rules", """SELECT chunk_id, CASE WHEN start_line - 2 < 1 THEN 'start_line' WHEN end_line % 7 < 1 THEN 'end_line'
  WHEN start_line - 2 > end_line % 7 THEN 'order' END AS fault FROM chunks""")
def f21(spark, folder):
    c = T.chunks(spark, folder)
    return c.select("chunk_id", schemas.chunk_faults(F.col("start_line") - 2, F.col("end_line") % 7, F.col("code")).alias("fault"))


COS = "list_cosine_similarity(embedding, (SELECT embedding FROM embs WHERE chunk_id = {}))"


@query("v1_semantic_search", f"""SELECT chunk_id, path, round({COS.format(7)}, 6) AS similarity FROM embs JOIN files ON file_id = chunk_id WHERE {COS.format(7)} >= 0.1
  AND contains('/' || path, '/en/') ORDER BY {COS.format(7)} DESC, chunk_id LIMIT 10 OFFSET 2""")
def v1(spark, folder):
    hits = S.semantic(T.embeddings(spark, folder), _vector(spark, folder, 7), threshold=0.1)
    f = T.files(spark, folder).where(P.in_path(F.col("path"), "en")).select(F.col("file_id").alias("chunk_id"), "path")
    top = S.page(hits.select("chunk_id", "similarity").join(f, "chunk_id"), [F.col("similarity").desc(), F.col("chunk_id")], 10, 2)
    return top.select("chunk_id", "path", F.round("similarity", 6).alias("similarity"))


@query("v2_semantic_by_distance", f"SELECT chunk_id, round(1 - {COS.format(7)}, 6) AS distance FROM embs WHERE 1 - {COS.format(7)} <= 0.8")
def v2(spark, folder):
    hits = S.semantic(T.embeddings(spark, folder), _vector(spark, folder, 7)).withColumn("distance", 1 - F.col("similarity"))
    return hits.where("distance <= 0.8").dropDuplicates(["chunk_id"]).select("chunk_id", F.round("distance", 6).alias("distance"))


@query("v3_similar_chunks", f"SELECT chunk_id, round({COS.format(0)}, 6) AS score FROM embs WHERE chunk_id <> 0 ORDER BY {COS.format(0)} DESC, chunk_id LIMIT 10")
def v3(spark, folder):
    top = S.page(S.neighbours(T.embeddings(spark, folder), 0), [F.col("score").desc(), F.col("chunk_id")], 10)
    return top.select("chunk_id", F.round("score", 6).alias("score"))


@query("v4_similar_by_similarity", f"SELECT chunk_id, round({COS.format(3)}, 6) AS score FROM embs WHERE chunk_id <> 3 AND {COS.format(3)} >= 0.2")
def v4(spark, folder):
    return S.neighbours(T.embeddings(spark, folder), 3, min_similarity=0.2).select("chunk_id", F.round("score", 6).alias("score"))


@query("v5_search_by_vector", f"""SELECT chunk_id, round({COS.format(9)}, 6) AS score FROM embs WHERE 1 - {COS.format(9)} <= 0.75 ORDER BY {COS.format(9)} DESC, chunk_id LIMIT 20""")
def v5(spark, folder):
    hits = S.semantic(T.embeddings(spark, folder), _vector(spark, folder, 9)).where(1 - F.col("similarity") <= 0.75)
    return S.page(hits, [F.col("similarity").desc(), F.col("chunk_id")], 20).select("chunk_id", F.round("similarity", 6).alias("score"))


@query("v6_similarities_of_ids", f"SELECT chunk_id, round({COS.format(5)}, 6) AS similarity FROM embs WHERE chunk_id IN (SELECT doc_id FROM labels)")
def v6(spark, folder):
    ids = T.table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"))
    return S.semantic(T.embeddings(spark, folder).join(ids, "chunk_id", "left_semi"), _vector(spark, folder, 5)).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("v7_vector_math", """SELECT a.chunk_id, round(list_inner_product(a.embedding, b.embedding), 6) AS dot, round(list_cosine_similarity(a.embedding, b.embedding), 6)
  AS cosine,
  round(list_distance(a.embedding, b.embedding), 6) AS euclidean, round(sqrt(list_inner_product(a.embedding, a.embedding)), 6) AS magnitude
  FROM embs a JOIN embs b ON b.chunk_id = a.chunk_id + 1""")
def v7(spark, folder):
    e = T.embeddings(spark, folder).select("chunk_id", "embedding")
    other = e.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return e.join(other, "chunk_id").select("chunk_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.euclidean(a, b), 6).alias("euclidean"), F.round(V.norm(a), 6).alias("magnitude"))


@query("v8_matryoshka", """SELECT chunk_id, list_transform(embedding[1:16], lambda x: round(x / sqrt(list_inner_product(embedding[1:16], embedding[1:16])), 6)) AS embedding
  FROM embs""")
def v8(spark, folder):
    return T.embeddings(spark, folder).select("chunk_id", F.transform(V.shorten(F.col("embedding"), 16), lambda x: F.round(x, 6)).alias("embedding"))


@query("v10_diff_semantic", f"""SELECT chunk_id, round({COS.format(2)}, 6) AS similarity FROM embs JOIN files ON file_id = chunk_id WHERE path LIKE 'src2/%'
  AND {COS.format(2)} >= 0.05 ORDER BY {COS.format(2)} DESC, chunk_id LIMIT 10""")
def v10(spark, folder):
    diff = T.files(spark, folder).where(F.col("path").startswith("src2/")).select(F.col("file_id").alias("chunk_id"))
    hits = S.semantic(T.embeddings(spark, folder).join(diff, "chunk_id", "left_semi"), _vector(spark, folder, 2), threshold=0.05)
    return S.page(hits, [F.col("similarity").desc(), F.col("chunk_id")], 10).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("v11_merge_diff_and_stored", f""", hits AS (SELECT chunk_id, chunk_id % 90 AS location, {COS.format(4)} AS s, chunk_id % 10 < 3 AS is_diff FROM embs),
  best AS (SELECT *, row_number() OVER (PARTITION BY location, is_diff ORDER BY s DESC, chunk_id) AS n FROM hits)
  SELECT chunk_id, is_diff, round(s, 6) AS similarity FROM best b WHERE n = 1 AND s >= 0.1 AND (is_diff OR NOT EXISTS (SELECT 1 FROM hits h
  WHERE h.is_diff AND h.location = b.location))""")
def v11(spark, folder):
    hits = S.semantic(T.embeddings(spark, folder), _vector(spark, folder, 4)).select("chunk_id", (F.col("chunk_id") % 90).alias("location"), F.col("similarity"), (F.col("chunk_id") % 10 < 3).alias("is_diff"))
    diff, stored = hits.where("is_diff"), hits.where("not is_diff")
    both = diff.unionByName(stored.join(diff.select("location"), "location", "left_anti"))
    first = F.row_number().over(Window.partitionBy("location").orderBy(F.col("similarity").desc(), "chunk_id"))
    return both.withColumn("n", first).where("n = 1 and similarity >= 0.1").select("chunk_id", "is_diff", F.round("similarity", 6).alias("similarity"))


HYBRID = f""", s AS (SELECT chunk_id, {COS.format(6)} AS sim, row_number() OVER (ORDER BY {COS.format(6)} DESC, chunk_id) - 1 AS p FROM embs QUALIFY p < 20),
  r AS (SELECT file_id AS chunk_id, row_number() OVER (ORDER BY path) - 1 AS p FROM files WHERE regexp_matches(text, 'License|idiot') QUALIFY p < 20),
  h AS (SELECT coalesce(s.chunk_id, r.chunk_id) AS chunk_id, CASE WHEN s.chunk_id IS NULL THEN 'regex' WHEN r.chunk_id IS NULL THEN 'semantic'
  ELSE 'hybrid' END AS search_type,
    coalesce((((SELECT count(*) FROM s) - s.p) / (SELECT count(*) FROM s) * 0.3 + sim * 0.7) * 0.7, 0) + coalesce(((SELECT count(*) FROM r) - r.p) / (SELECT count(*) FROM r) * 0.3, 0) AS score
    FROM s FULL JOIN r ON s.chunk_id = r.chunk_id)
  SELECT chunk_id, search_type, round(score, 6) AS combined_score FROM h ORDER BY score DESC, chunk_id LIMIT {{}}"""


def _hybrid(spark, folder, limit):
    s = S.ranked_positions(S.semantic(T.embeddings(spark, folder), _vector(spark, folder, 6)).select("chunk_id", "similarity"), [F.col("similarity").desc(), F.col("chunk_id")], 20)
    hits = T.files(spark, folder).where(F.col("text").rlike("License|idiot")).select(F.col("file_id").alias("chunk_id"), "path")
    r = S.ranked_positions(hits, [F.col("path")], 20)
    return S.page(S.fuse(s, r, 0.7), [F.col("combined_score").desc(), F.col("chunk_id")], limit).withColumn("combined_score", F.round("combined_score", 6))


@query("v12_fusion", HYBRID.format(40))
def v12(spark, folder):
    return _hybrid(spark, folder, 40)


@query("v13_hybrid_search", HYBRID.format(10))
def v13(spark, folder):
    return _hybrid(spark, folder, 10)


@query("v14_multi_hop")
def v14(spark, folder):
    """Rounds until the ranking stops to improve, with a score by id in place of a model's."""
    e = T.embeddings(spark, folder)
    return S.multi_hop(e, _vector(spark, folder, 1), (F.col("chunk_id") * 37 % 101) / 100.0).select("chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("v15_rerank", f""", h AS (SELECT chunk_id, {COS.format(8)} AS s, text FROM embs LEFT JOIN files ON file_id = chunk_id)
  SELECT chunk_id, round(CASE WHEN chunk_id % 3 = 0
  AND text IS NOT NULL THEN len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+')), ['and', 'the', 'thing'])) / 3.0
  ELSE s END, 6) AS rerank_score FROM h""")
def v15(spark, folder):
    hits = S.semantic(T.embeddings(spark, folder), _vector(spark, folder, 8)).select("chunk_id", F.col("similarity").alias("rerank_score"))
    text = T.files(spark, folder).select(F.col("file_id").alias("chunk_id"), "text")
    scores = text.where("chunk_id % 3 = 0").select("chunk_id", S.term_overlap("the thing and", F.col("text")).alias("score"))
    return S.apply_rerank(hits, scores).select("chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


@query("v16_compound_rerank", """SELECT doc_id AS chunk_id, round(avg(CASE WHEN contains(text, q) THEN n ELSE 0 END), 6) AS rerank_score
  FROM documents, (VALUES ('idiot', 1.0), ('License', 0.5), ('the', 0.25)) AS v(q, n) GROUP BY doc_id""", views=False)
def v16(spark, folder):
    d = T.table(spark, folder, "documents")
    queries = [("idiot", 1.0), ("License", 0.5), ("the", 0.25)]
    scores = F.array(*[F.when(F.contains("text", F.lit(q)), F.lit(n)) for q, n in queries])
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / len(queries)
    return d.select(F.col("doc_id").alias("chunk_id"), F.round(mean, 6).alias("rerank_score"))


ELBOW = f""", h AS (SELECT chunk_id, {COS.format(11)} AS s, row_number() OVER (ORDER BY {COS.format(11)} DESC, chunk_id) - 1 AS rank, count(*) OVER ()
  AS n, max({COS.format(11)}) OVER () AS hi, min({COS.format(11)}) OVER () AS lo FROM embs WHERE chunk_id <> 11),
  d AS (SELECT *, CASE WHEN n >= 3 AND hi > lo THEN abs(1 - rank / (n - 1) - (s - lo) / (hi - lo)) / sqrt(2) END AS far FROM h),
  e AS (SELECT CASE WHEN far >= 0.01 THEN rank END AS elbow FROM d ORDER BY far DESC, rank LIMIT 1) """


def _elbow(spark, folder):
    e = S.neighbours(T.embeddings(spark, folder), 11).select("chunk_id", "score")
    return S.elbow(e, "score")


@query("v17_elbow", ELBOW + "SELECT d.chunk_id, round(s, 6) AS score, e.elbow FROM d, e WHERE d.rank = e.elbow")
def v17(spark, folder):
    return _elbow(spark, folder).where("rank = elbow").select("chunk_id", F.round("score", 6).alias("score"), F.col("elbow").cast("long").alias("elbow"))


@query("v18_elbow_threshold", ELBOW + "SELECT round(coalesce((SELECT s FROM d, e WHERE d.rank = e.elbow), (SELECT s FROM d WHERE rank = n // 2), 0.5), 6) AS threshold")
def v18(spark, folder):
    e = _elbow(spark, folder)
    picked = e.agg(F.max(F.when(F.col("rank") == F.col("elbow"), F.col("score"))).alias("at"), F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2), F.col("score"))).alias("mid"))
    return picked.select(F.round(F.coalesce("at", "mid", F.lit(0.5)), 6).alias("threshold"))


@query("v19_elbow_filter", ELBOW + "SELECT d.chunk_id, d.rank FROM d, e WHERE d.rank <= coalesce(e.elbow, d.n)")
def v19(spark, folder):
    return _elbow(spark, folder).where("rank <= coalesce(elbow, n)").select("chunk_id", F.col("rank").cast("long").alias("rank"))


@query("v20_unified_score", """SELECT doc_id AS chunk_id, coalesce(CAST(toxic AS DOUBLE), CAST(n_chars AS DOUBLE), 0) AS score FROM documents LEFT
  JOIN labels USING (doc_id)""", views=False)
def v20(spark, folder):
    l = T.table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("rerank_score"))
    d = T.table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("similarity")).join(l, "doc_id", "left")
    return d.select(F.col("doc_id").alias("chunk_id"), S.unified_score(d).alias("score"))


@query("v21_regex_budget", """SELECT language, CAST(greatest(20, CAST(floor(n * 0.3) AS INTEGER)) AS INTEGER) AS target, greatest(1, CAST(floor(greatest(20, floor(n * 0.3)) / k)
  AS INTEGER)) AS per_symbol FROM (SELECT language, count(*) AS n, count(DISTINCT symbol) AS k FROM chunks GROUP BY language)""")
def v21(spark, folder):
    n = T.chunks(spark, folder).groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("k"))
    target, each = S.augmentation_budget(F.col("n"), F.col("k"))
    return n.select("language", target.cast("int").alias("target"), each.alias("per_symbol"))


@query("v22_symbol_search", r""", w AS (SELECT DISTINCT chunk_id, path, start_line, unnest(regexp_split_to_array(code, '[^0-9A-Za-z_]+')) AS word FROM chunks),
  n AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY path, start_line, chunk_id) AS k FROM w WHERE word IN ('idiot', 'clown', 'License', 'Apache'))
  SELECT word AS symbol, chunk_id, path FROM n WHERE k <= 5""")
def v22(spark, folder):
    symbols = spark.createDataFrame([("idiot",), ("clown",), ("License",), ("Apache",)], "symbol string")
    return S.search_by_symbols(T.chunks(spark, folder), symbols, per_symbol=5).select("symbol", "chunk_id", "path")


@query("v23_symbol_regex", r"""SELECT DISTINCT symbol, (CASE WHEN regexp_matches(symbol, '^[0-9A-Za-z_]') THEN '\b' ELSE '(?:^|\W)' END)
  || regexp_replace(symbol, '([\\.^$|?*+()\[\]{}])', '\\\1', 'g')
  || (CASE WHEN regexp_matches(symbol, '[0-9A-Za-z_]$') THEN '\b' ELSE '(?:\W|$)' END) AS pattern FROM chunks""")
def v23(spark, folder):
    return T.chunks(spark, folder).select("symbol").distinct().select("symbol", S.symbol_regex(F.col("symbol")).alias("pattern"))


@query("v24_enhance", r"""SELECT chunk_id, regexp_replace(symbol || '_part1_part2', '(?:_part[0-9]+)+$', '') AS symbol, end_line - start_line + 1 AS line_count,
  CASE WHEN length(code) > 500 THEN left(code, 500) || '...' ELSE code END AS code_preview, length(code) > 500 AS is_truncated, regexp_extract(path, '(\.[^./]+)$', 1) AS file_extension FROM chunks""")
def v24(spark, folder):
    c = T.chunks(spark, folder).withColumn("symbol", F.concat("symbol", F.lit("_part1_part2")))
    return S.enhance(c).select("chunk_id", "symbol", "line_count", "code_preview", "is_truncated", "file_extension")


@query("v25_page_metadata", """SELECT 20 AS offset, 10 AS page_size, count(*) > 30 AS has_more, CASE WHEN count(*) > 30 THEN 30 END AS next_offset, count(*) AS total FROM chunks
  WHERE contains(code, 'License')""")
def v25(spark, folder):
    return S.page_metadata(T.chunks(spark, folder).where(F.contains("code", F.lit("License"))), 10, 20)


@query("v26_url_interleave", r""", p AS (SELECT page_id % 3 AS query_ord, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS rank, url FROM pages),
  k AS (SELECT *, lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1))
  || coalesce(nullif(regexp_replace(regexp_extract(substr(regexp_replace(url, '#.*$', ''), length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) + 1), '^([^?]*)', 1), '/+$', ''), ''), '/') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\?.*)$', 1) AS key FROM p),
  f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, query_ord, url) AS n FROM k)
  SELECT query_ord, rank, url FROM f WHERE n = 1 ORDER BY rank, query_ord LIMIT 60""")
def v26(spark, folder):
    p = T.table(spark, folder, "pages").select((F.col("page_id") % 3).alias("query_ord"), "page_id", "url")
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("query_ord").orderBy("page_id")).cast("long"))
    return S.interleave(p.select("query_ord", "rank", "url"), 60).select("query_ord", "rank", "url")
