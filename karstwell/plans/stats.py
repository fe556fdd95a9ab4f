"""Queries of counts, coverage, evaluation and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karstwell.operators import cluster as K
from karstwell.operators import search as S
from karstwell.operators import stats as A
from karstwell.plans._register import query
from karstwell.sources import tables as T


def _single_rows(*frames):
    """Single-row frames side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


@query("a1_table_counts", """SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embs)
  AS embeddings, (SELECT count(DISTINCT provider || '/' || model) FROM embs) AS models""")
def a1(spark, folder):
    e = T.embeddings(spark, folder).agg(F.count("*").alias("embeddings"), F.countDistinct("provider", "model").alias("models"))
    return _single_rows(T.files(spark, folder).agg(F.count("*").alias("files")), T.chunks(spark, folder).agg(F.count("*").alias("chunks")), e)


@query("a2_valid_counts", """SELECT count(*) AS embeddings, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0) AS valid, CAST(sum(len(embedding) * 4)
  AS BIGINT) AS bytes FROM embs""")
def a2(spark, folder):
    from karstwell.functions.vectors import is_valid

    return T.embeddings(spark, folder).agg(F.count("*").alias("embeddings"), F.count_if(is_valid(F.col("embedding"))).alias("valid"), F.sum(F.col("dims").cast("long") * 4).alias("bytes"))


@query("a3_scope_counts", "SELECT (SELECT count(*) FROM files WHERE path LIKE 'src2/%') AS files, (SELECT count(*) FROM chunks WHERE path LIKE 'src2/%') AS chunks")
def a3(spark, folder):
    inside = F.col("path").startswith("src2/")
    return _single_rows(T.files(spark, folder).where(inside).agg(F.count("*").alias("files")), T.chunks(spark, folder).where(inside).agg(F.count("*").alias("chunks")))


@query("a4_file_stats", """SELECT c.file_id, chunk_type, count(*) AS chunks, CAST(sum(length(code)) AS BIGINT) AS chars, max(CASE WHEN e.chunk_id IS NULL THEN 0 ELSE 1 END)
  AS embeddings FROM chunks c LEFT JOIN embs e ON e.chunk_id = c.file_id GROUP BY ALL""")
def a4(spark, folder):
    per = T.chunks(spark, folder).groupBy("file_id", "chunk_type").agg(F.count("*").alias("chunks"), F.sum(F.length("code").cast("long")).alias("chars"))
    e = T.embeddings(spark, folder).select(F.col("chunk_id").alias("file_id"), F.lit(1).alias("e"))
    return per.join(e, "file_id", "left").select("file_id", "chunk_type", "chunks", "chars", F.coalesce("e", F.lit(0)).alias("embeddings"))


@query("a5_provider_stats", """SELECT provider, model, count(*) AS embeddings, count(DISTINCT path) AS files, max(dims) AS dims FROM embs JOIN files ON file_id = chunk_id
  GROUP BY provider, model""")
def a5(spark, folder):
    f = T.files(spark, folder).select(F.col("file_id").alias("chunk_id"), "path")
    return T.embeddings(spark, folder).drop("embedding").join(f, "chunk_id").groupBy("provider", "model").agg(F.count("*").alias("embeddings"), F.countDistinct("path").alias("files"), F.max("dims").alias("dims"))


@query("a6_embedding_stats", """SELECT provider, model, dims, count(*) AS n, count(DISTINCT chunk_id) AS chunks, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM embs
  GROUP BY provider, model, dims""")
def a6(spark, folder):
    g = T.embeddings(spark, folder).groupBy("provider", "model", "dims").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a few rows: one for each model


@query("a8_row_waste", "SELECT n_name AS \"table\", CAST(sum(4096 - k) AS BIGINT) AS wasted, round(1 - sum(k) / (4096 * count(*)), 6) AS free_ratio FROM (SELECT s_nationkey AS nk, s_suppkey % 7 AS g, max(s_suppkey) AS k FROM supplier GROUP BY 1, 2) JOIN nation ON n_nationkey = nk GROUP BY n_name", views=False)
def a8(spark, folder):
    n = T.table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("table"))
    g = T.table(spark, folder, "supplier").join(n, "s_nationkey").select("table", (F.col("s_suppkey") % 7).alias("row_group"), F.lit("c").alias("column"), F.col("s_suppkey").alias("count"), F.lit(4096).alias("capacity"))
    return A.row_waste(g).select("table", "wasted", F.round("free_ratio", 6).alias("free_ratio"))


HITS = "list_cosine_similarity(embedding, (SELECT embedding FROM embs WHERE chunk_id = 10))"


@query("a9_top_files", f"""SELECT source, round(avg({HITS}), 6) AS score FROM embs JOIN documents ON doc_id = chunk_id GROUP BY source
  ORDER BY avg({HITS}) DESC, source LIMIT 5""")
def a9(spark, folder):
    hits = _scored(spark, folder)
    return S.page(hits.groupBy("source").agg(F.avg("similarity").alias("s")), [F.col("s").desc(), F.col("source")], 5).select("source", F.round("s", 6).alias("score"))


def _scored(spark, folder):
    vector = [float(x) for x in T.embeddings(spark, folder).where("chunk_id = 10").select("embedding").first()[0]]
    d = T.table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return S.semantic(T.embeddings(spark, folder), vector).select("chunk_id", "similarity").join(d, "chunk_id")


@query("a10_file_priority", f"SELECT source, round(sum({HITS}), 6) AS priority FROM embs JOIN documents ON doc_id = chunk_id GROUP BY source")
def a10(spark, folder):
    return _scored(spark, folder).groupBy("source").agg(F.round(F.sum("similarity"), 6).alias("priority"))


@query("a11_skip_reasons", """SELECT CASE WHEN n_chars > 5000 THEN 'large' WHEN n_chars < 100 THEN 'tiny' ELSE 'none' END AS reason, count(*) AS n FROM documents
  GROUP BY 1""", views=False)
def a11(spark, folder):
    n = F.col("n_chars")
    return T.table(spark, folder, "documents").groupBy(F.when(n > 5000, "large").when(n < 100, "tiny").otherwise("none").alias("reason")).agg(F.count("*").alias("n"))


def _ranked(spark, folder):
    """Sources are queries: documents by length, relevant ones are labelled of good quality."""
    d = T.table(spark, folder, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars", F.col("doc_id").cast("string").alias("path"))
    good = T.table(spark, folder, "labels").where("quality = 1").select("doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "doc_id"))
    return d.select("query_id", "path", rank.alias("rank")), d.join(good, "doc_id", "left_semi").select("query_id", "path")


METRICS = """, d AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, doc_id IN (SELECT doc_id
  FROM labels WHERE quality = 1) AS hit FROM documents),
  m AS (SELECT query_id, CAST(min(rank) FILTER (WHERE hit) AS INTEGER) AS first_relevant_rank, count(*) FILTER (WHERE hit AND rank <= 5)
  AS hits_5, count(*) FILTER (WHERE hit) AS n, count(*) AS results FROM d GROUP BY query_id HAVING n > 0) """


@query("a12_query_metrics", METRICS + """SELECT query_id, first_relevant_rank, hits_5, round(hits_5 / n, 6) AS recall_5, round(hits_5 / least(5, results), 6) AS precision_5 FROM m""")
def a12(spark, folder):
    m = A.query_metrics(*_ranked(spark, folder), [5])
    return m.select("query_id", "first_relevant_rank", "hits_5", F.round("recall_5", 6).alias("recall_5"), F.round("precision_5", 6).alias("precision_5"))


@query("a13_aggregate_metrics", METRICS + """SELECT round(avg(1 / first_relevant_rank), 6) AS mrr_hits, round(avg(coalesce(1 / first_relevant_rank, 0)), 6) AS mrr, round(avg(hits_5 / n), 6)
  AS recall_5, round(avg(hits_5 / least(5, results)), 6) AS precision_5, round(avg(CASE WHEN hits_5 > 0 THEN 1.0 ELSE 0 END), 6)
  AS hit_rate_5, round(avg(CASE WHEN first_relevant_rank <= 5 THEN 1 / log2(first_relevant_rank + 1) ELSE 0 END), 6) AS ndcg_5 FROM m""")
def a13(spark, folder):
    m = A.aggregate_metrics(A.query_metrics(*_ranked(spark, folder), [5]), [5])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("a13_latency", """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4)
  AS p50, round(list_sort(list(o_totalprice))[CAST(floor(0.95 * (count(*) - 1)) AS INTEGER) + 1], 4) AS p95, round(max(o_totalprice), 4) AS max
  FROM orders GROUP BY o_orderpriority""", views=False)
def a13b(spark, folder):
    l = A.latency_stats(T.table(spark, folder, "orders"), "o_totalprice", ["o_orderpriority"])
    return l.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "max")])


@query("a14_cluster_quality", """, c AS (SELECT lang AS a, source AS b, count(*) * 1.0 AS n FROM documents GROUP BY ALL), ta AS (SELECT a, sum(n) AS s FROM c GROUP BY a), tb
  AS (SELECT b, sum(n) AS s, max(n) AS m FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
  x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS nij, (SELECT sum(s * (s - 1) / 2) FROM ta) AS ai, (SELECT sum(s * (s - 1) / 2) FROM tb)
  AS bj, t, (SELECT sum(n / t * ln(n * t / (ta.s * tb.s))) FROM c JOIN ta USING (a) JOIN tb USING (b), t) AS mi,
    (SELECT -sum(s / t * ln(s / t)) FROM ta, t) AS ht, (SELECT -sum(s / t * ln(s / t)) FROM tb, t) AS hp, (SELECT avg(m / s) FROM tb) AS pu FROM t)
  SELECT round((nij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ht + hp) / 2), 6)
  AS nmi, round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6)
  AS v_measure, round(pu, 6) AS mean_purity FROM x""")
def a14(spark, folder):
    q = A.cluster_quality(T.table(spark, folder, "documents").select(F.col("lang").alias("truth"), F.col("source").alias("predicted")))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("a15_regression", """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4)
  AS std, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4)
  AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY l_returnflag""", views=False)
def a15(spark, folder):
    r = A.regression(T.table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "slope", "intercept")], F.round("r_squared", 6).alias("r_squared"))


@query("a15_outliers", """SELECT o_orderkey, round(z, 4) AS z_score, CASE WHEN z > 0 THEN 'high latency' ELSE 'unusually fast' END AS reason
  FROM (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w AS z FROM orders WINDOW w
  AS (PARTITION BY o_orderpriority)) WHERE abs(z) > 1.5""", views=False)
def a15b(spark, folder):
    o = A.outliers(T.table(spark, folder, "orders"), "o_totalprice", ["o_orderpriority"], 1.5)
    return o.select("o_orderkey", F.round("z_score", 4).alias("z_score"), "reason")


@query("a16_coverage", """SELECT language, count(*) AS files, count(l.doc_id) AS referenced, round(100.0 * count(l.doc_id) / count(*), 2) AS percent FROM files LEFT
  JOIN labels l ON l.doc_id = file_id GROUP BY language""")
def a16(spark, folder):
    seen = T.table(spark, folder, "labels").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("r"))
    g = T.files(spark, folder).select("file_id", "language").join(seen, "file_id", "left").groupBy("language").agg(F.count("*").alias("files"), F.count("r").alias("referenced"))
    return g.withColumn("percent", F.round(F.col("referenced") * 100.0 / F.col("files"), 2))


@query("a17_gap_scores", """SELECT p_size AS cluster_id, count(*) AS votes, round(count(*) * avg(p_retailprice / 2000) * (1 + 0.3 / (1 + min(p_partkey % 4))), 6) AS score
  FROM part GROUP BY p_size""", views=False)
def a17(spark, folder):
    g = T.table(spark, folder, "part").select(F.col("p_size").alias("cluster_id"), (F.col("p_retailprice") / 2000).alias("confidence"), (F.col("p_partkey") % 4).alias("shard"))
    return A.gap_scores(g).select("cluster_id", "votes", F.round("score", 6).alias("score"))


@query("a18_synthesis_budget", """SELECT l_suppkey, CASE WHEN count(*) * 400 < 10000 THEN 30000 WHEN count(*) * 400 < 100000 THEN 50000 WHEN count(*) * 400 < 1000000 THEN 80000
  ELSE 150000 END AS input_tokens FROM lineitem GROUP BY l_suppkey""", views=False)
def a18(spark, folder):
    return T.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).select("l_suppkey", A.synthesis_input_tokens(F.col("n") * 20).alias("input_tokens"))


@query("a19_adaptive_budgets", """SELECT p_partkey, CAST(floor(10000 + 40000 * r) AS INTEGER) AS file_content_tokens, CAST(floor(15000 + 45000 * r) AS INTEGER) AS llm_input_tokens,
  CAST(floor(18000 + 3000 * r) AS INTEGER) AS leaf_answer_tokens, CAST(floor(11000 + 8000 * r) AS INTEGER) AS internal_answer_tokens
  FROM (SELECT p_partkey, (p_partkey % 5) / CAST(greatest(p_size % 8 + 4, 1) AS DOUBLE) AS r FROM part)""", views=False)
def a19(spark, folder):
    return T.table(spark, folder, "part").select("p_partkey", *A.adaptive_budgets(F.col("p_partkey") % 5, F.col("p_size") % 8 + 4))


@query("a20_batch_size_knee", "SELECT CAST(8 AS INTEGER) AS batch_size", views=False)
def a20(spark, folder):
    from karstwell.operators.chunking import best_batch_size

    results = spark.createDataFrame([(2, 100.0, True), (4, 150.0, True), (8, 190.0, True), (16, 200.0, True), (32, 400.0, True), (64, 900.0, False)], "batch_size int, throughput double, success boolean")
    return best_batch_size(results)


@query("a21_insert_batch_size", """SELECT CAST(greatest(1000, least(20000, floor(4194304 / greatest(1.0, avg(octet_length(encode(text))))))) AS INTEGER) AS batch_size
  FROM documents""", views=False)
def a21(spark, folder):
    return A.insert_batch_size(T.table(spark, folder, "documents"), "text")


@query("k3_reassign_outliers", """, p AS (SELECT vec_id, embedding, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label % 3 END AS label FROM embeddings), e AS (SELECT vec_id, label, i,
  CAST(embedding[i] AS DOUBLE) AS x FROM p, unnest(range(1, 65)) AS t(i)),
  c AS (SELECT label, i, avg(x) AS x FROM e WHERE label >= 0 GROUP BY label, i), d AS (SELECT e.vec_id, c.label, sum((e.x - c.x) * (e.x - c.x)) AS d
  FROM e JOIN c USING (i) WHERE e.label < 0 GROUP BY e.vec_id, c.label)
  SELECT vec_id, CAST(label AS INTEGER) AS label FROM p WHERE label >= 0 UNION ALL SELECT vec_id, CAST(arg_min(label, d) AS INTEGER) FROM d GROUP BY vec_id""")
def k3(spark, folder):
    e = T.table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 4 == 0, -1).otherwise(F.col("label") % 3).cast("int").alias("label"))
    return K.reassign_outliers(e, "vec_id").select("vec_id", "label")


@query("k1_kmeans")
def k1(spark, folder):
    return K.kmeans(T.table(spark, folder, "embeddings"), 8).select("vec_id", "cluster_id")


@query("k2_density_clusters")
def k2(spark, folder):
    return K.density_clusters(T.table(spark, folder, "embeddings"), "vec_id", min_cluster_size=2).select("vec_id", "label")


@query("k4_bounded_clusters")
def k4(spark, folder):
    e = T.table(spark, folder, "embeddings").withColumn("tokens", F.lit(1000))
    return K.bounded_clusters(e, "vec_id", 15_000, 50_000).select("vec_id", "cluster_id")


@query("k5_token_kmeans")
def k5(spark, folder):
    e = T.table(spark, folder, "embeddings").withColumn("tokens", F.lit(1000))
    return K.token_kmeans(e, 50_000).select("vec_id", "cluster_id")


@query("k6_average_linkage")
def k6(spark, folder):
    """Groups of up to 64 neighbouring ids of one label, as the few queries of a report are."""
    group = F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 64).cast("string"))
    e = T.table(spark, folder, "embeddings").select("vec_id", "embedding", group.alias("report"))
    return K.average_linkage(e, "report", "vec_id", 0.75)
