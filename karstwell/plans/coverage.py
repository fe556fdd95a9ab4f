"""Queries of discovery, stores, parsers, splits, live queues and exploration."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from karstwell.functions import arrow_text as A
from karstwell.functions import paths as P
from karstwell.operators import chunking as C
from karstwell.operators import discovery as D
from karstwell.operators import ingest as I
from karstwell.operators import joins as J
from karstwell.operators import parsing
from karstwell.operators import research as R
from karstwell.operators import search as S
from karstwell.operators import stats as A_
from karstwell.operators.index import build_index, search_index
from karstwell.plans._register import query
from karstwell.plans.search import _vector
from karstwell.sources import tables as T
from karstwell.sources.scan import scan_files
from karstwell.sources.storage import shared_dir
from karstwell.streaming import live as L

# -- discovery ---------------------------------------------------------------------------------------------------------


@query("s1_scan_files")
def s1(spark, folder):
    """The files of the folder, without opening them."""
    return scan_files(spark, folder, include=["**/*.parquet"], content=False).select("path", "size", "language")


@query("s2_discover")
def s2(spark, folder):
    return D.discover(spark, folder, include=["**/*.parquet"], exclude=["**/lineitem.parquet/**"])


@query("s5_included", "SELECT path FROM files WHERE regexp_matches(path, '(^|/)[^/]*7\\.txt$') OR path LIKE 'src1/%' OR regexp_matches(path, '/doc_[0-9]\\.txt$')")
def s5(spark, folder):
    return T.files(spark, folder).where(P.included(F.col("path"), ["**/*7.txt", "src1/**", "**/doc_?.txt"])).select("path")


@query("s7_glob_classes", """SELECT * FROM (VALUES ('**/*.py', 'extension'), ('*.TXT', 'extension'), ('**/Makefile', 'name'), ('src/**/*.js', 'other'), ('**/test_*', 'other'))
  AS v("glob", kind)
  WHERE (SELECT count(*) FROM documents) >= 0""", views=False)
def s7(spark, folder):
    globs = ["**/*.py", "*.TXT", "**/Makefile", "src/**/*.js", "**/test_*"]
    rows = []
    for g in globs:
        extensions, names, _ = P.summarize_globs([g])
        rows.append((g, "extension" if extensions else "name" if names else "other"))
    return spark.createDataFrame(rows, "glob string, kind string")


NESTED = "CASE file_id % 4 WHEN 0 THEN 'web/node_modules/' WHEN 1 THEN 'build/' WHEN 2 THEN 'src/' ELSE 'lib/build.d/' END || path"


def _nested(spark, folder):
    head = F.element_at(F.array(*[F.lit(x) for x in ("web/node_modules/", "build/", "src/", "lib/build.d/")]), (F.col("file_id") % 4 + 1).cast("int"))
    return T.files(spark, folder).select("file_id", F.concat(head, "path").alias("path"))


@query("s8_pruned_directories", f"SELECT file_id FROM (SELECT file_id, {NESTED} AS path FROM files) WHERE file_id % 4 >= 2 AND (path LIKE 'src/%' OR path LIKE 'lib/%')")
def s8(spark, folder):
    """Only below the globs' literal directories, and below no heavy one."""
    f = _nested(spark, folder)
    globs = ["src/**/*.txt", "lib/**", "build/**"]
    below = C.any_of([P.under_directory(F.col("path"), d) for d in P.include_prefixes(globs)])
    return f.where(below & D.light(F.col("path"))).select("file_id")


@query("s9_ignore_rules", f"""SELECT file_id FROM (SELECT file_id, {NESTED} AS path FROM files)
  WHERE NOT ((path LIKE '%/de/%' OR path LIKE 'build/%' OR regexp_matches(path, '(^|/)doc_[0-9]*5\\.txt$')) AND NOT regexp_matches(path, '(^|/)doc_15\\.txt$'))""")
def s9(spark, folder):
    rules = ["# comment", "", "de/", "/build", "doc_*5.txt", "!doc_15.txt"]
    return _nested(spark, folder).where(~P.ignored(F.col("path"), rules)).select("file_id")


@query("s18_write_batch", """, d AS (SELECT * FROM files WHERE file_id % 5 = 0), n AS (SELECT * FROM files WHERE file_id % 5 = 1)
  SELECT 'files' AS stored, count(*) AS n FROM files WHERE file_id % 5 <> 0
  UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id % 5 > 1 OR (file_id % 5 = 1 AND start_line = 1)
  UNION ALL SELECT 'embeddings', count(*) FROM embs JOIN chunks c ON c.file_id = embs.chunk_id AND c.start_line = 1 WHERE c.file_id % 5 > 1""")
def s18(spark, folder):
    """A transaction that deletes a fifth of the files and stores another with one chunk each, and the store it leaves."""
    f, c = T.files(spark, folder).select("file_id", "path"), T.chunks(spark, folder).select("file_id", "chunk_id", "start_line")
    e = T.embeddings(spark, folder).select(F.col("chunk_id").alias("file_id"), "dims")
    e = e.join(c.where("start_line = 1").select("file_id", "chunk_id"), "file_id").select("chunk_id", "dims")
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    new = f.where("file_id % 5 = 1")
    I.write_batch(root, f, c, e, new_files=new, new_chunks=c.join(new.select("file_id"), "file_id", "left_semi").where("start_line = 1"), new_embeddings=e.limit(0), deleted=f.where("file_id % 5 = 0"))
    names = ("files", "chunks", "embeddings")
    counts = [x.agg(F.lit(n).alias("stored"), F.count("*").alias("n")) for n, x in zip(names, I.read_store(spark, root), strict=True)]
    return I.union_all(counts)


@query("s22_commit_ranges", """SELECT * FROM (VALUES ('commit', 'abc^..abc'), ('last', 'HEAD~3..HEAD'), ('range', 'a..b')) AS v(selector, commits) WHERE (SELECT count(*)
  FROM documents) >= 0""", views=False)
def s22(spark, folder):
    rows = [("commit", I.commit_range(commit="abc")), ("last", I.commit_range(last=3)), ("range", I.commit_range(range_="a..b"))]
    return spark.createDataFrame(rows, "selector string, commits string")


# -- parsing and splitting ----------------------------------------------------------------------------------------------


@query("p20_parsed_files", r""", m AS (SELECT file_id, file_id % 3 AS k, len(ls) AS n, ls[1] AS head FROM file_lines)
  SELECT file_id, 'Title' AS name, 'DEFINITION' AS concept, CAST(1 AS INTEGER) AS start_line, CAST(n + 1 AS INTEGER) AS end_line FROM m WHERE k = 0
  UNION ALL SELECT file_id, 'Tail', 'DEFINITION', n + 2, n + 5 FROM m WHERE k = 0
  UNION ALL SELECT file_id, 'code_' || (n + 3), 'BLOCK', n + 3, n + 5 FROM m WHERE k = 0
  UNION ALL SELECT file_id, 'os', 'IMPORT', 1, 1 FROM m WHERE k = 1
  UNION ALL SELECT file_id, 'comment_2', 'COMMENT', 2, n + 1 FROM m WHERE k = 1
  UNION ALL SELECT file_id, 'A', 'DEFINITION', n + 2, n + 5 FROM m WHERE k = 1
  UNION ALL SELECT file_id, 'A.f', 'DEFINITION', n + 3, n + 5 FROM m WHERE k = 1
  UNION ALL SELECT file_id, 'block_' || (n + 6), 'BLOCK', n + 6, n + 6 FROM m WHERE k = 1
  UNION ALL SELECT file_id, 'doc', 'DEFINITION', 2, 2 FROM m WHERE k = 2
  UNION ALL SELECT file_id, 'more', 'DEFINITION', 3, 6 FROM m WHERE k = 2""")
def p20(spark, folder):
    """Documents as Markdown, as the comments of Python files, and as a value in JSON."""
    f = T.files(spark, folder)
    k = F.col("file_id") % 3
    commented = F.array_join(F.transform(F.split("text", "\n", -1), lambda l: F.concat(F.lit("# "), l)), "\n")
    text = (
        F.when(k == 0, F.concat(F.lit("# Title\n"), F.regexp_replace("text", "(?m)^([ \t]*)(```|#)", "$1.$2"), F.lit("\n## Tail\n```\n# no heading\n```")))
        .when(k == 1, F.concat(F.lit("import os\n"), commented, F.lit("\nclass A:\n    @os.x\n    def f(self):\n        return 1\nx = 2")))
        .otherwise(F.concat(F.lit("{\n \"doc\": "), F.to_json(F.struct("text")), F.lit(",\n \"more\": [\n  1, {\"a\": 2},\n  3\n ]\n}")))
    )
    language = F.when(k == 0, "markdown").when(k == 1, "python").otherwise("json")
    return parsing.parse_files(f.select("file_id", language.alias("language"), text.alias("text"))).select("file_id", "name", "concept", "start_line", "end_line")


@query("p21_parsers", "SELECT path, CASE file_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'braces' WHEN 2 THEN 'markdown' ELSE 'paragraphs' END AS parser FROM files")
def p21(spark, folder):
    """The parser of each file by its path."""
    f = T.files(spark, folder)
    ending = F.element_at(F.array(*[F.lit(x) for x in (".py", ".rs", ".md", ".unknown")]), (F.col("file_id") % 4 + 1).cast("int"))
    known = F.create_map(*[F.lit(x) for language, parser in parsing.PARSERS.items() for x in (language, parser.__name__)])
    return f.select("path", F.coalesce(known[I.language(F.concat("path", ending))], F.lit("paragraphs")).alias("parser"))


INK = r"length(regexp_replace({}, '\s', '', 'g'))"


@query("p5_split_ink", f"SELECT file_id, CAST({INK.format('text')} AS BIGINT) AS ink, true AS fits FROM files WHERE {INK.format('text')} > 0")
def p5(spark, folder):
    """Splitting keeps every character that isn't white space, and all pieces fit."""
    f = T.files(spark, folder)
    whole = f.select("file_id", F.lit("text").alias("name"), F.lit("BLOCK").alias("concept"), F.col("text").alias("content"), F.lit(1).alias("start_line"), C.line_count(F.col("text")).alias("end_line"))
    pieces = C.split_chunks(whole).select("file_id", C.non_whitespace(F.col("content")).alias("ink"), (~C.needs_split(F.col("content"))).alias("fits"))
    return pieces.groupBy("file_id").agg(F.sum("ink").cast("long").alias("ink"), F.bool_and("fits").alias("fits")).where("ink > 0")


@query("p6_emergency_split", f"""SELECT file_id, {INK.format('text')} AS ink, md5(regexp_replace(text, chr(10), ' ', 'g')) AS whole FROM files WHERE {INK.format('text')} > 0""")
def p6(spark, folder):
    """Texts on one line are cut at separators; the pieces, in order, are the text."""
    f = T.files(spark, folder)
    line = f.select("file_id", F.lit("text").alias("name"), F.lit("BLOCK").alias("concept"), F.regexp_replace("text", "\n", " ").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    pieces = C.split_chunks(line).withColumn("n", F.coalesce(F.try_to_number(F.regexp_extract("name", r"_part(\d+)$", 1), F.lit("999999")), F.lit(0)).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda p: p["content"]), "")
    g = pieces.groupBy("file_id").agg(whole.alias("whole"))
    return g.select("file_id", C.non_whitespace(F.col("whole")).cast("long").alias("ink"), F.md5("whole").alias("whole")).where("ink > 0")


@query("p11_revalidated", f"""SELECT CAST(sum(CASE WHEN {INK.format('text')} > 1200 OR greatest(1, length(text) // 3) > 6000 THEN 1 ELSE 0 END) AS BIGINT) AS too_large, CAST(0
  AS BIGINT) AS left_over FROM files""")
def p11(spark, folder):
    """Stored chunks that a parser left too large, and how many are left after they were split again."""
    f = T.files(spark, folder).select("file_id", F.lit("t").alias("name"), F.lit("BLOCK").alias("concept"), F.col("text").alias("content"), F.lit(1).alias("start_line"), C.line_count(F.col("text")).alias("end_line"))
    both = I.union_all([x.select(C.needs_split(F.col("content")).alias("large"), F.lit(i).alias("pass_")) for i, x in enumerate((f, C.split_chunks(f)))])
    return both.agg(F.count_if(F.col("large") & (F.col("pass_") == 0)).alias("too_large"), F.count_if(F.col("large") & (F.col("pass_") == 1)).alias("left_over"))


@query("p13_token_shards", """, c AS (SELECT label AS cluster_id, vec_id, 1000 + (vec_id * 7919) % 9000 AS tokens, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k
  FROM embeddings),
  r AS (SELECT cluster_id, vec_id, k, tokens AS held, 0 AS shard FROM c WHERE k = 1 UNION ALL
    SELECT c.cluster_id, c.vec_id, c.k, CASE WHEN held + c.tokens > 40000 THEN c.tokens ELSE held + c.tokens END, CASE
  WHEN held + c.tokens > 40000 THEN shard + 1 ELSE shard END
    FROM r JOIN c ON c.cluster_id = r.cluster_id AND c.k = r.k + 1)
  SELECT vec_id, CAST(shard AS INTEGER) AS shard FROM r""")
def p13(spark, folder):
    """Shards of 40,000 tokens within each cluster."""
    e = T.table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), "vec_id", (1000 + (F.col("vec_id") * 7919) % 9000).alias("tokens"))
    return C.token_batches(e, by="cluster_id", order="vec_id", max_tokens=40_000, max_rows=1 << 30).select("vec_id", F.col("batch").alias("shard"))


SPEC = "CASE chunk_type WHEN 'function' THEN 4 WHEN 'namespace' THEN 3 WHEN 'comment' THEN 2 WHEN 'block' THEN 1 END"


@query("d3b_kept_duplicates", rf""", l AS (SELECT *, CASE file_id % 4 WHEN 0 THEN 'vue' WHEN 1 THEN 'haskell' ELSE 'text' END AS lang FROM chunks),
  k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(code, '^\s+|\s+$', '', 'g') ORDER BY {SPEC} DESC, end_line - start_line, chunk_id)
  AS n FROM l WHERE lang = 'text')
  SELECT chunk_id FROM l WHERE lang <> 'text' UNION ALL SELECT chunk_id FROM k WHERE n = 1""")
def d3b(spark, folder):
    """Languages that need their duplicates keep them; lines do not nest."""
    language = F.when(F.col("file_id") % 4 == 0, "vue").when(F.col("file_id") % 4 == 1, "haskell").otherwise("text")
    return J.dedup_chunks(T.chunks(spark, folder).withColumn("language", language)).select("chunk_id")


@query("n7_parameter_types", "SELECT event_id, ['a', event_type] AS names, ['int', NULL] AS types FROM events", views=False)
def n7(spark, folder):
    meta = F.concat(F.lit('[{"name": "a", "type": "int"}, "'), "event_type", F.lit('"]'))
    found = T.table(spark, folder, "events").select("event_id", A.lift(A.parameters, "array<struct<name:string,type:string>>")(meta).alias("p"))
    return found.select("event_id", F.col("p.name").alias("names"), F.col("p.type").alias("types"))


@query("n21_tokenizer_tokens")
def n21(spark, folder):
    import public_tokenizers

    count = A.tokenizer_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return T.table(spark, folder, "documents").select("doc_id", A.lift(count, "int")("text").alias("tokens"))


@query("n25_parsed_facts", """SELECT doc_id, text AS statement, source AS file_path, CAST(doc_id + 1 AS INTEGER) AS start_line, CAST(doc_id + 3 AS INTEGER) AS end_line
  FROM documents WHERE trim(text) <> ''""", views=False)
def n25(spark, folder):
    kind = "struct<file_path:string,start_line:int,end_line:int>"
    parse = lambda statement, source, i: json.dumps(A.parse_fact({"statement": statement, "source": source, "location": f"L{i + 1}-L{i + 3}"}, [source]))
    d = T.table(spark, folder, "documents").where(F.trim("text") != "")
    fact = F.from_json(A.lift(parse, "string")("text", "source", "doc_id"), kind)
    return d.select("doc_id", F.col("text").alias("statement"), fact.alias("f")).where("f is not null").select("doc_id", "statement", "f.*")


@query("n32_tree_lines", """, p AS (SELECT language AS g, string_split(path, '/') AS s FROM files), n AS (SELECT DISTINCT g, s[1:i] AS node FROM p, unnest(range(1, len(s) + 1))
  AS t(i)),
  m AS (SELECT g, node[1:len(node) - 1] AS parent, max(node) AS last FROM n GROUP BY 1, 2), x AS (SELECT n.g, n.node, n.node = m.last
  AS is_last, EXISTS (SELECT 1 FROM m b WHERE b.g = n.g AND b.parent = n.node) AS is_folder FROM n JOIN m ON m.g = n.g
  AND m.parent = n.node[1:len(n.node) - 1])
  SELECT x.g AS language, array_to_string(x.node, '/') AS node, string_agg(CASE WHEN len(a.node) < len(x.node) THEN CASE WHEN a.is_last THEN '    '
  ELSE '│   ' END ELSE CASE WHEN a.is_last THEN '└── ' ELSE '├── ' END END, '' ORDER BY len(a.node))
    || x.node[len(x.node)] || CASE WHEN x.is_folder THEN '/' ELSE '' END AS line
  FROM x JOIN x a ON a.g = x.g AND a.node = x.node[1:len(a.node)] GROUP BY x.g, x.node, x.is_folder""")
def n32(spark, folder):
    lines = R.file_tree_lines(T.files(spark, folder).select(F.col("language").alias("group"), "path"))
    return lines.select(F.col("group").alias("language"), F.array_join("node", "/").alias("node"), "line")


# -- live queues ----------------------------------------------------------------------------------------------------------

OPS = ", m AS (SELECT CASE WHEN event_type IN ('purchase', 'click') THEN 'delete' ELSE 'change' END AS operation, path, seq, ts FROM mutations) "


def _ops(spark, folder):
    kind = F.when(F.col("event_type").isin("purchase", "click"), "delete").otherwise("change")
    return T.mutations(spark, folder).select(kind.alias("operation"), "path", "seq", "ts")


@query("t7_delete_batches", OPS + """, o AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM m), d AS (SELECT *, place - row_number() OVER (ORDER BY seq) AS run FROM o
  WHERE operation = 'delete'),
  n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS k, min(place) OVER (PARTITION BY run) AS first FROM d)
  SELECT seq, CAST(first + k // 2 * 2 AS BIGINT) AS batch FROM n UNION ALL SELECT seq, NULL FROM m WHERE operation <> 'delete'""")
def t7(spark, folder):
    return L.delete_batches(_ops(spark, folder), most=2).select("seq", "batch")


TICKS = ", a AS (SELECT path AS queue, epoch_us(ts) // 86400000000 AS tick, count(*) AS events FROM mutations GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY tick) AS k FROM a)"


@query("t9_queue_overflow", TICKS + """,
  r AS (SELECT queue, tick, k, least(4, events) AS backlog, greatest(0, events - 4) AS dropped FROM o WHERE k = 1 UNION ALL
    SELECT o.queue, o.tick, o.k, least(4, greatest(0, backlog - (o.tick - r.tick)) + o.events), greatest(0, greatest(0, backlog - (o.tick - r.tick)) + o.events - 4) FROM r JOIN o ON o.queue = r.queue AND o.k = r.k + 1),
  c AS (SELECT *, sum(CASE WHEN dropped = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY tick) AS calm FROM r),
  b AS (SELECT queue, calm, min(tick) AS "begin", max(tick) AS "end", CAST(sum(dropped) AS BIGINT) AS dropped FROM c WHERE dropped > 0 GROUP BY queue, calm)
  SELECT queue, CAST(row_number() OVER (PARTITION BY queue ORDER BY "begin") AS INTEGER) AS burst, "begin", "end", dropped FROM b""")
def t9(spark, folder):
    """Days as ticks, queues of four."""
    m = T.mutations(spark, folder)
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("long")
    ticks = m.groupBy(F.col("path").alias("queue"), day.alias("tick")).agg(F.count("*").alias("events"))
    return L.overflow_bursts(ticks, capacity=4, drained=1)


@query("t11_retries", """SELECT seq, k AS attempt, CASE WHEN k <= 5 THEN round(0.1 * pow(2, k - 1), 6) END AS delay, CASE WHEN k <= 5 THEN epoch_us(ts) +
  CAST(100000 * pow(2, k - 1) AS BIGINT) END AS due FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY ts, seq) AS INTEGER) AS k FROM mutations WHERE event_type = 'purchase')""")
def t11(spark, folder):
    r = L.retries(T.mutations(spark, folder).where("event_type = 'purchase'"))
    return r.select("seq", "attempt", F.round("delay", 6).alias("delay"), F.unix_micros("due").alias("due"))


@query("t12_follow_ups", """, p AS (SELECT path, epoch_us(ts) AS started, epoch_us(ts) + 43200000000 AS finished FROM mutations WHERE seq % 10 = 0)
  SELECT p.path, finished AS due, max(m.seq) AS generation FROM p JOIN mutations m ON m.path = p.path AND epoch_us(m.ts) > started
  AND epoch_us(m.ts) <= finished GROUP BY p.path, started, finished""")
def t12(spark, folder):
    """Every tenth event is worked on for half a day."""
    m = T.mutations(spark, folder)
    p = m.where("seq % 10 = 0").select("path", F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 12 hours")).alias("finished"))
    f = L.follow_ups(m.select("path", "ts", F.col("seq").alias("generation")), p)
    return f.select("path", F.unix_micros("due").alias("due"), "generation")


# -- search and exploration ------------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(embedding, (SELECT embedding FROM embs WHERE chunk_id = {}))"


@query("v9_indexed_search", f"SELECT chunk_id, round({COS.format(7)}, 6) AS similarity FROM embs ORDER BY {COS.format(7)} DESC, chunk_id LIMIT 10")
def v9(spark, folder):
    """All lists are probed, so the result is that of a scan; fewer probes read less."""
    e = T.embeddings(spark, folder)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    build_index(e, path, lists=16)
    found = search_index(spark, path, _vector(spark, folder, 7), size=10, probes=16)
    return found.select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("w5_score_changes", """SELECT a.l_orderkey AS chunk_id, a.l_linenumber AS round, round(a.l_discount - b.l_discount, 6) AS change FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1""", views=False)
def w5(spark, folder):
    rounds = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("round"), F.col("l_discount").alias("score"))
    return A_.score_changes(rounds).select("chunk_id", "round", F.round("change", 6).alias("change"))


@query("r6_breadth_first", """WITH f AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS next, l_partkey % 17 AS score FROM lineitem), s AS (SELECT 1 AS node UNION ALL SELECT 2),
  a AS (SELECT DISTINCT next AS node FROM (SELECT f.*, row_number() OVER (PARTITION BY f.node ORDER BY score DESC, next) AS k FROM f
  JOIN s USING (node) WHERE next NOT IN (SELECT node FROM s)) WHERE k <= 3),
  b AS (SELECT DISTINCT next AS node FROM (SELECT f.*, row_number() OVER (PARTITION BY f.node ORDER BY score DESC, next) AS k FROM f
  JOIN a USING (node) WHERE next NOT IN (SELECT node FROM s UNION SELECT node FROM a)) WHERE k <= 3)
  SELECT node, 0 AS level FROM s UNION ALL SELECT node, 1 FROM a UNION ALL SELECT node, 2 FROM b""", views=False)
def r6(spark, folder):
    """From suppliers to parts, which are taken for suppliers again."""
    f = T.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("next"), (F.col("l_partkey") % 17).alias("score")).distinct()
    return R.breadth_first(spark.createDataFrame([(1,), (2,)], "node long"), f, levels=2)


@query("r7_explore_depth")
def r7(spark, folder):
    e = T.embeddings(spark, folder)
    files = e.select("chunk_id", F.concat(F.lit("f"), (F.col("chunk_id") % 40).cast("string")).alias("path"))
    covered = S.page(S.semantic(e, _vector(spark, folder, 7)), [F.col("similarity").desc(), F.col("chunk_id")], 30).select("chunk_id", F.col("similarity").alias("score"))
    return R.explore_depth(e, files, covered).select("chunk_id", "path", "query", F.round("similarity", 6).alias("similarity"))


@query("r12_rerank_in_batches", """SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS INTEGER) AS batch,
  round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+')), ['and', 'the', 'thing'])) / 3.0, 6) AS rerank_score FROM documents""", views=False)
def r12(spark, folder):
    d = T.table(spark, folder, "documents").select("doc_id", "text")
    out = R.rerank_in_batches(d, S.term_overlap("the thing and", F.col("text")), key="doc_id", order=["doc_id"])
    return out.select("doc_id", "batch", F.round("rerank_score", 6).alias("rerank_score"))


@query("r15_investigation")
def r15(spark, folder):
    """The files that a report would cite."""
    e = T.embeddings(spark, folder)
    f = T.files(spark, folder)
    chunks = f.select(F.col("file_id").alias("chunk_id"), F.concat(F.lit("f"), (F.col("file_id") % 40).cast("string")).alias("path"), F.lit(1).alias("start_line"), C.line_count(F.col("text")).alias("end_line"), F.col("text").alias("code"))
    return R.investigate(e, chunks, _vector(spark, folder, 7), (F.col("chunk_id") * 37 % 101) / 100.0)["citations"]
