"""Queries of research transforms, web pages, text parsers and live mutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karstwell.functions import arrow_text as A
from karstwell.operators import chunking as C
from karstwell.operators import research as R
from karstwell.plans._register import query
from karstwell.sources import tables as T
from karstwell.streaming import live as L


@query("r1_constants", """SELECT path, symbol AS name, code AS value, 'str' AS type FROM chunks QUALIFY row_number() OVER (PARTITION BY path, symbol
  ORDER BY start_line) = 1""")
def r1(spark, folder):
    c = T.chunks(spark, folder)
    meta = F.to_json(F.struct(F.array(F.struct(F.col("symbol").alias("name"), F.col("code").alias("value"), F.lit("str").alias("type"))).alias("constants")))
    return R.constants_from_metadata(c.select("path", "start_line", meta.alias("metadata")), ["start_line"])


def _facts(spark, folder):
    """A fact for each benchmark item, whose entities are its words and a number that several share."""
    b = T.table(spark, folder, "benchmark")
    entities = F.array_append(F.split("text", r"\s+"), F.concat(F.lit(" E"), (F.col("item_id") % 5).cast("string")))
    kinds = F.array(*[F.lit(x) for x in ("likely", "definite", "odd", "inferred")])
    return b.select(
        F.col("item_id").alias("fact_id"), entities.alias("entities"), F.element_at(kinds, (F.col("item_id") % 4 + 1).cast("int")).alias("confidence"),
        F.col("text").alias("category"), F.concat(F.lit("f"), (F.col("item_id") % 3).cast("string")).alias("path"),
    )


FACTS = r""", facts AS (SELECT item_id AS fact_id, list_append(regexp_split_to_array(text, '\s+'), ' E' || (item_id % 5)) AS entities,
  ['likely', 'definite', 'odd', 'inferred'][item_id % 4 + 1] AS confidence, text AS category, 'f' || (item_id % 3) AS path FROM benchmark) """


@query("r2_facts", FACTS + "SELECT fact_id FROM facts WHERE path IN ('f0', 'f2') AND len(list_filter(entities, lambda e: lower(trim(e)) = 'e1')) > 0 UNION ALL SELECT 1000 + fact_id FROM facts WHERE fact_id <> 3 AND item_shares(entities)".replace("item_shares(entities)", "len(list_intersect(list_transform(entities, lambda e: lower(trim(e))), (SELECT list_transform(entities, lambda e: lower(trim(e))) FROM facts WHERE fact_id = 3))) > 0"))
def r2(spark, folder):
    f = _facts(spark, folder)
    return R.facts_for(f, paths=["f0", "f2"], entity="e1").select("fact_id").unionByName(R.related_facts(f, 3).select((F.col("fact_id") + 1000).alias("fact_id")))


@query("r3_entity_index", FACTS + """, e AS (SELECT fact_id, i, entities[i] AS label, lower(trim(entities[i])) AS entity FROM facts, unnest(range(1, len(entities) + 1)) AS t(i))
  SELECT entity, arg_min(label, fact_id * 1000000 + i) AS label, count(DISTINCT fact_id) AS facts FROM e GROUP BY entity""")
def r3(spark, folder):
    return R.entity_index(_facts(spark, folder))


@query("r3_fact_priority", FACTS + """SELECT fact_id, confidence, category FROM facts ORDER BY CASE confidence WHEN 'definite' THEN 1 WHEN 'likely' THEN 2 WHEN 'inferred' THEN 3
  ELSE 5 END, category, fact_id LIMIT 25""")
def r3b(spark, folder):
    return R.facts_by_priority(_facts(spark, folder), 25).select("fact_id", "confidence", "category")


RANGES = ", r AS (SELECT 'c' || (conv_id % 50) AS path, turn * 3 + 1 AS start_line, turn * 3 + 1 + length(text) % 9 AS end_line, conv_id, turn FROM conversations) "


def _ranges(spark, folder):
    c = T.table(spark, folder, "conversations")
    return c.select(F.concat(F.lit("c"), (F.col("conv_id") % 50).cast("string")).alias("path"), (F.col("turn") * 3 + 1).alias("start_line"), (F.col("turn") * 3 + 1 + F.length("text") % 9).alias("end_line"), "conv_id", "turn")


@query("r4_unexplored", RANGES + """, x AS (SELECT * FROM r WHERE turn < 2), d AS (SELECT path FROM (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS l FROM x)
  GROUP BY path HAVING count(*) > 12) SELECT conv_id, turn FROM r WHERE turn >= 2 AND path NOT IN (FROM d) AND NOT EXISTS (SELECT 1 FROM x
  WHERE x.path = r.path AND r.start_line >= x.start_line AND r.end_line <= x.end_line)""")
def r4(spark, folder):
    r = _ranges(spark, folder)
    return R.unexplored(r.where("turn >= 2"), r.where("turn < 2"), full=12).select("conv_id", "turn")


@query("r5_line_coverage", RANGES + "SELECT path, count(DISTINCT l) AS lines FROM (SELECT path, unnest(range(start_line, end_line + 1)) AS l FROM r) GROUP BY path")
def r5(spark, folder):
    return R.line_coverage(_ranges(spark, folder)).select("path", F.col("lines").cast("long").alias("lines"))


@query("r9_files_in_budget", """, t AS (SELECT file_id, language, text, greatest(1, length(text) // 4) AS tokens FROM files), b AS (SELECT *, coalesce(sum(tokens)
  OVER (PARTITION BY language ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
  SELECT file_id, length(CASE WHEN tokens <= 20000 - before THEN text ELSE left(text, CAST((20000 - before) * 4 AS BIGINT)) END)
  AS chars, tokens > 20000 - before AS is_cut FROM b WHERE tokens <= 20000 - before OR 20000 - before > 500""")
def r9(spark, folder):
    f = T.files(spark, folder).select("file_id", "language", "text")
    return R.within_budget(f, ["file_id"], 20_000, by=["language"]).select("file_id", F.length("content").cast("long").alias("chars"), "is_cut")


@query("r10_code_context", """, t AS (SELECT chunk_id, file_id, code AS text, greatest(1, length(code) // 4) AS tokens FROM chunks), b AS (SELECT *, coalesce(sum(tokens)
  OVER (PARTITION BY file_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
  SELECT chunk_id FROM b WHERE tokens <= 100 - before""")
def r10(spark, folder):
    c = T.chunks(spark, folder).select("chunk_id", "file_id", F.col("code").alias("text"))
    return R.within_budget(c, ["chunk_id"], 100, by=["file_id"], key="chunk_id").select("chunk_id")


@query("r11_representatives", """, n AS (SELECT path, code, row_number() OVER (PARTITION BY path ORDER BY length(code) DESC, chunk_id) AS k FROM chunks)
  SELECT path, left(string_agg(code, chr(10) || chr(10) ORDER BY k), 400) AS document, count(*) AS chunks FROM n WHERE k <= 5 GROUP BY path""")
def r11(spark, folder):
    c = T.chunks(spark, folder).withColumn("score", F.length("code"))
    return R.representatives(c, "score", max_tokens=100)


@query("r13_citation_map", """, p AS (SELECT DISTINCT path FROM chunks WHERE contains(code, 'License')) SELECT path, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS number
  FROM p""")
def r13(spark, folder):
    return R.reference_map(T.chunks(spark, folder).where(F.contains("code", F.lit("License"))))


@query("r13_ranges", """, g AS (SELECT path, list_sort(list(start_line)) AS l FROM chunks GROUP BY path) SELECT path, array_to_string(list_transform(l[1:3], lambda x: 'L'
  || x || '-' || x), ', ') || CASE WHEN len(l) > 3 THEN ' +' || (len(l) - 3) || ' more' ELSE '' END AS ranges FROM g""")
def r13b(spark, folder):
    return R.chunk_ranges(T.chunks(spark, folder))


@query("r8_gap_selection", """
WITH t AS (SELECT *, row_number() OVER (ORDER BY score DESC, gap_id) - 1 AS rank FROM (
  SELECT l_partkey AS gap_id, count(*) * 1.0 AS score FROM lineitem GROUP BY l_partkey) ORDER BY score DESC, gap_id LIMIT 10),
m AS (SELECT max(score) AS hi, min(score) AS lo, count(*) AS n FROM t),
d AS (SELECT t.*, hi, CASE WHEN n >= 3 AND hi > lo THEN abs(1 - rank / (n - 1) - (score - lo) / (hi - lo)) / sqrt(2) END AS far FROM t, m),
e AS (SELECT CASE WHEN far >= 0.01 THEN rank END AS elbow FROM d ORDER BY far DESC NULLS LAST, rank LIMIT 1),
c AS (SELECT d.*, CASE WHEN elbow >= 1 THEN rank < elbow END AS above, score >= hi * 0.5 AS strong FROM d, e),
h AS (SELECT *, count(*) FILTER (WHERE above AND strong) OVER () >= 1 AS held FROM c)
SELECT gap_id FROM h WHERE CASE WHEN hi < 1e-9 THEN rank < 1 WHEN above IS NOT NULL THEN above AND (strong OR NOT held) ELSE true END""", views=False)
def r8(spark, folder):
    """Parts by the number of their lines; the table has more than ten."""
    gaps = T.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("gap_id")).agg(F.count("*").cast("double").alias("score"))
    return R.select_gaps(gaps).select("gap_id")


# -- parsers and folds: rows only, results are in the tests -----------------------------------------------------------------


@query("s11_content_hash")
def s11(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", A.lift(A.xxh3_hex, "string")("text").alias("content_hash"))


@query("s23_web_results")
def s23(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", A.lift(A.web_results, "array<struct<title:string,url:string,snippet:string>>")("html").alias("results"))


@query("s24_html_to_markdown")
def s24(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", A.lift(A.html_to_markdown, "string")("html").alias("markdown"))


@query("n7_parameter_names", "SELECT event_id, ['a', 'b' || event_type] AS names FROM events", views=False)
def n7(spark, folder):
    e = T.table(spark, folder, "events")
    meta = F.to_json(F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type")), F.struct(F.concat(F.lit("b"), "event_type").alias("name"), F.lit(None).cast("string").alias("type"))))
    return e.select("event_id", A.lift(A.parameter_names, "array<string>")(meta).alias("names"))


@query("n10_sort_citations", """SELECT item_id, text || ' [' || least(item_id % 7, item_id % 5) || '][' || greatest(item_id % 7, item_id % 5) || '] end' AS text
  FROM benchmark""", views=False)
def n10(spark, folder):
    i = F.col("item_id")
    t = F.concat("text", F.lit(" ["), (i % 7).cast("string"), F.lit("]["), (i % 5).cast("string"), F.lit("] end"))
    return T.table(spark, folder, "benchmark").select("item_id", A.lift(A.sort_citations, "string")(t).alias("text"))


@query("n13_linkify", "SELECT item_id, 'a [[' || item_id || ']](#ref-' || item_id || ') `[1]`' AS text FROM benchmark", views=False)
def n13(spark, folder):
    t = F.concat(F.lit("a ["), F.col("item_id").cast("string"), F.lit("] `[1]`"))
    return T.table(spark, folder, "benchmark").select("item_id", A.lift(A.linkify, "string")(t).alias("text"))


@query("n14_cited_refs", "SELECT item_id, [CAST(item_id AS VARCHAR)] AS refs FROM benchmark", views=False)
def n14(spark, folder):
    t = F.concat(F.lit("a ["), F.col("item_id").cast("string"), F.lit("] `[1]`\n```\n[2]\n```"))
    return T.table(spark, folder, "benchmark").select("item_id", A.lift(A.cited_refs, "array<string>")(t).alias("refs"))


@query("n15_paths_to_urls", "SELECT page_id, 'see ' || url || ' and xa.md' AS text FROM pages", views=False)
def n15(spark, folder):
    f = lambda text, url: A.paths_to_urls(text, {"a.md": url})
    return T.table(spark, folder, "pages").select("page_id", A.lift(f, "string")(F.lit("see a.md and xa.md"), F.col("url")).alias("text"))


@query("n17_chunk_id")
def n17(spark, folder):
    return T.chunks(spark, folder).select("chunk_id", A.lift(A.chunk_id, "long")("file_id", "code", "chunk_type").alias("content_id"))


@query("n23_json_array", "SELECT event_id, CAST(1 AS INTEGER) AS objects FROM events", views=False)
def n23(spark, folder):
    f = lambda t: len(A.json_objects(t))
    t = F.concat(F.lit("Here: ["), F.coalesce("props", F.lit("{}")), F.lit(", 3]"))
    return T.table(spark, folder, "events").select("event_id", A.lift(f, "int")(t).alias("objects"))


@query("n27_json_text", "SELECT event_id, props AS json FROM events", views=False)
def n27(spark, folder):
    t = F.concat(F.lit("text\n```json\n"), "props", F.lit("\n```\nmore"))
    return T.table(spark, folder, "events").select("event_id", A.lift(A.json_text, "string")(t).alias("json"))


@query("n33_strip_references", "SELECT item_id, trim(text) AS text FROM benchmark", views=False)
def n33(spark, folder):
    t = F.concat(F.trim("text"), F.lit("\n\n---\n\n## Sources\n- [1] x"))
    return T.table(spark, folder, "benchmark").select("item_id", A.lift(A.strip_references, "string")(t).alias("text"))


@query("p5_split_chunks")
def p5(spark, folder):
    f = T.files(spark, folder)
    lines = C.line_count(F.col("text"))
    return C.split_chunks(f.select("file_id", F.lit("text").alias("name"), F.lit("BLOCK").alias("concept"), F.col("text").alias("content"), F.lit(1).alias("start_line"), lines.alias("end_line")))


@query("p9_chunk_files")
def p9(spark, folder):
    kind = F.when(F.col("chunk_type") == "comment", "COMMENT").when(F.col("chunk_type") == "block", "BLOCK").otherwise("DEFINITION")
    return C.chunk_files(T.chunks(spark, folder).select("file_id", F.col("symbol").alias("name"), kind.alias("concept"), F.col("code").alias("content"), "start_line", "end_line"))


@query("p12_token_batches", """, RECURSIVE_PLACEHOLDER""".replace(", RECURSIVE_PLACEHOLDER", """, c AS (SELECT file_id, chunk_id, greatest(1, length(code) // 3)
  AS tokens, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS k FROM chunks),
  r AS (SELECT file_id, chunk_id, k, tokens AS held, 1 AS n, 0 AS batch FROM c WHERE k = 1 UNION ALL
    SELECT c.file_id, c.chunk_id, c.k, CASE WHEN held + c.tokens > 200 OR n >= 8 THEN c.tokens ELSE held + c.tokens END, CASE
  WHEN held + c.tokens > 200 OR n >= 8 THEN 1 ELSE n + 1 END, CASE WHEN held + c.tokens > 200 OR n >= 8 THEN batch + 1 ELSE batch END
    FROM r JOIN c ON c.file_id = r.file_id AND c.k = r.k + 1)
  SELECT chunk_id, CAST(batch AS INTEGER) AS batch FROM r"""))
def p12(spark, folder):
    from karstwell.functions.text import chunk_tokens

    c = T.chunks(spark, folder).select("file_id", "chunk_id", chunk_tokens(F.col("code")).alias("tokens"))
    return C.token_batches(c, by="file_id", order="chunk_id", max_tokens=200, max_rows=8).select("chunk_id", "batch")


@query("p18_json_depth", "SELECT event_id, CAST(1 AS INTEGER) AS depth FROM events", views=False)
def p18(spark, folder):
    f = lambda t: A.json_depth(t)[0]
    return T.table(spark, folder, "events").select("event_id", A.lift(f, "int")("props").alias("depth"))


@query("p19_natural_boundaries", r""", n AS (SELECT file_id, len(ls) AS n FROM file_lines),
  i AS (SELECT *, length(code) - length(regexp_replace(code, '^\s+', '')) AS indent FROM chunks),
  w AS (SELECT i.*, n, (SELECT min(b.start_line) FROM i b WHERE b.file_id = i.file_id AND b.start_line > i.end_line
  AND b.start_line < i.end_line + 200 AND b.indent <= i.indent) AS below FROM i JOIN n USING (file_id))
  SELECT chunk_id, CAST(CASE WHEN chunk_type = 'function' THEN greatest(1, start_line - 3) ELSE start_line END AS INTEGER) AS from_line,
    CAST(CASE WHEN chunk_type = 'function' THEN least(n, end_line + 3) WHEN file_id % 2 = 1 THEN end_line ELSE coalesce(below - 1, least(n, end_line + 50)) END AS INTEGER) AS to_line FROM w""")
def p19(spark, folder):
    """Every other file is taken for Python; the texts have no definitions or braces."""
    c = T.chunks(spark, folder).withColumn("path", F.concat("path", F.when(F.col("file_id") % 2 == 0, ".py").otherwise(".js")))
    return C.expand_boundaries(c, T.files(spark, folder))


@query("r14_references", "SELECT item_id, ['- [2] `src/b.py` (L' || item_id || ')'] AS refs FROM benchmark", views=False)
def r14(spark, folder):
    block = F.concat(F.lit("├── src/\n\t├── [1] a.py\n\t└── [2] b.py (L"), F.col("item_id").cast("string"), F.lit(")"))
    return T.table(spark, folder, "benchmark").select("item_id", A.lift(A.cited_references, "array<string>")(F.lit("see [2]"), block).alias("refs"))


# -- live mutations ----------------------------------------------------------------------------------------------------


@query("t1_admitted", "SELECT seq FROM mutations WHERE NOT path IN ('u1', 'u7') AND NOT path LIKE 'u2%'")
def t1(spark, folder):
    return L.admitted(T.mutations(spark, folder), ["**/u1/**", "**/u7/**", "u2*"]).select("seq")


@query("t2_suppressed_duplicates", """, o AS (SELECT seq, path, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY path ORDER BY ts, seq) AS k FROM mutations),
  r AS (SELECT seq, path, k, event_type AS kind, us AS at, true AS passed FROM o WHERE k = 1 UNION ALL
    SELECT o.seq, o.path, o.k, CASE WHEN r.kind <> o.event_type OR o.us - r.at >= 86400000000 THEN o.event_type ELSE r.kind END, CASE
  WHEN r.kind <> o.event_type OR o.us - r.at >= 86400000000 THEN o.us ELSE r.at END, r.kind <> o.event_type OR o.us - r.at >= 86400000000
    FROM r JOIN o ON o.path = r.path AND o.k = r.k + 1)
  SELECT seq FROM r WHERE passed""")
def t2(spark, folder):
    return L.suppress_duplicates(T.mutations(spark, folder), 86_400).select("seq")


@query("t3_debounced", """, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS n FROM mutations WINDOW w AS (PARTITION BY path
  ORDER BY ts, seq)), s AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts, seq) AS k FROM g)
  SELECT path, count(*) AS events, epoch_us(max(ts)) + 3600000000 AS fires_at FROM s GROUP BY path, k""")
def t3(spark, folder):
    return L.debounced(T.mutations(spark, folder), 3600).select("path", "events", F.unix_micros("fires_at").alias("fires_at"))


OPS = ", m AS (SELECT CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'change' END AS operation, path, seq % 10 AS generation, seq FROM mutations) "


def _ops(spark, folder):
    kind = F.when(F.col("event_type") == "purchase", "delete").otherwise("change")
    return T.mutations(spark, folder).select(kind.alias("operation"), "path", (F.col("seq") % 10).alias("generation"), "seq")


@query("t4_coalesced", OPS + "SELECT operation, path, generation, seq FROM m QUALIFY row_number() OVER (PARTITION BY operation, path ORDER BY generation DESC, seq) = 1")
def t4(spark, folder):
    return L.coalesced(_ops(spark, folder))


@query("t5_stale_deletes", OPS + "SELECT seq FROM m WHERE operation <> 'delete' OR generation >= (SELECT max(generation) FROM m x WHERE x.path = m.path)")
def t5(spark, folder):
    return L.without_stale_deletes(_ops(spark, folder)).select("seq")


@query("t6_priority", OPS + "SELECT seq, operation FROM m ORDER BY CASE operation WHEN 'delete' THEN 0 ELSE 1 END, seq")
def t6(spark, folder):
    return _ops(spark, folder).orderBy(L.priority(F.col("operation")), "seq").select("seq", "operation")


@query("t8_pressure", """, p AS (SELECT seq, count(*) OVER (PARTITION BY path ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS events
  FROM mutations) SELECT seq, events, CASE WHEN events >= 6 THEN 'overloaded' WHEN events >= 4 THEN 'elevated' ELSE 'normal' END AS state FROM p""")
def t8(spark, folder):
    return L.pressure(T.mutations(spark, folder), 86_400, elevated=4, overloaded=6).select("seq", "events", "state")


@query("t10_snapshot_diff", """SELECT path, CASE file_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' ELSE 'modified' END AS event_type FROM files WHERE file_id % 4 < 3""")
def t10(spark, folder):
    f = T.files(spark, folder).select("path", "size", F.lit(1.0).alias("mtime"), (F.col("file_id") % 4).alias("k"))
    after = f.where("k <> 1").withColumn("mtime", F.when(F.col("k") == 2, 2.0).otherwise(F.col("mtime")))
    return L.snapshot_diff(f.where("k <> 0"), after)


@query("t13_live_state", """SELECT seq, CASE seq % 6 WHEN 0 THEN 'degraded' WHEN 1 THEN 'uninitialized' WHEN 2 THEN 'busy' WHEN 3 THEN 'idle' WHEN 4 THEN 'stalled'
  ELSE 'busy' END AS state FROM mutations""")
def t13(spark, folder):
    k = F.col("seq") % 6
    m = T.mutations(spark, folder).select("seq", (k == 0).alias("has_error"), (k != 1).alias("ready"), (k == 2).cast("int").alias("active"), (k >= 4).cast("int").alias("backlog"), F.col("ts").alias("accepted_at"), F.lit(None).cast("timestamp").alias("progress_at"), (F.col("ts") + F.make_dt_interval(secs=F.when(k == 4, 60.0).otherwise(5.0))).alias("now"))
    return L.live_state(m).select("seq", "state")
