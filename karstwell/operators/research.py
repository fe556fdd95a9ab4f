"""Evidence, budgets and coverage of retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell.functions import text as X
from karstwell.operators.search import elbow, multi_hop, numbered, page, semantic
from karstwell.sources.storage import cut


def constants_from_metadata(chunks: DataFrame, order: list[str]) -> DataFrame:
    """path, name, value, type of the constants in JSON metadata; the first of each (path, name) stays."""
    kind = "struct<constants:array<struct<name:string,value:string,type:string>>>"
    rows = chunks.select("path", *order, F.posexplode(F.from_json("metadata", kind)["constants"]).alias("_at", "c")).where("c.name is not null")
    n = F.row_number().over(Window.partitionBy("path", "c.name").orderBy(*order, "_at"))
    return rows.withColumn("_n", n).where("_n = 1").select("path", "c.name", "c.value", "c.type")


def entity_index(facts: DataFrame) -> DataFrame:
    """entity (normalised), label (as first written) and number of facts. Columns: fact_id, entities."""
    e = facts.select("fact_id", F.posexplode("entities").alias("at", "label")).withColumn("entity", F.lower(X.strip(F.col("label"))))
    return e.groupBy("entity").agg(F.min_by("label", F.struct("fact_id", "at")).alias("label"), F.countDistinct("fact_id").alias("facts"))


def facts_for(facts: DataFrame, *, paths: list[str] | None = None, entity: str | None = None) -> DataFrame:
    if paths is not None:
        facts = facts.where(F.col("path").isin(paths))
    if entity is not None:
        facts = facts.where(F.exists("entities", lambda e: F.lower(X.strip(e)) == entity.strip().lower()))
    return facts


def related_facts(facts: DataFrame, fact_id: int) -> DataFrame:
    """Other facts that share an entity with one fact."""
    row = facts.where(F.col("fact_id") == fact_id).select(F.transform("entities", lambda e: F.lower(X.strip(e)))).first()
    names = row[0] if row else []
    shared = F.exists("entities", lambda e: F.lower(X.strip(e)).isin(names)) if names else F.lit(False)
    return facts.where((F.col("fact_id") != fact_id) & shared)


#: The order of confidence.
CONFIDENCE = ("definite", "likely", "inferred", "uncertain")


def facts_by_priority(facts: DataFrame, limit: int = 500) -> DataFrame:
    """By confidence, then category, then id; ``limit`` at most."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence")), F.lit(0))
    return facts.orderBy(F.when(rank == 0, 5).otherwise(rank), "category", "fact_id").limit(limit)


def line_coverage(ranges: DataFrame) -> DataFrame:
    """Distinct lines of each path: overlapping ranges are merged by a running maximum, no line is made a row. Columns: path, start_line, end_line."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end_line") - F.greatest(F.coalesce(before, F.lit(0)), F.col("start_line") - 1))
    return ranges.withColumn("_new", new).groupBy("path").agg(F.sum("_new").alias("lines"))


def unexplored(chunks: DataFrame, explored: DataFrame, *, full: int = 50) -> DataFrame:
    """Chunks (path, start_line, end_line) in no explored range of their file, which has at most ``full`` explored lines."""
    done = line_coverage(explored).where(F.col("lines") > full).select("path")
    r = explored.select(F.col("path").alias("_p"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b")).distinct()
    inside = (F.col("path") == F.col("_p")) & (F.col("start_line") >= F.col("_a")) & (F.col("end_line") <= F.col("_b"))
    return chunks.join(done, "path", "left_anti").join(r, inside, "left_anti")


def within_budget(files: DataFrame, order: list[str], max_tokens: int, *, by: list[str] = (), key: str = "file_id") -> DataFrame:
    """Files in order until the tokens are used; the one that passes the limit is cut if over 500 tokens are left.

    ``by`` partitions the budget, ``key`` identifies a file; null and empty
    texts cost no token and take no part. A file costs a token at least, so only
    the first ``max_tokens`` files of each budget are looked at, and Spark keeps
    no more of them in a task. Their keys and sizes are shuffled; texts are
    joined to the chosen ones only.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    sizes = files.select(*dict.fromkeys([key, *by, *order]), X.llm_tokens(F.col("text")).alias("tokens")).where("tokens > 0")
    first = sizes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_tokens)
    run = first.withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(max_tokens) - F.col("before")
    whole = F.col("tokens") <= left
    chosen = run.where(whole | (left > 500)).select(key, "tokens", "before", (~whole).alias("is_cut"), left.alias("left"))
    content = F.when(F.col("is_cut"), F.substring("text", F.lit(1), (F.col("left") * 4).cast("int"))).otherwise(F.col("text"))
    return files.join(chosen, key).withColumn("content", content).drop("left")


def representatives(chunks: DataFrame, score: str, *, per_file: int = 5, max_tokens: int = 2000) -> DataFrame:
    """A document for each path: its best chunks in order, joined, at most ``max_tokens`` long."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.col(score).desc(), "chunk_id"))
    top = chunks.withColumn("_n", n).where(F.col("_n") <= per_file)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "code"))), lambda s: s["code"]), "\n\n")
    return top.groupBy("path").agg(F.substring(joined, 1, max_tokens * 4).alias("document"), F.count("*").alias("chunks"))


def reference_map(paths: DataFrame) -> DataFrame:
    """path and its number in sorted order, from 1. The cited files of one report."""
    return paths.select("path").distinct().withColumn("number", F.row_number().over(Window.partitionBy().orderBy("path")))


def chunk_ranges(chunks: DataFrame, shown: int = 3) -> DataFrame:
    """path and ``L1-3, L7-9 +2 more``."""
    one = F.concat(F.lit("L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    g = chunks.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("start_line", "end_line", one.alias("t")))).alias("r"))
    head = F.array_join(F.transform(F.slice("r", 1, shown), lambda s: s["t"]), ", ")
    return g.select("path", F.concat(head, F.when(F.size("r") > shown, F.concat(F.lit(" +"), (F.size("r") - shown).cast("string"), F.lit(" more"))).otherwise("")).alias("ranges"))


def select_gaps(gaps: DataFrame, *, least: int = 1, most: int = 10) -> DataFrame:
    """Gaps (gap_id, score) worth filling: above the elbow of the best ``most``, and at least half the best score.

    Without an elbow at ``least`` or later: those of at least half the best score if there are ``most`` or fewer, else the best ``most``.
    """
    total = gaps.agg(F.count("*").alias("_total"))
    top = gaps.orderBy(F.col("score").desc(), "gap_id").limit(most)
    ranked = elbow(top.crossJoin(F.broadcast(total)), "score", id_="gap_id")
    best = F.max("score").over(Window.partitionBy())  # at most ``most`` rows
    ranked = ranked.withColumn("_best", best)
    strong = F.col("score") >= F.col("_best") * 0.5
    above = F.when((F.col("elbow") >= least) & (F.col("_total") > least), F.col("rank") < F.col("elbow"))
    ranked = ranked.withColumn("_held", F.count_if(above & strong).over(Window.partitionBy()) >= least)
    held = F.col("_held")
    picked = F.when(F.col("_total") <= least, True).when(F.col("_best") < 1e-9, F.col("rank") < least).when(above.isNotNull(), above & (strong | ~held)).when(F.col("_total") <= most, strong | (F.col("rank") < least)).otherwise(True)
    return ranked.where(picked).select(*gaps.columns)


def breadth_first(seeds: DataFrame, follow_ups: DataFrame, *, levels: int, keep: int = 3) -> DataFrame:
    """node and level of a level-by-level traversal: of each node its ``keep`` best follow-ups that were not met on levels before.

    ``seeds``: node. ``follow_ups``: node, next, score (what a model, or any
    scorer, proposes). A node that several name on one level is met once. One
    join and one limited window a level; levels are few.
    """
    met = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    last = met
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "next"))
    for level in range(1, levels + 1):
        near = follow_ups.select("node", "next", "score").join(last.select("node"), "node")
        fresh = near.join(met.select(F.col("node").alias("next")), "next", "left_anti")
        last = cut(fresh.withColumn("_n", place).where(F.col("_n") <= keep).select(F.col("next").alias("node")).distinct().withColumn("level", F.lit(level)))
        if last.isEmpty():
            break
        met = met.unionByName(last)
    return met


def explore_depth(embeddings: DataFrame, files: DataFrame, covered: DataFrame, *, files_kept: int = 5, queries: int = 2, size: int = 10) -> DataFrame:
    """Further chunks around the best files of what is covered: chunk_id, similarity, path (the file that asked), query.

    ``embeddings``: chunk_id, embedding, dims; ``files``: chunk_id, path;
    ``covered``: chunk_id, score. The ``files_kept`` files of the best mean score
    ask with the vectors of their ``queries`` best chunks, one after the other;
    what is covered or was found before is left out. At most files_kept *
    queries scans, and as many times ``size`` ids on the driver.
    """
    scored = covered.select("chunk_id", "score").join(files.select("chunk_id", "path"), "chunk_id")
    top = scored.groupBy("path").agg(F.avg("score").alias("mean")).orderBy(F.col("mean").desc(), "path").limit(files_kept)
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.col("score").desc(), "chunk_id"))
    asked = scored.join(F.broadcast(top), "path").withColumn("query", nth).where(F.col("query") <= queries)
    asked = asked.join(embeddings.select("chunk_id", "embedding"), "chunk_id").orderBy(F.col("mean").desc(), "path", "query").collect()
    left = embeddings.join(covered.select("chunk_id"), "chunk_id", "left_anti")
    seen: list[int] = []
    out: list[tuple] = []
    for r in asked:
        found = semantic(left.where(~F.col("chunk_id").isin(seen)) if seen else left, r["embedding"])
        for hit in page(found.select("chunk_id", "similarity"), [F.col("similarity").desc(), F.col("chunk_id")], size).collect():
            seen.append(hit["chunk_id"])
            out.append((hit["chunk_id"], float(hit["similarity"]), r["path"], r["query"]))
    return embeddings.sparkSession.createDataFrame(out, "chunk_id long, similarity double, path string, query int")


def rerank_in_batches(documents: DataFrame, score: Column, *, key: str, order: list[str], size: int = 64) -> DataFrame:
    """Adds batch (from 0, of ``size`` documents in order) and rerank_score; ties and batches do not change a score.

    ``score`` reads the document; a document that gets none has 0. Batches are
    what one call of a model takes; places are dealt out by ranges.
    """
    places = numbered(documents.select(*dict.fromkeys([key, *order])), [F.col(c) for c in order], "_place")
    batch = places.select(key, F.floor(F.col("_place") / size).cast("int").alias("batch"))
    return documents.join(batch, key).withColumn("rerank_score", F.coalesce(score, F.lit(0.0)))


def file_tree_lines(paths: DataFrame) -> DataFrame:
    """The lines of a drawn tree for each group (group, path): group, node (the path so far), line. Sorted by node, they are the tree.

    Every part of a path is a row, so no task holds a whole tree; siblings are in
    the order of their names, directories end in a slash.
    """
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, 1, n))
    nodes = paths.select("group", F.explode(steps).alias("node")).distinct()
    above = lambda n: F.slice(n, 1, F.size(n) - 1)
    siblings = nodes.groupBy("group", above(F.col("node")).alias("parent")).agg(F.max("node").alias("last"))
    marked = nodes.withColumn("parent", above(F.col("node"))).join(siblings, ["group", "parent"])
    below = siblings.select("group", F.col("parent").alias("node"), F.lit(True).alias("is_folder"))
    marked = marked.select("group", "node", (F.col("node") == F.col("last")).alias("is_last")).join(below, ["group", "node"], "left")
    marked = cut(marked)
    # what is drawn before a line depends on whether each folder on the way is the last of its siblings
    way = marked.withColumn("step", F.explode(F.sequence(F.lit(1), F.size("node")))).withColumn("at", F.slice("node", F.lit(1), F.col("step")))
    flags = marked.select("group", F.col("node").alias("at"), F.col("is_last").alias("at_last"))
    inner = F.when(F.col("step") < F.size("node"), F.when(F.col("at_last"), "    ").otherwise("│   ")).otherwise(F.when(F.col("at_last"), "└── ").otherwise("├── "))
    drawn = way.join(flags, ["group", "at"]).groupBy("group", "node", "is_folder").agg(F.array_sort(F.collect_list(F.struct("step", inner.alias("mark")))).alias("marks"))
    head = F.array_join(F.transform("marks", lambda m: m["mark"]), "")
    return drawn.select("group", "node", F.concat(head, F.element_at("node", -1), F.when(F.col("is_folder"), "/").otherwise("")).alias("line"))


def investigate(embeddings: DataFrame, chunks: DataFrame, vector: list[float], rerank: Column, *, max_tokens: int = 20_000, page_size: int = 10) -> dict[str, DataFrame]:
    """What a report is written from, in the order of the steps: found, files, context and citations.

    Rows are found over several hops, extended by the depth around the best
    files, ranked by file, cut to a token budget and numbered for citation. The
    writing itself needs a language model and is the caller's. ``chunks``:
    chunk_id, path, start_line, end_line, code; of the same ids as ``embeddings``.
    """
    found = multi_hop(embeddings, vector, rerank, page_size=page_size).withColumnRenamed("rerank_score", "score")
    more = explore_depth(embeddings, chunks, found.select("chunk_id", "score"), size=page_size)
    pool = cut(found.select("chunk_id", "score").unionByName(more.select("chunk_id", F.col("similarity").alias("score"))))
    own = chunks.join(pool, "chunk_id")
    files = own.groupBy("path").agg(F.avg("score").alias("score"), F.count("*").alias("chunks"))
    documents = representatives(own, "score").join(files.select("path", "score"), "path")
    ranked = documents.select("path", (-F.col("score")).alias("rank"), F.col("document").alias("text"))
    context = within_budget(ranked, ["rank", "path"], max_tokens, key="path")
    return {"found": pool, "files": files, "context": context, "citations": reference_map(context)}
