"""Filters, vector search and result ranking over files, chunks and embeddings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell.functions import vectors as V
from karstwell.functions.paths import escape_like, in_path
from karstwell.sources.storage import cut


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page in a total order; Spark keeps only offset + size rows of each task."""
    return df.orderBy(*order).offset(offset).limit(size)


def regex_search(chunks: DataFrame, pattern: str, *, path: str | None = None) -> DataFrame:
    """Chunks whose text has a match anywhere, case-sensitive."""
    return chunks.where(F.col("code").rlike(pattern) & in_path(F.col("path"), path))


def text_search(chunks: DataFrame, text: str, *, escaped: bool = False) -> DataFrame:
    """Substring of code or symbol. Unescaped, ``%`` and ``_`` of the query are wildcards; escaped, only code is searched."""
    if escaped:
        return chunks.where(F.col("code").like("%" + escape_like(text) + "%"))
    return chunks.where(F.col("code").like(f"%{text}%") | F.col("symbol").like(f"%{text}%"))


def page_metadata(found: DataFrame, size: int, offset: int) -> DataFrame:
    """One row: offset, page_size, has_more, next_offset, total."""
    total = found.agg(F.count("*").alias("total"))
    more = F.lit(offset + size) < F.col("total")
    return total.select(F.lit(offset).alias("offset"), F.lit(size).alias("page_size"), more.alias("has_more"), F.when(more, offset + size).alias("next_offset"), "total")


def semantic(embeddings: DataFrame, vector: list[float], *, threshold: float | None = None) -> DataFrame:
    """Adds the similarity to a fixed vector; keeps rows of its length, and with a ``threshold`` those at or over it."""
    found = embeddings.where(F.col("dims") == len(vector)).withColumn("similarity", V.cosine_literal(F.col("embedding"), vector))
    return found if threshold is None else found.where(F.col("similarity") >= threshold)


def neighbours(embeddings: DataFrame, chunk_id: int, *, max_distance: float | None = None, min_similarity: float | None = None) -> DataFrame:
    """Other chunks with their similarity to one chunk. The bound is a distance or a similarity, by name."""
    row = embeddings.where(F.col("chunk_id") == chunk_id).select("embedding").first()
    if row is None:
        return embeddings.limit(0).withColumn("score", F.lit(0.0))
    found = semantic(embeddings, row[0]).withColumnRenamed("similarity", "score").where(F.col("chunk_id") != chunk_id)
    if max_distance is not None:
        found = found.where(1 - F.col("score") <= max_distance)
    return found if min_similarity is None else found.where(F.col("score") >= min_similarity)


def fuse(semantic_hits: DataFrame, regex_hits: DataFrame, weight: float) -> DataFrame:
    """Hybrid scores. Inputs: chunk_id, position (from 0), the first also similarity; few rows each."""
    everything = Window.partitionBy()

    def placed(df: DataFrame) -> DataFrame:
        n = F.count("*").over(everything)
        return df.withColumn("pos", (n - F.col("position")) / n)

    s = placed(semantic_hits).select("chunk_id", ((F.col("pos") * 0.3 + F.coalesce("similarity", F.lit(0.5)) * 0.7) * weight).alias("s"))
    r = placed(regex_hits).select("chunk_id", (F.col("pos") * (1 - weight)).alias("r"))
    kind = F.when(F.col("s").isNull(), "regex").when(F.col("r").isNull(), "semantic").otherwise("hybrid")
    return s.join(r, "chunk_id", "full").select("chunk_id", kind.alias("search_type"), (F.coalesce("s", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("combined_score"))


def ranked_positions(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their position from 0."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order)) - 1)


def unified_score(df: DataFrame) -> Column:
    """rerank_score, similarity, score or 0; whichever the table has and the row holds first."""
    have = [c for c in ("rerank_score", "similarity", "score") if c in df.columns]
    return F.coalesce(*[F.col(c).cast("double") for c in have], F.lit(0.0))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 0.

    Rows are dealt out by ranges and sorted there; a partition's offset is the
    sum of the sizes before it (one number for each partition on the driver),
    so no task sees all rows.
    """
    # the id holds the partition and the row's place in it
    spread = cut(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in sorted(spread.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    return spread.withColumn("_part", part).join(table, "_part").withColumn(name, nth + F.col("_before")).drop("_part", "_id", "_before")


def elbow(df: DataFrame, score: str, *, id_: str = "chunk_id") -> DataFrame:
    """Adds rank (from 0, descending score), n and elbow (the rank farthest from the chord, or null).

    No elbow: fewer than three rows, all scores equal, or the distance under 0.01.
    """
    ranked = numbered(df, [F.col(score).desc(), F.col(id_)], "rank")
    ends = ranked.agg(F.count("*").alias("n"), F.max(score).alias("high"), F.min(score).alias("low"))
    x = F.col("rank") / (F.col("n") - 1)
    y = (F.col(score) - F.col("low")) / (F.col("high") - F.col("low"))
    ranked = ranked.crossJoin(F.broadcast(ends)).withColumn("far", F.when((F.col("n") >= 3) & (F.col("high") > F.col("low")), F.abs(1 - x - y) / F.sqrt(F.lit(2.0))))
    best = ranked.agg(F.max(F.struct("far", (-F.col("rank")).alias("r"))).alias("best"))
    at = F.when(F.col("best.far") >= 0.01, -F.col("best.r"))
    return ranked.crossJoin(F.broadcast(best)).withColumn("elbow", at).drop("high", "low", "far", "best")


def term_overlap(query: str, text: Column) -> Column:
    """A deterministic stand-in for a reranker: the share of the query's words in the text."""
    words = sorted(set(query.lower().split()))
    own = F.array_distinct(F.split(F.lower(text), r"\W+"))
    return F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]))) / F.lit(float(max(1, len(words))))


def apply_rerank(results: DataFrame, scores: DataFrame) -> DataFrame:
    """New scores by chunk_id; rows without one keep theirs."""
    new = scores.select("chunk_id", F.col("score").alias("_new"))
    return results.join(new, "chunk_id", "left").withColumn("rerank_score", F.coalesce("_new", "rerank_score")).drop("_new")


def multi_hop(embeddings: DataFrame, vector: list[float], rerank: Column, *, page_size: int = 10, offset: int = 0, threshold: float | None = None, max_rounds: int = 20, limit: int = 500) -> DataFrame:
    """Semantic seeds, then rounds of neighbours of the five best, until the ranking stops to improve.

    ``embeddings`` needs chunk_id, embedding, dims and what ``rerank`` (the score
    of a row for the query) reads. A round expands the top five by 20 neighbours
    each (30 in the first); the search ends at ``limit`` rows, with fewer than
    five positive candidates, without new rows, when a tracked score drops by
    0.15, or when the fifth score is under 0.3. Only ids and scores of at most
    ``limit`` rows are on the driver; vectors are scanned where they are.
    """
    spark = embeddings.sparkSession
    seeds = min(3 * page_size, 100)
    first = page(semantic(embeddings, vector).withColumn("rerank_score", rerank), [F.col("similarity").desc(), F.col("chunk_id")], seeds)
    held = {r["chunk_id"]: (r["rerank_score"], r["similarity"]) for r in first.select("chunk_id", "rerank_score", "similarity").collect()}

    def best(n: int) -> list[int]:
        return sorted(held, key=lambda c: (-held[c][0], c))[:n]

    tracked = {c: held[c][0] for c in best(5)}
    for round_ in range(max_rounds):
        positive = [c for c in best(5) if held[c][0] > 0]
        if len(positive) < 5 or len(held) >= limit:
            break
        wanted = embeddings.where(F.col("chunk_id").isin(positive)).select("chunk_id", "embedding").collect()
        near = None
        for r in sorted(wanted, key=lambda r: r["chunk_id"]):
            hits = semantic(embeddings, r["embedding"]).where(F.col("chunk_id") != r["chunk_id"])
            hits = page(hits, [F.col("similarity").desc(), F.col("chunk_id")], 30 if round_ == 0 else 20)
            near = hits if near is None else near.unionByName(hits)
        found = near.withColumn("rerank_score", rerank).select("chunk_id", "rerank_score", "similarity").collect()
        new = {r["chunk_id"]: (r["rerank_score"], r["similarity"]) for r in found if r["chunk_id"] not in held}
        if not new:
            break
        for c in sorted(new)[: limit - len(held)]:
            held[c] = new[c]
        now = best(5)
        if any(c in tracked and tracked[c] - held[c][0] >= 0.15 for c in tracked) or min(held[c][0] for c in now) < 0.3:
            break
        tracked = {c: held[c][0] for c in now}
    rows = [(c, float(s), float(v)) for c, (s, v) in held.items() if threshold is None or s >= threshold]
    out = spark.createDataFrame(rows, "chunk_id long, rerank_score double, similarity double")
    return page(out, [F.col("rerank_score").desc(), F.col("chunk_id")], page_size, offset)


def enhance(df: DataFrame) -> DataFrame:
    """Adds what a result page shows: clean symbol, line_count, preview, is_truncated, file_extension, similarity_percentage."""
    out = df.withColumns({
        "symbol": F.regexp_replace("symbol", r"(?:_part[0-9]+)+$", ""),
        "line_count": F.col("end_line") - F.col("start_line") + 1,
        "code_preview": F.when(F.length("code") > 500, F.concat(F.substring("code", 1, 500), F.lit("..."))).otherwise(F.col("code")),
        "is_truncated": F.length("code") > 500,
        "file_extension": F.regexp_extract("path", r"(\.[^./]+)$", 1),
    })
    return out.withColumn("similarity_percentage", F.round(F.col("similarity") * 100, 2)) if "similarity" in df.columns else out


def symbol_regex(symbol: Column) -> Column:
    """A pattern for a whole symbol: word boundaries, or for symbols that begin or end otherwise non-word guards."""
    safe = F.regexp_replace(symbol, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    head = F.when(symbol.rlike(r"^\w"), r"\b").otherwise(r"(?:^|\W)")
    tail = F.when(symbol.rlike(r"\w$"), r"\b").otherwise(r"(?:\W|$)")
    return F.concat(head, safe, tail)


def useful_symbol(symbol: Column) -> Column:
    """Longer than a character, no number, none of self, cls, this."""
    return (F.length(symbol) > 1) & ~symbol.rlike(r"^[0-9]+$") & ~F.lower(symbol).isin("self", "cls", "this")


#: Symbols whose keys are looked for before words become rows; with more, all words do.
FEW_SYMBOLS = 1000


def search_by_symbols(chunks: DataFrame, symbols: DataFrame, *, per_symbol: int, seen: DataFrame | None = None) -> DataFrame:
    """The first chunks in (path, start_line, chunk_id) order that match each symbol's pattern (``symbol_regex``).

    A symbol is looked up by its longest run of word characters (its first
    character if it has none), so that chunks meet symbols in an equality join;
    the pattern is then checked on what is left, unless the symbol is that run.
    Adds symbol and n. Null and empty symbols match nothing.
    """
    runs = F.filter(F.split("symbol", r"\W+"), lambda w: F.length(w) > 0)
    longest = F.element_at(F.reverse(F.array_sort(F.transform(runs, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), 1)["w"]
    key = F.when(F.size(runs) > 0, F.when(F.size(runs) == 1, F.element_at(runs, 1)).otherwise(longest)).otherwise(F.substring("symbol", 1, 1))
    asked = symbols.select("symbol").where(F.length("symbol") > 0).distinct()
    asked = asked.select("symbol", key.alias("key"), symbol_regex(F.col("symbol")).alias("pattern"))
    some = asked.select("key").limit(FEW_SYMBOLS + 1).collect()
    few, keys = len(some) <= FEW_SYMBOLS, sorted({r["key"] for r in some})
    words = F.split("code", r"\W+")
    if any(not re.match(r"[0-9A-Za-z_]", k) for k in keys) or not few:
        words = F.concat(words, F.split(F.regexp_replace("code", r"\w", ""), ""))
    if few:
        asked = F.broadcast(asked)
        words = F.array_intersect(words, F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>"))
    rows = chunks.drop("symbol", "key").withColumn("key", F.explode(F.array_distinct(words)))
    hits = rows.join(asked, "key").where((F.col("symbol") == F.col("key")) & F.col("symbol").rlike(r"^\w+$") | F.rlike("code", F.col("pattern")))
    if seen is not None:
        hits = hits.join(seen.select("chunk_id"), "chunk_id", "left_anti")
    place = Window.partitionBy("symbol").orderBy("path", "start_line", "chunk_id")
    return hits.withColumn("n", F.row_number().over(place)).where(F.col("n") <= per_symbol).drop("key", "pattern")


def augmentation_budget(hits: Column, symbols: Column) -> tuple[Column, Column]:
    """Regex results wanted in all, and for each symbol."""
    target = F.greatest(F.lit(20), F.floor(hits * 0.3).cast("int"))
    return target, F.greatest(F.lit(1), F.floor(target / symbols).cast("int"))


def normalize_url(url: Column) -> Column:
    """A key for equal pages: host in lower case, no fragment, no slashes at the path's end (but one for the root)."""
    base = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(base, F.length(head) + 1, F.lit(1 << 30))
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    return F.concat(F.lower(head), F.when(F.length(path) > 0, path).otherwise("/"), query)


def interleave(results: DataFrame, limit: int) -> DataFrame:
    """Round robin over queries by rank; a URL counts at its first place. Columns: query_ord, rank, url."""
    keyed = results.withColumn("key", normalize_url(F.col("url")))
    first = Window.partitionBy("key").orderBy("rank", "query_ord", "url")
    return keyed.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("rank", "query_ord").limit(limit)
