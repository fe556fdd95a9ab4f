"""Joins and deduplication over files, chunks, embeddings and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell import schemas
from karstwell.functions import text as X


def without_embedding(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """Chunks with text that have no embedding of the model."""
    have = embeddings.where((F.col("provider") == provider) & (F.col("model") == model)).select("chunk_id")
    return chunks.where(F.col("code").rlike(r"\S")).join(have, "chunk_id", "left_anti")


def in_ranges(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks whose lines overlap a range (file_id, low, high) of their file; each chunk once."""
    hit = (F.col("start_line") <= F.col("high")) & (F.col("end_line") >= F.col("low"))
    r = ranges.select("file_id", "low", "high")
    return chunks.alias("c").join(r.alias("r"), (F.col("c.file_id") == F.col("r.file_id")) & hit, "left_semi")


def context_of(chunks: DataFrame, wanted: DataFrame, lines: int) -> DataFrame:
    """Chunks around wanted ones (chunk_id): ``lines`` before and after."""
    around = chunks.join(wanted.select("chunk_id"), "chunk_id", "left_semi").select("file_id", F.greatest(F.lit(1), F.col("start_line") - lines).alias("low"), (F.col("end_line") + lines).alias("high"))
    return in_ranges(chunks, around)


def expand_windows(chunks: DataFrame, wanted: DataFrame, lines: int = 50) -> DataFrame:
    """Other chunks in the span of each file's wanted ones, widened by ``lines``."""
    have = chunks.join(wanted.select("chunk_id"), "chunk_id", "left_semi")
    spans = have.groupBy("file_id").agg(F.greatest(F.lit(1), F.min("start_line") - lines).alias("low"), (F.max("end_line") + lines).alias("high"))
    return in_ranges(chunks, spans).join(have.select("chunk_id"), "chunk_id", "left_anti")


def changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path and state of the current files: new, unchanged or changed. Columns: path, size, mtime (seconds), content_hash.

    Equal sizes and times within 0.01 s are unchanged; else the hashes decide.
    """
    s = stored.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime", "content_hash")])
    same_stat = (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) <= 0.01)
    state = F.when(F.col("_size").isNull() & F.col("_mtime").isNull(), "new").when(same_stat, "unchanged").when(F.col("content_hash") == F.col("_content_hash"), "unchanged").otherwise("changed")
    return current.join(s, "path", "left").select("path", state.alias("state"))


def orphans(stored: DataFrame, current: DataFrame, excluded: Column) -> DataFrame:
    """Stored paths that go: missing from the listing, or excluded by now."""
    seen = current.select("path", F.lit(True).alias("_seen"))
    reason = F.when(F.col("_seen").isNull(), "missing").when(excluded, "excluded")
    return stored.select("path").join(seen, "path", "left").select("path", reason.alias("reason")).where("reason is not null")


def chunk_diff(existing: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """unchanged and deleted rows of ``existing`` and added rows of ``new``, by normalised code within ``by``.

    Copies of a content all get the state of the content; unchanged ones are the
    existing copies. Both tables meet in one shuffle: a window over each content
    tells on which sides it is.
    """
    both = existing.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    same = Window.partitionBy(*by, F.md5(X.normalize_content(F.col("code"))))
    rows = both.withColumns({"_in_old": F.max("_old").over(same), "_in_new": F.max(~F.col("_old")).over(same)})
    state = F.when(~F.col("_old"), "added").when(F.col("_in_new"), "unchanged").otherwise("deleted")
    return rows.where("_old or not _in_old").withColumn("state", state).drop("_old", "_in_old", "_in_new")


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_exact(chunks: DataFrame) -> DataFrame:
    """One chunk for each content: the most specific, then the shortest, then the first. Blank ones go."""
    keyed = chunks.withColumn("_key", F.md5(X.normalize_content(F.col("code")))).where(F.col("code").rlike(r"\S"))
    return best_by(keyed, ["_key"], [schemas.specificity(F.col("chunk_type")).desc(), F.col("end_line") - F.col("start_line"), F.col("chunk_id")]).drop("_key")


#: Languages whose duplicates are kept.
KEEPS_DUPLICATES = ("vue", "vue_template", "haskell")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Exact, then without blocks inside definitions; languages that need duplicates keep them."""
    keep = F.col("language").isin(*KEEPS_DUPLICATES)
    return without_nested_blocks(dedup_exact(chunks.where(~keep))).unionByName(chunks.where(keep))


def without_nested_blocks(chunks: DataFrame) -> DataFrame:
    """Drops blocks whose text a longer, overlapping chunk of a more definite type holds."""
    block = F.col("chunk_type").isin("block", "array")
    outer = chunks.where(~block & (schemas.specificity(F.col("chunk_type")) >= 3)).select("file_id", F.col("start_line").alias("low"), F.col("end_line").alias("high"), X.normalize_content(F.col("code")).alias("whole"))
    inner = X.normalize_content(F.col("code"))
    nested = chunks.alias("c").join(outer.alias("o"), (F.col("c.file_id") == F.col("o.file_id")) & (F.col("start_line") <= F.col("high")) & (F.col("end_line") >= F.col("low")) & (F.length("whole") > F.length(inner)) & F.contains("whole", inner), "left_semi").where(block).select("chunk_id")
    return chunks.join(nested, "chunk_id", "left_anti")


def dedup_embeddings(embeddings: DataFrame) -> DataFrame:
    """The newest row of each (chunk_id, provider, model); no time counts as oldest, then the larger id."""
    return best_by(embeddings, ["chunk_id", "provider", "model"], [F.col("created_at").desc_nulls_last(), F.col("embedding_id").desc()])


def merge_lists(base: DataFrame, new: DataFrame, score: str = "score") -> DataFrame:
    """By chunk_id the better score; the base row among equals."""
    both = base.withColumn("_origin", F.lit(0)).unionByName(new.withColumn("_origin", F.lit(1)))
    return best_by(both, ["chunk_id"], [F.col(score).desc(), F.col("_origin")]).drop("_origin")


def sharing_entities(facts: DataFrame) -> DataFrame:
    """Pairs a < b of facts (fact_id, entities) that name the same entity, with the number of those.

    The pairs are the result, so it has as many rows as they are; ``entity_members``
    gives the same relation in the size of the input. AQE can split the join of an
    entity that very many facts name.
    """
    e = entity_members(facts)
    other = e.select(F.col("fact_id").alias("b"), "entity")
    return e.withColumnRenamed("fact_id", "a").join(other, "entity").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def entity_members(facts: DataFrame) -> DataFrame:
    """entity (normalised) and fact_id, once for each fact that names it: the relation of facts without its pairs."""
    return facts.select("fact_id", F.explode(F.array_distinct(F.transform("entities", lambda x: F.lower(X.strip(x))))).alias("entity"))


#: Fixed value: words that make a statement exclude others.
NEGATION = r"(?i)\b(never|always|cannot|must not|does not|is not|are not|no longer|impossible|forbidden|prohibited)\b"


def conflicts(facts: DataFrame) -> DataFrame:
    """Pairs a < b of facts on one entity of which one is negated, or whose numbers differ. Columns: fact_id, statement, entities.

    Facts that say alike on an entity (negation and numbers) are one class;
    classes are compared, and only those that conflict are opened into facts, so
    no pair is made that is not in the result.
    """
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all("statement", F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1))))
    said = facts.select("fact_id", F.col("statement").rlike(NEGATION).alias("negated"), numbers.alias("numbers"))
    e = entity_members(facts).join(said, "fact_id")
    classes = e.select("entity", "negated", "numbers").distinct()
    a = classes.select("entity", F.col("negated").alias("na"), F.col("numbers").alias("xa"))
    b = classes.select("entity", F.col("negated").alias("nb"), F.col("numbers").alias("xb"))
    numbered = (F.size("xa") > 0) & (F.size("xb") > 0) & (F.col("xa") != F.col("xb"))
    reason = F.when(F.col("na") != F.col("nb"), "negation").when(numbered, "numbers")
    apart = a.join(b, "entity").withColumn("reason", reason).where("reason is not null")
    first = e.select("entity", F.col("negated").alias("na"), F.col("numbers").alias("xa"), F.col("fact_id").alias("a"))
    second = e.select("entity", F.col("negated").alias("nb"), F.col("numbers").alias("xb"), F.col("fact_id").alias("b"))
    opened = apart.join(first, ["entity", "na", "xa"]).join(second, ["entity", "nb", "xb"])
    return opened.where("a < b").select("entity", "a", "b", "reason")


def imports_of(edges: DataFrame, files: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Chunks of the first ``limit`` imported files, with a score of 0.3. edges: from_path, to_path."""
    targets = edges.select(F.col("to_path").alias("path")).distinct().join(files.select("path", "file_id"), "path").orderBy("path").limit(limit)
    return chunks.join(F.broadcast(targets.select("file_id")), "file_id").withColumn("rerank_score", F.lit(0.3))


def shadowed(stored: DataFrame, diff: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a diff, and stored rows that none of them stands for; origin tells which. Both have the same columns."""
    rest = stored.join(diff.select(*key), key, "left_anti").select(*diff.columns)
    return diff.withColumn("origin", F.lit("diff")).unionByName(rest.withColumn("origin", F.lit("stored")))


def template_references(templates: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, script_references and undefined_references: distinct names of a template (file_id, text) with and without a symbol."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))
    used = templates.select("file_id", F.explode(names).alias("symbol"))
    known = used.join(symbols.select("symbol").distinct().withColumn("known", F.lit(1)), "symbol", "left").groupBy("file_id")
    return known.agg(F.count("known").alias("script_references"), (F.count("*") - F.count("known")).alias("undefined_references"))


def union_new(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``base`` and those of ``new`` with other keys."""
    return base.unionByName(new.join(base.select(key), key, "left_anti").select(*base.columns))


def common_and_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of ``old`` that ``new`` has too (side: both) or not (side: new)."""
    return old.intersect(new).withColumn("side", F.lit("both")).unionByName(old.subtract(new).withColumn("side", F.lit("new")))


def ordered_distinct(items: Column) -> Column:
    """The distinct items of an array in the order of their first places."""
    return F.array_distinct(items)


def source_chunks(chunks: DataFrame) -> DataFrame:
    """Each place (path, start_line, end_line) once."""
    return chunks.select("path", "start_line", "end_line").dropDuplicates()
