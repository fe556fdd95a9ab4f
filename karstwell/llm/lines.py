"""Line deduplication by overlapping windows of consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstwell.llm.shared import aside


def _covered(starts: Column, window: int) -> Column:
    """The lines of windows that start at ``starts``."""
    return F.flatten(F.transform(starts, lambda p: F.sequence(p, p + window - 1)))


def dedup_lines(documents: DataFrame, *, window: int = 3) -> DataFrame:
    """Removes later occurrences of repeated windows of ``window`` consecutive lines.

    ``documents``: doc_id, text; other columns are passed through, whatever
    their names, but for n_lines and n_removed, which are replaced. Lines end at
    \\n and are compared unchanged. Windows overlap: a document of n lines has
    n - ``window`` + 1. The first occurrence of a window has the smallest
    doc_id, then position. A line goes if it is covered by a later occurrence
    whose first occurrence is in another document. Inside a document, a line
    goes if a later occurrence covers it and no first occurrence does.

    Returns the input's columns with the lines left in text, n_lines (before)
    and n_removed.

    Null text stays null; null or empty text has n_lines 0. Fewer lines than a
    window, and windows without any character but white space: nothing goes.
    Null doc_id sorts last. Rows with the same doc_id and text are one document
    (both are changed alike); the same doc_id with other texts: each has its own
    windows, ordered by a hash of the text. All lines may go: text is then empty.
    An empty table gives an empty result.

    The windows are shuffled as 128-bit digests; the minimum is aggregated before
    the shuffle, and AQE can split the joins, so a window that a third of all
    documents share meets in no single task.
    """
    kept_columns = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    # the text is in the row alone, so that it is shuffled once
    keyed = aside(documents, doc_id=F.col("doc_id"), key=F.xxhash64("doc_id", "text"))
    text = F.col("row")["text"].cast("string")
    lines = F.split(text, "\n", -1)
    at = F.sequence(F.lit(0), F.size("lines") - window)
    joined = F.transform(at, lambda i: F.array_join(F.slice("lines", i + 1, window), "\n"))
    split = keyed.select("doc_id", "key", lines.alias("lines")).where(F.size("lines") >= window)
    windows = split.select("doc_id", "key", F.posexplode(joined).alias("pos", "w")).where(F.col("w").rlike(r"\S"))
    windows = windows.select("doc_id", "key", "pos", F.unhex(F.md5("w")).alias("w"))
    # structs compare nulls first, so the null flag leads
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "pos")
    repeated = windows.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    is_first = place == F.col("first")
    inside = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    kind = F.when(is_first, F.lit("first")).when(inside, F.lit("inside")).otherwise(F.lit("outside"))
    found = windows.join(repeated, "w").select("doc_id", "key", "pos", kind.alias("kind"))
    starts = {k: _covered(F.collect_set(F.when(F.col("kind") == k, F.col("pos"))), window) for k in ("first", "inside", "outside")}
    gone = F.array_union(starts["outside"], F.array_except(starts["inside"], starts["first"]))
    covered = found.groupBy("doc_id", "key").agg(gone.alias("gone")).where(F.size("gone") > 0)
    covered = covered.select(F.col("doc_id").alias("other_id"), F.col("key").alias("other_key"), "gone")

    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("key") == F.col("other_key"))
    out = keyed.join(covered, same, "left").withColumn("lines", lines)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.element_at("lines", i + 1))
    n_lines = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size("lines")).cast("long")
    text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in kept_columns]
    return out.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
