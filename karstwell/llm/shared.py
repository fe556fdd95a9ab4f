"""What the operators share: lineage cuts, rows kept aside, bitmaps, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.sources.storage import cut, shared_dir

__all__ = ["Bitmap", "aside", "components", "cut", "shared_dir", "small_batches", "texts_of", "tidy"]


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id (long) and text (string). Spark bounds the bytes of the Arrow batches that Python reads (64 MB)."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def tidy(spark: SparkSession) -> None:
    """Has Spark delete shuffle files that no plan refers to any more; it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of an Arrow batch of whole texts where a step asks for small ones; Spark's default is meant for narrow rows.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for the jobs that run inside; the session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before or BATCH_ROWS))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def aside(documents: DataFrame, **columns: Column) -> DataFrame:
    """All columns in one struct, ``row``, and ``columns`` beside it, so that no name of the table can clash with a step's own."""
    return documents.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


class Bitmap:
    """A set of 64-bit hashes with two places each, of bounded size; it may hold more than was put in."""

    #: Bits for each key, and at most (32 MB).
    KEY_BITS, MAX_BITS = 16, 1 << 28

    def __init__(self, hashes: DataFrame, count: int):
        """``hashes``: one column of longs; ``count``: about how many."""
        (name,) = hashes.columns
        self.bits = min(self.MAX_BITS, 1 << max(10, (self.KEY_BITS * count).bit_length()))
        low = self.bits - 1
        places = F.explode(F.array(F.col(name).bitwiseAND(F.lit(low)), F.shiftrightunsigned(name, 32).bitwiseAND(F.lit(low))))
        words = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
        found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()  # a row for each 64 bits at most
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For each of some unsigned 64-bit hashes whether it is (or seems) in the set."""
        out = np.ones(len(hashes), bool)
        for place in (hashes, hashes >> np.uint64(32)):
            place = place & np.uint64(self.bits - 1)
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every id that has a link.

    ``edges``: a, b (long). Returns id, component. Alternating large-star and
    small-star steps; each round is a partial aggregation (the minimum of a
    node's neighbours) and a sort-merge join that AQE can split, so a hub with
    any number of links is never gathered in one task. Rows with a null or a
    self link are ignored; no edges give an empty result.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = cut(small)
        state, before = _state(edges), state
        if state == before:
            break
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Two sums over the edges that stay only when the edges do."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(row[0]), row[1]
