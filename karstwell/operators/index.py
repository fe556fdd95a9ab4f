"""An inverted-file index of vectors: lists around centroids, of which a search reads the nearest few."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.functions import vectors as V
from karstwell.operators.search import page


def build_index(embeddings: DataFrame, path: str, *, lists: int | None = None, sample: int = 100_000, seed: int = 42) -> None:
    """Writes embeddings (chunk_id, embedding, dims, ...) by the list of their nearest centroid, and the centroids.

    The centroids are fitted on about ``sample`` unit vectors chosen by hash;
    every valid vector is indexed. ``lists`` (default: the root of the number of
    vectors) bounds the table of centroids, which is broadcast. One length of
    vectors at a time; invalid vectors are left out. An empty table writes an
    empty index.
    """
    spark = embeddings.sparkSession
    valid = embeddings.where(V.is_valid(F.col("embedding")))
    n = valid.count()
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    points = valid.where(share).select(array_to_vector(V.unit(F.col("embedding").cast("array<double>"))).alias("features"))
    k = max(1, min(lists or math.isqrt(n), points.count()))
    centres = [c.tolist() for c in KMeans(k=k, seed=seed, maxIter=10).fit(points).clusterCenters()] if k > 1 else []
    rows = [(i, c) for i, c in enumerate(centres)] or [(0, [])]
    table = spark.createDataFrame(rows, "list int, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    if centres:
        # the nearest centre in one pass: a literal table of at most ``lists`` rows
        all_ = F.broadcast(table.agg(F.collect_list(F.struct("list", "centre")).alias("cs")))
        near = F.array_min(F.transform("cs", lambda c: F.struct((-V.dot(c["centre"], F.col("u"))).alias("d"), c["list"].alias("list"))))["list"]
        valid = valid.withColumn("u", V.unit(F.col("embedding").cast("array<double>"))).crossJoin(all_).withColumn("list", near).drop("u", "cs")
    else:
        valid = valid.withColumn("list", F.lit(0))
    valid.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    valid.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")  # an empty index has no lists to tell them


def search_index(spark: SparkSession, path: str, vector: list[float], *, size: int, probes: int = 8, offset: int = 0, threshold: float | None = None) -> DataFrame:
    """The nearest rows by cosine among the ``probes`` lists whose centroids are nearest; other lists are not read.

    Columns of the table and similarity, in order, ties to the smaller chunk_id.
    With ``probes`` of at least the number of lists the result is exact.
    """
    centres = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])
    q = np.array(vector, float)
    near = sorted(centres, key=lambda r: (-float(np.dot(r["centre"], q)) if r["centre"] else 0.0, r["list"]))[:probes]
    columns = spark.read.parquet(f"{path}/columns").schema
    rows = spark.read.schema(columns).parquet(f"{path}/lists").where(F.col("list").isin([r["list"] for r in near])).where(F.col("dims") == len(vector))
    rows = rows.withColumn("similarity", V.cosine_literal(F.col("embedding"), [float(x) for x in vector]))
    rows = rows if threshold is None else rows.where(F.col("similarity") >= threshold)
    return page(rows.drop("list"), [F.col("similarity").desc(), F.col("chunk_id")], size, offset)
