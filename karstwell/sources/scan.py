"""Files of a folder as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.functions import paths as P
from karstwell.functions.arrow_text import lift, xxh3_hex
from karstwell.operators import ingest as I
from karstwell.operators.discovery import selected


def scan_files(spark: SparkSession, root: str, *, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = (), content: bool = True) -> DataFrame:
    """path (relative), size, modified_time, language; with ``content`` also content_hash, skip_reason and text.

    Listing is Spark's own and parallel. Literal directories before the first
    wildcard of every include glob are read alone; include, exclude and
    gitignore rules and heavy directories are then expressions on the path, which
    come before any file is opened. Without ``content`` none is.
    """
    root = root.rstrip("/")
    tops = P.include_prefixes(list(include))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/{t}" for t in tops] or root)
    marker = root if "://" in root else root.split(":", 1)[-1]
    df = df.withColumn("path", F.substring_index(F.col("path"), marker + "/", -1))
    df = df.where(selected(F.col("path"), list(include), list(exclude), list(ignore)))
    stat = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_time")]
    if not content:
        return df.select(*stat, I.language(F.col("path")).alias("language"))
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    out = df.select(*stat, "content", head.alias("_head"))
    out = out.withColumn("language", I.language(F.col("path"), F.col("_head")))
    out = out.withColumn("skip_reason", I.skip_reason(F.col("_head"), F.col("language"), F.col("size")))
    out = out.withColumn("content_hash", lift(xxh3_hex, "string")("content"))
    text = F.when(F.col("skip_reason").isNull(), F.decode("content", "UTF-8")).alias("text")
    return out.select("path", "size", "modified_time", "language", "content_hash", "skip_reason", text)
