"""The driver's tables as files, chunks, embeddings and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.operators.ingest import packed_id


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A document is a file ``source/lang/doc_<id>.txt``."""
    d = table(spark, folder, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.md5("text").alias("content_hash"), "text")


def line_chunks(files_: DataFrame) -> DataFrame:
    """A chunk for each line that is not blank; its id holds file and line, so that no order over all rows is needed."""
    lines = files_.select("file_id", "path", "language", F.posexplode(F.split("text", "\n", -1)).alias("at", "code")).where(F.col("code").rlike(r"\S"))
    line = (F.col("at") + 1).alias("start_line")
    kind = F.when(F.col("at") == 0, "namespace").when(F.length("code") > 200, "function").when(F.length("code") > 80, "block").otherwise("comment")
    return lines.select(
        packed_id(F.col("file_id"), F.col("at") + 1).alias("chunk_id"), "file_id", line, line.alias("end_line"), "code", kind.alias("chunk_type"),
        F.regexp_extract("code", r"^\s*(\S+)", 1).alias("symbol"), "path", "language",
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks(files(spark, folder))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.lit("fake").alias("provider"), F.concat(F.lit("model_"), F.col("label").cast("string")).alias("model"), "embedding", F.size("embedding").alias("dims"))


def mutations(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
