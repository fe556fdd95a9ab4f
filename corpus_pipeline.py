"""A training-corpus pipeline over the table documents: toxicity, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstwell.llm.lines import dedup_lines
from karstwell.llm.mixing import mix_sources
from karstwell.llm.neardup import drop_near_duplicates
from karstwell.llm.packing import pack_documents
from karstwell.llm.queries import held_out
from karstwell.llm.shared import shared_dir
from karstwell.llm.toxicity import drop_toxic
from karstwell.sources.storage import remove


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, unchanged.

    Null and empty texts score by the model's bias, and stay unless most labelled
    documents are toxic. Rows with null doc_id are scored like any other; equal
    texts stay or go together. No labels: all stay. Empty tables stay empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, labels, learn=~held_out(), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows. A document that had lines and lost all of them goes.

    Other columns stay as they are, whatever their names; n_chars follows the
    text where that changed. Null and empty texts stay. Rows with equal doc_id
    and text are one document: no window of one is later than that of the other.
    Rows with null doc_id count as the last. An empty table stays empty.
    """
    done = dedup_lines(_kept(docs, "doc_id", "text"))
    done = done.where("n_removed = 0 or n_removed < n_lines")
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        value = F.col("text") if c.lower() == "text" else F.col("row")[c]
        if c.lower() == "n_chars":
            value = F.when(changed, F.length("text")).otherwise(value)
        columns.append(value.cast(docs.schema[c].dataType).alias(c))
    return done.select(*columns)


def _kept(docs: DataFrame, *names: str) -> DataFrame:
    """What a stage reads, and all other columns in the struct ``row``; a text is not carried twice."""
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    return docs.select(F.struct(*others).alias("row"), *names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id (five-word shingles, similarity 0.8).

    Rows are documents: of rows with one doc_id all stay whose texts differ by
    more than that. Of rows with equal doc_id and text one stays. Texts without
    words and rows with null doc_id stay. Columns and texts are unchanged. An
    empty table stays empty.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that is taken n times is n rows, with unchanged columns.

    Texts without words are taken with the others of their source. A null source
    is a source. Rows with the same doc_id (also null) are taken alike. An empty
    table stays empty.
    """
    mixed = mix_sources(_kept(docs, "doc_id", "text", "source")).where("repeats > 0")
    copies = mixed.select("row", "text", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    return copies.select(*[F.col("text") if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are one token, the end id. Rows with null or equal
    doc_id are documents of their own. Ties in length go in the order in which
    a task reads them. An empty table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and a tokenizer cannot be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written to the shared folder and read by the next.

    A stage's table is deleted once the next one is written. That of the last
    stage but one is what the result reads, and stays.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
