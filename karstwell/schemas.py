"""Schemas of the persistent tables and the row rules they keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("file_id", T.LongType(), False), T.StructField("path", T.StringType(), False), T.StructField("name", T.StringType(), False),
    T.StructField("extension", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified_time", T.TimestampType()),
    T.StructField("content_hash", T.StringType()), T.StructField("language", T.StringType()), T.StructField("skip_reason", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])
CHUNKS = T.StructType([
    T.StructField("chunk_id", T.LongType(), False), T.StructField("file_id", T.LongType(), False), T.StructField("chunk_type", T.StringType(), False),
    T.StructField("symbol", T.StringType()), T.StructField("code", T.StringType(), False), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()),
    T.StructField("language", T.StringType()), T.StructField("metadata", T.StringType()),
])
#: One table for all lengths; readers filter on dims, writers partition by it.
EMBEDDINGS = T.StructType([
    T.StructField("embedding_id", T.LongType(), False), T.StructField("chunk_id", T.LongType(), False), T.StructField("provider", T.StringType(), False),
    T.StructField("model", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("dims", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampType()),
])

#: Chunk types that count as code, and as documentation.
CODE_TYPES = ("function", "method", "class", "interface", "struct", "enum", "namespace", "constructor", "property", "field", "type_alias", "closure", "trait", "script", "table", "object", "companion_object", "data_class", "extension_function", "block", "variable", "type", "macro", "import", "embedded_sql", "program", "function_block", "action")
DOCUMENTATION_TYPES = ("comment", "docstring", "header_1", "header_2", "header_3", "header_4", "header_5", "header_6", "paragraph", "code_block")
#: How specific a chunk type is; others have -1.
SPECIFICITY = {"definition": 4, "import": 3, "comment": 2, "structure": 0, "function": 4, "method": 4, "class": 4, "interface": 4, "struct": 4, "enum": 4, "type_alias": 3, "constructor": 3, "variable": 3, "field": 3, "property": 3, "type": 3, "macro": 3, "namespace": 3, "trait": 3, "key_value": 2, "table": 2, "object": 2, "array": 1, "block": 1}


def specificity(chunk_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SPECIFICITY.items() for x in pair])
    return F.coalesce(known[F.lower(chunk_type)], F.lit(-1))


def chunk_faults(start: Column, end: Column, code: Column) -> Column:
    """Why a chunk row is invalid, or null."""
    return (
        F.when(start < 1, "start_line").when(end < 1, "end_line").when(start > end, "order").when(F.coalesce(F.length(code), F.lit(0)) == 0, "code")
    )


def file_faults(path: Column, size: Column, mtime: Column) -> Column:
    """Why a file row is invalid, or null."""
    return F.when(F.coalesce(F.length(path), F.lit(0)) == 0, "path").when(size < 0, "size").when(mtime < 0, "mtime")
