"""Snapshots of the stored tables: each operation gives the next one from the last and what is new."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows by key; new rows replace stored ones. Keys are unique in ``new``."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def patch(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where they are not null."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return stored.join(n, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def with_ids(rows: DataFrame, order: list[str], by: str) -> DataFrame:
    """Consecutive ids within each ``by``, above its own range; no order over all rows is needed."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("chunk_id", packed_id(F.col(by), n))


def upsert_embeddings(stored: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """The newest row of each (chunk_id, provider, model); a vector of another length than ``dims`` is an error."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("mixed lengths")).cast("array<float>")))
    both = stored.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("chunk_id", "provider", "model").orderBy(F.col("_new").desc()))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def delete_files(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files, their chunks and those chunks' embeddings."""
    gone = files.join(paths.select("path"), "path", "left_semi").select("file_id")
    gone_chunks = chunks.join(gone, "file_id", "left_semi").select("chunk_id")
    return files.join(gone, "file_id", "left_anti"), chunks.join(gone, "file_id", "left_anti"), embeddings.join(gone_chunks, "chunk_id", "left_anti")


#: Chunk ids hold the file above this many bits for the place in it.
PLACE_BITS = 24
_TABLES = ("files", "chunks", "embeddings")


def packed_id(file_id: Column, place: Column) -> Column:
    """An id of file and place; an error where either does not fit."""
    fits = (place >= 0) & (place < 1 << PLACE_BITS) & (file_id >= 0) & (file_id < 1 << (63 - PLACE_BITS))
    return F.when(fits | file_id.isNull() | place.isNull(), F.shiftleft(file_id, PLACE_BITS) + place).otherwise(F.raise_error(F.lit("file or place out of range for an id")).cast("long"))


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder that the store's pointer names; None before the first write."""
    place, fs = _path(spark, f"{root}/current")
    if not fs.exists(place):
        return None
    return spark.read.text(f"{root}/current").first()[0].strip()


def read_store(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, chunks and embeddings of one version: what the last finished transaction wrote."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no store at {root}")
    return tuple(spark.read.parquet(f"{root}/{version}/{t}") for t in _TABLES)


def write_store(root: str, files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> str:
    """Writes the three tables as a new version, then points to it; returns its name.

    The pointer is one small file that is replaced in one step, so readers see
    all tables of the old version or all of the new one, and a crash before that
    step leaves the old one. The version before stays for readers that hold it;
    older ones are deleted.
    """
    spark = files.sparkSession
    before, version = current_version(spark, root), f"v-{uuid.uuid4().hex}"
    for name, df in zip(_TABLES, (files, chunks, embeddings), strict=True):
        out = df.write.partitionBy("dims") if name == "embeddings" and "dims" in df.columns else df.write
        out.parquet(f"{root}/{version}/{name}")
    target, fs = _path(spark, f"{root}/current")
    staged, _ = _path(spark, f"{root}/current.{version}")
    stream = fs.create(staged, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    replace[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(staged, target, replace)
    top, _ = _path(spark, root)
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)
    return version


def write_batch(root: str, files: DataFrame, chunks: DataFrame, embeddings: DataFrame, *, new_files: DataFrame, new_chunks: DataFrame, new_embeddings: DataFrame, deleted: DataFrame) -> str:
    """One writer transaction: deletions, then files with all their chunks, then embeddings, as one new version of the store."""
    f, c, e = delete_files(files, chunks, embeddings, deleted.select("path").union(new_files.select("path")).distinct())
    return write_store(root, f.unionByName(new_files), c.unionByName(new_chunks), e.unionByName(new_embeddings))


def skip_reason(head: Column, language: Column, size: Column, threshold: int = 20_000) -> Column:
    """Why a file is not parsed: binary (a NUL in its first 8 KiB), no language, or a large structured file."""
    return F.when(F.instr(F.substring(head, 1, 8192), "\0") > 0, "binary").when(language.isNull() | (language == "unknown"), "unsupported").when(language.isin("json", "yaml", "toml") & (size > threshold), "large_config")


#: Languages by extension and by whole name.
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "java": "java", "cs": "csharp", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "rb": "ruby", "php": "php", "lua": "lua", "sh": "bash", "sql": "sql", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "scss": "scss", "vue": "vue", "svelte": "svelte", "txt": "text", "m": "matlab", "hs": "haskell", "zig": "zig", "dart": "dart", "ex": "elixir", "groovy": "groovy", "tf": "hcl", "ps1": "powershell", "pdf": "pdf"}
NAMES = {"makefile": "makefile", "gnumakefile": "makefile", "dockerfile": "text", "readme": "text"}


def language(path: Column, content: Column | None = None) -> Column:
    """By whole name, then extension; ``.m`` files are Objective-C if their first 1,024 characters look like it."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    pairs = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    found = F.coalesce(pairs(NAMES)[name], pairs(EXTENSIONS)[F.regexp_extract(name, r"\.([^.]+)$", 1)], F.lit("unknown"))
    if content is None:
        return found
    objc = F.substring(content, 1, 1024).rlike(r"@(interface|implementation|protocol|property|import|class)\b|#import\b")
    return F.when((found == "matlab") & objc, "objc").otherwise(found)


HUNK = re.compile(r"@@ -[0-9]+(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@")
_HEADER = ("diff --git ", "index ", "new file", "deleted file", "similarity", "rename ")


#: Characters of a hunk's code; longer ones are split between lines.
HUNK_CHARS = 10_000
#: Characters of code that are sent on together, about.
_SENT_CHARS = 1 << 24


def _hunks(diff: str) -> Iterator[tuple[str | None, int, int, list[str]]]:
    """path, hunk, first line and the context and added lines of each hunk that adds some.

    ``--- `` and ``+++ `` lines are a header only as a pair: alone they are a line taken out or added. A pair belongs to
    a hunk that by its own counts lacks lines of both kinds.
    """
    lines = diff.split("\n")
    path, hunk, begin, body, added, old, new = None, 0, 0, None, False, 0, 0

    def done() -> list:
        return [(path, hunk, begin, body)] if body is not None and added and path is not None and path != "/dev/null" else []

    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        start = HUNK.match(line)
        pair = line.startswith("--- ") and after.startswith("+++ ") and (body is None or old < 1 or new < 1)
        if start or pair or line.startswith(_HEADER):
            yield from done()
            body, added = [] if start else None, False
            if start:
                hunk, begin = hunk + 1, int(start[2])
                old, new = (1 if n is None else int(n) for n in (start[1], start[3]))
        elif body is None:
            if line.startswith("+++ "):
                path = line[4:].removeprefix("b/")
        elif line[:1] in (" ", "+"):
            body.append(line[1:])
            added = added or line[0] == "+"
            old, new = old - (line[0] == " "), new - 1
        elif line[:1] == "-":
            old -= 1
    yield from done()


def _hunk_parts(lines: list[str], begin: int, most: int | None) -> Iterator[tuple[int, int, str]]:
    """First line, last line and code of parts of at most ``most`` characters, or of one line."""
    part: list[str] = []
    size = 0
    for line in lines:
        if most is not None and part and size + len(line) > most:
            yield begin, begin + len(part) - 1, "\n".join(part)
            begin, part, size = begin + len(part), [], 0
        part.append(line)
        size += len(line) + 1
    yield begin, begin + len(part) - 1, "\n".join(part)


def diff_hunks(diffs: DataFrame, *, most: int | None = HUNK_CHARS) -> DataFrame:
    """Hunks of unified diffs as chunks: diff_id, path, hunk, start_line, end_line, code (context and added lines).

    ``diffs``: diff_id (of any type), diff. Each row is a diff of its own, also where ids repeat; deleted files, hunks
    without new lines and null diffs give nothing. A hunk of over ``most`` characters becomes several rows, whose lines
    go on counting; None: every hunk is one row.
    """
    schema = StructType([diffs.schema["diff_id"], *StructType.fromDDL("path string, hunk int, start_line int, end_line int, code string")])
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows, size = batch.column(0), [], [], 0

            def sent(at: list, rows: list, ids: pa.Array = ids) -> pa.RecordBatch:
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], names=schema.names)

            for i, diff in enumerate(batch.column(1)):
                for path, hunk, begin, lines in _hunks(diff.as_py() or ""):
                    for part in _hunk_parts(lines, begin, most):
                        at.append(i)
                        rows.append((path, hunk, *part))
                        size += len(part[2])
                    if size > _SENT_CHARS:
                        yield sent(at, rows)
                        at, rows, size = [], [], 0
            yield sent(at, rows)

    return diffs.select("diff_id", "diff").mapInArrow(run, schema)


def commit_range(*, commit: str | None = None, last: int | None = None, range_: str | None = None) -> str | None:
    """The range of one selector; more than one is an error."""
    given = [x for x in (commit, last, range_) if x is not None]
    if len(given) > 1:
        raise ValueError("commit, last and range exclude each other")
    if commit is not None:
        return f"{commit}^..{commit}"
    return f"HEAD~{last}..HEAD" if last is not None else range_


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
