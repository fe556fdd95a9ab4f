"""Chunking: native metrics and line grouping; order-dependent folds as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karstwell.functions import text as X

MAX_CHARS, MIN_CHARS, MAX_TOKENS, MERGE_SHARE = 1200, 50, 6000, 0.8
#: Characters in which an emergency split looks for a separator, and the separators in order of preference.
SEARCH_WINDOW, SEPARATORS = 18_000, ("\n", ";", "}", "{", ",", " ")


# -- native ------------------------------------------------------------------------------------------------------------


def non_whitespace(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\s", ""))


def line_count(x: Column) -> Column:
    return F.size(F.split(x, "\n", -1))


def metrics(x: Column) -> list[Column]:
    return [non_whitespace(x).alias("non_whitespace_chars"), F.length(x).alias("total_chars"), line_count(x).alias("lines"), X.chunk_tokens(x).alias("tokens")]


def needs_split(x: Column) -> Column:
    return (non_whitespace(x) > MAX_CHARS) | (X.chunk_tokens(x) > MAX_TOKENS)


def has_long_lines(x: Column) -> Column:
    return F.array_max(F.transform(F.split(x, "\n", -1), lambda l: F.length(l))) > 0.2 * MAX_CHARS


def end_line(start: Column, x: Column) -> Column:
    return F.greatest(start, start + line_count(x) - 1)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))


def paragraphs(files: DataFrame, *, least: int = MIN_CHARS) -> DataFrame:
    """Maximal runs of non-blank lines with at least ``least`` characters that aren't white space.

    Blank lines so far number the run; both steps partition by file.
    """
    filled = F.col("line").rlike(r"\S")
    run = F.sum(F.when(filled, 0).otherwise(1)).over(Window.partitionBy("file_id").orderBy("at"))
    rows = _lines(files).withColumn("run", run).where(filled)
    parts = rows.groupBy("file_id", "run").agg((F.min("at") + 1).alias("start_line"), (F.max("at") + 1).alias("end_line"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    content = F.array_join(F.transform("ls", lambda s: s["line"]), "\n")
    parts = parts.select("file_id", F.concat(F.lit("paragraph_"), F.col("start_line").cast("string")).alias("name"), "start_line", "end_line", content.alias("content"))
    return parts.where(non_whitespace(F.col("content")) >= least)


def simple_paragraphs(files: DataFrame) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), X.strip), lambda p: F.length(p) > 0)
    return files.select("file_id", F.posexplode(parts).alias("at", "paragraph")).select("file_id", (F.col("at") + 1).alias("ordinal"), "paragraph")


def embedding_text(path: Column, language: Column, code: Column, *, target: Column | None = None, constants: Column | None = None) -> Column:
    """A header line before the code: path and language, a link target, the first five constants and how many more."""
    parts = [F.concat(F.lit("# "), path, F.lit(" ("), language, F.lit(")"))]
    if target is not None:
        parts.append(F.when(target.isNotNull(), F.concat(F.lit("[target: "), target, F.lit("]"))))
    if constants is not None:
        more = F.when(F.size(constants) > 5, F.concat(F.lit(", +"), (F.size(constants) - 5).cast("string"), F.lit(" more"))).otherwise("")
        parts.append(F.when(F.size(constants) > 0, F.concat(F.lit("["), F.array_join(F.slice(constants, 1, 5), ", "), more, F.lit("]"))))
    return F.concat(F.concat_ws(" ", *parts), F.lit("\n"), code)


def _gap(x: Column) -> Column:
    """What stands between the first SELECT and the first FROM, or null if that is not behind it."""
    head = F.regexp_extract(x, r"(?s)^(.*?)\bSELECT\b", 1)
    return F.when(x.rlike(r"\bSELECT\b") & x.rlike(r"\bFROM\b") & ~head.rlike(r"\bFROM\b"), X.strip(F.regexp_extract(x, r"(?s)\bSELECT\b(.*?)\bFROM\b", 1)))


#: Clauses of SQL with their points; the first two also occur in prose and count as weak.
SQL_CLAUSES = ((r"\bFROM\s+\w+", 25), (r"\bWHERE\s+\w+", 20), (r"\bJOIN\s+\w+", 20), (r"\bSET\s+\w+\s*=", 20), (r"\bORDER\s+BY\b", 20), (r"\bGROUP\s+BY\b", 20), (r"\bINTO\s+\w+", 20), (r"\bVALUES\s*\(", 10), (r"\bTABLE\s+", 20), (r"\bPRIMARY\s+KEY\b", 10), (r"\bFOREIGN\s+KEY\b", 10))
SQL_DDL = r"\b(CREATE|ALTER|DROP)\s+(TABLE|VIEW|INDEX|FUNCTION|TRIGGER|PROCEDURE|SCHEMA|SEQUENCE)\b"
SQL_DML = r"\bDELETE\s+FROM\b|\bUPDATE\s+\S+\s+SET\b|\bINSERT\s+INTO\b"


def sql_confidence(text: Column) -> Column:
    """How much a string looks like SQL, 0 to 1; without a verb 0. Weak signs alone count half."""
    x = F.upper(text)
    weak_points, strong, points = F.lit(0), F.lit(False), F.lit(30)
    for word in ("HAVING", "LIMIT", "OFFSET"):
        points = points + F.when(x.rlike(rf"\b{word}\b"), 10).otherwise(0)
    for i, (pattern, value) in enumerate(SQL_CLAUSES):
        hit = x.rlike(pattern)
        points = points + F.when(hit, value).otherwise(0)
        if i < 2:
            weak_points = weak_points + F.when(hit, value).otherwise(0)
        else:
            strong = strong | hit
    gap = _gap(x)
    structural = F.coalesce(gap.rlike(r"[^A-Z\s]"), F.lit(False))
    few = F.coalesce((F.length(gap) > 0) & ~gap.rlike(r"[^A-Z\s]") & (F.size(F.split(gap, r"\s+")) <= 2), F.lit(False))
    points = points + F.when(x.rlike(SQL_DDL), 20).otherwise(0) + F.when(structural | few, 10).otherwise(0) + F.when(x.rlike(SQL_DML), 10).otherwise(0)
    weak_points = weak_points + F.when(few, 10).otherwise(0)
    strong = strong | structural | x.rlike(SQL_DDL) | x.rlike(SQL_DML)
    points = points - F.when(~strong, F.floor(weak_points / 2)).otherwise(0)
    return F.when(x.rlike(r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b"), F.least(F.lit(1.0), points / 100)).otherwise(0.0)


def sql_concept(text: Column) -> Column:
    """definition for DDL, block for other SQL, null below a confidence of 0.6 or 15 characters."""
    x = F.upper(text)
    return F.when((sql_confidence(text) >= 0.6) & (F.length(text) >= 15), F.when(x.rlike(r"\b(CREATE|ALTER|DROP)\b"), "definition").otherwise("block"))


def text_metadata(x: Column) -> list[Column]:
    n = lambda p: F.regexp_count(x, F.lit(p))
    return [
        line_count(x).alias("line_count"), n(r"\S+").alias("word_count"), F.length(x).alias("char_count"), n(r"(?m)^#{1,6}[ \t]+\S.*$").alias("headings"),
        n(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\S").alias("list_items"), n(r"\b(?:TODO|FIXME|NOTE|HACK|XXX|BUG)\b").alias("annotations"), n(r'https?://[^\s<>"]+').alias("urls"),
    ]


def markdown_lines(files: DataFrame) -> DataFrame:
    """The kind of each line: code inside fences (their number so far is odd), header_n, list, table, paragraph, blank."""
    fence = F.col("line").startswith("```")
    fences = F.sum(fence.cast("int")).over(Window.partitionBy("file_id").orderBy("at"))
    rows = _lines(files).withColumn("fences", fences)
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]", 1))
    kind = (
        F.when((F.col("fences") % 2 == 1) | fence, "code").when(marks > 0, F.concat(F.lit("header_"), marks.cast("string")))
        .when(F.col("line").rlike(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]"), "list").when(F.col("line").rlike(r"^[ \t]*\|"), "table").when(F.col("line").rlike(r"\S"), "paragraph").otherwise("blank")
    )
    return rows.select("file_id", (F.col("at") + 1).alias("line"), kind.alias("kind"))


def summaries(chunks: DataFrame, limit: int, length: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line"))
    line = F.concat(F.lit("- "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), F.substring("code", 1, length))
    rows = chunks.withColumn("n", n).where(F.col("n") <= limit).select("file_id", F.struct("start_line", line.alias("line")).alias("s"))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("summary"))


def points_of_interest(files: DataFrame, limit: int) -> DataFrame:
    """Distinct items of bullet and numbered lists in order, ``limit`` for each file. Lines end at line feeds only; an item loses the spaces of any kind around it."""
    point = F.regexp_replace(F.regexp_extract("line", r"(?s)^\s*(?:[-*] |\d[^.]*\.|\d[^)]*\))(.*)\z", 1), r"^\p{Zs}+|\p{Zs}+\z", "")
    first = _lines(files).where(F.col("line").rlike(r"\S")).select("file_id", "at", point.alias("point")).where(F.length("point") > 0).groupBy("file_id", "point").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("at"))
    return first.withColumn("ordinal", n.cast("long")).where(F.col("ordinal") <= limit).select("file_id", "ordinal", "point")


def with_operational_point(points: Column, has_one: Column, point: str, limit: int) -> Column:
    return F.when(has_one, points).otherwise(F.slice(F.array_prepend(points, F.lit(point)), 1, limit))


def render(chunks: DataFrame) -> DataFrame:
    marks = X.fence(F.col("code"))
    head = F.concat(F.lit("### "), F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return chunks.select("chunk_id", F.concat(head, F.lit("\n"), marks, F.col("language"), F.lit("\n"), F.col("code"), F.lit("\n"), marks).alias("markdown"))


# -- folds -------------------------------------------------------------------------------------------------------------

PIECE = "file_id long, name string, concept string, content string, start_line int, end_line int"


def fits(text: str, share: float = 1.0) -> bool:
    if len(text) <= MAX_CHARS * share:
        return True
    return len(text) // 3 <= MAX_TOKENS * share and len("".join(text.split())) <= MAX_CHARS * share


def split_chunk(name: str, text: str, start: int, end: int) -> list[tuple[str, str, int, int]]:
    """(name, content, start_line, end_line) pieces that fit: halves by lines, or cuts at separators."""
    if fits(text):
        return [(name, text, start, end)]
    lines = text.split("\n")
    if len(lines) > 2 and end - start >= 2 and max(map(len, lines)) <= 0.2 * MAX_CHARS:
        half = len(lines) // 2
        first_end = max(start, min(start + half - 1, end))
        second = max(first_end + 1, min(first_end + 1, end))
        if second < end:
            return split_chunk(f"{name}_part1", "\n".join(lines[:half]), start, first_end) + split_chunk(f"{name}_part2", "\n".join(lines[half:]), second, end)
    return _cut(name, text, start, end)


def _cut(name: str, text: str, start: int, end: int) -> list[tuple[str, str, int, int]]:
    out, at, span = [], 0, end - start + 1
    ink = [0, *accumulate(not c.isspace() for c in text)]  # so that each test is two look-ups

    def fit(size: int) -> bool:
        return ink[at + size] - ink[at] <= MAX_CHARS and size // 3 <= MAX_TOKENS

    while at < len(text):
        left = len(text) - at
        size = left
        if not fit(left):
            window = min(SEARCH_WINDOW, left)
            # a separator at the very start is no place to cut
            places = (text.rfind(s, at, at + window) - at for s in SEPARATORS)
            size = next((p + 1 for p in places if p > 0 and fit(p + 1)), 0)
            if not size:
                size = window
                while not fit(size) and size > MIN_CHARS:
                    size //= 2
        first = min(end, start + int(at / len(text) * span))
        last = max(first, min(end, start + int(at / len(text) * span) + max(1, int(size / len(text) * span)) - 1))
        out.append((f"{name}_part{len(out) + 1}", text[at : at + size], first, last))
        at += size
    return out


def split_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that are too large in pieces; others unchanged. Columns: those of ``PIECE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["file_id"], n, r["concept"], c, s, e) for n, c, s, e in split_chunk(r["name"], r["content"], r["start_line"], r["end_line"])]
            yield _pieces(rows)

    return chunks.select("file_id", "name", "concept", "content", "start_line", "end_line").mapInArrow(run, PIECE)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file_id", "name", "concept", "content", "start_line", "end_line"])


#: Concepts that may be merged, first and second.
COMPATIBLE = {("COMMENT", "DEFINITION"), ("DEFINITION", "COMMENT"), ("BLOCK", "COMMENT"), ("COMMENT", "BLOCK"), ("DEFINITION", "STRUCTURE"), ("STRUCTURE", "DEFINITION")}
_RANK = {"DEFINITION": 4, "IMPORT": 3, "COMMENT": 2, "BLOCK": 1, "STRUCTURE": 0}


def _joined(parts: list[tuple]) -> str:
    text = parts[0][1]
    for p in parts[1:]:
        if p[1].strip() not in text:
            text += "\n" + p[1]
    return text


def _grouped(rows: list[tuple], together) -> list[tuple]:
    """Runs of rows (name, content, start, end, concept) that ``together(run, row)`` keeps, each as one if it fits."""
    out, run = [], []
    for r in rows:
        if run and not together(run, r):
            out += _merge(run)
            run = []
        run.append(r)
    return out + _merge(run)


def _merge(run: list[tuple]) -> list[tuple]:
    if len(run) < 2:
        return run
    text = _joined(run)
    if not fits(text):
        return run
    return [("_".join(dict.fromkeys(r[0] for r in run)), text, run[0][2], run[-1][3], run[0][4])]


def chunk_file(rows: list[tuple]) -> list[tuple]:
    """The chunks of one file from its parsed (name, content, start, end, concept) rows.

    Blocks merge while they stay under 80 % of the limits and five lines apart,
    comments while they touch; everything is split to fit; then neighbours merge
    greedily if they fit, are not nested, and are compatible.
    """
    out = []
    for concept in dict.fromkeys(r[4] for r in rows):
        own = sorted((r for r in rows if r[4] == concept), key=lambda r: r[2])
        if concept == "BLOCK":
            own = _grouped(own, lambda run, r: fits("\n".join(x[1] for x in run) + "\n" + r[1], MERGE_SHARE) and r[2] - run[-1][3] <= 5)
        elif concept == "COMMENT":
            own = _grouped(own, lambda run, r: r[2] - run[-1][3] <= 1)
        for name, text, start, end, _ in own:
            out += [(*p, concept) for p in split_chunk(name, text, start, end)]
    return merge_greedily(out)


def merge_greedily(rows: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for r in sorted(rows, key=lambda r: r[2]):
        last = out[-1] if out else None
        if last is None or not _may_merge(last, r):
            out.append(r)
            continue
        new = r[1].strip() not in last[1]
        head = r if _RANK.get(r[4], -1) > _RANK.get(last[4], -1) else last
        out[-1] = (head[0], last[1] + "\n" + r[1] if new else last[1], last[2], r[3] if new else last[3], head[4])
    return out


def _may_merge(a: tuple, b: tuple) -> bool:
    same = a[4] == b[4]
    if not same and (a[4], b[4]) not in COMPATIBLE:
        return False
    if a[2] < b[2] and b[3] <= a[3]:  # nested
        return False
    gap = 1 if not same and "COMMENT" in (a[4], b[4]) else 5
    text = a[1] if b[1].strip() in a[1] else a[1] + "\n" + b[1]
    return b[2] - a[3] <= gap and fits(text)


def chunk_files(parsed: DataFrame) -> DataFrame:
    """``chunk_file`` for each file_id. The group is one file, which is bounded by what a parser accepts."""

    def run(table: pa.Table) -> pa.Table:
        file = table.column("file_id")[0].as_py() if table.num_rows else None
        rows = [(r["name"], r["content"], r["start_line"], r["end_line"], r["concept"]) for r in table.to_pylist()]
        return pa.Table.from_batches([_pieces([(file, n, k, c, s, e) for n, c, s, e, k in chunk_file(sorted(rows, key=lambda r: (r[2], r[3], r[0])))])])

    return parsed.select("file_id", "name", "concept", "content", "start_line", "end_line").groupBy("file_id").applyInArrow(run, PIECE)


def token_batches(rows: DataFrame, *, by: str, order: str, max_tokens: int, max_rows: int) -> DataFrame:
    """Numbers batches of each ``by``: in order, a batch closes before it would pass ``max_tokens`` or ``max_rows``.

    A row over the limit is a batch of its own. One pass over sorted rows; only
    the running totals of the current group are held.
    """
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, tokens, n = object(), 0, 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(by).to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if k != key:
                    key, number, tokens, n = k, 0, 0, 0
                if n and (tokens + t > max_tokens or n >= max_rows):
                    number, tokens, n = number + 1, 0, 0
                tokens, n = tokens + t, n + 1
                out.append(number)
            yield batch.append_column("batch", pa.array(out, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", batch int"
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


#: Kinds of chunks that are whole definitions, and endings of files whose blocks are indented or in braces.
WHOLE_KINDS = ("function", "method", "class", "interface", "struct", "enum", "program", "function_block", "action", "property")
INDENTED = (".py", ".pyw")
BRACED = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".rs", ".go", ".java", ".js", ".ts", ".tsx", ".jsx", ".cs", ".swift", ".kt", ".scala")
#: Lines that are looked through on each side, of a chunk at most, and around a whole definition.
REACH, MOST_LINES, AROUND = 200, 300, 3


class Boundaries:
    """Look-ups on the lines of one file, made once for all its chunks. Lines count from 0 here."""

    def __init__(self, text: str, path: str):
        self.lines = text.split("\n")
        self.n = len(self.lines)
        lower = path.lower()
        self.style = "indent" if lower.endswith(INDENTED) else "braces" if lower.endswith(BRACED) else ""
        at = np.arange(self.n)
        latest = lambda hit: np.maximum.accumulate(np.where(hit, at, -1))
        if self.style == "indent":
            self.indent = np.array([len(x) - len(x.lstrip()) for x in self.lines])
            self.filled = np.array([bool(x.strip()) for x in self.lines])
            self.head = latest(np.array([bool(re.match(r"\s*(async def|def|class) ", x)) for x in self.lines]))
            # a paragraph ends at a blank line before a filled one
            self.gap = latest(~self.filled & np.append(self.filled[1:], False))
        elif self.style == "braces":
            opens, closes = (np.array([x.count(c) for x in self.lines]) for c in "{}")
            self.opens, self.closes = opens > 0, closes > 0
            self.depth = np.concatenate([[0], np.cumsum(opens - closes)])  # before each line, and at the end
            left, right = (np.array([c in x for x in self.lines]) for c in "()")
            before = np.concatenate([[-1], latest(left)[:-1]])
            self.signature = np.where(left & right & (at > np.maximum(0, at - 10)), at, np.where(before > np.maximum(0, at - 10), before, -1))

    def span(self, first: int, last: int) -> tuple[int, int]:
        """First and last line of the definition around some lines."""
        top, bottom = first, last
        low, high = max(0, first - REACH) + 1, min(self.n, last + REACH)
        if self.style == "indent":
            if first and self.head[first - 1] >= max(low, self.gap[first - 1] + 1):
                top = int(self.head[first - 1])
            below = slice(last + 1, high)
            ends = np.flatnonzero(self.filled[below] & (self.indent[below] <= self.indent[top]))
            bottom = last + int(ends[0]) if len(ends) else min(self.n - 1, last + 50)
        elif self.style == "braces":
            above = slice(low, first + 1)
            own = self.signature[above]
            outer = np.flatnonzero(self.opens[above] & (self.depth[above] > self.depth[first + 1]) & (own >= 0) & (own != first))
            top = int(own[outer[-1]]) if len(outer) else first
            below = slice(top + 1, max(top + 1, high))
            ends = np.flatnonzero(self.closes[below] & (self.depth[below.start + 1 : below.stop + 1] == self.depth[top]))
            bottom = top + 1 + int(ends[0]) if len(ends) else last
        return top, min(bottom, top + MOST_LINES)

    def widened(self, start: int, end: int, kind: str) -> tuple[int, int]:
        """A chunk's lines (from 1) widened to the definition around it; (0, 0) for lines that aren't there."""
        if not 1 <= start <= end <= self.n:
            return 0, 0
        if kind in WHOLE_KINDS:
            return max(1, start - AROUND), min(self.n, end + AROUND)
        top, bottom = self.span(start - 1, end - 1)
        return top + 1, bottom + 1


def expand_boundaries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Adds from_line and to_line: each chunk's lines, widened to the definition around them.

    Whole definitions get three lines on both sides. Others reach up to the
    head of their paragraph's definition and down to the next line that is
    indented no deeper (Python), or over the braces around them; 200 lines are
    looked through on each side, and 300 is the most.

    ``files`` (file_id, text): each text meets its chunks once, and its look-ups
    are made once. Chunks of files that aren't there get (0, 0).
    """

    def run(own: pa.Table, texts: pa.Table) -> pa.Table:
        text = texts.column("text")[0].as_py() if texts.num_rows else None
        found, known = [], {}
        for r in own.select(["start_line", "end_line", "chunk_type", "path"]).to_pylist():
            if text is None:
                found.append((0, 0))
                continue
            path = r["path"] or ""
            if path not in known:
                known[path] = Boundaries(text, path)
            found.append(known[path].widened(r["start_line"], r["end_line"], r["chunk_type"]))
        return pa.table({"chunk_id": own.column("chunk_id").cast(pa.int64()), "from_line": pa.array([a for a, _ in found], pa.int32()), "to_line": pa.array([b for _, b in found], pa.int32())})

    own = chunks.select("chunk_id", "file_id", "start_line", "end_line", "chunk_type", "path").groupBy("file_id")
    texts = files.select(F.col("file_id").alias("id"), "text").groupBy("id")
    return own.cogroup(texts).applyInArrow(run, "chunk_id long, from_line int, to_line int")


def best_batch_size(results: DataFrame, *, gain: float = 0.15, default: int = 100) -> DataFrame:
    """One row, batch_size: by ascending size, the last that improves throughput by over ``gain``; stops at the first that doesn't."""
    steps = F.array_sort(F.collect_list(F.struct("batch_size", "throughput")))
    fold = F.aggregate(
        F.slice(F.col("steps"), 2, F.size("steps")),
        F.struct(F.col("steps")[0]["batch_size"].alias("size"), F.col("steps")[0]["throughput"].alias("best"), F.lit(False).alias("stop")),
        lambda a, x: F.when(a["stop"], a).when(x["throughput"] > a["best"] * (1 + gain), F.struct(x["batch_size"].alias("size"), x["throughput"].alias("best"), F.lit(False).alias("stop"))).otherwise(F.struct(a["size"].alias("size"), a["best"].alias("best"), F.lit(True).alias("stop"))),
    )
    one = results.where("success").agg(steps.alias("steps"))
    return one.select(F.when(F.size("steps") > 0, fold["size"]).otherwise(default).cast("int").alias("batch_size"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
