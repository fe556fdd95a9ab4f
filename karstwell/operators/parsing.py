"""Parsers: files as concepts (definitions, imports, comments, blocks) for ``chunking.chunk_files``.

A parser is a function from a text to (name, concept, first line, last line),
lines counted from 1. ``PARSERS`` is the registry by language; languages without
an entry, and texts that their parser rejects, are cut into paragraphs.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Concept = tuple[str, str, int, int]

_BLANK = re.compile(r"\s*$")


def paragraphs(text: str) -> list[Concept]:
    """Runs of lines that are not blank."""
    out: list[Concept] = []
    begin = 0
    for i, line in enumerate([*text.split("\n"), ""], 1):
        if not _BLANK.match(line):
            begin = begin or i
        elif begin:
            out.append((f"paragraph_{begin}", "BLOCK", begin, i - 1))
            begin = 0
    return out


def python(text: str) -> list[Concept]:
    """Functions, classes and methods with their decorators, imports, runs of other statements, and comments."""
    out: list[Concept] = []

    def first(node: ast.AST) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])

    def walk(body: list[ast.stmt], outer: str) -> None:
        run: list[ast.stmt] = []

        def close() -> None:
            if run:
                out.append((f"{outer}block_{run[0].lineno}", "BLOCK", run[0].lineno, run[-1].end_lineno))
                run.clear()

        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                close()
                out.append((outer + node.name, "DEFINITION", first(node), node.end_lineno))
                if isinstance(node, ast.ClassDef):
                    walk([n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], f"{outer}{node.name}.")
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                close()
                names = ", ".join(a.asname or a.name for a in node.names)
                out.append((f"{node.module}: {names}" if isinstance(node, ast.ImportFrom) and node.module else names, "IMPORT", node.lineno, node.end_lineno))
            else:
                run.append(node)
        close()

    walk(ast.parse(text).body, "")
    comments = [t.start[0] for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip()]
    for a, b in _runs(comments):
        out.append((f"comment_{a}", "COMMENT", a, b))
    return out


def _runs(lines: list[int]) -> list[tuple[int, int]]:
    """First and last of runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in lines:
        if out and out[-1][1] == n - 1:
            out[-1] = out[-1][0], n
        else:
            out.append((n, n))
    return out


def markdown(text: str) -> list[Concept]:
    """Sections from heading to heading, fenced code inside them, and what stands before the first heading."""
    lines = text.split("\n")
    heads, fences, opened = [], [], 0
    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith("```"):
            if opened:
                fences.append((f"code_{opened}", "BLOCK", opened, i))
            opened = 0 if opened else i
        elif not opened and (m := re.match(r"#{1,6}[ \t]+(.*?)[ \t#]*$", line)):
            heads.append((i, m[1] or f"section_{i}"))
    out: list[Concept] = [("preamble", "BLOCK", 1, heads[0][0] - 1 if heads else len(lines))] if not heads or heads[0][0] > 1 else []
    for (i, name), (after, _) in zip(heads, [*heads[1:], (len(lines) + 1, "")], strict=True):
        out.append((name, "DEFINITION", i, after - 1))
    return [c for c in out + fences if any(not _BLANK.match(x) for x in lines[c[2] - 1 : c[3]])]


def json(text: str) -> list[Concept]:
    """The members of the outermost object or array."""
    out: list[Concept] = []
    depth, line, last, begin, name, n = 0, 1, 1, 0, "", 0
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],\n]|[^\s{}\[\],"]+')
    for m in token.finditer(text):
        t = m[0]
        if t == "\n":
            line += 1
            continue
        if t in "}]":
            depth -= 1
            if depth < 0:
                raise ValueError("unbalanced")
            if depth == 0 and begin:
                out.append((name, "DEFINITION", begin, last))
                begin = 0
        elif t == "," and depth == 1:
            if begin:
                out.append((name, "DEFINITION", begin, last))
            begin = 0
        elif depth == 1 and not begin:
            n += 1
            begin, name = line, t.strip('"') if t.startswith('"') else f"item_{n}"
        last = line
        if t in "{[":
            depth += 1
    if depth:
        raise ValueError("unbalanced")
    return out


def keyed(pattern: str) -> Callable[[str], list[Concept]]:
    """Parts that each begin with a line like ``pattern`` (its first group is the name)."""
    head = re.compile(pattern)

    def run(text: str) -> list[Concept]:
        lines = text.split("\n")
        heads = [(i, m[1]) for i, line in enumerate(lines, 1) if (m := head.match(line))]
        out: list[Concept] = [(f"block_{1}", "BLOCK", 1, heads[0][0] - 1 if heads else len(lines))] if not heads or heads[0][0] > 1 else []
        for (i, name), (after, _) in zip(heads, [*heads[1:], (len(lines) + 1, "")], strict=True):
            while after - 1 > i and _BLANK.match(lines[after - 2]):
                after -= 1
            out.append((name, "DEFINITION", i, after - 1))
        return [c for c in out if any(not _BLANK.match(x) for x in lines[c[2] - 1 : c[3]])]

    return run


def sql(text: str) -> list[Concept]:
    """Statements: DDL are definitions, the others blocks."""
    out: list[Concept] = []
    line = 1
    for part in re.split(r"(;)", text):
        body = part.strip()
        if body and body != ";":
            begin = line + part[: len(part) - len(part.lstrip())].count("\n")
            m = re.match(r"(?is)(?:create|alter|drop)\s+(?:or\s+replace\s+)?(?:\w+\s+)*?(?:table|view|index|function|trigger|procedure|schema|sequence)\s+(?:if\s+(?:not\s+)?exists\s+)?([\w.\"`]+)", body)
            out.append((m[1] if m else f"statement_{begin}", "DEFINITION" if m else "BLOCK", begin, begin + body.count("\n")))
        line += part.count("\n")
    return out


_IMPORT = re.compile(r"\s*(?:import\b|use\b|using\b|package\b|require\b|#\s*include\b|from\b.*\bimport\b)")
_NAMED = re.compile(r"\b(?:class|struct|interface|enum|trait|impl|namespace|module|object|record|union|function|func|fn|fun|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)")
_CALLED = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:=\s*(?:async\s*)?)?\(")


def braces(text: str) -> list[Concept]:
    """Languages with braces: outermost braced parts with their heads, imports, comments, and runs of other lines.

    Strings, character literals and comments are blanked before braces are counted.
    """
    kept = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    lines, bare = text.split("\n"), kept.split("\n")
    out: list[Concept] = []
    comments, loose = [], []
    depth, begin = 0, 0

    def flush(until: int) -> None:
        for a, b in _runs([n for n in loose if n < until]):
            out.append((f"block_{a}", "BLOCK", a, b))
        loose[:] = [n for n in loose if n >= until]

    for i, (line, code) in enumerate(zip(lines, bare, strict=True), 1):
        opens, closes = code.count("{"), code.count("}")
        if depth == 0 and not begin:
            if _BLANK.match(code):
                if not _BLANK.match(line):
                    comments.append(i)
                continue
            if not opens and _IMPORT.match(line):
                out.append((line.strip().rstrip(";"), "IMPORT", i, i))
                continue
            if not opens:
                loose.append(i)
                continue
            begin = i
            # a head that began on the lines before
            while loose and loose[-1] == begin - 1 and not lines[begin - 2].rstrip().endswith((";", "}")):
                begin = loose.pop()
        depth = max(0, depth + opens - closes)
        if depth == 0:
            head = " ".join(bare[begin - 1 : i]).split("{")[0]
            m = _NAMED.search(head) or _CALLED.search(head)
            flush(begin)
            out.append((m[1] if m else f"block_{begin}", "DEFINITION" if m else "BLOCK", begin, i))
            begin = 0
    if begin:
        raise ValueError("unbalanced")
    flush(len(lines) + 1)
    return out + [(f"comment_{a}", "COMMENT", a, b) for a, b in _runs(comments)]


#: The registry: parsers by language.
PARSERS: dict[str, Callable[[str], list[Concept]]] = {
    "python": python, "markdown": markdown, "json": json, "sql": sql, "yaml": keyed(r"([A-Za-z_][\w.-]*)\s*:"), "toml": keyed(r"\[+\s*([\w.\"-]+)\s*\]+"), "makefile": keyed(r"([\w./%-]+)\s*:(?!=)"),
    **{x: braces for x in ("javascript", "jsx", "typescript", "tsx", "java", "csharp", "go", "rust", "c", "cpp", "kotlin", "swift", "php", "dart", "zig", "groovy", "css", "scss", "hcl")},
}


def parse(text: str, language: str | None) -> list[Concept]:
    """The concepts of a text in the order of their lines; paragraphs where the language has no parser or it fails."""
    parser = PARSERS.get(language or "", paragraphs)
    try:
        found = parser(text)
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        found = paragraphs(text)
    return sorted(found, key=lambda c: (c[2], -c[3], c[0]))


def parse_files(files: DataFrame) -> DataFrame:
    """Concepts of files (file_id, language, text): file_id, name, concept, content, start_line, end_line.

    Null and blank texts have none. Feeds ``chunking.chunk_files``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines = (r["text"] or "").split("\n")
                rows += [(r["file_id"], n, c, "\n".join(lines[a - 1 : b]), a, b) for n, c, a, b in parse(r["text"] or "", r["language"])]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            names = ["file_id", "name", "concept", "content", "start_line", "end_line"]
            yield pa.record_batch([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("file_id", "language", "text").mapInArrow(run, "file_id long, name string, concept string, content string, start_line int, end_line int")
