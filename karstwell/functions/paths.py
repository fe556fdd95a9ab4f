"""Path filters, globs and ignore rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FORBIDDEN = ("..", "~", "*", "?", "[", "]", "\0", "\n", "\r")


def escape_like(text: str) -> str:
    """Makes ``\\``, ``%``, ``_`` and ``[`` stand for themselves in LIKE with ``\\`` as escape."""
    return re.sub(r"([\\%_\[])", r"\\\1", text)


def normalize_filter(path: str | None) -> str | None:
    """A relative path; directories end in ``/``. A last part with a dot after its first character is a file. Blank: None."""
    path = (path or "").strip()
    if not path:
        return None
    for bad in FORBIDDEN:
        if bad in path:
            raise ValueError(f"path filter contains {bad!r}")
    path = path.replace("\\", "/").lstrip("/")
    if path and not path.endswith("/") and "." not in path.rsplit("/", 1)[-1][1:]:
        path += "/"
    return path


def normalize_filter_column(path: Column) -> Column:
    """``normalize_filter`` for a column; null where that is an error or None."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"\\", "/"), "^/+", "")
    last = F.element_at(F.split(p, "/"), -1)
    bad = path.rlike(r"\.\.|[~*?\[\]\n\r\x00]")
    done = F.when(p.endswith("/") | (F.instr(F.substring(last, 2, 1 << 30), ".") > 0), p).otherwise(F.concat(p, F.lit("/")))
    return F.when(~bad & (F.length(p) > 0), done)


def in_path(column: Column, path: str | None) -> Column:
    """Directories match anywhere between slashes, files only at the end."""
    path = normalize_filter(path)
    if path is None:
        return F.lit(True)
    if path.endswith("/"):
        return F.contains(F.concat(F.lit("/"), column), F.lit("/" + path))
    return F.concat(F.lit("/"), column).endswith("/" + path)


def under_directory(column: Column, directory: str) -> Column:
    return (column == directory) | column.startswith(directory.rstrip("/") + "/")


def glob_regex(glob: str) -> str:
    """A glob over whole relative paths: ``**`` crosses slashes, ``*`` and ``?`` also do (fnmatch)."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"(?s)^{out}$"


def excluded(column: Column, globs: list[str]) -> Column:
    """``**/X/**`` means that a part of the path is X; other globs match the path or its last part."""
    tests = []
    for g in globs:
        m = re.fullmatch(r"\*\*/([^*?\[/]+)/\*\*", g)
        if m:
            tests.append(F.array_contains(F.split(column, "/"), m[1]))
        else:
            tests.append(column.rlike(glob_regex(g)) | F.element_at(F.split(column, "/"), -1).rlike(glob_regex(g)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def summarize_globs(globs: list[str]) -> tuple[set[str], set[str], list[str]]:
    """Extensions (``**/*.py``), exact names (``**/Makefile``), and the globs that are neither."""
    extensions, names, rest = set(), set(), []
    for g in globs:
        tail = g.removeprefix("**/")
        if re.fullmatch(r"\*\.[^*?\[\]/]+", tail):
            extensions.add(tail[1:].lower())
        elif re.fullmatch(r"[^*?\[\]/]+", tail):
            names.add(tail)
        else:
            rest.append(g)
    return extensions, names, rest


def included(column: Column, globs: list[str]) -> Column:
    """Any glob matches the path, the path without a leading ``**/`` rule, or the last part. Plain sets become IN lists."""
    extensions, names, rest = summarize_globs(globs)
    name = F.element_at(F.split(column, "/"), -1)
    tests = []
    if extensions:
        # the suffix from every dot, so that .d.ts matches as well as .ts
        tests.append(reduce(lambda a, b: a | b, [F.lower(name).endswith(e) for e in sorted(extensions)]))
    if names:
        tests.append(name.isin(sorted(names)))
    for g in rest:
        tests.append(column.rlike(glob_regex(g)) | column.rlike(glob_regex(g.removeprefix("**/"))) | name.rlike(glob_regex(g)))
    return reduce(lambda a, b: a | b, tests, F.lit(not globs))


def include_prefixes(globs: list[str]) -> list[str]:
    """Literal directories before the first wildcard; empty if a glob has none (then nothing can be pruned)."""
    out = []
    for g in globs:
        head = re.split(r"[*?\[]", g, maxsplit=1)[0]
        head = head.rsplit("/", 1)[0] if "/" in head else ""
        if not head:
            return []
        out.append(head)
    return sorted(set(out))


def gitignore_rules(lines: list[str]) -> list[tuple[int, str, bool]]:
    """(order, regular expression over relative paths, negated) of the lines of one ignore file."""
    rules = []
    for order, line in enumerate(lines):
        line = re.sub(r"(?<!\\) +$", "", line.rstrip("\n"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        only_directory, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                body, i = body + "/.+", i + 3
            elif line[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif line[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                body, i = body + re.escape(line[i]), i + 1
        rules.append((order, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if only_directory else "(?:/.*)?$"), negated))
    return rules


def ignored(column: Column, lines: list[str]) -> Column:
    """Whether the last rule that matches is not negated."""
    out = F.lit(False)
    for _, pattern, negated in gitignore_rules(lines):
        out = F.when(column.rlike(pattern), not negated).otherwise(out)
    return out
