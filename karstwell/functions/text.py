"""Scalar functions on text, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that are removed from a text, in this order (case-insensitive, by line).
VERBOSE = (
    r"It'?s important to note that\s+",
    r"It'?s worth noting that\s+",
    r"It should be noted that\s+",
    r"However, it should be mentioned that\s+",
    r"Please note that\s+",
    r"As mentioned (?:earlier|above|previously),?\s+",
    r"^No information (?:was )?found (?:for|about)[^\n]+\n",
    r"^Unfortunately, the (?:code|analysis) does not (?:show|provide)[^\n]+\n",
    r"The (?:exact|precise|specific) (?:implementation|details?|mechanism|values?) (?:is|are) not (?:provided|documented|shown|clear|available) in the (?:code|analysis)[,.]?\s*",
    r"(?:More|Additional) (?:research|investigation|analysis|context) (?:is|would be) (?:needed|required)[,.]?\s*",
)
#: Phrases that stand for missing facts, and patterns of vague quantities.
PLACEHOLDERS = ("provide exact", "provide precise", "specify exact", "implementation-dependent", "precise line-level mappings", "exact numeric budgets", "provide the actual", "should specify", "need to determine", "requires clarification")
VAGUE = (
    r"\b(several|many|few|some|various|multiple|numerous)\s+(seconds|minutes|items|entries|elements|chunks)",
    r"\b(around|approximately|roughly|about)\s+\d+",
    r"\bhundreds of\b",
    r"\bthousands of\b",
)


def strip(x: Column) -> Column:
    """Without white space at both ends (trim() would only take spaces)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalize_content(x: Column) -> Column:
    """Line ends as \\n, no white space at both ends."""
    return strip(F.regexp_replace(x, "\r\n?", "\n"))


def slug(x: Column, *, fallback: str = "topic", max_length: int | None = None, ascii_only: bool = False) -> Column:
    """Lower-case letters and digits joined by single dashes."""
    kept = "[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{N}]+"
    out = F.regexp_replace(F.regexp_replace(F.lower(strip(x)), kept, "-"), "^-+|-+$", "")
    out = F.when(F.length(out) > 0, out).otherwise(fallback)
    if max_length is not None:
        short = F.regexp_replace(F.substring(out, 1, max_length), "-+$", "")
        out = F.when(F.length(out) > max_length, F.when(F.length(short) > 0, short).otherwise(fallback)).otherwise(out)
    return out


def scope_label(x: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(x, F.lit("/"), F.lit("_")), F.lit("")), F.lit("root"))


def heading_from_point(x: Column) -> Column:
    """A bold opening, else all; up to a colon or a dash; 80 characters at most."""
    text = strip(x)
    bold = F.regexp_extract(text, r"(?s)^\*\*(.*?)\*\*", 1)
    text = F.when(text.rlike(r"(?s)^\*\*.*?\*\*"), strip(bold)).otherwise(text)
    cut = F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1)).when(F.instr(text, " - ") > 0, F.substring_index(text, " - ", 1)).when(F.instr(text, " — ") > 0, F.substring_index(text, " — ", 1))
    text = F.coalesce(strip(cut), text)
    text = F.when(F.length(text) > 80, F.concat(F.regexp_replace(F.substring(text, 1, 77), r"\s+$", ""), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) > 0, text).otherwise("Point of Interest")


def strip_parts(x: Column) -> Column:
    return F.regexp_replace(x, r"(?:_part[0-9]+)+$", "")


def relative_path(x: Column, root: str) -> Column:
    slashed = F.replace(x, F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/"
    return F.when(slashed.startswith(root), F.substring(slashed, len(root) + 1, 1 << 30)).otherwise(slashed)


def split_commas(x: Column) -> Column:
    """The parts of a comma list if each is like an identifier, else the whole as one."""
    parts = F.transform(F.split(x, ","), strip)
    fine = F.forall(parts, lambda p: p.rlike(r"^[A-Za-z_$][\w$]*$"))
    return F.when(fine, parts).otherwise(F.array(strip(x)))


def display_name(kind: Column, symbol: Column, code: Column) -> Column:
    flat = F.replace(F.substring(code, 1, 50), F.lit("\n"), F.lit(" "))
    return F.when(F.coalesce(F.length(symbol), F.lit(0)) > 0, F.concat(kind, F.lit(": "), symbol)).otherwise(F.concat(kind, F.lit(": "), F.when(F.length(code) > 50, F.concat(flat, F.lit("..."))).otherwise(flat)))


def citations(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))


def invalid_citations(x: Column, known: Column) -> Column:
    """Distinct cited numbers that are not in ``known``, in order."""
    return F.array_sort(F.array_distinct(F.filter(citations(x), lambda n: ~F.array_contains(known, n))))


def remove_verbosity(x: Column) -> Column:
    out = reduce(lambda c, p: F.regexp_replace(c, "(?im)" + p, ""), VERBOSE, x)
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def llm_tokens(x: Column) -> Column:
    """Four characters a token, one at least; none for an empty text."""
    n = F.coalesce(F.length(x), F.lit(0))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4))).otherwise(0).cast("int")


def chunk_tokens(x: Column) -> Column:
    """Three characters a token, one at least; none for an empty text."""
    n = F.coalesce(F.length(x), F.lit(0))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 3))).otherwise(0).cast("int")


def ratio_tokens(x: Column, ratio: float = 3.5) -> Column:
    n = F.coalesce(F.length(x), F.lit(0))
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / ratio))).otherwise(0).cast("int")


def quality_warnings(x: Column, target_tokens: int) -> Column:
    """Names of what is wrong: placeholder (each), citation_density, verbose, vague."""
    found = [F.when(F.contains(F.lower(x), F.lit(p)), F.lit(f"placeholder: {p}")) for p in PLACEHOLDERS]
    n = llm_tokens(x)
    found.append(F.when((n > 1000) & (F.size(citations(x)) < 5), "citation_density"))
    found.append(F.when(n > target_tokens * 1.5, "verbose"))
    found.append(F.when(reduce(lambda a, b: a | b, [x.rlike("(?i)" + p) for p in VAGUE]), "vague"))
    return F.array_compact(F.array(*found))


def quoted_phrases(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r'"([^"]+)"'), F.lit(1))


def fact_id(statement: Column, source: Column, place: Column) -> Column:
    return F.substring(F.sha2(F.concat(statement, F.lit(":"), source, F.lit(":"), place), 256), 1, 12)


def confidence(x: Column) -> Column:
    value = F.lower(strip(x.cast("string")))
    return F.when(value.isin("definite", "likely", "inferred", "uncertain"), value).otherwise("uncertain")


def fact_location(path: Column, start: Column, end: Column, url: Column, section: Column) -> Column:
    lines = F.when(start.isNull(), path).when(end.isNull() | (end == start), F.concat(path, F.lit(":"), start.cast("string"))).otherwise(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when(url.isNotNull(), F.when(section.isNotNull(), F.concat(url, F.lit("#"), section)).otherwise(url)).otherwise(lines)


def chunk_text(*candidates: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def json_field(metadata: Column, path: str) -> Column:
    """A field of JSON text; null for null, invalid JSON or a missing field."""
    return F.get_json_object(F.when(metadata.isNotNull() & (metadata != "NaN"), metadata), path)


def search_text(markdown: Column) -> Column:
    """Markdown as plain text for an index: no code blocks, images, tags and line marks, links as their words, single spaces."""
    out = F.regexp_replace(markdown, r"(?s)```.*?```|!\[[^\]]*\]\([^)]+\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"`([^`]+)`", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for mark in (r"#+\s*", r"[-*+]\s+", r"\d+\.\s+", r">\s?"):
        out = F.regexp_replace(out, r"(?m)^\s*" + mark, "")
    return strip(F.regexp_replace(out, r"\s+", " "))


def model_key(provider: Column, model: Column) -> Column:
    return F.concat_ws("/", provider, model)


def url_filename(url: Column) -> Column:
    """A safe name of at most 100 characters: the URL's letters and the first eight digits of its SHA-1."""
    safe = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"[^\p{L}\p{N}_.-]", "_")
    return F.concat(F.substring(safe, 1, 91), F.lit("_"), F.substring(F.sha1(url), 1, 8))


def fence(text: Column) -> Column:
    """Backticks enough to fence the text: one more than its longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
