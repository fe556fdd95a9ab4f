"""Vector arithmetic in double precision, inside generated code where the length is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts: list[Column]) -> Column:
    """A balanced tree, so that the expression's depth is logarithmic."""
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_literal(a: Column, vector: list[float]) -> Column:
    """Product with a fixed vector, as plain arithmetic on the elements (no lambda, no array of products)."""
    return _sum([a[i].cast("double") * F.lit(float(x)) for i, x in enumerate(vector)])


def norm(a: Column, dims: int | None = None) -> Column:
    if dims is None:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.sqrt(_sum([a[i].cast("double") * a[i].cast("double") for i in range(dims)]))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cosine_literal(a: Column, vector: list[float]) -> Column:
    size = sum(float(x) ** 2 for x in vector) ** 0.5
    length = norm(a, len(vector)) * F.lit(size)
    return F.when(length > 0, dot_literal(a, vector) / length).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector over its length; a vector without length stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def shorten(a: Column, dims: int) -> Column:
    """The first ``dims`` elements, of unit length; an error if there are fewer."""
    long_enough = F.when(F.size(a) >= dims, a).otherwise(F.raise_error(F.lit(f"vector shorter than {dims}")).cast("array<double>"))
    return unit(F.slice(long_enough.cast("array<double>"), 1, dims))


def is_valid(a: Column) -> Column:
    """Neither null nor empty nor all zero."""
    return F.coalesce(F.size(a) > 0, F.lit(False)) & F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def mean(vectors: list[list[float]]) -> list[float]:
    return [reduce(lambda x, y: x + y, c) / len(vectors) for c in zip(*vectors, strict=True)]
