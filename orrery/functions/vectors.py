"""Scalar functions on array<double> vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slices of a position: 1-based start and width of each axis (65 lexical, 16 structural, 5 semantic).
CODE_AXES = {"lexical": (1, 65), "structural": (66, 16), "semantic": (82, 5)}


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def zero() -> Column:
    return F.lit(0.0)


def padded(v: Column, size: Column) -> Column:
    """`v` with zeros appended up to `size`."""
    return F.concat(v, F.array_repeat(zero(), F.greatest(size - F.size(v), F.lit(0)).cast("int")))


def aligned(a: Column, b: Column) -> tuple[Column, Column]:
    """Both vectors with zeros up to the longer one's width."""
    size = F.greatest(F.size(a), F.size(b))
    return padded(a, size), padded(b, size)


def total(v: Column) -> Column:
    return F.aggregate(v, zero(), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, zero(), lambda s, x: s + x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_similarity(a: Column, b: Column, at_zero: float = 0.0) -> Column:
    """`at_zero` where a vector is zero."""
    product = norm(a) * norm(b)
    return F.when(product == 0, F.lit(at_zero)).otherwise(dot(a, b) / product)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where a vector is zero."""
    return F.lit(1.0) - cosine_similarity(a, b)


def distance(a: Column, b: Column, method: str = "cosine") -> Column:
    return cosine_distance(a, b) if method == "cosine" else euclidean(a, b)


def axis_distance(a: dict[str, Column], b: dict[str, Column], axis: str, method: str = "cosine") -> Column:
    """Distance in one axis of points given as {axis: vector}."""
    if axis not in a:
        raise ValueError(f"unknown axis: {axis}")
    return distance(a[axis], b[axis], method)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(zero())


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    scaled = lambda y, n: F.when(n > 0, F.transform(y, lambda x: x / n)).otherwise(y)
    return let(v, lambda y: let(norm(y), lambda n: scaled(y, n)))


def argmax_name(names: list[str], v: Column) -> Column:
    """The name of the first largest element."""
    table = F.array(*[F.lit(n) for n in names])
    return let(v, lambda x: F.element_at(table, F.array_position(x, F.array_max(x)).cast("int")))
