"""Column functions on vectors (arrays of numbers), accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """The Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of two arrays of equal length; 0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def is_valid(a: Column | str, dims: tuple[int, ...]) -> Column:
    """Not null, of one of the lengths ``dims``, all components finite."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(a).isin(*dims) & fine, F.lit(False))
