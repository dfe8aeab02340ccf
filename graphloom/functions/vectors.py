"""Vector expressions: arrays of floats in, double arithmetic, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector of at most this norm is left as it is.
TINY = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once. What stands in a lambda is computed for every element."""
    return F.transform(F.array(value), use)[0]


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def norm(v: Column | str) -> Column:
    """Euclidean length; 0 for an empty vector, null for null."""
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x * x))


def is_degenerate(v: Column | str) -> Column:
    """Whether a vector is too short to normalise."""
    return norm(v) <= TINY


def normalise(v: Column | str) -> Column:
    """The vector at unit length, or unchanged if it is degenerate."""
    return _once(as_double(v), lambda d: _once(norm(d), lambda n: F.when(n > TINY, F.transform(d, lambda x: x / n)).otherwise(d)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product over the shorter length; 0 for empty vectors."""
    pairs = F.zip_with(as_double(a), as_double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Similarity of vectors taken to be of unit length; 0 if either is null or empty."""
    return F.coalesce(dot(a, b), F.lit(0.0))


def distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)
