"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def is_sound(vector: Column) -> Column:
    """Not empty, finite, not all zero."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & (norm(vector) > 0)


def cosine(a: Column, b: Column) -> Column:
    """Null where the lengths differ or a vector isn't sound."""
    fits = (F.size(a) == F.size(b)) & is_sound(a) & is_sound(b)
    return F.when(fits, clipped(dot(a, b) / (norm(a) * norm(b))))


def unit(vector: Column) -> Column:
    """The vector over its norm, worked out once a row."""
    return F.element_at(F.transform(F.array(norm(vector)), lambda n: F.transform(vector, lambda x: x.cast("double") / n)), 1)


def hash_slot(token: Column, dimensions: int) -> Column:
    """The slot of a hashed bag of words: the first two bytes of the token's SHA-256."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 4), 16, 10).cast("int") % dimensions).cast("int")
