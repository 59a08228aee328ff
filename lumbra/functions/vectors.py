"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = F.lit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or without a direction."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    """The largest float for vectors of unequal length."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)
    return F.when(F.size(a) != F.size(b), F.lit(3.4028234663852886e38)).otherwise(F.sqrt(square))


def normalise(v: Column) -> Column:
    """The vector of length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def to_text(v: Column) -> Column:
    """[x,y,...] with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def from_text(s: Column) -> Column:
    return F.from_json(s, "array<float>")
