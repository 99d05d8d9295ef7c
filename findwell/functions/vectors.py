"""Vector arithmetic on ARRAY<FLOAT> columns: single-precision products, double-precision sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findwell.functions.text import col


def inner_product(a, b) -> Column:
    """0 for vectors of different length or without numbers."""
    x, y = col(a), col(b)
    total = F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), total).otherwise(F.lit(0.0))


def cosine_of_units(a, b) -> Column:
    """Inner product of unit vectors within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner_product(a, b)))


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalized_vector(a) -> Column:
    """The vector at unit length; a zero vector as it is."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(col(a), lambda v: (v.cast("double") / n).cast("float"))).otherwise(col(a))


def checked(a, dimensions: int) -> Column:
    """The vector, or an error if it has other dimensions."""
    ok = F.size(col(a)) == dimensions
    return F.when(F.assert_true(ok, F.lit(f"vector must have {dimensions} dimensions")).isNull(), col(a))
