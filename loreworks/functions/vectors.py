"""Column functions over float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def truncate_normalise(vec: Column, dim: int) -> Column:
    """The first ``dim`` values scaled to unit length (cut first, then scaled)."""
    kept = F.slice(vec, 1, dim)
    length = F.greatest(norm(kept), F.lit(NORM_FLOOR))
    return F.transform(kept, lambda v: v.cast("double") / length)


def normalise(vec: Column) -> Column:
    """Unit length; a (near) zero vector is returned as it is."""
    length = norm(vec)
    return F.when(length > NORM_FLOOR, F.transform(vec, lambda v: v.cast("double") / length)).otherwise(
        F.transform(vec, lambda v: v.cast("double"))
    )
