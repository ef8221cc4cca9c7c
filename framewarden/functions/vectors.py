"""Appearance vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; null if it is null, empty or shorter than 1e-8."""
    n = norm(a)
    # the length is bound by an outer function: within the inner one it would be computed again for every component
    scaled = F.get(F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m)), F.lit(0))
    return F.when((F.size(a) > 0) & (n >= TINY), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is shorter than 1e-8."""
    na, nb = norm(a), norm(b)
    return F.when((na >= TINY) & (nb >= TINY), dot(a, b) / (na * nb)).otherwise(0.0)
