"""Vector arithmetic in double precision over float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores closer than this are ties, so that the order of hits does not depend
# on the order in which a sum happened to be taken.
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector has none, so the result is NULL."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
