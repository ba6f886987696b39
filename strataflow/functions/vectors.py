"""Vector distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Products in single precision summed in double; null if empty, of unequal length or of zero norm."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: (x * y).cast("float").cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
