"""Vector column expressions (stay inside Catalyst, no Python per row).

Arrays are cast to ``array<double>`` before any arithmetic so 32-bit storage
never changes the result.  A similarity that is undefined (zero vector,
width mismatch, null) is null, never NaN: NaN would sort above every number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0).cast("double"), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """``1 - cosine distance``; null when either vector has zero length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_squared(a, b) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda s, x: s + x)


def cast_float32(v) -> Column:
    return _c(v).cast("array<float>")


def width(v) -> Column:
    return F.size(_c(v))
