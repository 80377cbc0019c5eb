"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recquarry.functions.arrays import let


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a, eps: float | None = 1e-6) -> Column:
    """x / max(|x|, eps); ``eps=None`` divides by the bare norm (null for a zero vector)."""
    n = norm(a)
    n = F.greatest(n, F.lit(eps)) if eps is not None else F.nullif(n, F.lit(0.0))
    return let(n, lambda length: F.transform(_c(a), lambda x: x.cast("double") / length))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def multiply(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))


def scale(a, s) -> Column:
    s = F.lit(float(s)) if isinstance(s, (int, float)) else s
    return F.transform(_c(a), lambda x: x.cast("double") * s)
