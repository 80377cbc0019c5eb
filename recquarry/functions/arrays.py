"""Array and score expressions of the evaluators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, body) -> Column:
    """``body`` of a value computed once per row.

    An expression captured by a lambda is evaluated again for every element; passing it as
    the element of a one-entry array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truncate_score(score, method: str) -> Column:
    """``ceil``, ``floor`` or ``around`` (half to even)."""
    how = {"ceil": F.ceil, "floor": F.floor, "around": F.bround}
    if method not in how:
        raise ValueError(f"unknown truncation {method}")
    return how[method](_c(score)).cast("double")


def cut_off(score, threshold: float) -> Column:
    return F.when(_c(score) > threshold, 1).otherwise(0).cast("long")


def pad_ragged(values, width: int, fill: float = float("-inf")) -> Column:
    """Right-pad a list to ``width``; longer lists are an error of the caller."""
    v = _c(values).cast("array<double>")
    return F.concat(v, F.array_repeat(F.lit(fill).cast("double"), F.lit(width) - F.size(v)))
