"""Reproducible pseudo-random draws from hashes of row keys.

The value depends only on the seed and the key, never on partitioning or row
order, so a re-run task draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hex(seed: str, *parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("#", F.lit(seed), *(c.cast("string") for c in cols)))


def draw_int(seed: str, *parts) -> Column:
    """Unsigned 32-bit integer."""
    return F.conv(F.substring(draw_hex(seed, *parts), 1, 8), 16, 10).cast("long")


def draw_unit(seed: str, *parts) -> Column:
    """Double in [0, 1)."""
    return draw_int(seed, *parts).cast("double") / F.lit(4294967296.0)
