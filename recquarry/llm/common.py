"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recquarry.operators.layout import shared_dir

# Characters worked on at once inside a task; the memory of the numpy steps is a small multiple.
CHUNK_CHARS = 400_000
# Largest table that is ever marked for broadcast, in rows of a few numbers each.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    It cuts the lineage, and it survives the loss of executors.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast only if it has been counted and is small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has; they are told apart without regard to case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def chunks(texts: list, size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``size`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def text_parts(column: pa.Array, size: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of consecutive texts of an Arrow column with about ``size`` bytes, and their texts; null is empty.

    A task so holds a batch of whole texts once, and only one part of it as Python strings.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text starts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.concatenate(([0], np.cumsum(lengths)[:-1]))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once for a row.

    The optimizer would copy an expression into every place that reads it, also into functions over
    arrays, which would work it out anew for each element; it does not look through a generator.
    The outer form keeps it from testing the array's size first, which would work it out twice.
    """
    out = df
    for name, column in columns.items():
        out = out.select(*(c for c in out.columns if c != name), F.explode_outer(F.array(column)).alias(name))
    return out
