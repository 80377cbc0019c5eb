"""Data-layout helpers that keep operators safe on skewed, very large inputs.

Plain windows send every row of one key to one task.  The helpers here look at
the key sizes first (one map-side combined count): keys below ``HOT_ROWS`` go
through ordinary windows, larger ones are range-sorted across the cluster and
cut into fixed-size blocks, so that no task ever sees an unbounded group.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one key that a single window task still handles comfortably.
HOT_ROWS = 1_000_000
# Rows per block once a hot key is cut up.
BLOCK_ROWS = 100_000
# Rows of a log per task where each of them comes to hold a list.
LIST_ROWS = 100_000
# Low bits of a double that a histogram of magnitudes leaves out: 256 buckets for each power of two.
RADIX_SHIFT = 44
# Largest number of rows ever marked for broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="recquarry-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint; survives executor loss."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write an aggregated side out once and mark it for broadcast if it proved small.

    Beyond the bound the written frame comes back unmarked and Spark shuffles it.
    """
    written = materialize(df)
    seen = written.limit(max_rows + 1).count()
    return F.broadcast(written) if seen <= max_rows else written


def lookup_join(df: DataFrame, looked_up: DataFrame, keys: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Join rows with an aggregate that has one row per key, such that a hot key can be split.

    The adaptive skew join splits a partition only where both sides of the join are shuffles of their own.  An aggregate on
    the join key is none: its shuffle is the join's.  Written first, it is shuffled, or broadcast if it proves small, as any table.
    """
    return df.join(materialize(looked_up), keys, how)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on key columns; the right side's keys do not appear twice."""
    renamed = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*(f"_right_{k}" for k in keys))


def _total_by_partition(sorted_df: DataFrame, values: dict[str, Column]):
    tagged = sorted_df.withColumn("_m", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_m", 33).cast("int")).withColumn(
        "_row", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sums = [F.sum(v).cast("long").alias(n) for n, v in values.items()]
    # one row per partition
    rows = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *sums).orderBy("_part").collect()
    running = {n: 0 for n in ["_n", *values]}
    offsets = []
    for r in rows:
        offsets.append((r["_part"], *(running[n] for n in running)))
        for n in running:
            running[n] += r[n] or 0
    schema = ", ".join(["_part int", *(f"_off_{n} long" for n in running)])
    table = df_of(sorted_df.sparkSession, offsets, schema)
    return tagged.join(F.broadcast(table), "_part")


def df_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def index_rows(df: DataFrame, order: Sequence, name: str = "idx") -> DataFrame:
    """Dense 0-based global position in ``order``.

    A range sort spreads the rows; positions inside a partition come from the
    row counter and only one count per partition passes through the driver.
    ``order`` should identify rows up to interchangeable copies.
    """
    tagged = _total_by_partition(materialize(df.orderBy(*order)), {})
    return tagged.withColumn(name, F.col("_row") + F.col("_off__n")).drop("_m", "_part", "_row", "_off__n")


def global_running_sums(df: DataFrame, order: Sequence, values: dict[str, str]) -> DataFrame:
    """Inclusive running sums of integer columns over the whole table.

    ``values`` maps output name to input column.
    """
    cols = {f"v{i}": F.col(c) for i, c in enumerate(values.values())}
    tagged = _total_by_partition(materialize(df.orderBy(*order)), cols)
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged
    for i, (name, c) in enumerate(values.items()):
        out = out.withColumn(name, F.col(f"_off_v{i}") + F.sum(c).over(inside))
    return out.drop("_m", "_part", "_row", "_off__n", *(f"_off_v{i}" for i in range(len(values))))


class KeySizes(NamedTuple):
    """Rows of a table, and of its largest key, or bounds of them."""

    rows: int
    largest: int

    def below(self, limit: int | None = None) -> bool:
        """Whether no key is hot."""
        return self.largest <= (HOT_ROWS if limit is None else limit)

    def tasks(self) -> int:
        return max(1, -(-self.rows // LIST_ROWS))


def key_sizes(df: DataFrame, keys: Sequence[str]) -> KeySizes:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    return KeySizes(*(n or 0 for n in counted.agg(F.sum("_len"), F.max("_len")).first()))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows with their counts, or None when there are none."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    hot = counted.where(F.col("_len") > (HOT_ROWS if limit is None else limit))
    return None if hot.isEmpty() else hot


def window_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    before: int = 0,
    after: int = 0,
    limit: int | None = None,
    block: int | None = None,
    sizes: KeySizes | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Number rows per key and cut hot keys into blocks a window can run over.

    Adds ``_pos`` (1-based), ``_len``, ``_blk`` and ``_halo``.  A window over
    ``(keys, _blk)`` ordered by ``_pos`` and reaching at most ``before`` rows back
    or ``after`` rows ahead is exact for rows with ``_halo = false``; halo rows are
    the neighbours' copies and must be dropped afterwards.  Ties in ``order`` must
    be interchangeable.  ``sizes`` saves the count where the caller has one, and ``tasks`` is the number of tasks
    that keys which are not hot are spread over.
    """
    block = block or BLOCK_ROWS
    keys = list(keys)
    if before > block or after > block:
        raise ValueError("a block must be longer than the window reach")
    hot = None if sizes is not None and sizes.below(limit) else hot_keys(df, keys, limit)
    by_key = Window.partitionBy(*keys)

    def number(part: DataFrame) -> DataFrame:
        if tasks is not None:
            part = part.repartition(tasks, *keys)
        return (
            part.withColumn("_pos", F.row_number().over(by_key.orderBy(*order)).cast("long"))
            .withColumn("_len", F.count(F.lit(1)).over(by_key))
            .withColumn("_blk", F.lit(0).cast("long"))
            .withColumn("_halo", F.lit(False))
        )

    if hot is None:
        return number(df)
    hot = broadcast_if_small(hot.select(*keys))
    cold_part = join_keys(df, hot, keys, "left_anti")
    hot_part = join_keys(df, hot, keys, "left_semi")
    # the row counter makes sort keys unique, so equal rows still spread; written first, so
    # that a task run again after a lost executor sees the same counter
    spread = materialize(hot_part.withColumn("_tie", F.monotonically_increasing_id()))
    placed = index_rows(spread, [*keys, *order, "_tie"], "_g").drop("_tie")
    starts = placed.groupBy(*keys).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_len"))
    starts = broadcast_if_small(starts)
    joined = join_keys(placed, starts, keys, "inner").select(
        *df.columns, (F.col("_g") - F.col("_start") + 1).alias("_pos"), "_len"
    )
    home = F.floor((F.col("_pos") - 1) / F.lit(block)).cast("long")
    inside = (F.col("_pos") - 1) % F.lit(block)
    copies = F.filter(
        F.array(
            F.struct(home.alias("b"), F.lit(False).alias("h")),
            F.when(inside >= block - before, F.struct((home + 1).alias("b"), F.lit(True).alias("h"))),
            F.when((inside < after) & (home > 0), F.struct((home - 1).alias("b"), F.lit(True).alias("h"))),
        ),
        lambda c: c.isNotNull(),
    )
    blocks = (
        joined.withColumn("_c", F.explode(copies))
        .withColumn("_blk", F.col("_c.b"))
        .withColumn("_halo", F.col("_c.h"))
        .drop("_c")
    )
    return number(cold_part).unionByName(blocks)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence, limit: int | None = None, sizes: KeySizes | None = None
) -> DataFrame:
    """Adds ``_pos`` (1-based per key) and ``_len`` without building hot windows."""
    return window_blocks(df, keys, order, limit=limit, sizes=sizes).drop("_blk", "_halo")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence, values: dict[str, str], limit: int | None = None, sizes: KeySizes | None = None
) -> DataFrame:
    """Inclusive running sums of non-negative integer columns per key.

    Without keys, and for hot keys, the sum runs over the whole sorted table and
    the key's own starting level is taken off again.  ``sizes`` saves the count where the caller has one.
    """
    keys = list(keys)
    if not keys:
        return global_running_sums(df, order, values)
    by_key = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def plain(part: DataFrame) -> DataFrame:
        return part.select("*", *(F.sum(c).over(by_key).cast("long").alias(n) for n, c in values.items()))

    hot = None if sizes is not None and sizes.below(limit) else hot_keys(df, keys, limit)
    if hot is None:
        return plain(df)
    hot = broadcast_if_small(hot.select(*keys))
    cold_part = join_keys(df, hot, keys, "left_anti")
    hot_part = join_keys(df, hot, keys, "left_semi")
    summed = global_running_sums(hot_part, [*keys, *order], values)
    base = summed.groupBy(*keys).agg(
        *(F.min(F.col(n) - F.col(c)).alias(f"_base_{n}") for n, c in values.items())
    )
    base = broadcast_if_small(base)
    levelled = join_keys(summed, base, keys, "inner").select(
        *df.columns, *((F.col(n) - F.col(f"_base_{n}")).cast("long").alias(n) for n in values)
    )
    return plain(cold_part).unionByName(levelled)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark cuts to k before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def kth_smallest(
    df: DataFrame, keys: Sequence[str], value: str, rate: float, buckets: int = 4096, limit: int | None = None
) -> DataFrame:
    """Exact k-th smallest ``value`` per key with k = int(count * rate).

    Returns ``(keys, kth_index, kth)`` with kth_index = k; ``kth`` is null when k = 0.  A histogram narrows the
    search to one bucket per key and only that bucket is ranked, over its distinct
    values.
    """
    keys = list(keys)
    bounds = df.groupBy(*keys).agg(
        F.min(value).cast("double").alias("_lo"),
        F.max(value).cast("double").alias("_hi"),
        F.floor(F.count(F.lit(1)) * F.lit(float(rate))).cast("long").alias("_k"),
    )
    bounds = broadcast_if_small(bounds)
    slot = F.when(
        F.col("_hi") > F.col("_lo"),
        F.least(
            F.lit(buckets - 1),
            F.floor((F.col(value).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets),
        ),
    ).otherwise(F.lit(0))
    slotted = df.select(*keys, value).join(bounds, keys).withColumn("_b", slot.cast("int"))
    hist = slotted.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.first("_k").alias("_k"))
    # at most `buckets` rows per key
    upto = hist.withColumn(
        "_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    )
    chosen = (
        upto.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .select(*keys, "_b", (F.col("_upto") - F.col("_n")).alias("_below"))
    )
    chosen = broadcast_if_small(chosen)
    rest = (
        slotted.join(chosen, [*keys, "_b"])
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_below").alias("_below"), F.first("_k").alias("_k"))
    )
    ranked = running_sums(rest, keys, [value], {"_cum": "_n"}, limit)
    found = (
        ranked.where(F.col("_below") + F.col("_cum") >= F.col("_k")).groupBy(*keys).agg(F.min(value).alias("kth"))
    )
    return bounds.select(*keys, F.col("_k").alias("kth_index")).join(found, keys, "left")


def _magnitude_bits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per value of a batch of (key, values): row, magnitude, and its bits, which order like the magnitude."""
    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.abs(lists.flatten().to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(lists)), sizes), flat, np.ascontiguousarray(flat).view(np.int64)


def kth_smallest_magnitude(df: DataFrame, key: str, values: str, rate: float) -> DataFrame:
    """Exact k-th smallest magnitude of all values of a key, held in arrays, with k = int(count * rate).

    Returns ``(key, kth_index, kth)`` with kth_index = k; ``kth`` is null when k = 0.  ``key`` is a text column, ``values`` has
    arrays of doubles without nulls.  Arrays are not exploded: a magnitude's leading bits name its bucket, every task counts
    its arrays into one histogram a key, and the histograms are summed.  Only values of the bucket that holds
    the k-th one, under a hundredth of an octave wide, become rows.
    """
    cells = df.select(F.col(key).alias("_key"), F.col(values).cast("array<double>").alias("_v"))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.Series | None = None
        for batch in batches:
            row, _, bits = _magnitude_bits(batch)
            codes, names = pd.factorize(batch.column(0).to_pandas())
            found, n = np.unique(codes[row].astype(np.int64) << 20 | bits >> RADIX_SHIFT, return_counts=True)
            index = pd.MultiIndex.from_arrays([np.asarray(names, dtype=object)[found >> 20], found & (1 << 20) - 1])
            here = pd.Series(n, index=index)
            total = here if total is None else total.add(here, fill_value=0)
        if total is not None and len(total):
            keys, buckets = (total.index.get_level_values(i) for i in (0, 1))
            columns = [pa.array(keys, pa.string()), pa.array(buckets, pa.int32()), pa.array(total.to_numpy().astype("int64"))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_b", "_n"])

    counted = cells.mapInArrow(histogram, "_key string, _b int, _n long").groupBy("_key", "_b").agg(F.sum("_n").alias("_n"))
    # at most some thousand buckets per key
    by_key = Window.partitionBy("_key")
    upto = counted.select(
        "*",
        F.sum("_n").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.floor(F.sum("_n").over(by_key) * F.lit(float(rate))).cast("long").alias("_k"),
    )
    # the bucket of the k-th value; for k = 0 the first one, which gives the index alone
    first = F.col("_upto") - F.col("_n")
    chosen = upto.where((F.col("_upto") >= F.col("_k")) & (first < F.greatest("_k", F.lit(1)))).select(
        "_key", "_b", "_k", first.alias("_below")
    )
    chosen = broadcast_if_small(chosen)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, flat, bits = _magnitude_bits(batch)
            hit = bits >> RADIX_SHIFT == batch.column(2).to_numpy()[row]
            row = row[hit]
            columns = [batch.column(0).take(pa.array(row)), pa.array(flat[hit])]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_mag"])

    held = cells.join(chosen.where("_k > 0").select("_key", "_b"), "_key").select("_key", "_v", "_b")
    rest = held.mapInArrow(inside, "_key string, _mag double").groupBy("_key", "_mag").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(rest, ["_key"], ["_mag"], {"_cum": "_n"}).join(chosen, "_key")
    found = ranked.where(F.col("_below") + F.col("_cum") >= F.col("_k")).groupBy("_key").agg(F.min("_mag").alias("kth"))
    return chosen.select(F.col("_key"), F.col("_k").alias("kth_index")).join(found, "_key", "left").withColumnRenamed("_key", key)
