"""Cleaning, filtering and profiling of interaction logs and catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.operators.layout import lookup_join, materialize

# Half-open phase windows.
PHASE_WINDOWS = [
    ("pretrain", "2017-07-01", "2022-07-01"),
    ("phase1", "2022-07-01", "2022-10-01"),
    ("phase2", "2022-10-01", "2023-01-01"),
    ("test", "2023-01-01", "2023-04-01"),
]


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def valid_title(items: DataFrame) -> DataFrame:
    return items.where(F.col("title").isNotNull() & (F.length("title") > 0))


def since(df: DataFrame, min_date: str = "2020-01-01", ms: str = "timestamp") -> DataFrame:
    """Epoch milliseconds to ``ts``, keeping rows on or after ``min_date``.

    The comparison is on the raw column, so it reaches the file scan.
    """
    floor = F.unix_millis(F.to_timestamp(F.lit(min_date)))
    return df.where(F.col(ms) >= floor).withColumn("ts", F.timestamp_millis(ms))


def phase_of(ts, windows: Sequence = PHASE_WINDOWS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    label = None
    for name, start, end in windows:
        hit = (ts >= ntz(start)) & (ts < ntz(end))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label


def phase_split(df: DataFrame, windows: Sequence = PHASE_WINDOWS, ts: str = "ts") -> DataFrame:
    """Label each row with its phase; rows outside every window are dropped."""
    return df.withColumn("phase", phase_of(ts, windows)).where(F.col("phase").isNotNull())


def before(df: DataFrame, end: str, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) < ntz(end))


def normalize_epoch(df: DataFrame, column: str = "timestamp", ceiling: int = 10**10) -> DataFrame:
    """Divide the whole column by 1000 until its largest value is at most ``ceiling``."""
    top = df.agg(F.max(column)).first()[0]
    divisor = 1
    while top is not None and top // divisor > ceiling:
        divisor *= 1000
    return df.withColumn(column, F.floor(F.col(column) / F.lit(divisor)).cast("long")) if divisor > 1 else df


def before_epoch(df: DataFrame, cutoff: int | None, column: str = "timestamp") -> DataFrame:
    return df if cutoff is None else df.where(F.col(column) < cutoff)


def user_last_ts(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return df.groupBy(user).agg(F.max(ts).alias("last_ts"))


def active_users(df: DataFrame, start, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Whole histories of users whose last row is at or after ``start``."""
    active = user_last_ts(df, user, ts).where(F.col("last_ts") >= start)
    return lookup_join(df, active.select(user), user, "left_semi")


def semi_join(df: DataFrame, other: DataFrame, key: str = "item_id") -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def attach_counts(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Add ``item_count`` and ``user_count`` taken over ``counted`` (default: df itself).

    Counts are combined map-side and written, so that the adaptive skew join can split a
    hot item or user on the streamed side.
    """
    base = df if counted is None else counted
    item_counts = counts(base, "item_id", "item_count")
    user_counts = counts(base, "user_id", "user_count")
    return lookup_join(lookup_join(df, item_counts, "item_id"), user_counts, "user_id")


def min_interactions(df: DataFrame, n: int = 5, min_date: str | None = None) -> DataFrame:
    """Single-pass count filter.

    Item and user counts come from before the date filter; afterwards users need
    ``n`` remaining rows.  Items are not checked again.
    """
    recent = F.lit(True) if min_date is None else F.col("ts") >= ntz(min_date)
    # one pass over the log; all counts come from the numbers of rows per user and item
    pairs = df.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("n_recent"))
    pairs = materialize(pairs)
    item_ok = pairs.groupBy("item_id").agg(F.sum("n").alias("c")).where(F.col("c") >= n).select("item_id")
    left = pairs.join(item_ok.withColumn("ok", F.lit(True)), "item_id", "left").groupBy("user_id").agg(
        F.sum("n").alias("c"), F.sum(F.when(F.col("ok"), F.col("n_recent"))).alias("c_recent")
    )
    user_ok = left.where((F.col("c") >= n) & (F.col("c_recent") >= n))
    kept = lookup_join(df.where(recent), item_ok, "item_id", "left_semi")
    return lookup_join(kept, user_ok.select("user_id"), "user_id", "left_semi")


def profile(df: DataFrame, stage: str) -> DataFrame:
    """Number of rows, users and items from one scan; distinct keys are reduced map-side."""
    one = df.agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items")
    )
    return one.select(F.lit(stage).alias("stage"), F.expr("stack(3, 'points', points, 'users', users, 'items', items) as (metric, n)"))


def phase_domain_summary(df: DataFrame, phases: Sequence[str], domain: str = "domain") -> DataFrame:
    """Users, items and interactions per phase of each domain, in one row per domain."""
    once = materialize(df.groupBy(domain, "phase", "user_id", "item_id").agg(F.count(F.lit(1)).alias("n")))
    inter = once.groupBy(domain).pivot("phase", list(phases)).agg(F.sum("n").cast("long"))
    inter = inter.select(domain, *(F.coalesce(F.col(p), F.lit(0)).cast("long").alias(f"{p}_interactions") for p in phases))
    users = once.select(domain, "user_id").distinct().groupBy(domain).agg(F.count(F.lit(1)).alias("users"))
    items = once.select(domain, "item_id").distinct().groupBy(domain).agg(F.count(F.lit(1)).alias("items"))
    return inter.join(users, domain).join(items, domain)


def decay_popularity(df: DataFrame, threshold: str, half_life: float = 90, gamma: float = 0.2) -> DataFrame:
    """``(1 + sum(0.5 ** (days / half_life))) ** gamma`` per item, over rows before ``threshold``."""
    past = df.where(F.col("ts") < ntz(threshold))
    seconds = F.unix_micros(ntz(threshold).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    days = F.floor(seconds / F.lit(86400 * 1000000))
    weight = F.exp(-days * (F.log(F.lit(2.0)) / F.lit(float(half_life))))
    return past.groupBy("item_id").agg(F.pow(1 + F.sum(weight), F.lit(float(gamma))).alias("coeff"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """User and item numbers include the padding entry, also inside the sparsity."""
    wide = df.agg(
        F.count(F.lit(1)).alias("inter_num"),
        (F.count_distinct("user_id") + 1).alias("user_num"),
        (F.count_distinct("item_id") + 1).alias("item_num"),
    )
    inter, users, its = (F.col(c).cast("double") for c in ("inter_num", "user_num", "item_num"))
    return wide.select(
        "user_num",
        "item_num",
        "inter_num",
        F.when(users > 1, inter / (users - 1)).alias("avg_actions_of_users"),
        F.when(its > 1, inter / (its - 1)).alias("avg_actions_of_items"),
        (1 - inter / users / its).alias("sparsity"),
    )


def normalized_adjacency(df: DataFrame, user_num: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Edges of the bipartite graph in both directions with weight deg^-1/2 * deg^-1/2.

    Parallel edges stay separate rows.  Degrees are one row per node and written, so that
    the adaptive skew join can split a hot node.
    """
    edges = df.select(F.col(user).cast("long").alias("u"), (F.col(item).cast("long") + user_num).alias("i"))
    du = edges.groupBy("u").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("wu"))
    di = edges.groupBy("i").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("wi"))
    weighted = lookup_join(lookup_join(edges, du, "u", "inner"), di, "i", "inner").select("u", "i", (F.col("wu") * F.col("wi")).alias("weight"))
    both = F.explode(
        F.array(
            F.struct(F.col("u").alias("src"), F.col("i").alias("dst")),
            F.struct(F.col("i").alias("src"), F.col("u").alias("dst")),
        )
    )
    return weighted.select(both.alias("e"), "weight").select("e.src", "e.dst", "weight")
