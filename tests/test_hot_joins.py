"""A key with most of the rows is split in the joins with its own aggregate."""

import pytest
from pyspark.sql import functions as F

from recquarry.operators import clean, examples as ex

LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in LIMITS}
    for k, v in LIMITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def log(spark):
    # four fifths of the rows belong to one user and one item
    hot = (F.col("id") % 5 != 0)
    some = F.xxhash64("id") % 1000
    return spark.range(40_000).repartition(8).select(
        F.when(hot, 1).otherwise(some).alias("user_id"),
        F.when(hot, 1).otherwise(some).alias("item_id"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
    )


CASES = {
    "attach_counts": lambda df: clean.attach_counts(df),
    "active_users": lambda df: clean.active_users(df, clean.ntz("1970-01-01")),
    "min_interactions": lambda df: clean.min_interactions(df, 2),
    "normalized_adjacency": lambda df: clean.normalized_adjacency(df.select((F.abs("user_id") + 1).alias("user_id"), F.abs("item_id").alias("item_id")), 2000),
    "generation_turns": lambda df: ex.generation_turns(
        df.select(F.col("user_id").alias("conv_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text")), "title"
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_keys_are_split(tight, name):
    df = CASES[name](log(tight))
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
