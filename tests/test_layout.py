"""Skew-safe helpers: the hot path must equal plain windows and sorts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from recquarry.operators import layout, sequences as sq


@pytest.fixture(scope="module")
def log(spark):
    """A third of all rows belongs to user 1; ties and full copies included."""
    r = random.Random(3)
    data = [(1 if i % 3 == 0 else r.randrange(2, 40), r.randrange(12), r.randrange(60)) for i in range(1500)]
    data += data[:60]
    return spark.createDataFrame(data, "user_id int, item_id int, t int").withColumn(
        "ts", F.timestamp_seconds(F.col("t") * 3600).cast("timestamp_ntz")
    )


def test_index_rows(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("x"))
    got = layout.index_rows(df, ["x"], "i")
    assert all(x == i for x, i in rows(got, "x", "i"))
    assert got.count() == 1000


@pytest.mark.parametrize("block", [40, 97, 5000])
def test_history_hot_path(log, block):
    plain = sq.history_window(log, 30)
    hot = sq.history_window(log, 30, limit=100, block=block)
    cols = ["user_id", "pos", "len", "item_id", F.concat_ws(",", "history").alias("h")]
    assert rows(plain, *cols) == rows(hot, *cols)
    assert hot.count() == log.count()


def test_gap_hot_path(log):
    cols = ["user_id", "pos", "gap", "bucket"]
    assert rows(sq.time_gap_bucket(log), *cols) == rows(sq.time_gap_bucket(log, limit=100, block=33), *cols)


@pytest.mark.parametrize("fn", [sq.chunk_sequences, sq.user_sequences])
def test_collectors_hot_path(log, fn):
    def text(df):
        return sorted(str(r) for r in df.drop("times", "time_seq").collect())

    assert text(fn(log)) == text(fn(log, limit=100))


def test_last_items_hot_path(log):
    cols = ["user_id", "target", "len", F.concat_ws(",", "history").alias("h")]
    assert rows(sq.last_items(log, 9), *cols) == rows(sq.last_items(log, 9, limit=100), *cols)


def test_user_sequences_pages(log):
    s = sq.user_sequences(log, page=25, limit=100)
    assert s.agg(F.max(F.size("items"))).first()[0] == 25
    assert s.agg(F.sum(F.size("items"))).first()[0] == log.count()


def test_running_sums_hot_path(log):
    df = log.groupBy("user_id", "t").agg(F.count(F.lit(1)).alias("n"))
    plain = layout.running_sums(df, ["user_id"], [F.col("t").desc()], {"s": "n"})
    hot = layout.running_sums(df, ["user_id"], [F.col("t").desc()], {"s": "n"}, limit=20)
    assert rows(plain, "user_id", "t", "s") == rows(hot, "user_id", "t", "s")


def test_average_rank_hot_path(log):
    cols = ["user_id", "t", "ties", "avg_rank"]
    assert rows(sq.average_rank(log, ["user_id"], "t"), *cols) == rows(sq.average_rank(log, ["user_id"], "t", limit=20), *cols)


def test_null_keys_stay_on_one_side(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [(1, 5)], "k int, v int")
    got = layout.window_blocks(df, ["k"], ["v"], limit=10)
    assert got.count() == 31
    assert got.where("k is null").agg(F.max("_pos")).first()[0] == 30


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 0.8, 1.0])
def test_kth_smallest(spark, rate):
    rng = np.random.default_rng(5)
    a = np.round(rng.standard_normal(997), 2).tolist()
    b = [7.0] * 300 + [1e9, -1e9]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "k string, v double")
    for limit in (None, 5):
        got = {r["k"]: r["kth"] for r in layout.kth_smallest(df, ["k"], "v", rate, buckets=16, limit=limit).collect()}
        for key, values in (("a", a), ("b", b)):
            k = int(len(values) * rate)
            assert got[key] == (sorted(values)[k - 1] if k else None)


def test_broadcast_bound(spark):
    small, large = spark.range(5), spark.range(500)
    marked = layout.broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString()
    plain = layout.broadcast_if_small(large, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in marked.lower() and "broadcast" not in plain.lower()
