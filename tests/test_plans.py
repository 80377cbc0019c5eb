"""Physical plans: early limits, pruning, pushdown, few shuffles."""

import os

import pytest
from pyspark.sql import functions as F

from recquarry.operators import clean, layout, merge as mg, metrics as mt, sequences as sq
from recquarry.plans.bindings import interactions, table
from recquarry.sources import files

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle(spark):
    p = plan(layout.top_k(table(spark, SF, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3))
    assert p.count("WindowGroupLimit") == 2


def test_cap_and_variants_limit_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1)], "user_id int, pos int")
    assert "WindowGroupLimit" in plan(sq.cap_per_user(df, 5))
    assert "WindowGroupLimit" in plan(sq.sample_variant(df, ["user_id"], ["pos"]))


def test_history_and_position_share_one_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 1)], "user_id int, item_id int, ts int")
    assert plan(sq.history_window(df)).count("hashpartitioning") == 1


def test_leave_last_out_reuses_the_user_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 1)], "user_id int, item_id int, ts int")
    assert plan(sq.last_items(df, 5)).count("hashpartitioning") == 1


def test_date_filter_reaches_the_scan(spark):
    path = files.fresh_path(spark, "pushdown")
    spark.range(10).select((F.col("id") * 10**11).alias("timestamp"), F.col("id").alias("x"), F.lit("unused").alias("y")).write.parquet(path)
    p = plan(clean.since(spark.read.parquet(path), "2001-01-01").select("x"))
    assert "GreaterThanOrEqual(timestamp" in p
    assert "ReadSchema: struct<timestamp:bigint,x:bigint>" in p


def test_log_reads_only_its_columns(spark):
    p = plan(interactions(spark, SF))
    assert "l_extendedprice" not in p and "o_totalprice" not in p


def test_all_models_meet_in_one_shuffle(spark):
    df = spark.createDataFrame([("a", "p", 0, [1.0])], "model string, param string, chunk long, values array<double>")
    assert plan(mg.extrapolate_acceleration(df, ["a", "b", "c"])).count("Exchange") == 1


def test_every_cutoff_in_one_pass(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "user_id int, rank int, hit long, pos_len long")
    p = plan(mt.top_metrics(df, mt.TOP_METRICS, (1, 5, 10)))
    # once by user for the running hits and the sums, once for the mean
    assert p.count("Exchange") == 2


def test_counts_combine_before_the_shuffle(spark):
    p = plan(clean.counts(interactions(spark, SF), "user_id", "n"))
    assert "partial_count" in p


def test_no_text_enters_the_user_window(spark):
    from recquarry.operators import examples as ex

    log = spark.createDataFrame([(1, 1, 1, "2022-01-01")], "user_id int, item_id int, extra int, t string").selectExpr(
        "user_id", "item_id", "cast(t as timestamp_ntz) as ts", "extra"
    )
    items = spark.createDataFrame([(1, "a", "b", "c")], "item_id int, title string, description string, sem_id string")
    made = ex.build_examples(log, items, [("pretrain", "2017-07-01", "2022-07-01"), ("test", "2022-07-01", "2023-01-01")])
    text = plan(made)
    windows = [line for line in text.splitlines() if " Window [" in line or "-Window [" in line]
    assert windows and not any("title" in w or "description" in w for w in windows)
    # below the first window nothing but the log is read: the catalogue joins above it
    assert text.index("Join") < text.index("Window [")
