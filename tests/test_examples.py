"""Texts of histories: neighbouring targets share lookups, and tasks are as large as the log's rows make them."""

import random

import pytest
from pyspark.sql import functions as F

from recquarry.operators import examples as ex, layout, sequences as sq
from recquarry.sources import files

PHASES = [("pretrain", "2017-07-01", "2022-07-01"), ("test", "2022-07-01", "2023-01-01")]


def catalog(spark, rows):
    return spark.createDataFrame(rows, "item_idx int, item_id int, title string, description string, sem_id string")


def log_of(spark, users, n):
    at = F.timestamp_seconds(F.lit(1640995200) + F.col("id") * 60).cast("timestamp_ntz")
    return spark.range(users * n).select((F.col("id") % users).cast("int").alias("user_id"), (F.col("id") * 7 % 11).cast("int").alias("item_id"), at.alias("ts"))


def test_a_reference_is_looked_up_once_a_packet(spark, monkeypatch):
    asked = []
    look = ex.lookup_join
    monkeypatch.setattr(ex, "lookup_join", lambda df, *a: asked.append(df.count()) or look(df, *a))
    items = catalog(spark, [(i, i, f"t{i}", f"d{i}", f"s{i}") for i in range(11)])
    made = ex.build_examples(log_of(spark, 3, 100), items, [("phase1", "2017-07-01", "2023-01-01")])
    assert made.count() == 3 * 96
    # one row per position, not one per target and entry of its history
    assert asked == [3 * 100]


@pytest.mark.parametrize("packet", [1, 3, 128])
def test_any_histories_get_their_texts(spark, monkeypatch, packet):
    """Also such that are no windows of one log, with repeats, nulls, unknown items and items listed twice."""
    monkeypatch.setattr(ex, "PACKET", packet)
    r = random.Random(packet)
    listed = [(1, "a", None, "x"), (2, "b", "c", "y"), (2, "b", "b", "y"), (None, "n", "n", "n")]
    known = {1: [("a", "NA", "x")], 2: [("b", "b", "y"), ("b", "c", "y")]}
    draw = lambda n: [r.choice([1, 2, 3, None]) for _ in range(n)]
    data = [(u, p, v, r.choice([1, 2, 3, None]), draw(r.randrange(5))) for u in (1, 2, None) for p in range(1, 9) for v in range(r.randrange(3))]
    targets = spark.createDataFrame(
        [(u, p, v, i, [(h,) for h in hs]) for u, p, v, i, hs in data], "user_id int, pos long, variant int, item_id int, history array<struct<item_id: int>>"
    )
    items = catalog(spark, [(i, *x) for i, x in enumerate(listed)])
    texts = lambda i: [(i, *t) for t in known.get(i, [("NA",) * 3])]
    want = {}
    for u, p, v, i, hs in data:
        every = [t for h in [*hs, i] for t in texts(h)]
        want[u, p, v] = i, every[:-1], every[-1]
    for tasks in (None, 3):
        got = ex.with_texts(targets, items, tasks=tasks).collect()
        assert {(g.user_id, g.pos, g.variant): (g.item_id, [tuple(h) for h in g.history], tuple(g.info)) for g in got} == want


def test_histories_are_spread_by_the_rows_of_the_log(spark, monkeypatch):
    monkeypatch.setattr(layout, "LIST_ROWS", 50)
    log = log_of(spark, 40, 10)
    plain = lambda df: sorted((r["user_id"], r["pos"], tuple(r["history"])) for r in df.collect())
    h = ex.id_histories(log, 4).withColumn("history", F.col("history.item_id"))
    assert "hashpartitioning(user_id" in (p := h._jdf.queryExecution().executedPlan().toString()) and ", 8), REPARTITION_BY_NUM" in p
    assert plain(h) == plain(sq.history_window(log, 4, limit=5, block=6, sizes=layout.key_sizes(log, ["user_id"])))


def test_only_the_first_phase_is_capped(spark):
    items = catalog(spark, [(i, i, f"t{i}", f"d{i}", f"s{i}") for i in range(11)])
    log = log_of(spark, 2, 40)
    half = [("pretrain", "2017-07-01", "2022-01-01 00:40:00"), ("phase1", "2022-01-01 00:40:00", "2023-01-01")]
    for n, kept in ((0, 0), (3, 6), (None, 2 * 16)):
        got = ex.build_examples(log, items, half, max_user_sample=n).groupBy("phase").count().collect()
        assert dict(map(tuple, got)) == {"phase1": 40} | ({"pretrain": kept} if kept else {})


def test_equal_times_keep_a_users_examples_together(spark):
    path = files.fresh_path(spark, "examples")
    df = spark.createDataFrame([("d", "a", t, u) for u in (2, 1, 3) for t in (5, 3) for _ in (0, 1)], "domain string, phase string, timestamp long, user_id long")
    files.write_examples(df.repartition(4).coalesce(1), path)
    back = spark.read.json(f"{path}/domain=d/phase=a").collect()
    assert [(r["timestamp"], r["user_id"]) for r in back] == [(t, u) for t in (3, 5) for u in (1, 1, 2, 2, 3, 3)]
