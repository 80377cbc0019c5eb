"""Uniform negatives through the gaps of the rejected ids, and histories kept whole."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recquarry.operators import sequences as sq

few = settings(max_examples=6, deadline=None)


def allowed_by_hand(key, pool, reject):
    free = [x for x in range(1, pool + 1) if x not in set(reject)]
    if not free:
        return None
    return free[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % len(free)]


@given(st.lists(st.lists(st.integers(-2, 45), max_size=40), min_size=1, max_size=12), st.integers(2, 41))
@few
def test_draws_are_ranks_among_the_allowed(spark, lists, item_num):
    df = spark.createDataFrame(list(enumerate(lists)), "user_id int, s array<bigint>")
    got = {r["user_id"]: r["n"] for r in df.select("user_id", sq.negatives(7, item_num, "s", "t", "user_id").alias("n")).collect()}
    for u, s in enumerate(lists):
        assert got[u] == [allowed_by_hand(f"t#{u}#{j}", item_num - 1, s) for j in range(1, 8)]


def test_allowed_ids_are_equally_likely(spark):
    # the rejected ids lie together, where walking on from them would favour the next one
    reject = list(range(5, 25))
    df = spark.range(4000).select("id", F.lit(reject).cast("array<bigint>").alias("s"))
    drawn = df.select(F.explode(sq.negatives(5, 41, "s", "c", "id")).alias("x")).groupBy("x").count().collect()
    counts = Counter({r["x"]: r["count"] for r in drawn})
    free = [x for x in range(1, 41) if x not in reject]
    assert set(counts) == set(free)
    expected = 20_000 / len(free)
    chi2 = sum((counts[x] - expected) ** 2 / expected for x in free)
    assert chi2 < 43.8  # 99.9 % of 19 degrees of freedom


@pytest.mark.parametrize("limit", [None, 3])
def test_whole_histories_are_avoided(spark, limit):
    log = {1: [3, 3, 7, 1], 2: list(range(1, 30)), 3: [99, 0], 4: [5]}
    rows = [(u, x) for u, xs in log.items() for x in xs]
    df = spark.createDataFrame(rows, "user_id int, item int")
    got = {(r["user_id"], r["slot"]): r["item"] for r in sq.whole_history_negatives(df, 6, 30, "w", item="item", limit=limit).collect()}
    want = {(u, j): allowed_by_hand(f"w#{u}#{j}", 29, xs) for u, xs in log.items() if u != 2 for j in range(1, 7)}
    assert got == want


@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 30))
@few
def test_pages_hold_everything_and_give_the_tail(spark, n, page, length):
    df = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    df = df.unionByName(df.where("item_id < 3").withColumn("user_id", F.lit(2)))
    for limit in (None, 2):
        pages = sq.paged_sequences(df, page, limit=limit)
        rows = pages.where("user_id = 1").orderBy("page").collect()
        assert [x for r in rows for x in r["items"]] == list(range(n))
        assert all(r["n_pages"] == len(rows) and r["len"] == n and len(r["items"]) <= page for r in rows)
        tails = {r["user_id"]: r for r in sq.sequence_tail(pages, length, page).collect()}
        assert tails[1]["items"] == list(range(n))[-length:] and len(tails[1]["times"]) == min(n, length)
        assert tails[2]["items"] == list(range(min(n, 3)))[-length:]
