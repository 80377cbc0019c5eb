"""Work that is done once, in bounded parts, and without moving vectors or texts more than needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recquarry.operators import layout, sequences as sq, tokens as tk, vectors as vc


def counted(spark, df):
    """The rows, in a shuffle of their own, and a counter of how often they were made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema).repartition(3, df.columns[0]), made


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric, rescale", [("l2", False), ("l2", True), ("l2sq", False), ("dot", False), ("cosine", False)])
def test_full_lists_do_not_compute_every_key(monkeypatch, metric, rescale):
    rng = np.random.default_rng(5)
    # far from zero and close together, where single precision alone would mix up the order
    v = 300 + rng.standard_normal((200, 8)) * 1e-2
    coeff = rng.random(200) + 0.5 if rescale else None
    q = 300 + rng.standard_normal((12, 8)) * 1e-2
    starts, size = np.arange(0, 12, 3), 20
    asked = []
    keys = vc.RunningBest.keys
    monkeypatch.setattr(vc.RunningBest, "keys", lambda self, queries, block: asked.append(len(queries)) or keys(self, queries, block))
    best = vc.RunningBest(q, starts, 5, metric)
    gone = np.array([0, 1, 2, 3]), np.array([3, 3, 0, 7])
    for at in range(0, 200, size):
        ids = np.arange(at, at + size)
        best.add(vc.item_block(ids, ids, v[ids], None if coeff is None else coeff[ids], metric), gone)
    assert asked == [4]
    n_q, n_v = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    key = {"l2": n_q[:, None] + n_v - 2 * q @ v.T, "l2sq": n_q[:, None] ** 2 + n_v**2 - 2 * q @ v.T, "dot": -q @ v.T, "cosine": -q @ v.T / n_q[:, None] / n_v}[metric]
    key = (key / (1 if coeff is None else coeff)).reshape(4, 3, -1).min(axis=1)
    for i, c in zip(*gone):
        key[i, c::size] = np.inf
    want = np.sort(key, axis=1)[:, :5]
    assert np.allclose(best.key.reshape(4, 5), want, atol=1e-8) and not {(i, x % size) for i, x in zip(best.query, best.ids)} & set(zip(*gone))


def test_negatives_meet_anchors_without_shuffled_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((30, 4)))], "item_id long, vector array<double>")
    anchors = spark.createDataFrame([(a, rng.standard_normal(4).tolist(), a % 30) for a in range(9)], "anchor_id long, vector array<double>, positive long")
    pairs = spark.createDataFrame([(a, (a * 7 + j) % 33) for a in range(9) for j in range(12)], "anchor_id long, item_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for limit, slices in ((1 << 20, 1), (400, 3)):
            monkeypatch.setattr(vc, "CATALOG_BYTES", limit)
            r = vc.hard_negative_report(anchors, pairs, vectors, 0.3, (1, 5))
            assert plan(r).count("BroadcastHashJoin") == slices
            found.append([round(x, 9) for x in r.first()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1] and found[0][0] > 1


@pytest.mark.parametrize("rows", [5, layout.HOT_ROWS + 1])
def test_means_of_small_groups_come_together_first(spark, rows):
    df = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(9)], "g long, embedding array<double>")
    m = vc.mean_pool(df, "g", sizes=layout.KeySizes(9, rows))
    assert ("REPARTITION_BY_COL" in plan(m)) == (rows == 5)
    assert {r["g"]: list(r["embedding"]) for r in m.collect()} == {0: [3.0, 1.0], 1: [4.0, 1.0], 2: [5.0, 1.0]}


def test_a_tokenizer_gets_parts_of_a_batch(spark, monkeypatch):
    import pandas as pd

    texts = pd.Series(["abc", None, "defg", "x" * 20, "h"])
    assert list(tk.parts(iter([texts, texts[:0]]), 7)) == [["abc", "", "defg"], ["x" * 20], ["h"], []]
    monkeypatch.setattr(tk, "PART_CHARS", 50)
    df = spark.range(300).select("id", F.concat_ws(" ", F.lit("a"), F.repeat(F.lit("b "), F.col("id").cast("int"))).alias("t"))
    got = df.select("id", tk.tokenize("t")["ends"].alias("e")).collect()
    assert {r["id"]: len(r["e"]) for r in got} == {i: i + 1 for i in range(300)}


def test_batches_make_their_rows_once(spark):
    df, made = counted(spark, spark.range(60).select("id", (F.col("id") % 5 + 1).alias("n")))
    rows = tk.assign_batches(df, "n", ["id"], 9).orderBy("id").collect()
    assert [r["n"] for r in rows] == [i % 5 + 1 for i in range(60)] and made.value == 60


def test_sums_of_lists_continue_each_other(spark):
    lists = [[1, 3, 6], [], [2], [0, 4]]
    made = spark.createDataFrame([(lists,), ([],)], "p array<array<bigint>>").select(tk.cumulative(F.col("p")).alias("c")).collect()
    assert [list(r["c"]) for r in made] == [[0, 1, 3, 6, 8, 8, 12], [0]]


def test_negatives_read_the_history_once(spark):
    df, made = counted(spark, spark.range(90).select((F.col("id") % 7).alias("user_id"), (F.col("id") % 11).alias("item")))
    got = sq.whole_history_negatives(df, 3, 30, "w", item="item", sizes=layout.KeySizes(90, 13)).collect()
    held = {(i % 7, i % 11) for i in range(90)}
    assert len(got) == 21 and made.value == 90 and not {(r["user_id"], r["item"]) for r in got} & held


def test_tokens_are_counted_down_as_they_are(spark):
    df = spark.createDataFrame([(30, 5), (4, 7), (4, None), (100, 5), (30, 9), (None, 6)], "item_id long, s long")
    df = df.select("item_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    ids = sq.dense_ids(df, "item_id")
    # a missing time comes first, equal times by text
    assert sorted((r["id"], r["token"]) for r in ids.collect()) == [(0, "[PAD]"), (1, "4"), (2, "100"), (3, "30"), (4, None)]
