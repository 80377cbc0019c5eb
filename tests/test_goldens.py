"""Hand-worked cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from recquarry.functions import arrays as ax, codes as cx, text as tx, vectors as vx
from recquarry.operators import clean, codes as cd, examples as ex, merge as mg, metrics as mt, sequences as sq, vectors as vc


def values(df):
    return {(r["metric"], r["k"]): r["value"] for r in df.collect()}


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def arr(*xs, kind="bigint"):
    return F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>")


@pytest.fixture(scope="module")
def ranks(spark):
    hits = {"u0": [0, 1, 0, 1, 0], "u1": [0, 0, 0, 0, 0], "u2": [1, 0, 0, 1, 1]}
    pos = {"u0": 2, "u1": 1, "u2": 4}
    data = [(u, i + 1, h, pos[u]) for u, hs in hits.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(data, "user_id string, rank int, hit long, pos_len long")


def test_ranking_metrics(ranks):
    got = values(mt.top_metrics(ranks, mt.TOP_METRICS, (3, 5)))
    want = {
        3: dict(hit=0.666667, mrr=0.5, map=0.194444, recall=0.25, ndcg=0.285377, precision=0.222222),
        5: dict(hit=0.666667, mrr=0.5, map=0.341667, recall=0.583333, ndcg=0.453483, precision=0.333333),
    }
    for k, ms in want.items():
        for m, v in ms.items():
            assert got[(m, k)] == pytest.approx(v, abs=1e-6)


def test_generation_metrics(ranks):
    got = values(mt.generation_metrics(ranks, (3, 5)))
    want = {("NDCG", 3): 54.364325, ("Recall", 3): 66.666667, ("MRR", 3): 50.0, ("NDCG", 5): 95.971189, ("Recall", 5): 166.666667, ("MRR", 5): 73.333333}
    for key, v in want.items():
        assert got[key] == pytest.approx(v, abs=1e-6)


def test_diversity_metrics(spark):
    lists = spark.createDataFrame(
        [(u, i + 1, x) for u, xs in enumerate([[1, 2, 3], [1, 2, 4], [1, 5, 3]]) for i, x in enumerate(xs)],
        "user_id int, rank int, item_id int",
    )
    counts = spark.createDataFrame([(1, 10), (2, 5), (3, 4), (4, 3), (5, 2), (6, 1), (7, 1)], "item_id int, count long")
    got = values(mt.list_metrics(lists, mt.LIST_METRICS, (2, 3), 8, counts, 0.5))
    want = {
        2: (0.375, 7.0, 0.337135, 0.708333, 0.166667),
        3: (0.625, 5.888889, 0.304591, 0.513889, 0.111111),
    }
    for k, vs in want.items():
        for m, v in zip(mt.LIST_METRICS, vs):
            assert got[(m, k)] == pytest.approx(v, abs=1e-6), (m, k)


def test_tail_items(spark):
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([5, 1, 1, 9, 3])], "item_id int, count long")
    assert rows(mt.tail_items(counts, 0.1)) == [(1,)]
    assert rows(mt.tail_items(counts, 0.5)) == [(1,), (2,)]
    assert rows(mt.tail_items(counts, 3)) == [(1,), (2,), (4,)]


def test_value_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)], "truth int, score double")
    assert mt.auc(df).first()["value"] == pytest.approx(0.583333, abs=1e-6)
    got = values(mt.errors(df, ["mae", "rmse", "logloss"]))
    assert got[("mae", None)] == pytest.approx(0.46)
    assert got[("rmse", None)] == pytest.approx(0.563915, abs=1e-6)
    assert got[("logloss", None)] == pytest.approx(0.91944, abs=1e-6)
    assert math.isnan(mt.auc(df.where("truth = 1")).first()["value"])


def test_logloss_clips(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "truth int, score double")
    assert math.isfinite(mt.errors(df, ["logloss"]).first()["value"])


@pytest.mark.parametrize("limit", [None, 1])
def test_gauc(spark, limit):
    data = [("u1", s, p) for s, p in ((5, 0), (4, 1), (4, 0), (1, 1))] + [("u2", 3, 1), ("u2", 2, 0), ("u3", 1, 1), ("u4", 2, 0)]
    df = spark.createDataFrame([(u, i, float(s), p) for i, (u, s, p) in enumerate(data)], "user_id string, item_id int, score double, positive int")
    assert mt.gauc(mt.collect_mean_ranks(df, limit=limit)).first()["value"] == pytest.approx(0.416667, abs=1e-6)


def test_average_rank(spark):
    data = [(0, x) for x in (1, 2, 2, 2, 3, 3, 6)] + [(1, x) for x in (2, 2, 2, 2, 4, 5, 5)]
    df = spark.createDataFrame(data, "g int, s int")
    r = df.join(sq.average_rank(df, ["g"], "s", descending=False), ["g", "s"])
    assert [float(x) for g, s, x in rows(r, "g", "s", "avg_rank") if g == 0] == [1, 3, 3, 3, 5.5, 5.5, 7]
    assert [float(x) for g, s, x in rows(r, "g", "s", "avg_rank") if g == 1] == [2.5, 2.5, 2.5, 2.5, 5, 6.5, 6.5]


def test_decay_popularity(spark):
    df = spark.sql(
        "select 1 as item_id, ts from values (timestamp_ntz'2022-12-31 22:00:00'), (timestamp_ntz'2022-12-02'), (timestamp_ntz'2023-01-01') t(ts)"
    )
    assert clean.decay_popularity(df, "2023-01-01", 30, 0.25).first()["coeff"] == pytest.approx(1.257433, abs=1e-6)


def test_count_filter(spark):
    df = spark.sql(
        "select user_id, item_id, cast(ts as timestamp_ntz) as ts from values ('A','x','2019-01-01'),('A','y','2021-01-01'),('B','x','2021-01-01'),('B','y','2021-01-02') t(user_id,item_id,ts)"
    )
    assert rows(clean.min_interactions(df, 2, "2020-01-01"), "user_id", "item_id") == [("B", "x"), ("B", "y")]


def test_epoch(spark):
    ms = spark.createDataFrame([(1672531200000,), (1600000000999,)], "timestamp long")
    assert rows(clean.normalize_epoch(ms)) == [(1600000000,), (1672531200,)]
    s = spark.createDataFrame([(1672531200,)], "timestamp long")
    assert rows(clean.normalize_epoch(s)) == [(1672531200,)]


def test_stats_and_adjacency(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id int, item_id int")
    r = clean.dataset_stats(df).first()
    assert (r["user_num"], r["item_num"], r["inter_num"]) == (3, 3, 3)
    assert r["avg_actions_of_users"] == r["avg_actions_of_items"] == 1.5
    assert r["sparsity"] == pytest.approx(0.666667, abs=1e-6)
    adj = {(a, b): w for a, b, w in rows(clean.normalized_adjacency(df, 10))}
    assert len(adj) == 6
    assert adj[(1, 11)] == adj[(11, 1)] == pytest.approx(0.5)
    assert adj[(1, 12)] == adj[(2, 11)] == pytest.approx(0.707107, abs=1e-6)


def log_of(spark, n, start=0, step=3600):
    data = [(1, i + 1, start + i * step) for i in range(n)]
    return spark.createDataFrame(data, "user_id int, item_id int, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


@pytest.mark.parametrize("n,want", [(8, [[3, 4, 5], [6, 7, 8]]), (6, [[1, 2, 3], [4, 5, 6]]), (3, [[1, 2, 3]]), (2, [[1, 2]])])
def test_chunks(spark, n, want):
    c = sq.chunk_sequences(log_of(spark, n), 2)
    assert [r["item_seq"] for r in c.orderBy("chunk").collect()] == want


def test_prefixes(spark):
    c = spark.createDataFrame([(1, 0, [3, 4, 5]), (2, 0, [1])], "user_id int, chunk long, item_seq array<int>")
    assert [r["item_seq"] for r in sq.prefix_augment(c).orderBy("n").collect()] == [[3, 4], [3, 4, 5]]


def test_padding(spark):
    assert one(spark, sq.pad_left(arr(7, 8), 5)) == [0, 0, 0, 7, 8]
    assert one(spark, sq.pad_left(arr(*range(1, 8)), 5)) == [3, 4, 5, 6, 7]
    assert one(spark, sq.pad_left(arr(7, 8), 4, arr(1, 2, 3, 4))) == [3, 4, 7, 8]


def test_next_items(spark):
    c = spark.createDataFrame([(1, 0, [1, 2, 3, 4, 5, 6])], "user_id int, chunk long, item_seq array<int>")
    assert [(r["input"], r["target"]) for r in sq.next_item_pairs(c).orderBy("step").collect()] == [(i, i + 1) for i in range(1, 6)]
    assert one(spark, sq.next_item_mask(arr(*range(1, 7)), 6)) == [1] * 5
    assert one(spark, sq.next_item_mask(arr(1, 2), 6)) == [0, 0, 0, 0, 1]
    assert one(spark, sq.next_item_mask(arr(1), 3)) == [0, 0]


def test_calendar(spark):
    assert one(spark, sq.calendar_features(arr(0, 86399))) == [[1970, 1, 1, 0, 0, 0], [1970, 1, 1, 23, 59, 59]]


def test_time_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 10)], "user_id int, item_id int, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    assert rows(sq.time_gap_bucket(df), "pos", "gap", "bucket") == [(1, 2, 2), (2, 8, 6), (3, 0, 0)]
    m = one(spark, sq.time_gap_matrix(arr(0, 2, 10)))
    assert [len(r) for r in m] == [1, 2, 3] and [m[i][i] for i in range(3)] == [2, 6, 0]


def test_codes(spark):
    assert one(spark, cx.parse_sem_id(F.lit("<a_1><b_2><c_3><d_4>"))) == [1, 2, 3, 4]
    assert one(spark, cx.parse_sem_id(F.lit("<a_1><c_300><d_4>"))) == [1, -1, -1, 4]
    assert one(spark, cx.parse_sem_id(F.lit("<a_1><a_7> <ab_3><z_1><b_99999999999>"))) == [7, -1, -1, -1]
    assert one(spark, cx.format_sem_id(arr(1, 2, 3, 4, kind="int"))) == "<a_1><b_2><c_3><d_4>"
    assert one(spark, cx.code_to_token(F.lit(3), F.lit(255))) == 151669 + 1023
    assert tuple(one(spark, cx.token_to_code(F.lit(151669 + 257)))) == (1, 1)
    assert one(spark, cx.token_to_code(F.lit(5))) is None
    s = cx.START_ID
    assert one(spark, cx.code_tail(arr(s, 5, s + 1, s + 300))) == [s + 1, s + 300]
    assert one(spark, cx.code_tail(arr(s, s, s, s, s + 9))) == [s, s, s, s + 9]
    assert one(spark, cx.code_tail(arr(s, 7))) == []
    assert one(spark, cx.code_tail(arr())) == []


def test_collisions(spark):
    near = spark.createDataFrame(
        [(5, [5, 6, 7, 8]), (6, [6, 5, 8, 7]), (7, [7, 8, 6, 5]), (8, [8, 7, 6, 5])], "code int, neighbors array<int>"
    )
    last = [5, 5, 5, 6, 5, 8]
    codes = spark.createDataFrame([(i, [1, 2, c]) for i, c in enumerate(last)] + [(9, [1, 3, 5])], "item_idx long, codes array<int>")
    got = {i: c for i, c in rows(cd.resolve_collisions(codes, near), "item_idx", "codes")}
    # four codes are used up by the first four items; the others keep their own
    assert [got[i][2] for i in range(6)] == [5, 6, 7, 8, 5, 8]
    assert got[9] == [1, 3, 5]


def test_distances(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 4.0])], "item_id string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")

    def order(**kw):
        return [(r["item_id"], r["score"]) for r in vc.rank_catalog(q, kw.pop("items", items), 3, **kw).orderBy("rank").collect()]

    assert order(metric="l2") == [("a", 0.0), ("c", 0.0), ("b", 3.0)]
    assert order(metric="l2sq") == [("a", 0.0), ("b", 5.0), ("c", 20.0)]
    assert order(metric="cosine") == [("a", 1.0), ("c", 0.6), ("b", 0.0)]
    seen = spark.createDataFrame([(1, "a")], "query_id int, item_id string")
    assert [x for x, _ in order(metric="l2", exclude=seen)] == ["c", "b"]
    pop = items.withColumn("coeff", F.expr("case item_id when 'a' then 1.0D when 'b' then 2.0D else 0.0D end"))
    assert order(metric="l2", items=pop, rescale=True) == [("a", 0.0), ("b", 1.5), ("c", math.inf)]


def ckpt(spark, **models):
    data = [(m, "w", 0, [float(x) for x in v]) for m, v in models.items()]
    return spark.createDataFrame(data, "model string, param string, chunk long, values array<double>")


def test_temporal_fusion(spark):
    c = ckpt(spark, base=[0.5], m1=[1], m2=[2], m3=[4])
    steps = ["m1", "m2", "m3"]
    first = lambda df: df.first()["values"][0]
    assert first(mg.extrapolate_linear(c, steps, 1.0)) == 6
    assert first(mg.extrapolate_moving_average(c, steps, 1.0)) == 5.5
    assert first(mg.extrapolate_acceleration(c, steps)) == 6.5
    assert first(mg.fuse_decay(c, "base", steps)) == pytest.approx(2.557377, abs=1e-6)
    for fn, n in ((mg.extrapolate_linear, 1), (mg.extrapolate_acceleration, 2)):
        with pytest.raises(ValueError):
            fn(c, steps[:n])


def test_ties(spark):
    c = ckpt(spark, base=[0] * 6, target=[4, -2, 0.2, 3, -1, 0], source=[2, 3, 0.4, -1, -5, 0.1])
    got = mg.ties_merge(c, "base", ["target", "source"], 0.5).first()["values"]
    assert got == pytest.approx([1.5, 1.5, 0, 1.5, -1.5, 0])
    with pytest.raises(ValueError):
        mg.ties_merge(c, "base", ["target"])


def test_magnitude_mask(spark):
    v = ckpt(spark, m=[0.5, -0.1, 0.3, -0.2, 0.9]).drop("model")
    assert mg.mask_magnitude(v, 0.4).first()["values"] == pytest.approx([0.833333, 0, 0.5, 0, 1.5], abs=1e-6)
    assert mg.mask_magnitude(v, 0.0).first()["values"] == pytest.approx([0.5, -0.1, 0.3, -0.2, 0.9])
    with pytest.raises(ValueError):
        mg.mask_magnitude(v, 1.5)


def test_missing_parameter_is_an_error(spark):
    c = ckpt(spark, base=[1], a=[2]).unionByName(
        spark.createDataFrame([("base", "x", 0, [1.0])], "model string, param string, chunk long, values array<double>")
    )
    with pytest.raises(Exception, match="lacks parameter"):
        mg.task_vector(c, "base", "a").collect()
    with pytest.raises(Exception, match="only one vector"):
        a, b = mg.model_rows(c, "base"), mg.model_rows(c, "a")
        mg.add_vectors(a, b).collect()
    assert rows(mg.missing_params(c, ["base", "a"])) == [("a", "x")]
    # averaging uses the models that have it
    assert dict((r["param"], r["values"]) for r in mg.average_merge(c, ["base", "a"]).collect()) == {"w": [1.5], "x": [1.0]}


def test_run_name(spark):
    def name(targets, splits, args=None):
        t, s = F.array(*map(F.lit, targets)), F.array(*map(F.lit, splits))
        return one(spark, mg.merged_name(F.lit("sem_id"), F.lit("Movies_and_TV"), t, s, F.lit("ties_merging"), args))

    assert name(["Video_Games"], ["phase2"]) == "merged-Mov-Vid-phase2-sem_id-ties"
    assert name(["Video_Games"], ["phase2"], F.create_map().cast("map<string,string>")) == "merged-Mov-Vid-phase2-sem_id-ties-"
    assert name(["Video_Games"], ["pretrain", "phase1"]) == "merged-Mov-pretrainphase1-sem_id-ties"
    with pytest.raises(Exception, match="several"):
        name(["A", "B"], ["x", "y"])


def test_truncation(spark):
    t = lambda title, text, n: one(spark, tx.truncate_description(F.lit(title), F.lit(text), n))
    assert t("red ", "one two three", 64) == "one two three"
    assert t("red ", "one two three", 2) == "one..."
    # a title that was cut itself: the truncated text stands in
    assert t("very long title ", "text", 2) == "very long..."
    assert t("red ", "one  two ", 64) == "one  two "


def test_fixed_decimals(spark):
    xs = [0.0, 0.15, 0.25, 0.35, 2.5, 1e-9, -1.005, 999.9995, 1234.5, 0.0005, 0.0015, -0.0005, 1e16, 2.0005, 62.5 / 1000, 10003.93125]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for p in (1, 3, 4):
        got = dict((r["x"], r["t"]) for r in df.select("x", tx.fixed_decimals("x", p).alias("t")).collect())
        for x in xs:
            assert got[x] == f"{x:.{p}f}", (x, p)


def test_scores(spark):
    assert [one(spark, ax.truncate_score(F.lit(x), m)) for x, m in ((1.2, "ceil"), (1.8, "floor"), (2.5, "around"), (3.5, "around"))] == [2, 1, 2, 4]
    assert one(spark, ax.cut_off(F.lit(0.5), 0.5)) == 0
    assert one(spark, ax.pad_ragged(arr(1, 2), 4)) == [1, 2, -math.inf, -math.inf]


def test_l2_normalize(spark):
    assert one(spark, vx.l2_normalize(arr(3.0, 4.0, kind="double"))) == pytest.approx([0.6, 0.8])
    assert one(spark, vx.l2_normalize(arr(0.0, 0.0, kind="double"))) == [0, 0]


def test_pack_tokens(spark):
    p = one(spark, tx.pack_tokens(F.array(arr(5, 6), arr(7), arr()), 3, 1))
    assert p["ids"] == [5, 6, 0, 7, 0, 0]
    assert p["lengths"] == [3, 2, 1]
    assert p["positions"] == [1, 2, 3, 2, 3, 3]


def test_generation_prompt(spark):
    m = F.array(tx.message("user", F.lit("q")), tx.message("assistant", F.lit("a")))
    got = one(spark, tx.generation_prompt(m, "sem_id"))
    assert [tuple(x) for x in got] == [("user", "q"), ("assistant", "Recommended Item Index: ")]


def test_hits_are_substrings(spark):
    df = spark.createDataFrame([(1, ["<a_1><b_2>", "x"], "<a_1>"), (2, ["y"], None)], "user_id int, output array<string>, t string")
    assert rows(mt.hits_of_outputs(df, ["user_id"], "output", "t")) == [(1, 1, 1), (1, 2, 0), (2, 1, 0)]
    assert rows(mt.hits_of_outputs(df, ["user_id"], "output", "t", exact=True)) == [(1, 1, 0), (1, 2, 0), (2, 1, 0)]


def test_metric_registry():
    assert mt.needed_inputs(["recall", "gauc"]) == {"rec.topk", "rec.meanrank"}
    assert {n for n, m in mt.METRICS.items() if m["smaller"]} == {"mae", "rmse", "logloss", "averagepopularity", "giniindex"}
    with pytest.raises(ValueError, match="together"):
        mt.needed_inputs(["recall", "auc"])
    with pytest.raises(ValueError, match="unknown"):
        mt.needed_inputs(["nope"])


def test_unseen_rank(spark):
    order = spark.createDataFrame([(i, i) for i in range(1, 8)], "item_id int, rank long")
    targets = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "user_id int, item_id int")
    seen = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 7), (2, 3)], "user_id int, item_id int")
    assert rows(mt.rank_without_seen(targets, seen, order)) == [(1, 5, 3), (2, 3, None), (3, 2, 2)]


def test_build_examples_small(spark):
    items = spark.createDataFrame([(i, i, f"t{i}", f"d{i}", f"<a_{i}>") for i in range(1, 8)], "item_idx int, item_id int, title string, description string, sem_id string")
    log = log_of(spark, 7, 1640995200, 86400 * 40)
    phases = [("pretrain", "2017-07-01", "2022-07-01"), ("test", "2022-07-01", "2023-01-01")]
    got = ex.build_examples(log, items, phases, "title", max_len=2, min_len=3).orderBy("ts").collect()
    assert [(r["phase"], r["item_id"]) for r in got] == [("pretrain", 3), ("pretrain", 4), ("pretrain", 5), ("test", 7)]
    assert got[-1]["history"] == [5, 6] and got[0]["history"] is None
    user, answer = got[-1]["messages"]
    assert user["content"].endswith("\nTitle: t5\nDescription: d5\n\nTitle: t6\nDescription: d6")
    assert answer["content"] == "<think>\n\n</think>\n\nRecommended Item Title: t7"
    coded = ex.build_examples(log, items, phases, "sem_id", max_len=2, min_len=3)
    # a main and one auxiliary row per training target, the test row alone
    assert coded.groupBy("phase").count().orderBy("phase").collect() == [("pretrain", 6), ("test", 1)]


def test_users_below_every_cut_off_still_count(spark):
    """Two users with hits at ranks 1 and 40: half of them are found within 5."""
    from recquarry.operators import metrics as mt

    rows = spark.createDataFrame([(1, 1, 1), (2, 40, 1)], "user_id long, rank long, hit long")
    got = {(r.metric, r.k): r.value for r in mt.generation_metrics(rows, (5,)).collect()}
    assert got == {("NDCG", 5): 50.0, ("Recall", 5): 50.0, ("MRR", 5): 50.0}
    lists = rows.withColumn("pos_len", rows.hit)
    top = {r.metric: r.value for r in mt.top_metrics(lists, ["hit", "recall", "mrr"], (5,)).collect()}
    assert top == {"hit": 0.5, "recall": 0.5, "mrr": 0.5}


def test_item_groups_with_gaps(spark):
    from recquarry.operators import sequences as sq

    rows = [(10 * i, i, f"t{i}", f"d{i}", f"s{i}") for i in range(23)]
    items = spark.createDataFrame(rows, "item_idx long, item_id long, title string, description string, sem_id string")
    got = sq.item_groups(items, 5).collect()
    assert len(got) == 5 and all(len(r.examples) == 5 for r in got)
    assert sorted(t.item_id for r in got for t in r.targets) == list(range(23))
    assert all(not {t.item_id for t in r.targets} & {e.item_id for e in r.examples} for r in got)


def test_descriptions_of_all_kinds(spark, tmp_path):
    from recquarry.sources import files

    lines = [
        '{"parent_asin": "a", "title": "t", "description": ["x", "y"]}',
        '{"parent_asin": "b", "title": "t", "description": "plain text"}',
        '{"parent_asin": "c", "title": "t"}',
        '{"parent_asin": "d", "title": "", "description": []}',
    ]
    (tmp_path / "meta.json").write_text("\n".join(lines))
    got = {r.item_id: r.description for r in files.read_item_meta(spark, str(tmp_path)).collect()}
    assert got == {"a": "x\ny", "b": "plain text", "c": "None"}


def test_examples_of_unknown_and_missing_items(spark):
    """Unknown and null items stay in the history and read NA; hot users and repeated rows change nothing."""
    items = spark.createDataFrame([(1, "t1", None, "<a_1>")], "item_id int, title string, description string, sem_id string")
    log = spark.createDataFrame([(1, 1, 1), (1, 9, 2), (1, None, 3), (1, 1, 4), (1, 1, 4)], "user_id int, item_id int, s int")
    log = log.selectExpr("user_id", "item_id", "cast(timestamp_seconds(1640995200 + s) as timestamp_ntz) as ts")
    got = ex.build_examples(log, items, [("pretrain", "2017-07-01", "2022-07-01")], min_len=4).collect()
    assert [r["item_id"] for r in got] == [1, 1]
    shown = sorted(r["messages"][0]["content"].split("Title: ", 1)[1] for r in got)
    start = "t1\nDescription: NA\n\nTitle: NA\nDescription: NA\n\nTitle: NA\nDescription: NA"
    assert shown == [start, start + "\n\nTitle: t1\nDescription: NA"]
    assert ex.build_examples(log.limit(0), items, [("pretrain", "2017-07-01", "2022-07-01")]).count() == 0


def test_count_filter_against_brute_force(spark):
    import random

    from recquarry.operators import clean

    rnd = random.Random(3)
    data = [(7 if rnd.random() < 0.4 else rnd.randrange(12), rnd.randrange(9) if rnd.random() < 0.9 else None, rnd.randrange(100)) for _ in range(150)]
    log = spark.createDataFrame(data, "user_id int, item_id int, s int")
    log = log.selectExpr("user_id", "item_id", "s", "cast(timestamp_seconds(1640995200 + s) as timestamp_ntz) as ts")
    items, users = Counter(i for _, i, _ in data), Counter(u for u, _, _ in data)
    kept = [r for r in data if r[2] >= 30 and r[1] is not None and items[r[1]] >= 10 and users[r[0]] >= 10]
    left = Counter(u for u, _, _ in kept)
    want = sorted(r for r in kept if left[r[0]] >= 10)
    got = clean.min_interactions(log, 10, "2022-01-01 00:00:30")
    assert want and sorted((r.user_id, r.item_id, r.s) for r in got.collect()) == want


@pytest.mark.parametrize("limit", [None, 4])
def test_one_ordering_gives_lists_and_mean_ranks(spark, limit):
    r = random.Random(8)
    data = [(u, i, r.randrange(4) / 4, int(r.random() < 0.3)) for u in range(6) for i in range(r.randrange(1, 15))]
    scores = spark.createDataFrame(data, "user_id int, item_id int, score double, positive int")
    users = mt.collect_all(scores, 5, limit=limit)
    apart = lambda df, *c: rows(df, *c)
    assert apart(users, "user_id", "pos_rank_sum", "user_len", "pos_len") == apart(
        mt.collect_mean_ranks(scores).withColumn("pos_rank_sum", F.col("pos_rank_sum").cast("double")), "user_id", "pos_rank_sum", "user_len", "pos_len"
    )
    top = users.where("pos_len > 0").select("user_id", "pos_len", F.explode("top").alias("t")).select("user_id", "t.item", "t.rank", "t.hit", "pos_len")
    assert apart(top) == apart(mt.collect_ranks(scores, 5).select("user_id", "item_id", "rank", "hit", "pos_len"))
