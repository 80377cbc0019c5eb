"""Brute-force comparisons and invariants on small random inputs."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from recquarry.functions import codes as cx
from recquarry.operators import codes as cd, examples as ex, merge as mg, metrics as mt, sequences as sq, vectors as vc

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(1)
    q, v = rng.standard_normal((90, 8)), rng.standard_normal((230, 8))
    queries = spark.createDataFrame([(i % 40, x.tolist()) for i, x in enumerate(q)], "query_id int, vector array<double>")
    items = spark.createDataFrame([(i, x.tolist(), float(i % 5)) for i, x in enumerate(v)], "item_id int, vector array<double>, coeff double")
    seen = [(r.randrange(40), r.randrange(230)) for r in [random.Random(2)] for _ in range(900)]
    # one query has seen nearly everything
    seen += [(3, i) for i in range(225)] + [(99, 1), (1, 999)]
    return q, v, queries, items, seen, spark.createDataFrame(seen, "query_id int, item_id int")


@pytest.mark.parametrize("metric", ["l2", "l2sq", "cosine", "dot"])
@pytest.mark.parametrize("rescale", [False, True])
@pytest.mark.parametrize("shard", [7, 64, 2048])
def test_rank_catalog_equals_brute_force(space, metric, rescale, shard):
    q, v, queries, items, seen, seen_df = space
    if rescale and metric in ("cosine", "dot"):
        pytest.skip("rescaling divides distances")
    dots = q @ v.T
    nq, nv = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(v, axis=1)[None, :]
    s = {"dot": dots, "cosine": dots / nq / nv, "l2": nq + nv - 2 * dots, "l2sq": nq**2 + nv**2 - 2 * dots}[metric]
    larger = metric in ("dot", "cosine")
    gone = set(seen)
    want = {}
    for u in range(40):
        mine = s[[i for i in range(90) if i % 40 == u]]
        best = mine.max(0) if larger else mine.min(0)
        if rescale:
            best = np.array([np.inf if i % 5 == 0 else b / (i % 5) for i, b in enumerate(best)])
        order = sorted((i for i in range(230) if (u, i) not in gone), key=lambda i: (-round(best[i], 9) if larger else round(best[i], 9), i))
        want[u] = order[:12]
    got = {u: [] for u in range(40)}
    for r in vc.rank_catalog(queries, items, 12, metric, seen_df, rescale, shard_rows=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["item_id"])
    assert got == want


def random_codes(n, layers, size, seed):
    r = random.Random(seed)
    return [(i, [r.randrange(size) for _ in range(layers)]) for i in range(n)]


@given(st.integers(0, 10_000), st.integers(1, 30))
@few
def test_collision_repair(spark, seed, n):
    size = 5
    data = random_codes(n, 2, size, seed)
    codes = spark.createDataFrame(data, "item_idx long, codes array<int>")
    near = {c: sorted(range(size), key=lambda o: (abs(o - c), o)) for c in range(size)}
    ndf = spark.createDataFrame(list(near.items()), "code int, neighbors array<int>")
    used, want = {}, {}
    for i, (p, c) in data:
        mine = used.setdefault(p, [])
        free = [x for x in near[c] if x not in mine]
        pick = free[0] if free else c
        mine.append(pick)
        want[i] = [p, pick]
    got = {i: list(c) for i, c in rows(cd.resolve_collisions(codes, ndf), "item_idx", "codes")}
    assert got == want


def test_beam_equals_brute_force(spark):
    data = random_codes(60, 3, 4, 4)
    codes = spark.createDataFrame(data, "item_idx long, codes array<int>")
    r = random.Random(9)
    score = {(q, l): [round(r.random(), 3) for _ in range(4)] for q in range(6) for l in range(3)}
    sdf = spark.createDataFrame([(q, l, s) for (q, l), s in score.items()], "query_id int, layer int, logp array<double>")
    table = cd.prefix_table(codes, 3)
    paths = {tuple(c) for _, c in data}
    got = cd.constrained_beam(sdf, table, 64, 3)
    best = {q: sorted(paths, key=lambda p: (-round(sum(score[(q, l)][c] for l, c in enumerate(p)), 9), p)) for q in range(6)}
    for q in range(6):
        assert [tuple(x["codes"]) for x in got.where(f"query_id = {q}").orderBy("rank").collect()] == best[q][:64]
    narrow = {tuple(x["codes"]) for x in cd.constrained_beam(sdf, table, 2, 3).collect()}
    assert narrow <= paths


def test_legal_next(spark):
    codes = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 0, 0])], "item_idx long, codes array<int>")
    s, size = 100, 4
    tok = lambda *c: [s + i * size + x for i, x in enumerate(c)]
    cases = {
        "root": ([7], [101]), "step": ([7] + tok(1), [104, 106]), "deep": (tok(1, 2), [111]), "done": (tok(1, 2, 3), [2]),
        "off": (tok(1, 3), [101]), "off_full": (tok(1, 2, 2), [101]), "wrong_layer": ([105], [101]), "empty": ([], [101]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, tokens array<bigint>")
    got = dict(rows(cd.legal_next(df, cd.prefix_table(codes, 3), 2, s, 3, size), "name", "legal_tokens"))
    assert {k: list(v) for k, v in got.items()} == {k: v[1] for k, v in cases.items()}


def test_encode_matches_numpy_and_decodes(spark):
    rng = np.random.default_rng(0)
    v, book = rng.standard_normal((50, 6)), rng.standard_normal((2, 8, 6))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_idx long, vector array<double>")
    cb = spark.createDataFrame([(l, c, book[l, c].tolist()) for l in range(2) for c in range(8)], "layer int, code int, centroid array<double>")
    enc = cd.residual_encode(items, cb, True)
    dec = cd.decode_codes(enc, cb, n_layers=2)
    for r in dec.collect():
        res = v[r["item_idx"]]
        for l in range(2):
            c = int(np.argmin(((book[l] - res) ** 2).sum(1)))
            assert r["codes"][l] == c
            res = res - book[l, c]
            assert r["errors"][l] == pytest.approx(float((res**2).sum()))
        assert np.allclose(np.array(r["vector"]) + res, v[r["item_idx"]])


def test_fitted_codebooks_reduce_error(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((200, 4)))], "item_idx long, vector array<double>")
    cb = cd.fit_residual_codebooks(items, 3, 8, 5)
    assert cb.count() == 24
    loss = [r["loss"] for r in cd.quantization_error(cd.residual_encode(items, cb, True), 4).orderBy("layer").collect()]
    assert loss[0] > loss[1] > loss[2] > 0


@given(st.lists(st.integers(1, 6), min_size=1, max_size=12), st.integers(7, 12))
@few
def test_negatives_avoid_the_sequence(spark, seq, item_num):
    df = spark.createDataFrame([(1, seq)], "user_id int, s array<bigint>")
    neg = df.select(sq.negatives(20, item_num, "s", "t", "user_id").alias("n")).first()["n"]
    free = set(range(1, item_num)) - set(seq)
    assert len(neg) == 20
    if free:
        assert set(neg) <= free
    else:
        assert set(neg) == {None}


@given(st.integers(1, 40), st.integers(1, 7))
@few
def test_chunks_are_a_suffix(spark, n, max_len):
    df = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    got = [x for r in sq.chunk_sequences(df, max_len).orderBy("chunk").collect() for x in r["item_seq"]]
    size = max_len + 1
    drop = n % size if n > size else 0
    assert got == list(range(drop, n))


def test_item_groups_stay_outside_their_block(spark):
    items = spark.range(23).select(
        F.col("id").alias("item_idx"), F.col("id").alias("item_id"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("s").alias("sem_id")
    )
    for r in sq.item_groups(items, 5).collect():
        shown = [e["item_idx"] for e in r["examples"]]
        assert len(set(shown)) == 5
        assert not {e // 5 for e in shown} & {r["block"]}
    assert {r["type"] for r in ex.item_dialogues(items, 5).collect()} == {"t2i", "i2t"}


def checkpoints(spark, seed, models=("base", "target", "source")):
    r = random.Random(seed)
    data = [(m, f"p{k % 2}", k, [round(r.uniform(-1, 1), 3) for _ in range(8)]) for m in models for k in range(6)]
    return data, spark.createDataFrame(data, "model string, param string, chunk long, values array<double>")


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("rate", [0.0, 0.5, 0.8])
def test_ties_equals_numpy(spark, seed, rate):
    data, c = checkpoints(spark, seed)
    flat = {m: np.concatenate([v for x, _, _, v in data if x == m]) for m in ("base", "target", "source")}
    a, b = (flat["target"] - flat["base"]) * 0.7, (flat["source"] - flat["base"]) * 0.3
    k = int(len(a) * rate)
    if k:
        a = a * (abs(a) >= np.sort(abs(a))[k - 1])
        b = b * (abs(b) >= np.sort(abs(b))[k - 1])
    sign = np.sign(a + b)
    sign[sign == 0] = np.sign(sign.sum())
    a, b = a * (a * sign > 0), b * (b * sign > 0)
    both = (a != 0) & (b != 0)
    want = flat["base"] + np.where(both, (a + b) / 2, a + b)
    got = mg.ties_merge(c, "base", ["target", "source"], rate, 1.0, 0.3).orderBy("chunk").collect()
    assert np.allclose(np.concatenate([r["values"] for r in got]), want)


def test_identities(spark):
    data, c = checkpoints(spark, 5)
    same = c.where("model = 'base'")
    twin = same.unionByName(same.withColumn("model", F.lit("copy")))
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(mg.average_merge(twin, ["base", "copy"])) == text(mg.model_rows(c, "base"))
    # a model equal to the base leaves only the other model's kept changes
    zero = twin.unionByName(c.where("model = 'target'"))
    t = mg.ties_merge(zero, "base", ["target", "copy"], 0.0, 1.0, 0.0)
    got = {(r["param"], r["chunk"]): r["values"] for r in t.collect()}
    for m, p, k, v in data:
        if m == "target":
            assert got[(p, k)] == pytest.approx(v)


def test_merge_models_keeps_excluded_and_code_rows(spark):
    _, c = checkpoints(spark, 7)
    out = mg.merge_models(c, "base", "source", ["target"], "average_merging", "sem_id", 4, 8, 3, ["p0"], exclude=["p1"])
    src = {(r["param"], r["chunk"]): r["values"] for r in mg.model_rows(c, "source").collect()}
    tgt = {(r["param"], r["chunk"]): r["values"] for r in mg.model_rows(c, "target").collect()}
    for r in out.collect():
        key = (r["param"], r["chunk"])
        for i, v in enumerate(r["values"]):
            retained = key[0] == "p1" or key[1] * 8 + i >= 12
            assert v == pytest.approx(src[key][i] if retained else (src[key][i] + tgt[key][i]) / 2)


@given(st.integers(0, 1000))
@few
def test_metrics_in_range_and_monotone(spark, seed):
    r = random.Random(seed)
    data = [(u, i, r.choice([0.1, 0.5, r.random()]), int(r.random() < 0.3)) for u in range(8) for i in range(12)] + [(0, 50, 2.0, 1)]
    df = spark.createDataFrame(data, "user_id int, item_id int, score double, positive int")
    got = {(x["metric"], x["k"]): x["value"] for x in mt.evaluate(mt.TOP_METRICS + ["gauc"], (1, 3, 9), df).collect()}
    assert all(0 <= v <= 1 for v in got.values())
    for m in ("hit", "recall"):
        assert got[(m, 1)] <= got[(m, 3)] <= got[(m, 9)]


def test_dense_ids_with_catalog(spark):
    log = spark.createDataFrame([("b", 2), ("a", 3), ("b", 1), ("z", 1)], "item_id string, s int").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz")
    )
    assert rows(sq.dense_ids(log, "item_id"), "id", "token") == [(0, "[PAD]"), (1, "b"), (2, "z"), (3, "a")]
    catalog = spark.createDataFrame([("z", 0), ("q", 1)], "token string, order int")
    assert rows(sq.dense_ids(log, "item_id", catalog=catalog), "id", "token") == [(0, "[PAD]"), (1, "z"), (2, "q"), (3, "b"), (4, "a")]
