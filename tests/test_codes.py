"""Fitted codebooks, the packed trie, and vectorised search over code prefixes."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recquarry.operators import codes as cd

few = settings(max_examples=5, deadline=None)


def catalogue(spark, seed, n, layers, size):
    r = random.Random(seed)
    return spark.createDataFrame(
        [(i, [r.randrange(size) for _ in range(layers)]) for i in range(n)], "item_idx long, codes array<int>"
    )


def lloyd(v, ids, codes, iterations, start):
    """The same steps in plain numpy."""
    book = v[np.array([ids.index(i) for i in start])]
    for _ in range(iterations):
        c = cd.nearest(v, book)
        book = np.array([v[c == k].mean(0) if (c == k).any() else book[k] for k in range(len(book))])
    return book


def test_fit_is_lloyd_and_ignores_the_partitioning(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((90, 5))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_idx long, vector array<double>")
    books = [cd.codebook_arrays(cd.fit_residual_codebooks(items.repartition(n), 2, 6, 4, 7)) for n in (1, 7)]
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(*books))
    import hashlib

    draw = lambda i: (int(hashlib.md5(f"k7#0#{i}".encode()).hexdigest()[:8], 16), i)
    want = lloyd(v, list(range(90)), 6, 4, sorted(range(90), key=draw)[:6])
    assert np.allclose(books[0][0], want)


def test_fit_of_few_equal_and_no_items(spark):
    schema = "item_idx long, vector array<double>"
    few_items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], schema)
    book = cd.fit_residual_codebooks(few_items, 2, 8, 3)
    assert book.count() == 6
    report = {r["layer"]: r for r in cd.codebook_report(few_items, book).collect()}
    assert report[0]["items"] == report[0]["nearest"] == 3 and report[0]["loss"] == 0 and report[1]["codes"] == 3
    assert cd.fit_residual_codebooks(few_items.limit(0), 2, 8, 3).count() == 0


def test_report_counts_items_at_a_wrong_code(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "item_idx long, vector array<double>")
    book = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [9.0, 0.0])], "layer int, code int, centroid array<double>")
    right = cd.codebook_report(items, book).first()
    assert (right["items"], right["used"], right["largest"], right["nearest"]) == (10, 2, 5, 10)
    wrong = spark.createDataFrame([(i, [0]) for i in range(10)], "item_idx long, codes array<int>")
    monkeypatch.setattr(cd, "residual_encode", lambda *a, **k: wrong)
    assert cd.codebook_report(items, book).first()["nearest"] == 5


def test_large_codebooks_are_refused(spark, monkeypatch):
    book = spark.createDataFrame([(0, 0, [0.0] * 8)], "layer int, code int, centroid array<double>")
    monkeypatch.setattr(cd, "MAX_CODEBOOK_BYTES", 32)
    with pytest.raises(ValueError):
        cd.codebook_arrays(book)


@given(st.integers(0, 10**6), st.integers(1, 50), st.integers(1, 4), st.integers(1, 4))
@few
def test_trie_search_equals_joins(spark, seed, n, layers, width):
    table = cd.prefix_table(catalogue(spark, seed, n, layers, 5), layers)
    r = random.Random(seed + 1)
    # scores of one decimal, so that ties are common
    rows = [(q, l, [round(r.random(), 1) for _ in range(5)]) for q in range(8) for l in range(layers)]
    scores = spark.createDataFrame(rows, "query_id int, layer int, logp array<double>")
    found = lambda **kw: sorted((r[0], r["rank"], tuple(r["codes"]), round(r["score"], 9)) for r in cd.constrained_beam(scores, table, width, layers, **kw).collect())
    assert found() == found(trie_bytes=0) and found()


@given(st.integers(0, 10**6), st.integers(1, 40))
@few
def test_walks_equal_joins(spark, seed, n):
    layers, size, start = 3, 4, 100
    table = cd.prefix_table(catalogue(spark, seed, n, layers, size), layers)
    r = random.Random(seed)
    tails = [[7] * r.randrange(2) + [start + l * size + r.randrange(size) for l in range(r.randrange(layers + 1))] for _ in range(60)]
    tails += [[], [start + size], [start, start], [99], None]
    df = spark.createDataFrame(list(enumerate(tails)), "id int, tokens array<bigint>")
    for eos in (2, None):
        made = lambda **kw: sorted((x["id"], x["pos"], tuple(x["legal_tokens"])) for x in cd.legal_next(df.where("tokens is not null"), table, eos, start, layers, size, **kw).collect())
        assert made() == made(trie_bytes=0)


def test_trie_is_flat_and_sorted(spark):
    codes = catalogue(spark, 3, 200, 4, 16)
    trie = cd.pack_trie(cd.prefix_table(codes, 4), 4, 16)
    paths = {tuple(r["codes"]) for r in codes.collect()}
    assert [len(k) for k in trie.keys] == [len({p[: l + 1] for p in paths}) for l in range(4)]
    assert all((np.diff(k) > 0).all() for k in trie.keys)
    assert cd.pack_trie(cd.prefix_table(codes, 4), 4, 16, max_bytes=100) is None
    assert cd.constrained_beam(spark.createDataFrame([(1, [[0.0]])], "query_id int, logp array<array<double>>"), cd.prefix_table(codes.limit(0), 4), 3, 4).count() == 0


def test_search_needs_no_shuffle_for_whole_rows(spark):
    table = cd.prefix_table(catalogue(spark, 3, 50, 2, 4), 2)
    scores = spark.createDataFrame([(q, [[0.0] * 4] * 2) for q in range(9)], "query_id int, logp array<array<double>>")
    plan = cd.constrained_beam(scores, table, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
