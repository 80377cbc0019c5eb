"""Tokenizers with offsets, cuts at token borders, and batches by token budget."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recquarry.functions import text as tx
from recquarry.operators import tokens as tk

few = settings(max_examples=5, deadline=None)
TEXT = st.text(st.sampled_from("ab é中😀\n\t"), max_size=20)


def callers_tokenizer():
    """A tokenizer of two characters a token, white space included; nested, so that it travels by value."""

    def pairs_of_letters():
        def tokenize(texts):
            cuts = [[min(i + 2, len(t)) for i in range(0, len(t), 2)] for t in texts]
            return [[sum(map(ord, t[e - 2 + (e % 2) : e])) for e in ends] for t, ends in zip(texts, cuts)], cuts

        return tokenize

    return pairs_of_letters


pairs_of_letters = callers_tokenizer()


@given(st.lists(TEXT | st.none(), min_size=1, max_size=12), st.integers(0, 5))
@few
def test_cuts_lie_at_token_borders(spark, texts, n):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for make in (tk.whitespace_tokens, pairs_of_letters):
        e = df.withColumn("e", tk.tokenize("t", make))
        got = {r["id"]: r for r in e.select("id", "e", tk.first_tokens(F.col("t"), F.col("e.ends"), n).alias("kept")).collect()}
        ids, ends = make()([t or "" for t in texts])
        for i, t in enumerate(texts):
            assert list(got[i]["e"]["ids"]) == ids[i] and list(got[i]["e"]["ends"]) == ends[i]
            want = None if t is None else t if len(ends[i]) <= n else t[: ends[i][n - 1] if n else 0]
            assert got[i]["kept"] == want


def test_default_ids_are_hashes():
    ids, ends = tk.whitespace_tokens()(["a  bc", ""])
    assert ids == [[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in ("a", "bc")], []] and ends == [[1, 5], []]


def test_descriptions_are_cut_with_a_callers_tokenizer(spark):
    df = spark.createDataFrame([("ab", "cdef", 1), ("abcdefgh", "x", 2), ("t", None, 3)], "title string, description string, n int")
    got = {r["n"]: r["description"] for r in tk.truncate_descriptions(df, 2, pairs_of_letters).collect()}
    assert got == {1: "cd...", 2: "abcd...", 3: None}


def test_item_text_skips_what_says_nothing(spark):
    df = spark.createDataFrame([("0", 0, 0.0, False, "nan"), ("", 7, 1.5, True, "x"), (None, None, float("nan"), None, None)], "s string, i int, d double, b boolean, t string")
    got = [r[0] for r in df.select(tx.item_text("P ", ["s", "i", "d", "b", "t"])).collect()]
    assert got == ["P s: 0", "P i: 7d: 1.5b: truet: x", "P "]
    ids = tk.encode_items(df, "P ", ["s", "i"], 2).select("tokens").collect()
    assert [len(r[0]) for r in ids] == [2, 2, 1]


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(9, 30))
@few
def test_no_batch_is_above_its_budget(spark, lengths, budget):
    df = spark.createDataFrame(list(enumerate(lengths)), "id int, n int").repartition(4)
    rows = tk.assign_batches(df, "n", ["id"], budget).orderBy("id").collect()
    batches = [r["batch"] for r in rows]
    assert [r["n"] for r in rows] == lengths and batches == sorted(batches)
    for b in set(batches):
        assert sum(r["n"] for r in rows if r["batch"] == b) <= budget
    if max(lengths) == 9:
        with pytest.raises(ValueError):
            tk.assign_batches(df, "n", ["id"], 8)


def test_batches_hold_both_kinds_end_to_end(spark):
    rows = [(u, [[u] * (u % 3 + 1), [9]], [[7]] if u % 2 else []) for u in range(10)]
    df = spark.createDataFrame(rows, "u int, pos array<array<bigint>>, neg array<array<bigint>>").repartition(3)
    made = tk.pack_batches(df, ["u"], 20, 2).orderBy("batch").collect()
    flat = lambda kind: [x for r in made for x in r[kind]]
    cut = [[t[:2] for t in lists] for _, lists, _ in rows]
    assert flat("pos_ids") == [x for lists in cut for t in lists for x in [*t, 0]]
    assert flat("pos_lengths") == [len(t) + 1 for lists in cut for t in lists]
    assert flat("neg_ids") == [7, 0] * 5 and sum(r["n_sequences"] for r in made) == 10
    for r in made:
        assert len(r["pos_ids"]) + len(r["neg_ids"]) <= 20
        for k in ("pos", "neg"):
            assert list(r[f"{k}_cumulative"]) == [sum(r[f"{k}_lengths"][:i]) for i in range(len(r[f"{k}_lengths"]) + 1)]
            assert len(r[f"{k}_positions"]) == len(r[f"{k}_ids"])
    assert tk.pack_batches(df.limit(0), ["u"], 20, 2).count() == 0
