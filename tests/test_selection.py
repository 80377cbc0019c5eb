"""Selection inside arrays, masking in aligned rows, and the bucketed parameter table."""

import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recquarry.operators import layout, merge as mg
from recquarry.sources import files

few = settings(max_examples=6, deadline=None)
VALUES = st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1.0, -1.0, 5e-324, 1e308, float("inf"), 0.1, 0.1 + 1e-17]))


@given(st.dictionaries(st.sampled_from(["a", "b", "é"]), st.lists(st.lists(VALUES, max_size=6), min_size=1, max_size=8), min_size=1), st.sampled_from([0.0, 0.2, 0.5, 0.99, 1.0]))
@few
def test_kth_magnitude_is_exact(spark, chunks, rate):
    check_kth(spark, chunks, rate)


def test_kth_magnitude_in_a_hot_bucket(spark, monkeypatch):
    """More different values of one bucket than a window may hold are ranked over the cluster."""
    monkeypatch.setattr(layout, "HOT_ROWS", 5)
    values = [1 + i / 1e6 for i in range(200)]
    for rate in (0.1, 0.5, 0.999):
        check_kth(spark, {"a": [values, values[:50]], "b": [[-v for v in values]], "c": [[3.0]]}, rate)


def check_kth(spark, chunks, rate):
    rows = [(k, c) for k, cs in chunks.items() for c in cs]
    df = spark.createDataFrame(rows, "param string, values array<double>").repartition(3)
    got = {r["param"]: (r["kth_index"], r["kth"]) for r in layout.kth_smallest_magnitude(df, "param", "values", rate).collect()}
    for k, cs in chunks.items():
        flat = sorted(abs(v) for c in cs for v in c)
        at = int(len(flat) * rate)
        if flat:
            assert got[k] == (at, flat[at - 1] if at else None)
        else:
            assert k not in got


def test_values_become_rows_only_in_the_last_bucket(spark):
    rng = np.random.default_rng(1)
    rows = [("p", rng.standard_normal(500).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "param string, values array<double>")
    found = layout.kth_smallest_magnitude(df, "param", "values", 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    flat = np.sort(np.abs(np.concatenate([r[1] for r in rows])))
    assert found.first()["kth"] == flat[int(len(flat) * 0.8) - 1]


def models(spark, n=24, width=6):
    r = random.Random(4)
    rows = [(m, f"layer_{i % 5}", i, [round(r.uniform(-2, 2), 3) for _ in range(width)]) for m in ("base", "x", "y") for i in range(n)]
    return spark.createDataFrame(rows, "model string, param string, chunk long, values array<double>")


def composed(ckpt, names, rates, method, weight_format, strategy, exclude):
    """Mask every model on its own, put the models together again, and merge them."""
    masked = mg.model_rows(ckpt, "base").withColumn("model", F.lit("base"))
    for m, rate in zip(names, rates):
        new = mg.mask_weights(ckpt, "base", m, rate, weight_format, strategy, True, "0", 64, exclude)
        masked = masked.unionByName(mg.override(mg.model_rows(ckpt, m), new).withColumn("model", F.lit(m)))
    return {
        "average_merging": lambda: mg.average_merge(masked, names, exclude),
        "task_arithmetic": lambda: mg.task_arithmetic_merge(masked, "base", names, 1.0),
        "ties_merging": lambda: mg.ties_merge(masked, "base", names, exclude=exclude),
    }[method]()


@pytest.mark.parametrize("method", ["average_merging", "task_arithmetic", "ties_merging"])
@pytest.mark.parametrize("weight_format, strategy", [("delta_weight", "magnitude"), ("finetuned_weight", "random"), ("finetuned_weight", "magnitude")])
def test_masking_aligned_rows_equals_the_steps(spark, method, weight_format, strategy):
    ckpt = models(spark)
    values = lambda df: {(r["param"], r["chunk"]): [round(v, 9) + 0.0 for v in r["values"]] for r in df.collect()}
    exclude = ["layer_3"]
    made = mg.mask_merge(ckpt, "base", ["x", "y"], [0.3, 0.5], method, weight_format, strategy, exclude=exclude)
    assert values(made) == values(composed(ckpt, ["x", "y"], [0.3, 0.5], method, weight_format, strategy, exclude))


def test_bucketed_tables_align_and_merge_without_shuffle(spark, tmp_path):
    store = files.store_checkpoints(models(spark), f"store_{uuid.uuid4().hex}", 4, str(tmp_path / "store"))
    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in physical(mg.average_merge(models(spark), ["x", "y"]))
    for df in (
        mg.align(store, ["base", "x", "y"]),
        mg.average_merge(store, ["x", "y"]),
        mg.mask_merge(store, "base", ["x", "y"], method="average_merging"),
        mg.override(mg.model_rows(store, "base"), mg.model_rows(store, "x")),
    ):
        plan = physical(df)
        assert "Exchange hashpartitioning" not in plan, plan
        assert df.count() == 24
    same = mg.mask_merge(models(spark), "base", ["x", "y"])
    got = mg.mask_merge(store, "base", ["x", "y"])
    assert sorted(map(str, got.collect())) == sorted(map(str, same.collect()))


def test_missing_parameters_and_wrong_settings(spark):
    ckpt = models(spark).where("not (model = 'y' and param = 'layer_1')")
    with pytest.raises(Exception, match="lacks parameter"):
        mg.mask_merge(ckpt, "base", ["x", "y"], method="average_merging").collect()
    kept = mg.mask_merge(ckpt, "base", ["x", "y"], method="average_merging", weight_format="finetuned_weight")
    assert kept.count() == 24
    for wrong in ({"method": "none"}, {"strategy": "none"}, {"weight_format": "none"}, {"rates": [2.0, 0.1]}):
        with pytest.raises(ValueError):
            mg.mask_merge(ckpt, "base", ["x", "y"], **wrong)
