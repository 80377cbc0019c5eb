"""Every registered query against its SQL twin on the smallest tables."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402
from recquarry.operators import layout  # noqa: E402
from recquarry.plans import registry, sequencing  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
UNPARTITIONED = re.compile(r"windowspecdefinition\([^,()]+ (ASC|DESC)")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert not UNPARTITIONED.search(plan)
    if name in registry.SQL:
        problem = compare(df, con, registry.SQL[name])
        assert problem is None or problem == "EMPTY", problem
    else:
        assert df.count() > 0


HOT = [n for n in sequencing.R.queries if n in (
    "history_window", "train_targets", "cap_per_user", "user_sequences", "chunk_sequences", "leave_last_out",
    "next_item_pairs", "negative_sample", "average_rank", "time_gap_bucket", "history_lookup",
)] + ["h_gauc", "collect_rank_inputs", "build_examples", "ties_merge", "mask_magnitude"]


@pytest.mark.parametrize("name", HOT)
def test_query_with_hot_keys(spark, con, name, monkeypatch):
    """With tiny limits nearly every key counts as hot; results must stay the same."""
    monkeypatch.setattr(layout, "HOT_ROWS", 30)
    monkeypatch.setattr(layout, "BLOCK_ROWS", 32)
    assert compare(registry.QUERIES[name](spark, SF), con, registry.SQL[name]) is None


def test_names_match():
    assert set(registry.SQL) <= set(registry.QUERIES)
