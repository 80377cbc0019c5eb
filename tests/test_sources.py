"""File formats beyond the registered round trips."""

import os

import pytest

from conftest import rows
from recquarry.operators import layout
from recquarry.sources import files


def test_header_is_replaced_by_position(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("item,person,x,y\nA,B,5.0,1000\n")
    assert rows(files.read_ratings(spark, str(path))) == [("A", "B", 5.0, 1000)]


def test_item_meta_rules(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text(
        '{"parent_asin": "1", "title": "a", "description": ["x", "y"], "price": 3}\n'
        '{"parent_asin": "2", "title": "", "description": []}\n'
        '{"parent_asin": "3", "description": ["z"]}\n'
        '{"parent_asin": "4", "title": "b", "description": null}\n'
        '{"parent_asin": "5", "title": "c", "description": []}\n'
    )
    assert rows(files.read_item_meta(spark, str(path)), "item_id", "description", "title") == [
        ("1", "x\ny", "a"), ("4", "None", "b"), ("5", "", "c"),
    ]


def test_items_keep_line_breaks_and_quotes(spark):
    path = files.fresh_path(spark, "items")
    df = spark.createDataFrame([("1", 'say "hi",\nthen go', "t, 1"), ("2", "plain", "u")], files.ITEMS)
    files.write_items(df, path)
    assert rows(files.read_items(spark, path)) == rows(df)


def test_examples_are_partitioned_and_ordered(spark):
    path = files.fresh_path(spark, "examples")
    df = spark.createDataFrame([("d", p, t, t * 10) for p in ("a", "b") for t in (5, 3, 9, 1)], "domain string, phase string, timestamp long, x long")
    files.write_examples(df.coalesce(1), path)
    assert os.path.isdir(f"{path}/domain=d/phase=a")
    back = spark.read.json(f"{path}/domain=d/phase=b")
    assert [r["timestamp"] for r in back.collect()] == [1, 3, 5, 9]


class Session:
    """Stands in for a session whose settings a running one cannot change."""

    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_shared_folder_comes_from_the_session():
    assert layout.shared_dir(Session("hdfs://x/ckpt", "yarn")) == "hdfs://x/ckpt"
    assert files.fresh_path(Session("hdfs://x/ckpt", "yarn"), "t").startswith("hdfs://x/ckpt/t-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        layout.shared_dir(Session(None, "yarn"))
