"""Binds the operators' logical inputs to the benchmark tables.

This is the only module that knows table names; each binding has its SQL twin in
``CTE`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES = [
    ("pretrain", "1990-01-01", "2000-01-01"),
    ("phase1", "2000-01-01", "2000-07-01"),
    ("phase2", "2000-07-01", "2001-01-01"),
    ("test", "2001-01-01", "2001-08-02"),
]
HORIZON = "2001-08-02"
THRESHOLD = "2001-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
    od = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")
    )
    return li.join(od, "l_orderkey").select("user_id", "item_id", "ts")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        "ts",
        F.expr("unix_micros(cast(ts as timestamp))").alias("micros"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_idx"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.concat_ws("\n", "p_brand", "p_type").alias("description"),
    )


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


# SQL twins -----------------------------------------------------------------

INTER = """inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EVENTS = """ev AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts,
         epoch_us(ts) AS micros FROM events)"""

ITEMS = """items AS (
  SELECT p_partkey AS item_idx, p_partkey AS item_id, p_name AS title,
         p_brand || chr(10) || p_type AS description FROM part)"""

PHASE_CASE = """CASE WHEN ts < TIMESTAMP '2000-01-01' AND ts >= TIMESTAMP '1990-01-01' THEN 'pretrain'
     WHEN ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2000-07-01' THEN 'phase1'
     WHEN ts >= TIMESTAMP '2000-07-01' AND ts < TIMESTAMP '2001-01-01' THEN 'phase2'
     WHEN ts >= TIMESTAMP '2001-01-01' AND ts < TIMESTAMP '2001-08-02' THEN 'test' END"""


class Registry:
    """Collects a module's queries with their SQL twins."""

    def __init__(self):
        self.queries = {}
        self.sql = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep
