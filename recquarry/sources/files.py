"""Readers and writers for the file formats of the recommendation tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recquarry.functions.text import format_floats
from recquarry.operators.layout import shared_dir

RATINGS = "user_id STRING, item_id STRING, rating DOUBLE, timestamp BIGINT"
ITEM_META = "parent_asin STRING, title STRING, description STRING"
INTERACTIONS = "item_id STRING, user_id STRING, timestamp BIGINT"
ITEMS = "item_id STRING, description STRING, title STRING"
MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared directory."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rating log; the file's own header is skipped and columns are named by position."""
    return spark.read.schema(RATINGS).option("header", True).option("enforceSchema", True).csv(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTIONS).option("header", True).csv(path)


def read_item_meta(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata with usable titles; a description list becomes one text, a plain one stays as it is."""
    raw = spark.read.schema(ITEM_META).json(path)
    # a list arrives as its JSON text
    listed = F.when(F.col("description").startswith("["), F.from_json("description", "array<string>"))
    return raw.where(F.col("title").isNotNull() & (F.length("title") > 0)).select(
        F.col("parent_asin").alias("item_id"),
        F.when(F.col("description").isNull(), F.lit("None"))
        .otherwise(F.coalesce(F.array_join(listed, "\n"), F.col("description")))
        .alias("description"),
        "title",
    )


def write_interactions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.select("item_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    _write_table(out, path, fmt)


def write_items(df: DataFrame, path: str, fmt: str = "csv") -> None:
    _write_table(df, path, fmt)


def _write_table(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        # multi-line texts survive because quotes and line breaks are escaped
        df.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(path)
    else:
        df.write.parquet(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_examples(df: DataFrame, path: str, by=("domain", "phase"), order: str = "timestamp") -> None:
    """Gzip JSON lines, one folder per partition value, time-ordered inside each file.

    Rows stay where the example building left them, so writing adds a local sort and no
    shuffle.  Among equal times a user's examples lie together, whose histories then compress to little more than one.
    """
    together = [c for c in ("user_id",) if c in df.columns]
    (
        df.sortWithinPartitions(*by, order, *together)
        .write.partitionBy(*by)
        .option("compression", "gzip")
        .json(path)
    )


def write_outputs(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("item_id", "item_idx", "embedding").write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item_id BIGINT, item_idx BIGINT, embedding ARRAY<FLOAT>").parquet(path)


def append_metrics(df: DataFrame, path: str, precision: int = 3) -> None:
    """Append metric rows to a tab-separated archive with fixed decimals.

    Every part file carries a header, so readers see one header per file and never
    one in the middle of the data.
    """
    format_floats(df, precision).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_checkpoint(df: DataFrame, path: str) -> None:
    """Parameter table, one folder per model."""
    df.write.partitionBy("model").mode("append").parquet(path)


def read_checkpoints(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("model").isin(models)) if models else df


def store_checkpoints(df: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Parameter table of several models as table ``name``, bucketed and sorted by (param, chunk).

    All models' values of a chunk lie in one bucket, so aligning, overriding and merging models of the table, or of
    tables with as many buckets, needs no shuffle.  Rows are placed by one shuffle here; ``buckets`` should make files of
    some hundred megabytes.  The files lie in ``path``, by default a new folder of the shared directory.
    """
    spark = df.sparkSession
    (
        df.select("model", "param", "chunk", "values")
        .repartition(buckets, "param", "chunk")
        .write.option("path", path or fresh_path(spark, name))
        .bucketBy(buckets, "param", "chunk")
        .sortBy("param", "chunk")
        .saveAsTable(name)
    )
    return spark.table(name)
