"""A corpus pipeline of five stages; every stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recquarry.llm import byte_bpe, decontaminate, exact_dedup, minhash_dedup
from recquarry.llm.common import stored, table
from recquarry.llm.queries import toxicity_scores


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half."""
    return docs.where(toxicity_scores(spark, sf_dir, docs) < 0.5)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id."""
    return exact_dedup.deduplicate(docs, keep="largest")


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash_dedup.deduplicate(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold an item of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the digests of ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return docs.select("doc_id", byte_bpe.digests(docs, path).alias("r")).select("doc_id", "r.*")


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_near_copy),
    ("decontamination", keep_uncontaminated),
    ("byte_bpe", encode),
]
# Learned scores, near copies and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs.select(*(F.col(c) for c in docs.columns))
