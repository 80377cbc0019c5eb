"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a run: its digests in order, each with the number of rows and the
identifier that stays.  In each round the runs whose numbers differ in one digit (base
``FAN_IN``) exchange entries: the digit of the digest decides which of them gets an entry,
so that after all rounds each run holds one share of the digest space, no run grows, and a
digest that fills a third of the table is folded by ``FAN_IN`` in every round instead of meeting in one
task.  A task merges its incoming runs in digest order in a single pass.

Matches are verified at every level: entries are one text only if the SHA-256 digest, an
independent 64-bit hash and the length in bytes all agree.

Defined cases: a null text counts as empty; null ids sort before all others (an id of -2^63
is read as null); of rows repeated with the same id and text, ``kept`` is true for all, and
``deduplicate`` keeps one of them.  Extra columns are left alone,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import broadcast_checked, free_names, stored, text_or_empty

FAN_IN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["d", "c", "n"]
NO_ID = -(1 << 63)


def normalized(text: str) -> Column:
    """A-Z in lower case, nothing else changed; null is empty."""
    return F.translate(text_or_empty(text), UPPER, LOWER)


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = normalized(text)
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("d"),
        F.xxhash64(t).alias("c"),
        F.octet_length(t).alias("n"),
    )


def _merge_sorted(keep: str):
    """One pass over runs in key order: the first or last id of a key stays, sizes add up."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = (frame["run"] != frame["run"].shift()) | (frame["d"] != frame["d"].shift())
            new |= (frame["c"] != frame["c"].shift()) | (frame["n"] != frame["n"].shift())
            merged = frame.groupby(new.cumsum().to_numpy()).agg(
                {"run": "first", "d": "first", "c": "first", "n": "first", "id": keep, "size": "sum"}
            )
            held = merged.iloc[-1:]
            yield merged.iloc[:-1]
        if held is not None:
            yield held

    return merge


def keepers(prints: DataFrame, keep: str = "largest", runs: int | None = None) -> DataFrame:
    """One row ``(d, c, n, keep_id, group_size)`` per distinct text."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    runs = runs or int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while FAN_IN**rounds < runs:
        rounds += 1
    level = prints.withColumn("size", F.lit(1).cast("long")).withColumn("run", F.spark_partition_id() % F.lit(FAN_IN**rounds))
    merge = _merge_sorted("min" if keep == "smallest" else "max")
    place = F.pmod("c", F.lit(FAN_IN**rounds))
    for r in range(rounds):
        unit = FAN_IN**r

        def digit(c: Column, unit: int = unit) -> Column:
            return (c / F.lit(unit)).cast("long") % F.lit(FAN_IN)

        target = F.col("run") + (digit(place) - digit(F.col("run"))) * F.lit(unit)
        level = (
            level.withColumn("run", target.cast("int"))
            .repartition(runs, "run")
            .sortWithinPartitions("run", *KEYS)
            .mapInPandas(merge, "run int, d binary, c long, n int, id long, size long")
        )
    return level.select(*KEYS, F.col("id").alias("keep_id"), F.col("size").alias("group_size"))


def _joined(prints: DataFrame, keep: str) -> DataFrame:
    # the side of the documents may have a hot key, the other side has each key once
    found = keepers(prints, keep)
    return prints.join(found.hint("shuffle_merge"), KEYS).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("d")).alias("text_sha256"),
    )


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _joined(stored(fingerprints(docs, doc_id, text), "fingerprints"), keep)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    found = stored(keepers(prints, keep).select("d", "keep_id"), "keepers")
    key = free_names(docs, "row_id", "digest")
    digest = F.unhex(F.sha2(normalized(text).cast("binary"), 256))
    tagged = docs.withColumns({key[0]: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), key[1]: digest})
    # an id marks its row unless it is repeated; ids are small, so they, not texts, are counted
    dropped = prints.join(found, "d", "left").where(F.col("id") != F.col("keep_id")).select(F.col("id").alias(key[0]), F.col("d").alias(key[1]))
    dropped = stored(dropped, "dropped")
    out = tagged.join(broadcast_checked(dropped), key, "left_anti")
    repeated = not prints.groupBy("id", "d").count().where("count > 1").isEmpty()
    if repeated:
        out = out.dropDuplicates(key)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
