"""Line deduplication with overlapping windows of three lines.

Windows of three consecutive lines are hashed to 128 bits and grouped over all documents with
map-side combining, which finds the windows that occur more than once and their first
occurrence in the order (id, text hash, position).  Later occurrences are removed: the covered line
positions of a document are merged, and the remaining lines are joined again.

Defined cases: lines end at line feeds; a document with fewer than three lines has no window and
stays whole; windows without any character other than white space are no windows; null
texts count as empty; lines of a first occurrence are not removed by its own repeats that overlap it
(four equal lines become three).  Rows repeated with the same id and text are one
document, and each of them gets the same result.  Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import held, text_or_empty

WINDOW = 3


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = text_or_empty(text)
    return held(docs.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("k"), t.alias("lines")), lines=F.split("lines", "\n", -1))


def windows(lines: DataFrame) -> DataFrame:
    """Rows (id, k, pos, h1, h2) of all windows; ``pos`` is the 0-based first line."""

    def window(i):
        part = [F.get("lines", i + j) for j in range(WINDOW)]
        blank = F.concat(*part).rlike(r"^\s*$")
        return F.when(
            ~blank,
            F.struct(i.alias("pos"), F.xxhash64(F.lit(1), *part).alias("h1"), F.xxhash64(F.lit(2), *part).alias("h2")),
        )

    each = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)
    found = F.explode_outer(each).alias("w")
    return lines.where(F.size("lines") >= WINDOW).select("id", "k", found).where("w is not null").select("id", "k", "w.*")


def repeated_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, k, removed): line positions that later occurrences cover, in no order."""
    lines = _lines(docs, doc_id, text)
    seen = windows(lines)
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "k", "pos")
    # repeated rows of one document give the same place, so occurrences are told apart by least and greatest
    first = (
        seen.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last")
        .select("h1", "h2", F.col("first.id").alias("id0"), F.col("first.k").alias("k0"), F.col("first.pos").alias("pos0"))
    )
    same = F.col("id").eqNullSafe(F.col("id0")) & (F.col("k") == F.col("k0"))
    later = seen.join(first, ["h1", "h2"]).where(~(same & (F.col("pos") == F.col("pos0"))))
    covered = F.sequence(F.col("pos"), F.col("pos") + WINDOW - 1)
    kept_back = F.when(same, F.array_except(covered, F.sequence(F.col("pos0"), F.col("pos0") + WINDOW - 1))).otherwise(covered)
    return later.groupBy("id", "k").agg(F.array_distinct(F.flatten(F.collect_set(kept_back))).alias("removed"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (positions in order), text (what stays)."""
    lines = _lines(docs, doc_id, text)
    removed = repeated_positions(docs, doc_id, text).select(F.col("id").alias("rid"), F.col("k").alias("rk"), "removed")
    joined = lines.join(removed, (F.col("k") == F.col("rk")) & F.col("id").eqNullSafe(F.col("rid")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.filter("lines", lambda _, i: ~F.array_contains(gone, i))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.array_sort(gone).alias("removed"),
        F.when(F.size(gone) == 0, F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
