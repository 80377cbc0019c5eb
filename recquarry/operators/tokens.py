"""Token work on item texts: a pluggable tokenizer with offsets, cuts at token borders, batches by token budget.

A tokenizer is given as a factory.  ``make_tokenize()`` runs once per Python worker and returns a function from a
list of texts to two lists of lists: the ids of each text, and the character offsets where its tokens end.  With the
offsets a text is cut as a text, so nothing has to be decoded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.functions import text as tx
from recquarry.functions.arrays import let
from recquarry.operators.layout import global_running_sums

# Characters a tokenizer gets at once, whatever an Arrow batch holds; a longer text comes alone.
PART_CHARS = 1_000_000
# Words whose ids a worker remembers.
KNOWN_WORDS = 100_000

Tokenize = Callable[[list[str]], tuple[list[list[int]], list[list[int]]]]


def whitespace_tokens() -> Tokenize:
    """Default tokenizer: runs of other than white space; a token's id is 28 bits of its md5."""
    import hashlib
    import re

    known: dict[str, int] = {}

    def number(word: str) -> int:
        if word not in known:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = int(hashlib.md5(word.encode()).hexdigest()[:7], 16)
        return known[word]

    def tokenize(texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        ids, ends = [], []
        for t in texts:
            # no match outlives its token
            found = [(number(m.group()), m.end()) for m in re.finditer(r"\S+", t)]
            ids.append([i for i, _ in found])
            ends.append([e for _, e in found])
        return ids, ends

    return tokenize


def parts(batches: Iterator[pd.Series], most: int | None = None) -> Iterator[list[str]]:
    """The texts of each batch in lists of at most ``most`` characters, or of one text."""
    most = PART_CHARS if most is None else most
    for batch in batches:
        part, held = [], 0
        for t in batch:
            t = t or ""
            if part and held + len(t) > most:
                yield part
                part, held = [], 0
            part.append(t)
            held += len(t)
        yield part


def tokenize(text: str | Column, make_tokenize: Callable[[], Tokenize] = whitespace_tokens) -> Column:
    """Struct (ids, ends) of a text column, in parts of Arrow batches; null texts have no tokens."""

    @F.pandas_udf("ids array<bigint>, ends array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make_tokenize()
        for part in parts(batches):
            ids, ends = encode(part)
            yield pd.DataFrame(
                {
                    "ids": pd.Series([np.asarray(i, "int64") for i in ids], dtype=object),
                    "ends": pd.Series([np.asarray(e, "int32") for e in ends], dtype=object),
                }
            )

    return run(F.col(text) if isinstance(text, str) else text)


def first_tokens(text: Column, ends: Column, n: int) -> Column:
    """The text up to the end of its n-th token, or the whole text when it has no more tokens."""
    return F.when(F.size(ends) > n, F.substring(text, F.lit(1), F.get(ends, F.lit(n - 1)) if n else F.lit(0))).otherwise(text)


def truncate_descriptions(
    items: DataFrame, max_tokens: int, make_tokenize: Callable[[], Tokenize] = whitespace_tokens,
    title: str = "title", description: str = "description",
) -> DataFrame:
    """Replaces the description by what follows the title in the first ``max_tokens`` tokens of both.

    A changed length is marked with "...".
    """
    both = items.withColumn("_text", F.concat(title, description))
    cut = both.withColumn("_kept", first_tokens(F.col("_text"), tokenize("_text", make_tokenize)["ends"], max_tokens))
    rest = tx.after_title(F.col("_kept"), F.col(title), F.col(description))
    return cut.withColumn(description, rest).select(*items.columns)


def encode_items(
    items: DataFrame, prompt: str, keys: Sequence[str], max_tokens: int, known: Column | None = None,
    make_tokenize: Callable[[], Tokenize] = whitespace_tokens, name: str = "tokens",
) -> DataFrame:
    """Adds the ids of each item's joined text, cut to ``max_tokens``."""
    ids = tokenize(tx.item_text(prompt, list(keys), known), make_tokenize)["ids"]
    return items.withColumn(name, F.slice(ids, 1, max_tokens))


def assign_batches(df: DataFrame, length: str, order: Sequence, budget: int) -> DataFrame:
    """Adds ``batch`` such that no batch holds more than ``budget`` tokens, rows staying in ``order``.

    Batches come from one distributed prefix sum of the lengths.  A batch takes the rows whose sum ends inside a window that is
    shorter than the budget by what the longest row can reach back, so windows need not know each other.  Numbers ascend
    but may have gaps.  A row longer than the budget is an error.
    """
    # the sums write the sorted rows, so the longest is read off there and the rows are made once
    summed = global_running_sums(df.withColumn("_len", F.col(length).cast("long")), order, {"_upto": "_len"})
    longest = summed.agg(F.max("_len")).first()[0] or 0
    if longest > budget:
        raise ValueError(f"a row of {longest} tokens does not fit into a batch of {budget}")
    window = budget - max(longest, 1) + 1
    at = F.greatest(F.col("_upto") - 1, F.lit(0))
    return summed.withColumn("batch", F.floor(at / F.lit(window)).cast("long")).drop("_len", "_upto")


def pack_batches(
    sequences: DataFrame, order: Sequence[str], budget: int, max_len: int, emb_slots: int = 1, positives: str = "pos", negatives: str = "neg"
) -> DataFrame:
    """Sequences of token lists end to end, batch by batch.

    ``positives`` and ``negatives`` hold one token list per item.  Returns ``(batch, n_sequences)`` and for both kinds
    ``<kind>_ids``, ``<kind>_lengths``, ``<kind>_cumulative`` (starting with 0) and ``<kind>_positions`` over the whole
    batch, whose ids of both kinds together stay within ``budget``.
    """
    kinds = {"pos": positives, "neg": negatives}
    packed = sequences.select(*order, *(tx.pack_tokens(c, max_len, emb_slots).alias(k) for k, c in kinds.items()))
    packed = packed.withColumn("_n", F.size("pos.ids") + F.size("neg.ids"))
    placed = assign_batches(packed, "_n", list(order), budget)
    # running sums within a sequence, to which a batch adds what lies before the sequence
    sums = {f"{k}_sums": F.slice(running(F.col(k)["lengths"]), F.lit(2), F.size(F.col(k)["lengths"])) for k in kinds}
    placed = placed.withColumns(sums)
    rows = F.sort_array(F.collect_list(F.struct(*order, *kinds, *sums)))
    joined = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("n_sequences"), rows.alias("r"))
    # a field of an array of structs is the array of that field
    out = [F.flatten(F.col(f"r.{k}")[part]).alias(f"{k}_{part}") for k in kinds for part in ("ids", "lengths", "positions")]
    return joined.select("batch", "n_sequences", *out, *(cumulative(F.col(f"r.{s}")).alias(f"{k}_cumulative") for k, s in zip(kinds, sums)))


def running(values: Column) -> Column:
    """Running sums of a short list, from 0 on."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def cumulative(parts: Column) -> Column:
    """Running sums over all lists, from 0 on, out of those of each list; work grows with their lengths, not their squares."""
    totals = F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0).cast("long")))
    moved = let(running(totals), lambda starts: F.transform(parts, lambda p, i: let(F.get(starts, i), lambda s: F.transform(p, lambda x: x + s))))
    return F.concat(F.array(F.lit(0).cast("long")), F.flatten(moved))
