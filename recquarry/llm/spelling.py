"""Grouping of spelling variants: words one edit apart, the rare one led to the frequent one.

Words are counted over the whole corpus first; everything after that works on distinct words.

Near words are joined by asymmetric q-chunks.  The shorter word of a pair (of equal lengths: the smaller one)
contributes two disjoint chunks, its halves.  The longer word contributes positional grams of the halves' lengths. One
edit lies in one half only and leaves the other as it is: the first half stays where it is, the second moves by the
difference of the lengths, at most one.  So of all positional grams only those at that shift can
meet a chunk, and only these are sent.  Half a word alone still meets many words of a large vocabulary.  Therefore the half
that holds the edit is cut into two chunks by the same rule, one of which is kept as well; a key is the kept half with the kept
quarter: four for the shorter word, eight for the longer one, whatever their length.  Keys meet in an equi-join, and what meets is verified by a banded edit
distance.  No pair is lost; one that meets in several keys counts in the first.

A word's form is the near word of the largest count, if that is ``ratio`` times its own or more; roots
follow forms by pointer doubling.  Counts grow by ``ratio`` in every step, so chains are short: at ratio 5
five rounds reach the end of every chain that 64-bit counts allow.

Large inputs.  Words are pre-aggregated before the shuffle, so a word that holds a third of all rows costs one row a task.
A gram that many distinct words share is a property of the vocabulary, not of the rows; both sides of the
join are written tables, so that the adaptive skew join can split such a key.  Nothing is collected but the number of words that still
move.

Cases.  Null and empty texts have no words.  Null ids count as the id ''.  Repeated rows count as often as they occur.  Ties between
near words of equal count: the smallest in code-point order.  Texts of any length are scanned once.  An empty
table gives no words.  Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import stored, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Counts are 64-bit integers.
MAX_COUNT = 2**63 - 1


def slip(word: Column, id_text: Column, one_in: int) -> Column:
    """Typing slips for trials: drops one code point of about one in ``one_in`` words, chosen by a hash.

    The hash is the crc32 of ``id:word``; its remainder by the length names the code point.
    """
    h = F.crc32(F.concat(id_text, F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % F.lit(one_in) == 0, without).otherwise(word)


def count_words(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = 6, min_count: int = 5, slip_one_in: int | None = None
) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased, with at least ``min_length`` code points and ``min_count`` occurrences."""
    # shorter runs cannot become words; a match always takes the whole run
    runs = F.regexp_extract_all(text_or_empty(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = df.select(id_text.alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if slip_one_in:
        found = found.select(slip(F.col("word"), F.col("id"), slip_one_in).alias("word")).where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def keys(word: Column, length: Column, shift: Column) -> list[Column]:
    """What a word of ``length``, or one longer by ``shift``, keeps if the edit lies in the back or front of either half.

    Everything before the edit keeps its place, everything after it moves by ``shift``.
    """
    half = F.floor(length / 2).cast("int")
    rest = length - half
    front, front_of_rest = F.floor(half / 2).cast("int"), F.floor(rest / 2).cast("int")

    def cut(start: Column, size: Column) -> Column:
        return F.substring(word, start + 1, size)

    nowhere = F.lit(0)
    first, second = cut(nowhere, half), cut(half + shift, rest)
    return [
        F.concat(first, cut(half, front_of_rest)),
        F.concat(first, cut(half + front_of_rest + shift, rest - front_of_rest)),
        F.concat(second, cut(nowhere, front)),
        F.concat(second, cut(front + shift, half - front)),
    ]


def _spread(words: DataFrame, names: tuple[str, str], shifts: list[int]) -> DataFrame:
    word, n = names
    at = []
    for shift in shifts:
        length = F.length(word) - shift
        made = keys(F.col(word), length, F.lit(shift))
        at += [F.struct(F.lit(k).alias("part"), length.alias("length"), key.alias("gram")) for k, key in enumerate(made)]
    return words.select(word, n, F.explode(F.array(*at)).alias("p")).select("p.part", "p.length", "p.gram", word, n)


def chunks_of(words: DataFrame) -> DataFrame:
    """The chunks a word contributes: ``(part, length, gram, word, n)``."""
    return _spread(words, ("word", "n"), [0])


def grams_of(words: DataFrame) -> DataFrame:
    """The positional grams that can meet chunks of a word as long or one shorter: ``(part, length, gram, other, other_n)``."""
    return _spread(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), ("other", "other_n"), [0, 1])


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words that differ by one inserted, deleted or replaced code point, once: ``(word, n, other, other_n)``."""
    left, right = stored(chunks_of(words), "chunks"), stored(grams_of(words), "grams")
    met = left.join(right, ["part", "length", "gram"])
    close = F.levenshtein("word", "other", 1) == 1
    in_order = (F.length("other") > F.col("length")) | (F.col("word") < F.col("other"))
    # a pair that meets in several parts counts in the first
    ours = keys(F.col("word"), F.col("length"), F.lit(0))
    theirs = keys(F.col("other"), F.col("length"), F.length("other") - F.col("length"))
    before = [(F.col("part") > k) & (a == b) for k, (a, b) in enumerate(zip(ours[:-1], theirs[:-1]))]
    found = met.where(in_order & close)
    return found.where(~reduce(lambda a, b: a | b, before)).select("word", "n", "other", "other_n")


def follow(forms: DataFrame, ratio: int) -> DataFrame:
    """``(word, root)`` of the words with a form, by pointer doubling over ``(word, form)``."""
    steps = math.ceil(math.log(MAX_COUNT, ratio))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 2)))):
        at = stored(at, "roots")
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(onward, "root", "left")
        if joined.where("next is not null").isEmpty():
            break
        at = joined.select("word", F.coalesce("next", "root").alias("root"))
    return at


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``(word, n)``."""
    if ratio < 2:
        raise ValueError("the ratio of counts must be two or more")
    words = stored(words, "words")
    pairs = near_pairs(words)
    # each word learns of the other one
    sides = F.array(
        F.struct(F.col("word").alias("word"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near")))
    near = (
        pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    )
    joined = words.join(near, "word", "left")
    enough = -F.col("best.minus_n") >= F.col("n") * ratio
    formed = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(formed.where("form is not null"), ratio)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
