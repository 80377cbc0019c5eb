"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic
programming carries the best score and the number of pieces.  Rules of the tokenizer that are
kept: spaces become the space mark and one is put in front; a character that no piece covers
alone may be an unknown one, ten points below the worst piece, and counts as its UTF-8 bytes where the
vocabulary has byte pieces; of equal scores the path found first stays, that is the one
whose last piece starts earliest.  Scores are added in double precision, so that long texts
do not depend on the rounding of a running sum.

No piece has a space mark after another character (checked when the vocabulary is read), so
the best path of a text is the best paths of its space-led words, and counts of words are kept in a
bounded cache.

Null and empty texts have no pieces.  Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000


class Vocabulary(NamedTuple):
    """Pieces with scores, the score of an unknown character, and whether bytes stand in for it."""

    pieces: dict[str, float]
    unknown: float
    byte_fallback: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Normal pieces of a sentencepiece model file, whose scores are taken as log probabilities."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    return make_vocabulary(pieces, model.trainer_spec.byte_fallback)


def make_vocabulary(pieces: dict[str, float], byte_fallback: bool) -> Vocabulary:
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece reaches over a space; words can't be counted one by one")
    return Vocabulary(pieces, min(pieces.values(), default=0.0) - UNKNOWN_PENALTY, byte_fallback)


class Counter(dict):
    """Word -> number of pieces; a missing word is worked out, and the cache starts anew when full."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        self.unknown, self.byte_fallback = vocabulary.unknown, vocabulary.byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def best_path(self, word: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        found: list[list] = [[] for _ in word]
        if len(self.automaton):
            for end, match in self.automaton.iter(word):
                found[end].append(match)
        score, pieces = [0.0], [0]
        for end, matches in enumerate(found):
            best, count, alone = None, 0, False
            for length, value in sorted(matches, reverse=True):  # earliest start first
                alone |= length == 1
                total = score[end + 1 - length] + value
                if best is None or total > best:
                    best, count = total, pieces[end + 1 - length] + 1
            if not alone:
                total = score[end] + self.unknown
                if best is None or total > best:
                    width = len(word[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                    best, count = total, pieces[end] + width
            score.append(best)
            pieces.append(count)
        return score[-1], pieces[-1]

    def __missing__(self, word: str) -> int:
        n = self.best_path(word)[1]
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, spaces = 0, 0
        lookup = self.__getitem__
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return sum([lookup(MARK + w) for w in words])
        for w in words:
            spaces += 1
            if w:
                total += lookup(MARK * spaces + w)
                spaces = 0
        return total + (lookup(MARK * spaces) if spaces else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def count_tokens(df: DataFrame, path: str, text: str = "text") -> Column:
    """Number of pieces of a text column; the vocabulary is read once per Python worker from the
    tokenizer files every machine has."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in batches:
            yield pd.Series([c.count(t or "") for t in batch], dtype="int64")

    return run(F.col(text).cast("string"))
