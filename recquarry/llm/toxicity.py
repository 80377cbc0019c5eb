"""Toxicity scores on texts restored by a noisy-channel decoder.

1. *Character language model.*  Letter trigrams are counted over all documents, summed inside
   each task first; the table has 64 x 64 x 64 cells whatever the input and is interpolated
   with bigrams and unigrams.
2. *Restoration.*  Spans that look disguised are read as lattices: a symbol stands for the letters it
   resembles, a repeated letter or a separator may be dropped, each at a channel cost.  A
   Viterbi search over the last two letters finds the reading that the language model and
   the channel like best.  Readings are added to the words as written.  Spans are: words with
   letters beside look-alikes, with a letter three times in a row, with several doubled letters or a doubled letter
   that words seldom double, with punctuation between letters, or made of look-alikes only; and letters or look-alikes spaced
   out by one to three spaces or symbols, two letters among them.  Plain numbers and prices are left as they are.
3. *Score.*  Words and word beginnings are hashed; each has a shrunken share of toxic documents
   among four fifths of the training documents.  On the last fifth a logistic curve is fitted over
   the strongest word of a document and the sum of its words with more than even odds.

The classifier learns from at most about ``MAX_TRAINING`` labelled rows, taken by a hash of the id
so that a bounded table can be broadcast to the documents; the language model reads all
documents.  Equal texts are learned from once, as toxic if one of their labels is.

Null and empty texts, and texts without letters, get the score of no evidence.  With no labels
at all every score is 0.  Several labels of one id count as toxic if any is.  Null labels are
not learned from.  Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import chunks, code_points, stored, text_parts

MAX_TRAINING = 50_000
FEATURE_BITS = 20
SLAB_BITS = 14  # hashed features whose evidence is worked out together
PREFIXES = (4, 5)
# A feature needs about this many training documents to outweigh the base rate.
SHRINK = 8.0
LETTERS = 64
# Letters that digits and symbols stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h",
}
SEPARATORS = ".-_*~ '"
# Look-alikes that may stand for a spaced-out letter; the others serve as separators there.
SPACED = "0123456789@$€£"
# Letters that words of Latin script seldom double.
SELDOM_DOUBLED = "hijkquvwxy"
# Short words that may come right before a spaced-out word.
ONE_LETTER_WORDS = "aieouy"
HASHED_LETTERS = 40
COST_SUBSTITUTE, COST_DOUBLE, COST_REPEAT, COST_SEPARATOR, COST_DROP = 1.0, 2.5, 0.3, 0.2, 8.0
CACHE_SPANS = 20_000


class Model(NamedTuple):
    trigrams: np.ndarray  # log P(c | a, b), flat
    evidence: np.ndarray  # logit of the share of toxic documents, per hashed feature
    base: float  # logit of no evidence
    curve: tuple[float, float, float]  # intercept, weight of the strongest word, weight of the sum


@cache
def _letter_table() -> np.ndarray:
    """Code point -> letter index: 0 for no letter, then a-z, Latin-1 small letters, others."""
    table = np.fromiter((60 if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint8, 0x110000)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    latin = np.arange(0xDF, 0x100)
    table[latin] = np.where(latin == 0xF7, 0, 27 + latin - 0xDF)
    return table


def trigram_counts(texts: list[str]) -> np.ndarray:
    total = np.zeros(LETTERS**3, np.int64)
    for a, b in chunks(texts):
        points, _ = code_points([t.lower() for t in texts[a:b]])
        at = _letter_table()[points].astype(np.int32)
        if len(at) > 2:
            total += np.bincount((at[:-2] * LETTERS + at[1:-1]) * LETTERS + at[2:], minlength=LETTERS**3)
    return total


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated log probabilities; all cells are positive, so any text has a reading."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1.0) / (uni.sum() + LETTERS)
    p2 = (bi + 20.0 * p1) / (bi.sum(axis=1, keepdims=True) + 20.0)
    p3 = (tri + 20.0 * p2) / (tri.sum(axis=2, keepdims=True) + 20.0)
    return np.log(p3).astype(np.float32).ravel()


class Decoder:
    """Readings of disguised spans, kept in a bounded cache."""

    def __init__(self, trigrams: np.ndarray):
        self.trigrams = trigrams
        self.table = _letter_table()
        self.cache: dict[str, str] = {}

    def read(self, span: str) -> str:
        found = self.cache.get(span)
        if found is None:
            found = self.viterbi(span)
            if len(self.cache) >= CACHE_SPANS:
                self.cache.clear()
            if len(span) <= 64:
                self.cache[span] = found
        return found

    def viterbi(self, span: str) -> str:
        """Best reading; a state is the last two letters, a path a linked list of letters."""
        trigrams, table = self.trigrams, self.table
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        run = 0
        for i, c in enumerate(span):
            run = run + 1 if i and c == span[i - 1] else 0
            options: list[tuple[str, float]] = []
            if table[ord(c)]:
                options.append((c, 0.0))
            options += [(x, COST_SUBSTITUTE) for x in LEET.get(c, "")]
            if c in SEPARATORS:
                drop = COST_SEPARATOR
            elif run:
                drop = COST_DOUBLE if run == 1 else COST_REPEAT
            else:
                drop = None if table[ord(c)] else COST_DROP
            indexed = [(int(table[ord(x)]), x, cost) for x, cost in options]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                if drop is not None and ((a, b) not in after or score - drop > after[a, b][0]):
                    after[a, b] = (score - drop, path)
                row = (a * LETTERS + b) * LETTERS
                for k, x, cost in indexed:
                    total = score - cost + float(trigrams[row + k])
                    if (b, k) not in after or total > after[b, k][0]:
                        after[b, k] = (total, (path, x))
            states = after
        score, path = max(
            ((s + float(trigrams[(a * LETTERS + b) * LETTERS]), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0]
        )
        letters = []
        while path is not None:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters))


@cache
def _flags() -> tuple[np.ndarray, ...]:
    """Per code point: a look-alike, a look-alike of the spaced-out rule, a letter seldom doubled, punctuation that may split a word, white space."""
    tables = []
    for chars in (LEET, SPACED, SELDOM_DOUBLED):
        table = np.zeros(0x110000, bool)
        table[[ord(c) for c in chars]] = True
        tables.append(table)
    splits = np.fromiter((unicodedata.category(chr(i))[0] in "PS" for i in range(0x110000)), bool, 0x110000)
    splits[[ord(c) for c in "'\u2019"]] = False  # contractions
    white = np.zeros(0x110000, bool)
    white[[9, 10, 13, 32]] = True
    return *tables, splits & ~tables[0], white


def disguised_spans(text: str, points: np.ndarray) -> list[str]:
    """Spans of a lower-case text that may hide words, each once; ``points`` are its code points."""
    n = len(points)
    if n < 3:
        return []
    is_leet, is_spaced, is_seldom, is_split, is_white = _flags()
    letter, leet, white = _letter_table()[points] > 0, is_leet[points], is_white[points]
    gaps = np.concatenate(([-1], np.flatnonzero(white), [n]))

    def words_at(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(gaps, places, "right")

    # letters next to look-alikes, and letters three times in a row: the whole word
    same = (points[1:] == points[:-1]) & letter[1:]
    found = [
        words_at(np.flatnonzero((leet[1:] & letter[:-1]) | (leet[:-1] & letter[1:]))),
        words_at(np.flatnonzero(same[1:] & same[:-1])),
        words_at(np.flatnonzero(same & is_seldom[points[1:]])),
        # punctuation between letters
        words_at(np.flatnonzero(letter[2:] & is_split[points[1:-1]] & letter[:-2])),
    ]
    doubled = words_at(np.flatnonzero(same))
    found.append(doubled[1:][doubled[1:] == doubled[:-1]])
    # words of look-alikes only: three or more, not all the same, and more than an amount
    first, stop = gaps[:-1] + 1, gaps[1:]
    count = np.concatenate(([0], np.cumsum(leet)))
    symbols = np.concatenate(([0], np.cumsum(leet & ~((points >= 48) & (points <= 57)))))
    only = (stop - first >= 3) & (count[stop] - count[first] == stop - first) & (symbols[stop] - symbols[np.minimum(first + 1, n)] > 0)
    alike = [g for g in np.flatnonzero(only).tolist() if len(set(text[first[g] : stop[g]])) > 1]
    spans = [text[gaps[g - 1] + 1 : gaps[g]].strip(".,;:?\"'()") for g in np.unique(np.concatenate(found)).tolist()]
    spans += [text[first[g] : stop[g]] for g in alike]
    # spaced out: single letters or look-alikes with one to three spaces or symbols of a line between them
    unit = letter | is_spaced[points]
    single = unit.copy()
    single[1:] &= ~unit[:-1]
    single[:-1] &= ~unit[1:]
    at = np.flatnonzero(single)
    if len(at) > 2:
        units, breaks = np.concatenate(([0], np.cumsum(unit))), np.concatenate(([0], np.cumsum(~(unit | leet | is_split[points] | white) | (points == 10))))
        step = np.diff(at)
        joined = (step <= 4) & (units[at[1:]] - units[at[:-1]] == 1) & (breaks[at[1:]] == breaks[at[:-1]])
        edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        letters = np.concatenate(([0], np.cumsum(letter[at])))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            size, known = b - a + 1, int(letters[b + 1] - letters[a])
            if size < 3 or known < 2 or (known < size and size < 4):
                continue
            spans.append(text[at[a] : at[b] + 1])
            if size > 3 and text[at[a]] in ONE_LETTER_WORDS:
                spans.append(text[at[a + 1] : at[b] + 1])
    return list(dict.fromkeys(spans))


def restore(text: str, decoder: Decoder, points: np.ndarray) -> list[str]:
    """Readings of all disguised spans."""
    return [r for r in (decoder.read(s) for s in disguised_spans(text, points)) if r]


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hashed feature and word number of every word and word beginning of lower-case texts."""
    points, starts = code_points(texts)
    letter = _letter_table()[points] > 0
    edge = np.diff(letter.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # texts are closed by line feeds
    length = end - begin
    owner = np.searchsorted(starts, begin, "right") - 1
    number = np.arange(len(begin))
    # running polynomial hash of the first letters, then of the whole word
    h = np.zeros(len(begin), np.uint64)
    out_owner, out_feature, out_word = [], [], []
    shift, mult = np.uint64(64 - FEATURE_BITS), np.uint64(0x9E3779B97F4A7C15)
    alive = np.arange(len(begin))
    for k in range(int(length.max(initial=0))):
        alive = alive[length[alive] > k]
        if not len(alive):
            break
        if k == HASHED_LETTERS:  # the few long words: all their letters at once
            rest = np.fromiter((zlib.crc32(points[begin[i] : end[i]].tobytes()) for i in alive.tolist()), np.uint64, len(alive))
            h[alive] = (h[alive] ^ rest) * np.uint64(1099511628211)
            break
        h[alive] = (h[alive] ^ points[begin[alive] + k]) * np.uint64(1099511628211)
        if k + 1 in PREFIXES:
            out_owner.append(owner[alive])
            out_feature.append(((h[alive] ^ np.uint64(k)) * mult) >> shift)
            out_word.append(alive)
    out_owner.append(owner)
    out_feature.append(((h ^ np.uint64(0xABCDEF)) * mult) >> shift)
    out_word.append(number)
    return np.concatenate(out_owner), np.concatenate(out_feature).astype(np.int64), np.concatenate(out_word)


def prepared(texts: list[str], decoder: Decoder) -> list[str]:
    """Lower-case texts with the readings of their disguised spans added."""
    lower = [t.lower() for t in texts]
    points, starts = code_points(lower)
    stops = np.append(starts[1:], len(points)) - 1
    out = []
    for text, a, b in zip(lower, starts.tolist(), stops.tolist()):
        readings = restore(text, decoder, points[a:b])
        out.append(text + " " + " ".join(readings) if readings else text)
    return out


def document_counts(texts: list[str], toxic: np.ndarray, decoder: Decoder, counts: np.ndarray | None = None) -> np.ndarray:
    """Rows of clean and toxic documents that hold each feature, added to ``counts`` if given."""
    width = 1 << FEATURE_BITS
    counts = np.zeros((2, width), np.int64) if counts is None else counts
    for a, b in chunks(texts):
        owner, feature, _ = word_features(prepared(texts[a:b], decoder))
        pairs = np.unique((owner << FEATURE_BITS) | feature)
        label = toxic[a:b][pairs >> FEATURE_BITS]
        feature = pairs & (width - 1)
        for k in (0, 1):
            np.add.at(counts[k], feature[label == k], 1)
    return counts


def evidence(counts: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, float]:
    rate = (toxic + 0.5) / (clean + toxic + 1.0)
    share = (counts[1] + rate * SHRINK) / (counts.sum(axis=0) + SHRINK)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share)).astype(np.float32), float(np.log(rate / (1 - rate)))


def strengths(texts: list[str], values: np.ndarray, base: float, decoder: Decoder) -> np.ndarray:
    """Per text: logit of the strongest word and the sum of the positive logits, at most 20."""
    out = np.zeros((len(texts), 2))
    out[:, 0] = base
    for a, b in chunks(texts):
        owner, feature, word = word_features(prepared(texts[a:b], decoder))
        value = values[feature]
        top = np.full(b - a, -np.inf)
        np.maximum.at(top, owner, value)
        strong = np.flatnonzero(value > 0)
        per_word = pd.DataFrame({"o": owner[strong], "w": word[strong], "v": value[strong]}).groupby(["o", "w"])["v"].max()
        out[a:b, 0] = np.where(np.isfinite(top), top, base)
        above = np.bincount(per_word.index.get_level_values(0), weights=per_word.to_numpy(), minlength=b - a)
        out[a:b, 1] = np.minimum(above, 20.0)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps, both classes with the same total weight.  With one class only, plain logits."""
    if not 0 < y.sum() < len(y):
        return 0.0, 1.0, 0.0
    z = np.column_stack((np.ones(len(x)), x))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in beta)


def score_texts(texts: list[str], model: Model, decoder: Decoder) -> np.ndarray:
    if not np.isfinite(model.base):
        return np.zeros(len(texts))
    x = strengths(texts, model.evidence, model.base, decoder)
    a, b, c = model.curve
    return 1.0 / (1.0 + np.exp(-np.clip(a + x @ np.array([b, c]), -500, 500)))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """``labels`` are the training rows; ``documents`` are all documents."""
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for _, _, part in text_parts(batch.column("text")):
                total += trigram_counts([t for t in part if t])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": used.astype(np.int32), "n": total[used]})

    cells = texts.select("text").mapInArrow(count_letters, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LETTERS**3)
    counts[cells["cell"].to_numpy(dtype=int)] = cells["n"].to_numpy()
    trigrams = trigram_model(counts)
    shared = spark.sparkContext.broadcast(trigrams)

    by_id = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    known = stored(by_id.agg(F.max((F.col(toxic) > 0).cast("int")).alias("toxic")), "labels")
    share = min(1.0, MAX_TRAINING / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(5))
    rows = texts.join(F.broadcast(sample), "id").where(F.col("text").isNotNull())
    # equal texts are one row, whatever tasks they are read by
    rows = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = stored(rows.select("text", "toxic", fold.alias("fold")), "training")

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, total = Decoder(shared.value), np.zeros((2, 1 << FEATURE_BITS), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, b, part in text_parts(batch.column("text")):
                document_counts(part, toxic[a:b], decoder, total)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"cell": used.astype(np.int32), "clean": total[0, used], "toxic": total[1, used]})

    learned = rows.where("fold > 0")
    docs = [0, 0]
    for r in learned.groupBy("toxic").count().collect():  # two rows
        docs[r["toxic"]] = r["count"]
    _, base = evidence(np.zeros((2, 1)), *docs)

    def weigh(frame: pd.DataFrame) -> pd.DataFrame:
        slab, counts = int(frame["cell"].iloc[0]) >> SLAB_BITS, np.zeros((2, 1 << SLAB_BITS))
        counts[:, frame["cell"].to_numpy() & ((1 << SLAB_BITS) - 1)] = frame[["clean", "toxic"]].to_numpy().T
        return pd.DataFrame({"slab": [slab], "logits": [evidence(counts, *docs)[0].tobytes()]})

    # the tasks turn counts into evidence, so the driver holds 4 bytes for each hashed feature
    sums = learned.mapInArrow(count_features, "cell int, clean long, toxic long")
    sums = sums.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    slabs = sums.groupBy(F.shiftright("cell", SLAB_BITS)).applyInPandas(weigh, "slab int, logits binary")
    values = np.full(1 << FEATURE_BITS, base, np.float32)
    for r in slabs.collect():  # 2^(FEATURE_BITS - SLAB_BITS) rows
        values[r["slab"] << SLAB_BITS : (r["slab"] + 1) << SLAB_BITS] = np.frombuffer(r["logits"], np.float32)
    if not sum(docs):
        return Model(trigrams, values, -np.inf, (0.0, 1.0, 0.0))
    known_values = spark.sparkContext.broadcast((values, base))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for a, b, part in text_parts(batch.column("text")):
                x = strengths(part, *known_values.value, decoder)
                toxic = batch.column("toxic").slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"top": x[:, 0].copy(), "above": x[:, 1].copy(), "toxic": toxic})

    # a fifth of the bounded sample
    held = rows.where("fold = 0").mapInArrow(measure, "top double, above double, toxic int").toPandas()
    held = held.sort_values(["top", "above", "toxic"])
    curve = fit_curve(held[["top", "above"]].to_numpy(dtype=float), held["toxic"].to_numpy(dtype=float))
    return Model(trigrams, values, base, curve)


def score(df: DataFrame, model: Model, text: str = "text") -> Column:
    """Probability-like score of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, decoder = shared.value, Decoder(shared.value.trigrams)
        for batch in batches:
            scores = [score_texts(part, known, decoder) for _, _, part in text_parts(batch)]
            yield pa.array(np.concatenate([np.zeros(0), *scores]))

    return run(F.col(text).cast("string"))
