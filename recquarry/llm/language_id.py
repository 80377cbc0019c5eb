"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on every labelled row, summed inside each task before
anything is shuffled: a task sends at most ``languages x buckets`` rows, whatever it read.  The
log-probability matrix has ``languages x buckets`` floats, so its size does not follow the
number of documents; it is broadcast and batches of texts are scored with it in numpy.

Null labels are not learned from.  Without any labelled row every prediction is ``und``.
A text that is null or has no letter gets ``und`` and the score 0.  Ties go to the language
that sorts first.  Repeated rows and extra columns change nothing: each row is scored by its
text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import chunks, code_points

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
# More labels than this are refused: the matrix is meant to be broadcast.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


class Model(NamedTuple):
    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def hashed_ngrams(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, order * 40503, np.uint32)
    for k in range(order):
        h += points[k : k + n] * _MULTIPLIERS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return h >> np.uint32(32 - BUCKET_BITS)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all texts in a row and where each text's begin.

    A text is closed by a line feed, which is its end mark; no n-gram reaches into the next.
    """
    points, starts = code_points([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    for order in ORDERS:
        h = hashed_ngrams(points, order)
        inside = owner[: len(h)] == owner[order - 1 : order - 1 + len(h)]
        kept = owner[: len(h)][inside]
        yield h[inside], np.searchsorted(kept, np.arange(len(starts) + 1))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows whose label is not null."""
    width = 1 << BUCKET_BITS

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for frame in frames:
            for name, part in frame.groupby("lang"):
                total = grams.setdefault(name, np.zeros(width, np.int64))
                docs[name] = docs.get(name, 0) + len(part)
                texts = [t or "" for t in part["text"]]
                for a, b in chunks(texts):
                    for buckets, _ in _grams(texts[a:b]):
                        total += np.bincount(buckets, minlength=width)
        for name, total in grams.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": used.astype("int32"), "n": total[used]})
            yield pd.DataFrame({"lang": [name], "bucket": np.array([-1], "int32"), "n": [docs[name]]})

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.toPandas()  # at most languages x buckets rows
    languages = sorted(counted["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} can be told apart")
    counts, docs = np.zeros((len(languages), width)), np.zeros(len(languages))
    at = counted["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=int)
    bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    counts[at[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    docs[at[bucket < 0]] = n[bucket < 0]
    smooth = counts + 1.0
    log_prob = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else counts
    log_prior = np.log(docs / docs.sum()) if languages else docs
    return Model(languages, log_prob.astype(np.float32), log_prior)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Log joint probability per text and language, in double precision sums of n-gram values."""
    out = np.tile(model.log_prior, (len(texts), 1))
    for buckets, bounds in _grams(texts):
        starts = bounds[:-1]
        filled = bounds[1:] > starts
        for k in range(len(model.languages)):
            if len(buckets):
                sums = np.add.reduceat(model.log_prob[k][buckets], starts[filled], dtype=np.float64)
                out[filled, k] += sums
    return out


def predict(texts: pd.Series, model: Model) -> pd.DataFrame:
    values = [t or "" for t in texts]
    names, scores = [UNKNOWN] * len(values), np.zeros(len(values))
    if model.languages:
        for a, b in chunks(values):
            part = values[a:b]
            points, starts = code_points(part)
            known = np.logical_or.reduceat(_letters()[points], starts)
            joint = score_texts(model, part)
            best = joint.argmax(axis=1)
            share = 1.0 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
            for i in np.flatnonzero(known):
                names[a + i], scores[a + i] = model.languages[best[i]], share[i]
    return pd.DataFrame({"lang_pred": names, "score": scores})


def identify(df: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column: the language and its posterior probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch, shared.value)

    return run(F.col(text).cast("string"))
