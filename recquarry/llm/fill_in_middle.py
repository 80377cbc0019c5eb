"""Fill-in-the-middle transformation with cuts at unit borders.

A unit is a run of the letters A-Z and a-z, or one other code point.  A text of n units is cut
after two drawn numbers of units into prefix, middle and suffix, which are put in another order
behind marks (``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle), or left alone
(``plain``).

The cuts are found without walking the characters.  The UTF-8 bytes of an Arrow batch are
viewed as 64-bit words, eight bytes a word.  Arithmetic on whole words (SWAR) marks each byte
that ends a unit with the high bit of its lane: the next byte must not continue a code point,
and must not be a letter after a letter.  ``bitwise_count`` gives the marks of a word, their running
sum is searched for the word that holds the wanted mark, and the lane inside it follows from
byte-wise prefix sums, a multiplication.  Code points are counted in the same way from the
bytes that begin one.

Draws are hashes of a seed and the id, so a repeated task cuts at the same places.

Cases.  Null and empty texts: no units, plain, empty output.  A text that holds one of the marks:
plain, so that ``restore`` is exact for every row.  Null ids draw like the id ''.  Repeated rows with one
id are cut alike.  A very long text is worked on alone, in memory of a small multiple of its bytes.  An
empty table stays empty.  Columns that clash with a name of the result are replaced by it;
all others are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import text_or_empty

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Bytes of text worked on at once inside a task; the arrays are a small multiple of it.
CHUNK_BYTES = 4_000_000
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"

U = np.uint64


def lanes(byte: int) -> np.uint64:
    """A word with ``byte`` in each of its eight lanes."""
    return U(byte * 0x0101010101010101)


HIGH, ONES, CASE_BIT, SEVEN = lanes(0x80), lanes(1), lanes(0x20), lanes(0x7F)
# added to a seven-bit lane these carry into the high bit from 'a' on, and from the one after 'z' on
FROM_A, PAST_Z = lanes(0x80 - ord("a")), lanes(0x80 - ord("z") - 1)


def letters(words: np.ndarray) -> np.ndarray:
    """High bit of each lane that holds a letter A-Z or a-z."""
    low = (words | CASE_BIT) & SEVEN
    return (low + FROM_A) & ~(low + PAST_Z) & ~words & HIGH


def continuations(words: np.ndarray) -> np.ndarray:
    """High bit of each lane that holds a UTF-8 continuation byte (10xxxxxx)."""
    return words & ~(words << U(1)) & HIGH


def of_next(marks: np.ndarray) -> np.ndarray:
    """Each lane's mark replaced by that of the byte after it."""
    out = marks >> U(8)
    out[:-1] |= marks[1:] << U(56)
    return out


class Marks(NamedTuple):
    """Marked bytes as high bits, with the number of marks up to and including each word."""

    words: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Marks:
        return cls(words, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte position."""
        word, lane = at >> 3, (at & 7).astype(U)
        before = np.where(word > 0, self.upto[word - 1], 0)
        # the lanes below `lane`
        inside = self.words[word] & ((U(1) << (lane * U(8))) - U(1))
        return before + np.bitwise_count(inside)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Byte position of the nth mark, counted from 1."""
        word = np.searchsorted(self.upto, nth, side="left")
        left = nth - np.where(word > 0, self.upto[word - 1], 0)
        # a multiplication sums the marks up to each lane; lanes still below `left` lie before it
        sums = (self.words[word] >> U(7)) * ONES
        short = ((left.astype(U) - U(1)) * ONES | HIGH) - sums
        return word * 8 + np.bitwise_count(short & HIGH)


def unit_ends(data: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the bytes that end a unit and of those that begin a code point.

    ``data``: the bytes of texts one after another, padded with zeros to whole words and at
    least one byte more than the texts; ``ends``: the position after each text that is not empty.
    """
    words = data.view("<u8")
    letter, more = letters(words), continuations(words)
    end = HIGH & ~of_next(more) & ~(letter & of_next(letter))
    end.view(np.uint8)[ends - 1] |= 0x80
    return Marks.of(end), Marks.of(~more & HIGH)


def arrange(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, plain_from: int, spm_below: int) -> Iterator[tuple]:
    """For each text: n, form, code points of prefix and of middle, output bytes.

    ``offsets``: where each text begins, and where the last one ends.  ``draws``: four numbers a text.
    """
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    size = int(offsets[-1])
    padded = np.zeros((size // 8 + 1) * 8, np.uint8)
    padded[:size] = data[:size]
    units, points = unit_ends(padded, stop[stop > start])
    first = units.rank(start)
    n = units.rank(stop) - first
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)

    def at(k: np.ndarray) -> np.ndarray:
        """Position after k units of each text."""
        out = start.copy()
        some = k > 0
        out[some] = units.select(first[some] + k[some]) + 1
        return out

    one, two = at(cuts[:, 0]), at(cuts[:, 1])
    begun, until_one, until_two = points.rank(start), points.rank(one), points.rank(two)
    whole = padded.tobytes()
    for i in range(len(start)):
        text = whole[start[i] : stop[i]]
        if not text or draws[i, 2] % 100 >= plain_from or PREFIX in text or SUFFIX in text or MIDDLE in text:
            yield int(n[i]), "plain", None, None, text
            continue
        head, mid, tail = whole[start[i] : one[i]], whole[one[i] : two[i]], whole[two[i] : stop[i]]
        if draws[i, 3] % 100 < spm_below:
            form, out = "spm", (SUFFIX, tail, PREFIX, head, MIDDLE, mid)
        else:
            form, out = "psm", (PREFIX, head, SUFFIX, tail, MIDDLE, mid)
        yield int(n[i]), form, int(until_one[i] - begun[i]), int(until_two[i] - until_one[i]), b"".join(out)


def restore(output: bytes, form: str) -> bytes:
    """The text that gave an output of this form, from the output alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, rest = output.removeprefix(first).split(second, 1)
    tail, mid = rest.split(MIDDLE, 1)
    if form == "spm":
        head, tail = tail, head
    return head + mid + tail


def groups(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``size`` bytes; a longer text stands alone."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def draw_numbers(id_col: str, seed: int) -> Column:
    """Four numbers of 32 bits: the first hexadecimal groups of the sha256 of ``seed:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def transform(
    df: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars (code points, null if plain), output and restored.

    ``plain_percent`` of the texts stay plain; of the others ``spm_percent`` put the suffix first.
    """

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, draws: pa.Array) -> pa.Array:
        large = texts.cast(pa.large_string())
        offsets = np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, large.offset * 8)
        body = large.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        drawn = draws.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(large), 4)
        made: list[list] = [[], [], [], [], [], []]
        for a, b in groups(offsets):
            here = offsets[a : b + 1] - offsets[a]
            part = data[offsets[a] : offsets[b]]
            for n, form, head, mid, out in arrange(part, here, drawn[a:b], 100 - plain_percent, spm_percent):
                for column, value in zip(made, (n, form, head, mid, out, restore(out, form))):
                    column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(made, kinds)]
        arrays[4:] = [a.cast(pa.string()) for a in arrays[4:]]
        return pa.StructArray.from_arrays(arrays, [f.split()[0] for f in RESULT.split(", ")])

    names = [f.split()[0] for f in RESULT.split(", ")]
    # all input columns travel as one struct, so that no helper name can clash with them
    row = F.struct(*df.columns) if df.columns else F.struct()
    cut = df.select(row.alias("row"), run(text_or_empty(text), draw_numbers(id_col, seed)).alias("r"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in names]
    return cut.select(*kept, *(F.col("r")[c].alias(c) for c in names))
