"""Byte-level BPE encoding and decoding with ranks in the tiktoken file format.

Pre-tokenisation works on arrays.  Every code point gets a class (letter, number, space U+0020,
other white space, apostrophe, other).  One rule needs more than the neighbours: whether an
apostrophe opens a token depends on the run it stands in.  That is a small automaton over the
classes; its transition functions compose associatively, so the composition table of all
functions that can arise is worked out once, blocks of characters are composed side by side,
and a scan over the blocks gives the state before every character.  Boundaries then follow
from states, classes and up to two characters ahead.

Pieces between boundaries are merged by rank once and kept in a bounded cache.  Offsets are
kept with the ids: ``encode`` returns where each piece begins, and ``decode`` takes the
lengths of the token bytes, so that each token can be placed in the text again.

Null and empty texts give no ids.  Lone surrogates cannot be stored in a Spark string.
Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import chunks, code_points, text_parts

CACHE_PIECES = 100_000
LONG_PIECE = 100
LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(6)
# Code points with the Unicode property White_Space, U+0020 apart.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# What may follow an apostrophe that opens a token.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
# States: the last character left no open run an apostrophe would join (FREE), it did (JOINS),
# or it was an apostrophe that opened a token (OPENED).
FREE, JOINS, OPENED = range(3)
TRANSITIONS = {
    LETTER: (FREE, FREE, FREE),
    NUMBER: (FREE, FREE, FREE),
    WHITE: (FREE, FREE, FREE),
    SPACE: (JOINS, JOINS, JOINS),
    OTHER: (JOINS, JOINS, JOINS),
    QUOTE: (OPENED, JOINS, JOINS),
}
BLOCK = 64


@cache
def class_table() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            kinds[i] = LETTER
        elif major == "N":
            kinds[i] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    kinds[0x20], kinds[0x27] = SPACE, QUOTE
    return kinds


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of the transitions give: composition table, the element of
    each class, and each element's result from the state FREE.  Element 0 is the identity."""
    elements = [(FREE, JOINS, OPENED)]
    for k in range(6):
        if TRANSITIONS[k] not in elements:
            elements.append(TRANSITIONS[k])
    i = 0
    while i < len(elements):  # closure under composition
        for g in [*elements]:
            for made in (tuple(g[s] for s in elements[i]), tuple(elements[i][s] for s in g)):
                if made not in elements:
                    elements.append(made)
        i += 1
    at = {f: k for k, f in enumerate(elements)}
    then = np.array([[at[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8)
    return then, np.array([at[TRANSITIONS[k]] for k in range(6)], np.uint8), np.array([f[FREE] for f in elements], np.uint8)


def compose_before(elements: np.ndarray) -> np.ndarray:
    """Composition of all elements before each position (an exclusive scan)."""
    then, _, _ = monoid()
    size = then.shape[0]
    flat = then.ravel()
    n = len(elements)
    if n <= BLOCK:
        out, held = np.zeros(n, np.uint8), 0
        for i in range(n):
            out[i] = held
            held = flat[held * size + elements[i]]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # position in the block first
    inside = np.empty_like(grid)
    held = np.zeros(rows, np.uint8)
    for j in range(BLOCK):
        inside[j] = held
        held = flat[held.astype(np.intp) * size + grid[j]]
    carried = compose_before(held).astype(np.intp) * size
    for j in range(BLOCK):
        inside[j] = flat[carried + inside[j]]
    return np.ascontiguousarray(inside.T).ravel()[:n]


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where a piece begins.  ``points`` holds texts with one closing mark each; ``starts``
    are their first positions.  The closing mark always begins a piece of its own."""
    n = len(points)
    ends = np.append(starts[1:], n) - 1
    kind = class_table()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    closing = np.zeros(n + 2, bool)
    closing[ends] = True
    _, of_class, from_free = monoid()
    elements = of_class[kind]
    elements[ends] = of_class[LETTER]  # back to FREE for the next text
    state = from_free[compose_before(elements)]

    before = np.empty_like(kind)
    before[0] = WHITE
    before[1:] = kind[:-1]
    white = (kind == SPACE) | (kind == WHITE)
    white_before = (before == SPACE) | (before == WHITE)
    other = (kind == OTHER) | (kind == QUOTE)
    other_before = (before == OTHER) | (before == QUOTE)
    white_after = np.zeros(n, bool)
    white_after[:-1] = white[1:]
    last_white = white & ~(white_after | closing[1 : n + 1])
    # the last white-space character before something else stands apart from those before it
    begin = np.where(white, ~white_before | last_white, np.where(other, ~other_before, kind != before) & (before != SPACE))
    # a white-space run that ends the text is one piece, and so are runs up to their last character
    opened = np.flatnonzero((kind == QUOTE) & (state == FREE))
    if len(opened):
        padded = np.append(points, np.zeros(3, points.dtype))
        stop = np.zeros(len(opened), np.int64)
        for ending in ENDINGS:
            fits = stop == 0
            for k, c in enumerate(ending, 1):
                fits &= (padded[opened + k] == ord(c)) & ~closing[np.minimum(opened + k, n)]
            stop[fits] = len(ending) + 1
        hit = stop > 0
        at, length = opened[hit], stop[hit]
        begin[at + 1] = False
        after = at + length
        begin[np.minimum(after, n - 1)] |= after < n
        # a quote right after such an ending is a run of its own already: kinds differ there
    begin[ends] = True
    begin |= first[:n]
    return begin


class Ranks(NamedTuple):
    by_bytes: dict[bytes, int]
    by_id: list[bytes]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Ranks:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return Ranks(ranks, by_id)


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: pairs of the lowest rank are merged first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, for pieces too long for scanning."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(piece[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j] = stop, False
        after[i] = after[j]
        if after[i] < n:
            prior[after[i]] = i
        offer(i)
        if prior[i] >= 0:
            offer(prior[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Piece -> ids, worked out when missing.  Pieces that were not asked for while the cache filled up once are forgotten."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = merge_piece(piece.encode("utf-8"), self.ranks)
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def piece_cache(path: str) -> Pieces:
    return Pieces(read_ranks(path).by_bytes)


def encode_batch(texts: list[str], path: str) -> Iterator[tuple[list[int], np.ndarray]]:
    """For each text its ids and the character offsets where pieces begin."""
    lookup = piece_cache(path).__getitem__
    for a, b in chunks(texts):
        part = texts[a:b]
        points, starts = code_points(part)
        at = np.flatnonzero(piece_starts(points, starts))
        bounds = np.searchsorted(at, np.append(starts, len(points)))
        for k, text in enumerate(part):
            offsets = at[bounds[k] : bounds[k + 1]] - starts[k]
            cuts = offsets.tolist()
            ids: list[int] = []
            add = ids.extend
            for i, j in zip(cuts, cuts[1:]):  # the last cut is the closing mark
                add(lookup(text[i:j]))
            yield ids, offsets[:-1]


def decode(ids: list[int], path: str) -> bytes:
    by_id = read_ranks(path).by_id
    return b"".join([by_id[i] for i in ids])


def token_offsets(ids: list[int], path: str) -> np.ndarray:
    """Byte offset in the decoded text where each token begins."""
    by_id = read_ranks(path).by_id
    return np.cumsum([0, *(len(by_id[i]) for i in ids)])[:-1]


def encode(df: DataFrame, path: str, text: str = "text") -> Column:
    """Struct (ids, piece_offsets) of a text column."""

    @F.pandas_udf("ids array<int>, piece_offsets array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(encode_batch([t or "" for t in batch], path))
            yield pd.DataFrame({"ids": [x for x, _ in made], "piece_offsets": [o.astype("int32") for _, o in made]})

    return run(F.col(text).cast("string"))


def digests(df: DataFrame, path: str, text: str = "text") -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids alone."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sha = hashlib.sha256
        names = [str(i) for i in range(len(read_ranks(path).by_id))]
        for batch in batches:
            n, id_sha, text_sha = [], [], []
            for _, _, texts in text_parts(batch):
                for ids, _ in encode_batch(texts, path):
                    n.append(len(ids))
                    id_sha.append(sha(",".join([names[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(sha(decode(ids, path)).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(F.col(text).cast("string"))
