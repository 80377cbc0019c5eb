"""BPE encoding and decoding of a tokenizers JSON file, cut at forced boundaries.

Every merge makes a token of the vocabulary.  A pair of neighbouring bytes that occurs inside no
token is therefore never joined: no token can span it, and what is merged on one side does not
depend on the other.  All pairs that do occur are kept in a table of 65,536 flags, so one
lookup a byte finds the forced boundaries of a whole batch.  The fragments between them are encoded
independently, and their ids are concatenated.

The file's own rules add boundaries: strings of added tokens stand for themselves, and the rest is
split by the byte-level pattern before merging.  Most borders of that pattern are forced ones
as well; what it adds are splits that the vocabulary alone would allow (white space before a word,
an apostrophe after punctuation).  Fragments are short, the same ones come back all the time, and their ids are kept in a
bounded cache.  A long fragment (a long run of one character) is merged with a heap in n log n.

Ids follow the merge list of the file, pair by pair, not the ids of the joined strings.

Only files whose settings mean exactly this are accepted: model BPE without dropout, unknown token, affixes,
byte fallback and ``ignore_merges``; no normalizer; pre-tokenizer and decoder ByteLevel, no prefix space; added
tokens without stripping.  Anything else raises ``ValueError``.  Truncation and padding are not applied.

Cases.  Null and empty texts give no ids and decode to the empty text.  Lone surrogates cannot be
stored in a Spark string.  Repeated rows, ties (the leftmost of equal pairs is merged first) and very long
texts have no special rule.  An empty table stays empty.  The operators are columns, so no
other column is touched, whatever its name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from recquarry.llm.common import chunks

CACHE_FRAGMENTS = 400_000
CACHED_BYTES = 64
SCANNED_BYTES = 64
# Fixed value: the split pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Code points that became letters or numbers after Unicode 16, by whose classes the library splits.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


class Vocabulary(NamedTuple):
    byte_ids: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, id of the joined token)
    by_id: list[bytes]
    inside: np.ndarray  # 256 * first + second -> the pair occurs inside a token
    added: dict[str, int]
    added_pattern: object | None


def byte_letters() -> dict[str, int]:
    """Byte for each letter of byte-level vocabularies: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"tokenizer file not supported: {what}")


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    _require(model.get("type") == "BPE", "model")
    for setting in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
        _require(not model.get(setting), setting)
    _require(not spec.get("normalizer"), "normalizer")
    _require(before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True), "pre_tokenizer")
    _require(decoder.get("type") == "ByteLevel", "decoder")

    letters = byte_letters()
    vocab: dict[str, int] = model["vocab"]
    _require(all(c in vocab for c in letters), "a byte without a token")
    as_bytes = {token: bytes(letters[c] for c in token) for token in vocab if all(c in letters for c in token)}
    byte_ids = [0] * 256
    for letter, b in letters.items():
        byte_ids[b] = vocab[letter]
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    inside = np.zeros(65536, bool)
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    for _, made in merges.values():
        _require(made < 2**31, "ids")
    for token in as_bytes.values():
        raw = np.frombuffer(token, np.uint8).astype(np.intp)
        inside[raw[:-1] * 256 + raw[1:]] = True

    added = {}
    for entry in spec.get("added_tokens") or []:
        _require(not any(entry.get(k) for k in ("single_word", "lstrip", "rstrip")), "added token")
        added[entry["content"]] = entry["id"]
    by_id = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        by_id[i] = as_bytes.get(token, token.encode())
    for token, i in added.items():
        by_id[i] = token.encode()
    # at one place the longest added token wins
    longest = sorted(added, key=len, reverse=True)
    pattern = regex.compile("|".join(map(regex.escape, longest))) if longest else None
    return Vocabulary(byte_ids, merges, by_id, inside, added, pattern)


@lru_cache(maxsize=2)
def split_pattern(early: bool):
    """The compiled pattern; the shorter one is for texts whose code points all come before the later ones."""
    if early:
        return regex.compile(PATTERN)
    later = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
    letter, number = (rf"[\p{{{kind}}}--[{later}]]" for kind in "LN")
    other = rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]"
    spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r" ?\p{L}", f" ?{letter}").replace(r" ?\p{N}", f" ?{number}")
    return regex.compile(spelled, regex.V1)


def merge(fragment: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one fragment: the pair of the lowest rank is merged first, the leftmost of equal ones."""
    ids = [vocabulary.byte_ids[b] for b in fragment]
    if len(ids) > SCANNED_BYTES:
        return _merge_long(ids, vocabulary.merges)
    find, none = vocabulary.merges.get, (1 << 62, -1)
    pairs = [find(p, none) for p in zip(ids, ids[1:])]
    while pairs:
        low = min(pairs)
        if low is none or low[1] < 0:
            break
        i = pairs.index(low)
        ids[i : i + 2] = [low[1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = find((ids[i], ids[i + 1]), none)
        if i:
            pairs[i - 1] = find((ids[i - 1], ids[i]), none)
    return ids


def _merge_long(ids: list[int], merges: dict) -> list[int]:
    """The same with a heap over linked parts."""
    n = len(ids)
    ids = [*ids]
    after, prior = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            found = merges.get((ids[i], ids[after[i]]))
            if found:
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        # an entry is stale once either part has been merged
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j] = merges[left, right][1], -1
        after[i] = after[j]
        if after[i] < n:
            prior[after[i]] = i
        offer(prior[i])
        offer(i)
    return [i for i in ids if i >= 0]


class Fragments(dict):
    """Fragment -> ids, worked out when missing; starts anew when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, fragment: bytes) -> list[int]:
        ids = merge(fragment, self.vocabulary)
        if len(fragment) <= CACHED_BYTES:
            if len(self) >= CACHE_FRAGMENTS:
                self.clear()
            self[fragment] = ids
        return ids


@lru_cache(maxsize=4)
def fragment_cache(path: str) -> Fragments:
    return Fragments(read_vocabulary(path))


def spans(text: str, vocabulary: Vocabulary) -> Iterator[tuple[int, str]]:
    """Parts of a text in order: (id, string) of an added token, or (-1, ordinary text)."""
    at = 0
    if vocabulary.added_pattern:
        for hit in vocabulary.added_pattern.finditer(text):
            if hit.start() > at:
                yield -1, text[at : hit.start()]
            yield vocabulary.added[hit.group()], hit.group()
            at = hit.end()
    if at < len(text):
        yield -1, text[at:]


def boundaries(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """True at each byte that no token can join to the byte before it; the first byte is one."""
    cut = np.ones(len(data), bool)
    cut[1:] = ~inside[data[:-1].astype(np.intp) * 256 + data[1:]]
    return cut


def encode_batch(texts: list[str], path: str) -> Iterator[list[int]]:
    """Ids of each text."""
    vocabulary, lookup = read_vocabulary(path), fragment_cache(path).__getitem__
    for a, b in chunks(texts):
        # one row for each part: (text, added id or -1), its characters and the lengths of its pieces
        owner, special, parts, sizes, lengths = [], [], [], [], []
        for k in range(a, b):
            for i, part in spans(texts[k], vocabulary):
                found = [part] if i >= 0 else split_pattern(max(part) < chr(LATER[0][0])).findall(part)
                owner.append(k)
                special.append(i)
                parts.append(part)
                sizes.append(len(found))
                lengths += map(len, found)
        whole = "".join(parts).encode()
        data = np.frombuffer(whole, np.uint8)
        # byte position of each code point, and the end
        points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts = points[np.cumsum([0, *lengths])]
        cut = boundaries(data, vocabulary.inside)
        cut[starts[:-1]] = True
        at = np.flatnonzero(cut)
        firsts = starts[np.cumsum([0, *sizes])]  # where each part begins, and the end
        bounds = np.searchsorted(at, firsts).tolist()
        cuts = [*at.tolist(), len(whole)]
        made: list[list[int]] = [[] for _ in range(a, b)]
        for j, (k, i) in enumerate(zip(owner, special)):
            if i >= 0:
                made[k - a].append(i)
                continue
            add = made[k - a].extend
            here = cuts[bounds[j] : bounds[j + 1] + 1]
            for x, y in zip(here, here[1:]):
                add(lookup(whole[x:y]))
        yield from made


def decode_ids(ids: list[int], path: str) -> str:
    """Text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
    by_id = read_vocabulary(path).by_id
    return b"".join([by_id[i] for i in ids if 0 <= i < len(by_id)]).decode("utf-8", "replace")


def encode(text: str | Column, path: str) -> Column:
    """Ids of a text column, ``array<int>``."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(ids, "int32") for ids in encode_batch([t or "" for t in batch], path)], dtype=object)

    return run(_text(text))


def decode(ids: str | Column, path: str) -> Column:
    """Text of an ids column; null and empty give the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([decode_ids([] if i is None else i.tolist(), path) for i in batch], dtype=object)

    return run(F.col(ids) if isinstance(ids, str) else ids)


def digests(text: str | Column, path: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids alone."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for ids in encode_batch([t or "" for t in batch], path):
                packed = np.array(ids, "<u4").tobytes()
                rows.append((len(ids), sha(packed).hexdigest(), sha(decode_ids(ids, path).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(_text(text))


def _text(text: str | Column) -> Column:
    return (F.col(text) if isinstance(text, str) else text).cast("string")
