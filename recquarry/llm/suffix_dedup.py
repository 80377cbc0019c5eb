"""Removal of repeated byte strings with suffix arrays.

Removed is every byte covered by a ``LENGTH``-byte string that also starts anywhere else.

1. *Anchors.*  In every ``LENGTH``-byte window the ``GRAM``-byte string with the least hash (the leftmost of
   equal ones) is its anchor.  It depends on the window's bytes alone, so equal windows have
   equal anchors at equal places, and a window can only be repeated if its anchor is.
2. *Segments.*  The bytes of an anchor's windows are its segment, known by a 64-bit digest besides the
   anchor's own.  Where all segments of a repeated anchor are equal, all of its windows are repeated.  Otherwise the
   different segments are cut out, each once with its count.
3. *Suffix arrays.*  Segments meet by anchor.  Within a task suffixes are sorted in two stages: those smaller than
   their successor are sorted directly, by their first ``LENGTH`` bytes; the others are induced by a scan of the
   buckets in order of first bytes, each suffix placing its predecessor.  Neighbours in the array whose
   common prefix is at least ``LENGTH`` bytes are repeated windows; so are those of a segment counted twice.
4. *Removal.*  Marked windows go back to the documents, where covered bytes are merged into runs.

A task sorts a bounded number of suffixes at a time.  An anchor with more than ``HOT_SEGMENTS`` different segments is
not collected: its windows are hashed to 128 bits and counted instead, with map-side combining.

Texts are written once in buckets of their id, a table in the warehouse, so that no join shuffles them.

Defined cases: null texts count as empty; null ids are read as -2^63 and come back as null; texts below ``LENGTH`` bytes stay whole; rows repeated with the same id and
text repeat each other's windows; equal (id, text) rows all get one result.  Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import CHUNK_CHARS, stored, text_or_empty
from recquarry.llm.exact_dedup import NO_ID
from recquarry.llm.minhash_dedup import mix

LENGTH = 200
GRAM = 32
HOT_SEGMENTS = 20_000
# Window starts whose suffixes are sorted at once in a task.
BATCH_WINDOWS = 300_000
_PLACE_BITS = 24
_PIECE = 1 << 23  # longer texts are searched in overlapping pieces of this many bytes


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at every position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    words = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data).data, 0, (1,))
    for k in range(0, GRAM, 8):
        h = (h ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return mix(h)


def window_anchors(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the texts data[starts[i]:stops[i]].

    Returns text number, first and last window start, anchor position and anchor hash, one row per
    anchor.  Positions are those of ``data``, which has at most 2^24 bytes.
    """
    span = LENGTH - GRAM + 1
    h = _gram_hashes(data)
    n = len(h)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < span:
        return empty
    place = np.arange(n, dtype=np.uint64)
    key = (h & ~np.uint64((1 << _PLACE_BITS) - 1)) | place
    rows = -(-n // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int32)
    long = stops - starts >= LENGTH
    valid[starts[long]] += 1
    np.add.at(valid, stops[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return empty
    text = np.searchsorted(starts, at, "right") - 1
    a = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first], at[last], a[first], h[a[first]]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of bounded size: numbers, offsets and bytes; long texts in overlapping pieces."""
    numbers, offsets, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            part = t[at : at + _PIECE]
            if held and size + len(part) > 2 * CHUNK_CHARS:
                yield numbers, offsets, held
                numbers, offsets, held, size = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            held.append(part)
            size += len(part)
            if at + _PIECE >= len(t):
                break
            at += _PIECE - LENGTH + 1
    if held:
        yield numbers, offsets, held


def anchors(docs: DataFrame) -> DataFrame:
    """Rows (id, k, p, h, d) of documents (id, k, text), one per anchor.

    ``p`` packs the first window start, the number of further windows and the anchor's place after
    the first start; ``h`` is the anchor's hash, ``d`` that of its segment, the bytes of all its windows.
    """

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, keys = frame["id"].to_numpy(), frame["k"].to_numpy()
            texts = [t.encode("utf-8") for t in frame["text"]]
            for numbers, offsets, held in _pieces(texts):
                sizes = np.array([len(x) for x in held])
                starts = np.cumsum(sizes) - sizes
                data = b"".join(held)
                t, s, e, a, h = window_anchors(np.frombuffer(data, np.uint8), starts, starts + sizes)
                row = np.array(numbers)[t]
                move = np.array(offsets)[t] - starts[t]
                digest = [segment_hash(data[i : j + LENGTH]) for i, j in zip(s.tolist(), e.tolist())]
                yield pd.DataFrame({"id": ids[row], "k": keys[row], "p": pack(s + move, e - s, a - s), "h": h.view(np.int64), "d": np.array(digest, np.int64)})

    return docs.mapInPandas(find, "id long, k int, p long, h long, d long")


def segment_hash(segment: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(segment, digest_size=8).digest(), "little", signed=True)


def pack(start, more, place):
    return (start << 16) | (more << 8) | place


def unpack(p):
    return p >> 16, (p >> 8) & 255, p & 255


def cut_segments(found: DataFrame) -> DataFrame:
    """Rows (h, d, anchor, windows, seg) from documents with their list ``at`` of anchors to look into.

    A segment that this task has sent before is left out.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[tuple[int, int]] = set()
        for frame in frames:
            out: dict[str, list] = {c: [] for c in ("h", "d", "anchor", "windows", "seg")}
            for text, at in zip(frame["text"], frame["at"]):
                data = text.encode("utf-8")
                for r in at:
                    key = (r["h"], r["d"])
                    if key in sent:
                        continue
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(key)
                    start, more, place = unpack(r["p"])
                    out["h"].append(key[0])
                    out["d"].append(key[1])
                    out["anchor"].append(place)
                    out["windows"].append(more + 1)
                    out["seg"].append(data[start : start + more + LENGTH])
                if len(out["h"]) > 20_000:
                    yield pd.DataFrame(out)
                    out = {c: [] for c in out}
            if out["h"]:
                yield pd.DataFrame(out)

    return found.mapInPandas(cut, "h long, d long, anchor int, windows int, seg binary")


def two_stage_sort(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Order of the wanted suffixes by their first ``depth`` symbols.

    ``data`` holds segments of symbols 1..255, each closed by a 0 at one of ``ends``; ``wanted`` marks positions.
    Suffixes smaller than their successor are sorted directly; the others are induced from them.
    """
    n = len(data)
    change = np.zeros(n, np.int8)
    change[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    change[ends] = 1  # a closing mark is smaller than whatever follows
    # equal neighbours take the direction of the next change
    known = np.where(change != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(known[::-1])[::-1]
    rising = change[following] > 0
    # positions the wanted ones are induced from: each run of falling suffixes down to its first rising one
    rise_at = np.where(rising, np.arange(n), n - 1)
    next_rise = np.minimum.accumulate(rise_at[::-1])[::-1]
    needed = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(needed, at, 1)
    np.add.at(needed, next_rise[at] + 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    direct = np.flatnonzero(needed & rising)
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    first = data[direct]
    bounds = np.searchsorted(first, np.arange(257))
    out = []
    for symbol in range(256):
        part, k = [], 0
        while k < len(induced[symbol]):  # suffixes placed so far may place others in this bucket
            part.append(induced[symbol][k])
            _place_predecessors(induced[symbol][k], data, rising, needed, induced)
            k += 1
        own = direct[bounds[symbol] : bounds[symbol + 1]]
        if len(own):
            part.append(own)
            _place_predecessors(own, data, rising, needed, induced)
        out += part
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def _place_predecessors(order: np.ndarray, data: np.ndarray, rising: np.ndarray, needed: np.ndarray, induced: list) -> None:
    before = order[order > 0] - 1
    before = before[~rising[before] & needed[before]]
    if len(before):
        symbols = data[before]
        place = np.argsort(symbols, kind="stable")
        before, symbols = before[place], symbols[place]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for part in np.split(before, cuts):
            induced[data[part[0]]].append(part)


def repeated_windows(segments: list[bytes], windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """For each segment the window starts from low to high whose LENGTH bytes start in another place, too."""
    sizes = np.array([len(s) + 1 for s in segments])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = starts + sizes - 1
    wanted = np.zeros(len(data) + 1, np.int32)
    low, high = np.maximum(low, 0), np.minimum(high, windows - 1)
    some = low <= high
    wanted[(starts + low)[some]] += 1
    np.add.at(wanted, (starts + high)[some] + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    symbols, depth, unit, marks, closing = data, LENGTH, 1, wanted, ends
    inner = np.ones(len(data), bool)
    inner[ends] = False
    if (data[inner] == 0).any():  # two symbols for a byte leave 0 free
        unit, depth = 2, 2 * LENGTH
        symbols = np.empty(2 * len(data), np.uint8)
        symbols[0::2], symbols[1::2] = (data >> 4) + 1, (data & 15) + 1
        symbols[2 * ends] = symbols[2 * ends + 1] = 0
        marks = np.zeros(2 * len(data), bool)
        marks[0::2] = wanted
        closing = np.sort(np.concatenate((2 * ends, 2 * ends + 1)))
    order = two_stage_sort(symbols, closing, marks, depth) // unit
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    equal = np.zeros(len(order) + 1, bool)
    step = 1 << 16  # common prefixes of neighbours, compared a bounded number of rows at a time
    for i in range(0, len(order) - 1, step):
        a, b = order[i : min(i + step, len(order) - 1)], order[i + 1 : min(i + step, len(order) - 1) + 1]
        equal[i + 1 : i + 1 + len(a)] = (view[a] == view[b]).all(axis=1)
    hit = np.zeros(len(data), bool)
    hit[order[equal[:-1] | equal[1:]]] = True
    return [np.flatnonzero(hit[a : a + w]) for a, w in zip(starts, windows)]


def mark_segments(segments: DataFrame) -> DataFrame:
    """Rows (h, d, runs) for distinct segments, which come sorted by anchor; ``runs`` are inclusive ranges of window starts."""

    def runs(hits: np.ndarray) -> list[tuple[int, int]]:
        if not len(hits):
            return []
        cut = np.flatnonzero(np.diff(hits) > 1)
        return list(zip(hits[np.append(0, cut + 1)].tolist(), hits[np.append(cut, len(hits) - 1)].tolist()))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        segs, windows = frame["seg"].tolist(), frame["windows"].to_numpy(dtype=np.int64)
        anchor, total = frame["anchor"].to_numpy(dtype=np.int64), int(frame["windows"].sum())
        hits: list[list[np.ndarray]] = [[] for _ in segs]
        # equal windows have their anchor at the same offset, so a large group is sorted by offsets
        slices = max(1, -(-total // BATCH_WINDOWS))
        width = -(-(LENGTH - GRAM + 1) // slices)
        for offset in range(0, LENGTH - GRAM + 1, width):
            found = repeated_windows(segs, windows, anchor - (offset + width - 1), anchor - offset)
            for held, f in zip(hits, found):
                held.append(f)
        out = []
        for held, n, w in zip(hits, frame["n"], windows):
            out.append([(0, int(w) - 1)] if n > 1 else runs(np.unique(np.concatenate(held))))
        made = pd.DataFrame({"h": frame["h"].to_numpy(), "d": frame["d"].to_numpy(), "runs": out})
        return made[made["runs"].map(len) > 0]

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            while len(frame):
                # whole anchors only: cut after the last complete one once there is enough
                ahead = frame["windows"].cumsum().to_numpy()
                stop = int(np.searchsorted(ahead, max(BATCH_WINDOWS - size, 0))) + 1
                if stop >= len(frame):
                    held.append(frame)
                    size += int(ahead[-1])
                    break
                h = frame["h"].to_numpy()
                same = np.flatnonzero(h[stop:] != h[stop - 1])
                if not len(same):
                    held.append(frame)
                    size += int(ahead[-1])
                    break
                stop += int(same[0])
                held.append(frame.iloc[:stop])
                yield work(pd.concat(held, ignore_index=True))
                held, size, frame = [], 0, frame.iloc[stop:]
            if size >= 2 * BATCH_WINDOWS:  # finish what is complete
                whole = pd.concat(held, ignore_index=True)
                last = whole["h"].to_numpy() == whole["h"].iloc[-1]
                if not last.all():
                    yield work(whole[~last])
                    whole = whole[last]
                held, size = [whole], int(whole["windows"].sum())
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return segments.select("h", "d", "n", "anchor", "windows", "seg").mapInPandas(mark, "h long, d long, runs array<struct<low: int, high: int>>")


def count_windows(segments: DataFrame) -> DataFrame:
    """The same as ``mark_segments`` for anchors with very many segments: windows are hashed and counted."""
    piece = F.transform(
        F.sequence(F.lit(0), F.col("windows") - 1),
        lambda p: F.struct(
            p.alias("p"),
            F.xxhash64(F.lit(1), F.substring("seg", p + 1, F.lit(LENGTH))).alias("w1"),
            F.xxhash64(F.lit(2), F.substring("seg", p + 1, F.lit(LENGTH))).alias("w2"),
        ),
    )
    each = segments.select("h", "d", "n", F.explode(piece).alias("w")).select("h", "d", "n", "w.*")
    many = each.groupBy("h", "w1", "w2").agg(F.sum("n").alias("times")).where("times > 1")
    hit = each.join(many, ["h", "w1", "w2"])
    return hit.groupBy("h", "d").agg(F.collect_set(F.struct(F.col("p").alias("low"), F.col("p").alias("high"))).alias("runs"))


def by_document(docs: DataFrame) -> DataFrame:
    """Documents (id, k, text) written once in buckets of their id.

    The texts are joined twice; from buckets neither join shuffles them.
    """
    spark = docs.sparkSession
    name = f"suffix_documents_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.write.bucketBy(buckets, "id").sortBy("id").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_runs(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """Rows (id, k, runs) of documents (id, k, text) with repeated windows: inclusive ranges of window starts."""
    hot = HOT_SEGMENTS if hot is None else hot
    found = stored(anchors(docs.where(F.octet_length("text") >= LENGTH)), "anchors")
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    shared = shared.where("times > 1").select("h", (F.col("d0") != F.col("d1")).alias("mixed"))
    # the side of the occurrences may have a hot anchor, the other side has each anchor once
    hits = stored(found.join(shared, "h"), "shared-anchors")
    # an anchor with one segment only: all windows of the segment are repeated
    whole = hits.where("not mixed").select("id", "k", F.array(_range(F.col("p"), F.lit(0), _more("p"))).alias("runs"))
    open_hits = hits.where("mixed").select("id", "k", "p", "h", "d")
    lists = open_hits.groupBy("id", "k").agg(F.collect_set(F.struct("p", "h", "d")).alias("at"))
    lists = lists.select(F.col("id").alias("hid"), F.col("k").alias("hk"), "at").hint("shuffle_merge")
    with_text = docs.join(lists, (F.col("id") == F.col("hid")) & (F.col("k").cast("long") - F.col("hk").cast("long") == 0))
    segments = stored(cut_segments(with_text.select("text", "at")), "segments")
    counts = open_hits.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"))
    once = segments.groupBy("h", "d").agg(*(F.max(c).alias(c) for c in ("anchor", "windows", "seg")))
    distinct = stored(once.join(counts, ["h", "d"]), "distinct-segments")
    large = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("h"), "hot-anchors")
    if large.isEmpty():
        marked = mark_segments(distinct.repartition("h").sortWithinPartitions("h"))
    else:
        marked = mark_segments(distinct.join(large, "h", "left_anti").repartition("h").sortWithinPartitions("h"))
        marked = marked.unionByName(count_windows(distinct.join(large, "h")))
    marked = stored(marked, "marked-segments")
    back = open_hits.join(marked, ["h", "d"])
    moved = back.select("id", "k", F.transform("runs", lambda r: _range(F.col("p"), r["low"], r["high"])).alias("runs"))
    return moved.unionByName(whole).groupBy("id", "k").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _more(p: str) -> Column:
    return F.shiftright(p, 8).bitwiseAND(F.lit(255).cast("long"))


def _range(p: Column, low: Column, high: Column) -> Column:
    start = F.shiftright(p, 16)
    return F.struct((start + low).cast("int").alias("low"), (start + high).cast("int").alias("high"))


def covered_spans(runs: list, size: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges [from, to) of window starts given as inclusive ranges."""
    spans: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        stop = min(high + LENGTH, size)
        if spans and low <= spans[-1][1]:
            if stop > spans[-1][1]:
                spans[-1] = (spans[-1][0], stop)
        else:
            spans.append((low, stop))
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges)."""
    t = text_or_empty(text)
    key = F.shiftright(F.xxhash64(t), 32).cast("int")
    rows = by_document(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), key.alias("k"), t.alias("text")))
    runs = repeated_runs(rows, hot).select(F.col("id").alias("rid"), F.col("k").alias("rk"), "runs").hint("shuffle_merge")
    joined = rows.join(runs, (F.col("id") == F.col("rid")) & (F.col("k").cast("long") - F.col("rk").cast("long") == 0), "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low: int, high: int>>")
    def removed(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, runs):
            data = text.encode("utf-8")
            spans = covered_spans([(r["low"], r["high"]) for r in found], len(data)) if found is not None else []
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    name = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return joined.select(name, removed("text", "runs").alias("r")).select("doc_id", "r.*")
