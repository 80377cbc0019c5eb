"""Near-duplicate classes with ProbMinHash, banding and exact verification.

*Signature.*  A document is its set of five-word shingles, all of weight 1 however often they occur, since
links are judged by sets.  Every
shingle starts a Poisson process whose rate is its weight; its arrivals fall on random registers, and a
register keeps the shingle that arrived first.  Registers of two documents agree with their
probability Jaccard similarity, which is the Jaccard similarity of the sets when weights are equal.  A process ends as soon as its next arrival is later than all
registers of its document, so the work is about the number of shingles plus a constant.

*Candidates.*  Documents with equal shingle sets are one node.  Nodes meet in buckets of bands of
registers.  In a bucket of at most ``SMALL`` nodes all are compared; in a larger one each
is compared with the bucket's most central node.  The nodes of large buckets that still hold more than
one class go through an exact set-similarity join by prefix filter, which finds every pair across classes
that reaches the threshold.  Pairs inside one class are not compared again.

*Verification.*  Pairs of the bands whose registers agree often enough, and all pairs of the exact join, are
compared by their exact shingle sets; a link is a Jaccard similarity of at least 0.8.  Classes are the connected
components of the links, found by alternating star contractions with stored rounds.

A pair at similarity 0.8 misses all bands with probability (1 - 0.8^5)^24, about 1 in 10,000.  A pair that
meets in a band is compared or already in one class.  ``n_links`` counts the links that were verified; in large
buckets pairs inside one class are left out, so it is no count of all near copies.

Defined cases: words are runs of letters and digits in lower case; a text with one to
four words is one shingle; a text without words is alone in its class, as is a row without
an id; rows with the same id are one document.  The class id is its smallest document id.
Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import CHUNK_CHARS, broadcast_checked, code_points, free_names, stored, text_parts

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
SMALL = 16
# Counts that order shingles by frequency, and nodes of one key that are compared with in one group.
CELLS = 1 << 20
SALT = 256
# Pairs whose registers agree less often are not verified; at 0.8 this is six standard deviations away.
MIN_AGREEMENT = 0.55
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1 + max(SHINGLE, ROWS))]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for longer texts than a chunk are not kept."""
    known = 1 << CHUNK_CHARS.bit_length()
    return tuple(p[:n] for p in _known_powers(known)) if n <= known else _make_powers(n)


@cache
def _known_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(n)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct shingles, ordered by owner and hash."""
    points, starts = code_points([t.lower() for t in texts])
    word = _word_characters()[points]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + _GOLD) * up, out=sums[1:])
    words = mix((sums[end] - sums[begin]) * down[begin])
    owner = np.searchsorted(starts, begin, "right") - 1
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    reach = np.bincount(owner, minlength=len(texts))[owner]  # words of the document
    last = np.cumsum(np.bincount(owner, minlength=len(texts)))[owner] - 1
    index = np.arange(n)
    for k in range(SHINGLE):
        at = np.minimum(index + k, n - 1)
        inside = index + k <= last
        total += np.where(inside, mix(words[at] + _SALTS[k + 1]), np.uint64(0))
    # whole shingles, or the only one of a short document
    whole = (index + SHINGLE - 1 <= last) | ((reach < SHINGLE) & (index == last - reach + 1))
    owner, value = owner[whole], mix(total[whole])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def prob_min_hash(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, documents: int) -> np.ndarray:
    """Registers (documents x REGISTERS) holding the shingle that arrived first; 0 without shingles."""
    registers = np.zeros((documents, REGISTERS), np.uint64)
    flat = registers.ravel()
    first = np.full(documents * REGISTERS, np.inf)
    rate = weight.astype(float)
    time = np.zeros(len(value))
    state = value.copy()
    while len(value):
        state += _GOLD
        draw = mix(state)
        other = mix(draw ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        cell = owner * REGISTERS + (other % np.uint64(REGISTERS)).astype(np.int64)
        early = time < first[cell]
        if early.any():
            np.minimum.at(first, cell[early], time[early])
            won = early & (time == first[cell])
            flat[cell[won]] = value[won]
        alive = time < first.reshape(documents, REGISTERS).max(axis=1)[owner]
        owner, value, rate, time, state = owner[alive], value[alive], rate[alive], time[alive], state[alive]
    return registers


def band_hashes(registers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(registers), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            out[:, b] = mix(out[:, b] + registers[:, b * ROWS + r] + _SALTS[r + 1])
    return out.astype(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, f1, f2, n, bands, marks): set fingerprint, number of shingles, band hashes, register bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_parts(batch.column("text")):
                owner, value, _ = shingles(texts)
                # repeated passages must not move the registers away from the similarity of the sets
                registers = prob_min_hash(owner, value, np.ones(len(value)), b - a)
                sums = np.zeros((2, b - a), np.uint64)
                np.add.at(sums[0], owner, mix(value ^ np.uint64(0xA5A5)))
                np.add.at(sums[1], owner, mix(value ^ np.uint64(0x5A5A5A)))
                marks = registers.astype(np.uint8)
                cuts = np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(a, b - a),
                        "f1": sums[0].astype(np.int64),
                        "f2": sums[1].astype(np.int64),
                        "n": np.bincount(owner, minlength=b - a).astype(np.int64),
                        "bands": pa.ListArray.from_arrays(cuts, band_hashes(registers).ravel()),
                        "marks": pa.array([m.tobytes() for m in marks], pa.binary()),
                    }
                )

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, "id long, f1 long, f2 long, n long, bands array<long>, marks binary")


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, shingles): distinct shingle hashes of 32 bits."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_parts(batch.column("text")):
                owner, value, _ = shingles(texts)
                cuts = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                small = pa.array(value.astype(np.uint32).view(np.int32))
                sets = pa.ListArray.from_arrays(cuts, small)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(a, b - a), "shingles": sets})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(collect, "id long, shingles array<int>")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal register bytes."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, REGISTERS)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, REGISTERS)
    return pd.Series((x == y).mean(axis=1))


def linked(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b, similarity) among pairs a < b by their exact shingle sets."""
    both = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)
    links = both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= THRESHOLD)
    return stored(links, "links")


def sets_of(asked: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Stored shingle sets of the nodes in a stored table."""
    rows = docs.join(broadcast_checked(asked), F.col(doc_id).cast("long") == F.col("node"), "left_semi")
    return stored(shingle_sets(rows, doc_id, text), "shingle-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b, similarity) among candidate pairs a < b whose registers agree often enough."""
    agrees = F.pandas_udf(agreement, "double")
    marks = nodes.select("node", "marks")
    near = (
        pairs.join(marks.withColumnRenamed("node", "a").withColumnRenamed("marks", "ma"), "a")
        .join(marks.withColumnRenamed("node", "b").withColumnRenamed("marks", "mb"), "b")
        .where(agrees("ma", "mb") >= MIN_AGREEMENT)
        .select("a", "b")
    )
    near = stored(near, "near-pairs")
    asked = stored(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "asked")
    return linked(near, sets_of(asked, docs, doc_id, text))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) of all nodes with an edge (a, b); the label is the least node of the component.

    Alternating large-star and small-star contractions; the edges of each round are stored.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # every edge now points to a smaller node
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(small.union(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
        check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
        before = check


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of the nodes in small buckets."""
    nodes = rows.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("m"))  # at most SMALL
    pairs = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return nodes.where(F.size("m") > 1).select(F.explode(F.flatten(pairs)).alias("p")).select("p.x", "p.y")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b")


def first_candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of the bands, and the rows (key, node) of large buckets; both stored."""
    bucket = nodes.select("node", F.posexplode("bands").alias("band", "h")).select("node", F.xxhash64("band", "h").alias("key"))
    shared = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = stored(bucket.join(shared, "key"), "shared-buckets")
    popularity = rows.groupBy("node").agg(F.sum("size").alias("popularity"))
    large = stored(rows.where(F.col("size") > SMALL).join(popularity, "node"), "large-buckets")
    small = _small_pairs(rows.where(F.col("size") <= SMALL))
    hub = large.groupBy("key").agg(F.max_by("node", F.struct("popularity", -F.col("node"))).alias("hub"))
    stars = large.join(hub, "key")
    pairs = _ordered(small, "x", "y").union(_ordered(stars, "node", "hub")).distinct()
    return stored(pairs, "pairs"), large.select("key", "node")


def crowded(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, label) of the nodes in large buckets that hold more than one class; stored."""
    labelled = large.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled-buckets")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1")
    return stored(labelled.join(mixed.select("key"), "key", "left_semi").select("node", "label").distinct(), "crowd")


def prefix_rows(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, node, label, n, p): the rarest shingles of every node and their places in the common order.

    The order is by rising frequency of the shingle's cell in a table of ``CELLS`` counts, then by the
    shingle.  Any order common to all nodes finds every pair; rare ones in front keep the groups small.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for frame in frames:
            for s in frame["shingles"]:
                np.add.at(total, np.unique(s) & (CELLS - 1), 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"cell": used.astype(np.int32), "n": total[used]})

    cells = sets.select("shingles").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, keys, places = [], [], []
            for s in frame["shingles"]:
                s = np.unique(s)
                first = np.lexsort((s, shared.value[s & (CELLS - 1)]))[: len(s) - math.ceil(THRESHOLD * len(s) - 1e-6) + 1]
                sizes.append(len(s))
                keys.append(s[first])
                places.append(np.arange(len(first), dtype=np.int32))
            many = [len(k) for k in keys]
            if sum(many):
                yield pd.DataFrame(
                    {
                        "key": np.concatenate(keys),
                        "node": np.repeat(frame["node"].to_numpy(), many),
                        "label": np.repeat(frame["label"].to_numpy(), many),
                        "n": np.repeat(sizes, many),
                        "p": np.concatenate(places),
                    }
                )

    rows = sets.join(crowd, F.col("id") == F.col("node")).select("node", "label", "shingles")
    return stored(rows.mapInPandas(cut, "key int, node long, label long, n int, p int"), "prefixes")


def exact_candidates(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs across classes of the crowd that may reach the threshold: a set-similarity join by prefix filter.

    Two sets that reach it share a shingle among the first n - ceil(t n) + 1 of the larger one and the first
    n - ceil(2t / (1 + t) n) + 1 of the smaller one, and behind it enough shingles are left in both.
    A core that all nodes share is no key of the smaller ones unless they are alike but for less than that.
    """
    rows = prefix_rows(crowd, sets)
    short = F.col("p") <= F.col("n") - F.ceil(2 * THRESHOLD / (1 + THRESHOLD) * F.col("n") - 1e-6)
    per_class = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(short).alias("short"))
    keys = per_class.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("short").alias("short"), F.max_by("label", F.struct("rows", "label")).alias("top")
    )
    keys = stored(keys.where("classes > 1 AND short > 0").select("key", "top", F.ceil(F.col("short") / SALT).cast("int").alias("salts")), "prefix-keys")
    rows = stored(rows.withColumn("short", short).join(keys, "key"), "keyed-prefixes")
    # pairs inside a key's largest class are never made: side 0 is the other classes with all, side 1 the largest one with the others
    inside = F.col("label") == F.col("top")
    left = rows.where("short").select(
        "key", F.when(inside, 1).otherwise(0).alias("side"), F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"),
        F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("p").alias("px"),
    )
    right = rows.select("*", F.explode(F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(
        "key", "side", "salt", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("p").alias("py")
    )
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    close = (
        (F.col("lx") != F.col("ly"))
        & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
        & (F.col("nx") >= THRESHOLD * F.col("ny") - 1e-6)
        & (rest >= THRESHOLD / (1 + THRESHOLD) * (F.col("nx") + F.col("ny")) - 1e-6)
    )
    return stored(_ordered(left.join(right, ["key", "side", "salt"]).where(close), "x", "y").distinct(), "pairs")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links (verified links of its node to other texts)."""
    signed = stored(signatures(docs, doc_id, text), "signatures")
    node = signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("id", "bands", "marks")).alias("s"))
    nodes = stored(node.select("f1", "f2", F.col("s.id").alias("node"), "s.bands", "s.marks"), "nodes")
    pairs, large = first_candidates(nodes)
    links = verified(pairs, nodes, docs, doc_id, text)
    found = stored(components(links), "classes")
    crowd = crowded(large, found)
    if not crowd.isEmpty():
        sets = sets_of(crowd.select("node"), docs, doc_id, text)
        links = stored(links.union(linked(exact_candidates(crowd, sets).join(pairs, ["a", "b"], "left_anti"), sets)), "links")
        found = stored(components(links), "classes")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("f1", "f2", "node").join(found, "node", "left").join(degree, "node", "left")
    # the documents' side may have a hot set of shingles, the nodes' side has each set once
    placed = signed.where("n > 0").select("id", "f1", "f2").join(known.hint("shuffle_merge"), ["f1", "f2"])
    placed = placed.select(
        F.col("id").alias("doc_id"), F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    alone = signed.where("n = 0").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = docs.where(F.col(doc_id).isNull()).select(*(F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id")), F.lit(0).cast("long").alias("n_links"))
    return placed.unionByName(alone).unionByName(unnamed)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each class, with all their columns, whatever their names."""
    found = classes(docs, doc_id, text)
    (gone,) = free_names(docs, "dropped")
    dropped = stored(found.where("doc_id <> class_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    out = docs.join(broadcast_checked(dropped), F.col(doc_id).cast("long") == F.col(gone), "left_anti")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
