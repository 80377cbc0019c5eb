"""Residual quantisation, collision repair, and search over code prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recquarry.functions import codes as cx
from recquarry.functions import vectors as vx
from recquarry.functions.arrays import let
from recquarry.functions.draws import draw_int
from recquarry.operators.layout import materialize, top_k

# A codebook is a model parameter; larger ones are refused rather than broadcast.
MAX_CODEBOOK_ROWS = 65_536
MAX_CODEBOOK_BYTES = 256 << 20
# Largest catalogue trie that is sent to every executor; beyond it prefixes are looked up by joins.
TRIE_BYTES = 256 << 20


def codebook_arrays(codebook: DataFrame) -> list[np.ndarray]:
    """Codebook as one matrix per layer; its rows and bytes are checked first."""
    n, width = codebook.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    if n > MAX_CODEBOOK_ROWS or n * width * 8 > MAX_CODEBOOK_BYTES:
        raise ValueError(f"codebook has more than {MAX_CODEBOOK_ROWS} rows or {MAX_CODEBOOK_BYTES} bytes")
    rows = codebook.select("layer", "code", "centroid").collect()
    books: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["layer"], r["code"])):
        books.setdefault(r["layer"], []).append(r["centroid"])
    return [np.asarray(books[layer], dtype=float) for layer in sorted(books)]


def nearest(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the closest centroid; near ties go to the lowest code, whatever the summation order."""
    d = (vectors**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * vectors @ book.T
    return np.argmin(np.round(d, 9), axis=1)


def residual_encode(items: DataFrame, codebook: DataFrame, keep_errors: bool = False) -> DataFrame:
    """Nearest centroid per layer on the running residual: ``(item_idx, codes[, errors])``.

    ``errors`` holds the squared residual length left after each layer.
    """
    books = codebook_arrays(codebook)
    id_type = items.schema["item_idx"].dataType.simpleString()
    schema = f"item_idx {id_type}, codes array<int>, errors array<double>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            r = np.stack(b["vector"].to_numpy()).astype(float)
            codes, errors = [], []
            for book in books:
                c = nearest(r, book)
                r = r - book[c]
                codes.append(c)
                errors.append((r**2).sum(1))
            yield pd.DataFrame(
                {"item_idx": b["item_idx"], "codes": list(np.stack(codes, 1)), "errors": list(np.stack(errors, 1))}
            )

    out = items.select("item_idx", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(encode, schema)
    return out if keep_errors else out.drop("errors")


def quantization_error(encoded: DataFrame, dim: int) -> DataFrame:
    """Mean squared residual element after each layer."""
    return (
        encoded.select(F.posexplode("errors").alias("layer", "e"))
        .groupBy(F.col("layer").cast("long").alias("layer"))
        .agg((F.avg("e") / F.lit(float(dim))).alias("loss"))
    )


def fit_residual_codebooks(
    items: DataFrame, n_layers: int = 4, codes: int = 256, iterations: int = 10, seed: int = 0
) -> DataFrame:
    """One k-means per layer on the residuals of the layers before: ``(layer, code, centroid)``.

    A layer starts from ``codes`` residuals drawn by a hash of the seed, layer and item, and makes at most
    ``iterations`` Lloyd steps.  In a step every task assigns its residuals to the captured
    centroids and passes on one sum per code, so a step shuffles ``tasks x codes`` rows, whatever the number of
    items, and the driver sees the centroids alone.  A code without items keeps its centroid.  Residuals are written once
    per layer.  With fewer items than codes a layer has fewer centroids.
    """
    spark = items.sparkSession
    residual = items.select("item_idx", F.col("vector").cast("array<double>").alias("vector"))
    rows: list[tuple[int, int, list[float]]] = []
    for layer in range(n_layers):
        residual = materialize(residual)
        drawn = residual.orderBy(draw_int(f"k{seed}", F.lit(layer), "item_idx"), "item_idx").limit(codes)
        book = np.array([r["vector"] for r in drawn.select("vector").collect()])
        if not len(book):
            break
        for _ in range(iterations):
            moved = _lloyd_step(residual, book)
            done = np.allclose(moved, book, rtol=0, atol=1e-13)
            book = moved
            if done:
                break
        rows += [(layer, c, [float(x) for x in v]) for c, v in enumerate(book)]

        def subtract(batches: Iterator[pd.DataFrame], book=book) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    r = np.stack(b["vector"].to_numpy())
                    yield pd.DataFrame({"item_idx": b["item_idx"], "vector": list(r - book[nearest(r, book)])})

        residual = residual.mapInPandas(subtract, residual.schema)
    return spark.createDataFrame(rows, "layer int, code int, centroid array<double>")


def _lloyd_step(residual: DataFrame, book: np.ndarray) -> np.ndarray:
    """Centroids moved to the mean of the residuals they are nearest to."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(book), np.zeros(len(book), np.int64)
        for b in batches:
            if len(b):
                r = np.stack(b["vector"].to_numpy())
                c = nearest(r, book)
                np.add.at(total, c, r)
                n += np.bincount(c, minlength=len(book))
        held = np.flatnonzero(n)
        if len(held):
            yield pd.DataFrame({"code": held.astype("int32"), "n": n[held], "total": list(total[held])})

    parts = residual.select("vector").mapInPandas(sums, "code int, n long, total array<double>")
    added = parts.groupBy("code").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
    moved = book.copy()
    for r in added.collect():  # one row per code
        moved[r["code"]] = np.array(r["total"]) / r["n"]
    return moved


def codebook_report(items: DataFrame, codebook: DataFrame) -> DataFrame:
    """How a codebook fits: per layer ``(layer, codes, items, used, largest, nearest, loss)``.

    ``used`` codes have items, ``largest`` is the size of the largest, ``nearest`` counts items for which no
    centroid of the layer is closer than the assigned one, checked anew with column
    arithmetic, and ``loss`` is the mean squared element left after the layer.
    """
    codes = residual_encode(items, codebook)
    books = codebook.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("book"))
    assigned = items.join(codes, "item_idx").select(F.col("vector").cast("array<double>").alias("residual"), "codes")
    n_layers = codebook.agg(F.max("layer")).first()[0]
    parts = []
    for layer in range((-1 if n_layers is None else n_layers) + 1):
        # one row whose size `codebook_arrays` has checked
        here = assigned.withColumn("layer", F.explode(F.array(F.lit(layer)))).join(F.broadcast(books), "layer")
        code = F.get("codes", F.lit(layer))
        left = vx.subtract("residual", F.element_at("book", code + 1)["centroid"])
        best = F.array_min(F.transform("book", lambda b: let(vx.subtract("residual", b["centroid"]), lambda d: vx.dot(d, d))))
        judged = here.select(code.alias("code"), left.alias("left"), best.alias("best"), "codes")
        judged = judged.withColumn("d", vx.dot("left", "left"))
        per = judged.groupBy("code").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((F.col("d") <= F.col("best") + 1e-8).cast("long")).alias("nearest"),
            F.sum(F.col("d") / F.size("left")).alias("d"),
        )
        parts.append(
            per.agg(
                F.lit(layer).cast("long").alias("layer"),
                F.sum("n").cast("long").alias("items"),
                F.count(F.lit(1)).alias("used"),
                F.max("n").alias("largest"),
                F.sum("nearest").cast("long").alias("nearest"),
                (F.sum("d") / F.sum("n")).alias("loss"),
            )
        )
        assigned = judged.select(F.col("left").alias("residual"), "codes")
    report = reduce(DataFrame.unionByName, parts)
    sizes = codebook.groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count(F.lit(1)).alias("codes"))
    return report.join(F.broadcast(sizes), "layer").select("layer", "codes", "items", "used", "largest", "nearest", "loss")


def code_neighbors(codebook: DataFrame, layer: int | None = None) -> DataFrame:
    """For each code of one layer (default: the last) all its codes by distance, itself first."""
    if layer is None:
        layer = codebook.agg(F.max("layer")).first()[0]
    book = codebook.where(F.col("layer") == layer).select("layer", "code", "centroid")
    # one row holding the layer's codes, bounded by the codebook size
    all_codes = book.groupBy("layer").agg(F.collect_list(F.struct("code", "centroid")).alias("others"))

    def entry(o, centroid):
        diff = vx.subtract(o["centroid"], centroid)
        return F.struct(F.round(vx.norm(diff), 9).alias("d"), (o["code"] != F.col("code")).alias("other"), o["code"].alias("code"))

    ranked = F.array_sort(F.transform("others", lambda o: entry(o, F.col("centroid"))))
    return book.join(F.broadcast(all_codes), "layer").select(
        "code", F.transform(ranked, lambda e: e["code"]).alias("neighbors")
    )


def collision_report(codes: DataFrame, prefix_len: int) -> DataFrame:
    """Largest cluster sharing the leading codes, and how many items collide completely."""
    full = codes.groupBy("codes").agg(F.count(F.lit(1)).alias("n"))
    groups = full.groupBy(F.slice("codes", 1, prefix_len).alias("p")).agg(
        F.sum("n").alias("size"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("colliding")
    )
    return groups.agg(
        F.max("size").cast("long").alias("max_cluster_size"),
        F.sum("colliding").cast("long").alias("colliding_items"),
        F.sum("size").cast("long").alias("items"),
    )


def resolve_collisions(codes: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Give items of one prefix group distinct last codes while codes last.

    In item order each item takes the nearest last-layer code its group has not used.
    Every such step uses up one code, so only the first ``C`` items of a group (C = codes
    per layer) are folded; everyone after them finds all codes used and keeps the own one.
    A group of any size therefore costs one bounded list.
    """
    n_codes = neighbors.count()
    id_type = codes.schema["item_idx"].dataType
    split = codes.select(
        "item_idx", F.slice("codes", F.lit(1), F.size("codes") - 1).alias("prefix"), F.element_at("codes", -1).alias("own")
    )
    crowded = (
        split.groupBy("prefix", "own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix").distinct()
    )
    head = top_k(split.join(crowded, "prefix", "left_semi"), ["prefix"], ["item_idx"], n_codes)
    near = neighbors.select(F.col("code").alias("own"), "neighbors")
    listed = (
        head.join(F.broadcast(near) if n_codes <= MAX_CODEBOOK_ROWS else near, "own")
        .groupBy("prefix")
        .agg(F.sort_array(F.collect_list(F.struct("item_idx", "own", "neighbors"))).alias("members"))
    )
    taken = F.aggregate(
        "members",
        F.array().cast("array<int>"),
        lambda acc, m: F.concat(
            acc,
            F.array(
                F.coalesce(F.get(F.filter(m["neighbors"], lambda x: ~F.array_contains(acc, x)), F.lit(0)), m["own"]).cast("int")
            ),
        ),
    )
    fixed = listed.select(F.explode(F.arrays_zip(F.col("members.item_idx").alias("item_idx"), taken.alias("new"))).alias("f"))
    fixed = fixed.select(F.col("f.item_idx").cast(id_type).alias("item_idx"), F.col("f.new").alias("new"))
    return split.join(fixed, "item_idx", "left").select(
        "item_idx", F.concat("prefix", F.array(F.coalesce("new", "own"))).alias("codes")
    )


def decode_codes(df: DataFrame, codebook: DataFrame, codes: str = "codes", n_layers: int = 4, name: str = "vector") -> DataFrame:
    """Sum of the centroids of the valid codes; -1 adds nothing."""
    books = codebook_arrays(codebook)
    dim = books[0].shape[1]
    # a codebook of checked size, so each layer joins as a broadcast
    out = df
    total = F.array_repeat(F.lit(0.0), dim)
    for layer in range(n_layers):
        book = codebook.where(F.col("layer") == layer).select(
            F.col("code").alias(f"_k{layer}"), F.col("centroid").cast("array<double>").alias(f"_v{layer}")
        )
        out = out.join(F.broadcast(book), F.get(F.col(codes), F.lit(layer)) == F.col(f"_k{layer}"), "left")
        total = F.when(F.col(f"_v{layer}").isNotNull(), vx.add(total, F.col(f"_v{layer}"))).otherwise(total)
    extra = [c for i in range(n_layers) for c in (f"_k{i}", f"_v{i}")]
    return out.withColumn(name, total).drop(*extra)


def prefix_table(codes: DataFrame, n_layers: int = 4) -> DataFrame:
    """Every code prefix of the catalogue with its legal next codes, in ascending order."""
    steps = codes.select("codes", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))).alias("level"))
    # distinct before grouping: the root and other hot prefixes shrink to their codes map-side
    nexts = steps.select(
        "level", F.slice("codes", F.lit(1), F.col("level")).alias("prefix"), F.get("codes", F.col("level")).alias("next")
    ).distinct()
    return nexts.groupBy("level", "prefix").agg(F.sort_array(F.collect_list("next")).alias("next_codes"))


def code_vocabulary(
    codes: DataFrame, start: int = cx.START_ID, n_layers: int = 4, layer_size: int = cx.CODES_PER_LAYER
) -> DataFrame:
    """Vocabulary rows of the code tokens, ``(id, content, items)``, with the number of items that use each.

    All tokens of all layers are listed, used or not, in the order of their ids.
    """
    used = codes.select(F.posexplode("codes").alias("layer", "code")).groupBy("layer", "code").agg(F.count(F.lit(1)).alias("items"))
    rows = codes.sparkSession.range(n_layers * layer_size)
    layer, code = F.floor(F.col("id") / F.lit(layer_size)).cast("int"), (F.col("id") % layer_size).cast("int")
    content = F.concat(F.lit("<"), F.char(layer + 97), F.lit("_"), code.cast("string"), F.lit(">"))
    every = rows.select(cx.code_to_token(layer, code, start, layer_size).alias("id"), content.alias("content"), layer.alias("layer"), code.alias("code"))
    return every.join(used, ["layer", "code"], "left").select("id", "content", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


class Trie(NamedTuple):
    """The catalogue's prefixes as one sorted array per level.

    Nodes of a level are numbered in lexicographic order of their prefixes.  ``keys[l]`` holds
    ``parent * size + code`` for every node of level l + 1, ascending, so that a node's number is its
    position and a node's children are a slice.
    """

    keys: list[np.ndarray]
    size: int

    def children(self, level: int, node):
        """First and last position (exclusive) of the children of nodes of a level."""
        keys = self.keys[level]
        return np.searchsorted(keys, node * self.size), np.searchsorted(keys, (node + 1) * self.size)


def pack_trie(prefixes: DataFrame, n_layers: int, size: int | None = None, max_bytes: int | None = None) -> Trie | None:
    """Prefix table as a trie, or None if it would be larger than ``max_bytes``.

    ``size`` is the number of codes a layer may have; by default what the table holds.
    """
    limit = TRIE_BYTES if max_bytes is None else max_bytes
    nodes, largest = prefixes.agg(F.sum(F.size("next_codes")), F.max(F.array_max("next_codes"))).first()
    if not nodes:
        return Trie([np.zeros(0, np.int64) for _ in range(n_layers)], size or 1)
    # eight bytes a key, and the lists they are read from
    if nodes * 16 > limit:
        return None
    size = max(size or 0, largest + 1)
    keys = []
    table = prefixes.orderBy("level", "prefix").select("level", "next_codes").toArrow()
    level, lists = table["level"].to_numpy(), table["next_codes"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    codes = lists.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(level)), counts)
    for l in range(n_layers):
        first = np.searchsorted(level, l)
        here = level[owner] == l
        keys.append((owner[here] - first) * size + codes[here])
    return Trie(keys, size)


def walk_codes(trie: Trie, tails, start: int) -> tuple[np.ndarray, np.ndarray]:
    """How many codes of each token list lead to a node, and which: all of its codes, or 0 at the root."""
    sizes = np.array([len(t) for t in tails], np.int64)
    flat = np.concatenate([np.asarray(t, np.int64) for t in tails]) if len(tails) else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    node = np.zeros(len(sizes), np.int64)
    for l, keys in enumerate(trie.keys):
        at = np.flatnonzero((sizes > l) & (node >= 0))
        code = flat[first[at] + l] - start - l * trie.size
        wanted = node[at] * trie.size + code
        place = np.searchsorted(keys, wanted)
        hit = (code >= 0) & (code < trie.size) & (place < len(keys))
        hit[hit] = keys[place[hit]] == wanted[hit]
        node[at] = np.where(hit, place, -1)
    return np.where(node >= 0, sizes, 0).astype(np.int32), np.maximum(node, 0)


def legal_next(
    requests: DataFrame,
    prefixes: DataFrame,
    eos: int | None = None,
    start: int = cx.START_ID,
    n_layers: int = 4,
    layer_size: int = cx.CODES_PER_LAYER,
    trie_bytes: int | None = None,
) -> DataFrame:
    """Allowed next token ids of partial token lists: adds ``pos`` and ``legal_tokens``.

    The code tail is walked through the catalogue prefixes.  A mismatch starts again at the
    root; a complete code allows only ``eos``.  The prefixes travel as a packed trie, so
    requests are not shuffled; a catalogue beyond ``trie_bytes`` is looked up by joins.
    """
    trie = pack_trie(prefixes, n_layers, layer_size, trie_bytes)
    if trie is None:
        return _legal_by_joins(requests, prefixes, eos, start, n_layers, layer_size)
    sent = requests.sparkSession.sparkContext.broadcast(trie)
    ends = [] if eos is None else [eos]

    @F.pandas_udf("pos int, legal_tokens array<bigint>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        levels = sent.value
        for tails in batches:
            pos, node = walk_codes(levels, tails, start)
            legal = []
            for p, n in zip(pos.tolist(), node.tolist()):
                below = levels.children(p, n) if p < n_layers else ()
                legal.append(start + p * layer_size + levels.keys[p][below[0] : below[1]] % layer_size if below and below[0] < below[1] else ends)
            yield pd.DataFrame({"pos": pos, "legal_tokens": legal})

    found = requests.withColumn("_walk", walk(cx.code_tail("tokens", start, n_layers, layer_size)))
    return found.select(*requests.columns, "_walk.pos", "_walk.legal_tokens")


def _legal_by_joins(
    requests: DataFrame, prefixes: DataFrame, eos: int | None, start: int, n_layers: int, layer_size: int
) -> DataFrame:
    tail = cx.code_tail("tokens", start, n_layers, layer_size)
    codes = F.transform(F.col("tail"), lambda t, i: (t - start - i * layer_size).cast("int"))
    ok = F.forall("tail_codes", lambda c: (c >= 0) & (c < layer_size))
    walked = (
        requests.withColumn("tail", tail)
        .withColumn("tail_codes", codes)
        .withColumn("level", F.when(ok, F.size("tail")).otherwise(0))
        # a full tail is looked up through its parent
        .withColumn("at", F.least(F.col("level"), F.lit(n_layers - 1)))
        .withColumn("prefix", F.slice("tail_codes", F.lit(1), F.col("at")))
    )
    root = prefixes.where(F.col("level") == 0).select(F.col("level").alias("root"), F.col("next_codes").alias("root_codes"))
    nodes = prefixes.select(F.col("level").alias("at"), "prefix", "next_codes")
    # the root is one broadcast row, so requests at the root do not meet in one task
    keyed = walked.withColumn("prefix", F.when(F.col("at") > 0, F.col("prefix"))).withColumn("root", F.col("at") - F.col("at"))
    looked = keyed.join(nodes.where(F.col("at") > 0), ["at", "prefix"], "left").join(F.broadcast(root), "root", "left")
    full = F.col("level") == n_layers
    complete = full & F.array_contains("next_codes", F.get("tail_codes", F.lit(n_layers - 1)))
    inside = (F.col("level") > 0) & ~full & F.col("next_codes").isNotNull()
    pos = F.when(F.coalesce(complete, F.lit(False)), n_layers).when(inside, F.col("level")).otherwise(0)
    ends = F.array(F.lit(eos).cast("long")) if eos is not None else F.array().cast("array<bigint>")
    legal = F.coalesce(F.when(F.col("pos") > 0, F.col("next_codes")).otherwise(F.col("root_codes")), F.array().cast("array<int>"))
    out = looked.withColumn("pos", pos).withColumn(
        "legal_tokens",
        F.when((F.col("pos") == n_layers) | (F.size(legal) == 0), ends).otherwise(
            F.transform(legal, lambda c: (start + F.col("pos") * layer_size + c).cast("long"))
        ),
    )
    return out.select(*requests.columns, "pos", "legal_tokens")


# Candidates a beam search holds at once inside a task.
BEAM_CELLS = 4_000_000


def beam_search(trie: Trie, logp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Beams of a block of queries, all levels in turn: query position, codes, score, rank.

    ``logp``: queries x layers x codes.  Ties are decided by the codes: nodes are numbered in their order.
    """
    query, node = np.arange(len(logp)), np.zeros(len(logp), np.int64)
    score, path = np.zeros(len(logp)), np.zeros((len(logp), 0), np.int32)
    rank = np.zeros(len(logp), np.int64)
    for level in range(len(trie.keys)):
        lo, hi = trie.children(level, node)
        counts = hi - lo
        from_beam = np.repeat(np.arange(len(node)), counts)
        child = np.arange(len(from_beam)) + np.repeat(lo - (np.cumsum(counts) - counts), counts)
        code = trie.keys[level][child] % trie.size
        q = query[from_beam]
        grown = score[from_beam] + logp[q, level, code]
        order = np.lexsort((child, -np.round(grown, 9), q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < width
        order, rank = order[keep], rank[keep]
        query, node, score = q[keep], child[order], grown[order]
        path = np.column_stack([path[from_beam[order]], code[order].astype(np.int32)])
    return query, path, score, rank + 1


def constrained_beam(
    scores: DataFrame, prefixes: DataFrame, width: int = 20, n_layers: int = 4, trie_bytes: int | None = None
) -> DataFrame:
    """Best ``width`` complete codes per query under catalogue constraints: ``(query_id, codes, score, rank)``.

    ``scores``: one row per query, ``(query_id, logp)`` with one list per layer and one value per
    code, or one row per query and layer, ``(query_id, layer, logp)``, which takes one shuffle.  The catalogue's
    prefixes are broadcast as a packed trie, and all levels are searched where the
    scores are; a code without a score counts as minus infinity.  A catalogue beyond ``trie_bytes`` is searched by one join per
    level.
    """
    trie = pack_trie(prefixes, n_layers, None, trie_bytes)
    if trie is None:
        return _beam_by_joins(scores, prefixes, width, n_layers)
    if "layer" in scores.columns:
        listed = F.sort_array(F.collect_list(F.struct("layer", "logp")))
        scores = scores.where(F.col("layer") < n_layers).groupBy("query_id").agg(listed["logp"].alias("logp"))
    whole = scores.where(F.size("logp") >= n_layers).select("query_id", F.col("logp").cast("array<array<double>>").alias("logp"))
    sent = scores.sparkSession.sparkContext.broadcast(trie)
    id_type = scores.schema["query_id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = sent.value
        block = max(1, BEAM_CELLS // (width * levels.size))
        for b in batches:
            for at in range(0, len(b), block):
                part = b.iloc[at : at + block]
                logp = np.full((len(part), n_layers, levels.size), -np.inf)
                for i, layers in enumerate(part["logp"]):
                    for l in range(n_layers):
                        known = layers[l][: levels.size]
                        logp[i, l, : len(known)] = known
                query, path, score, rank = beam_search(levels, logp, width)
                ids = part["query_id"].to_numpy()[query]
                yield pd.DataFrame({"query_id": ids, "codes": list(path), "score": score, "rank": rank.astype("int32")})

    return whole.mapInPandas(search, f"query_id {id_type}, codes array<int>, score double, rank int")


def _beam_by_joins(scores: DataFrame, prefixes: DataFrame, width: int, n_layers: int) -> DataFrame:
    """The same, a level at a time: at most ``width * codes`` rows per query exist at once."""
    if "layer" not in scores.columns:
        scores = scores.select("query_id", F.posexplode("logp").alias("layer", "logp"))
    root = prefixes.where(F.col("level") == 0).select(F.col("level").alias("layer"), "next_codes")
    beams = None
    for level in range(n_layers):
        layer = scores.where(F.col("layer") == level).select("query_id", "layer", "logp")
        if beams is None:
            here = layer.join(F.broadcast(root), "layer")
            here = here.withColumn("prefix", F.array().cast("array<int>")).withColumn("score", F.lit(0.0))
        else:
            nodes = prefixes.where(F.col("level") == level).select("prefix", "next_codes")
            here = beams.join(nodes, "prefix").join(layer, "query_id")
        grown = here.select("query_id", "prefix", "score", "logp", F.explode("next_codes").alias("code")).select(
            "query_id",
            F.concat("prefix", F.array("code")).alias("prefix"),
            (F.col("score") + F.get("logp", F.col("code"))).alias("score"),
        )
        beams = top_k(grown, ["query_id"], [F.round("score", 9).desc(), "prefix"], width)
    return beams.select("query_id", F.col("prefix").alias("codes"), "score", "rank")
