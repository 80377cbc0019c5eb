"""Per-user sequences: histories, targets, chunks, padding, ids and negatives.

Every operator numbers rows with ``layout.window_blocks`` and collects bounded
lists only, so one user may own any share of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recquarry.functions.arrays import let
from recquarry.functions.draws import draw_hex
from recquarry.operators.clean import ntz
from recquarry.operators.layout import KeySizes, index_rows, key_sizes, number_rows, running_sums, top_k, window_blocks

# Fixed value: name of the padding entry with id 0.
PAD = "[PAD]"


def history_window(
    df: DataFrame,
    max_len: int = 30,
    user: str = "user_id",
    order: Sequence[str] = ("ts", "item_id"),
    item: str = "item_id",
    limit: int | None = None,
    block: int | None = None,
    sizes: KeySizes | None = None,
) -> DataFrame:
    """Each row with the user's previous ``max_len`` items, oldest first.

    Adds ``history``, ``pos`` (1-based) and ``len``.  With ``sizes`` users are spread over tasks by the number of rows, for
    callers that sort the lists: rows grow by them only after the shuffle, whose bytes do not tell what a task will hold.
    """
    b = window_blocks(df, [user], order, before=max_len, limit=limit, block=block, sizes=sizes, tasks=sizes and sizes.tasks())
    w = Window.partitionBy(user, "_blk").orderBy("_pos").rowsBetween(-max_len, -1)
    return (
        b.withColumn("history", F.collect_list(item).over(w))
        .where(~F.col("_halo"))
        .drop("_blk", "_halo")
        .withColumnRenamed("_pos", "pos")
        .withColumnRenamed("_len", "len")
    )


def train_targets(df: DataFrame, start: str, end: str, min_len: int = 5) -> DataFrame:
    """Rows from the ``min_len``-th on that fall into the phase window.

    Apply after ``history_window`` so that histories reach across phase borders.
    """
    return df.where((F.col("pos") >= min_len) & (F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))


def test_targets(df: DataFrame, start: str, end: str) -> DataFrame:
    """Only the user's last row, and only when it falls into the window."""
    return df.where((F.col("pos") == F.col("len")) & (F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))


def cap_per_user(df: DataFrame, n: int | None, seed: str = "0", user: str = "user_id", apart: Column | None = None) -> DataFrame:
    """At most ``n`` random targets per user; None keeps all.

    ``apart`` identifies a user's rows that are not to be counted; it is null for the others.
    """
    if n is None:
        return df
    if apart is not None and n < 1:
        return df.where(apart.isNotNull())
    groups = [user] if apart is None else [user, apart]
    return top_k(df, groups, [draw_hex(seed, user, "pos"), "pos"], n, "_r").drop("_r")


def drop_empty_examples(df: DataFrame, due: Column, user: str = "user_id", item: str = "item_id", page: int = 10_000) -> DataFrame:
    """The items that are due, by way of each user's list of examples; users without any have no rows.

    ``df`` has ``_pos``, the row's place in the user's history; a list holds the examples of one page of it.
    """
    at = F.floor((F.col("_pos") - 1) / F.lit(page))
    lists = df.groupBy(user, at.alias("page")).agg(F.collect_list(F.when(due, F.col(item))).alias("examples"))
    return lists.where(F.size("examples") > 0).select(user, F.explode("examples").alias(item))


def sample_variant(df: DataFrame, keys: Sequence[str], tie: Sequence[str], seed: str = "0", apart: Column | None = None) -> DataFrame:
    """One random row per key, and every row that ``apart`` identifies within its key; it is null for the others."""
    groups = [*keys] if apart is None else [*keys, apart]
    return top_k(df, groups, [draw_hex(seed, *keys, *tie), *tie], 1, "_r").drop("_r")


def last_items(
    df: DataFrame, max_len: int, user: str = "user_id", order=("ts", "item_id"), item: str = "item_id", limit=None
) -> DataFrame:
    """History and target of leave-last-out: the last row and the ``max_len`` before it.

    Only those rows are collected, so this is much cheaper than histories for every row.
    """
    b = number_rows(df, [user], order, limit).where(F.col("_pos") >= F.col("_len") - max_len)
    rows = F.sort_array(F.collect_list(F.struct("_pos", F.col(item).alias("item"), "ts")))
    g = b.groupBy(user).agg(rows.alias("r"), F.max("_len").alias("len"))
    n = F.size("r")
    return g.select(
        user,
        F.slice("r.item", F.lit(1), n - 1).alias("history"),
        F.slice("r.ts", F.lit(1), n - 1).alias("history_ts"),
        F.element_at("r.item", -1).alias("target"),
        F.element_at("r.ts", -1).alias("ts"),
        "len",
    )


def test_examples(df: DataFrame, start: str, end: str, max_len: int = 30, user: str = "user_id", item: str = "item_id", **kw) -> DataFrame:
    """``last_items`` of the users whose last row falls into the window."""
    last = last_items(df, max_len, user, item=item, **kw)
    return last.where((F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))


def user_sequences(
    df: DataFrame, page: int = 10_000, user: str = "user_id", order=("ts", "item_id"), limit=None
) -> DataFrame:
    """Whole ordered histories as lists, in pages of at most ``page`` rows per user."""
    b = number_rows(df, [user], order, limit)
    p = F.floor((F.col("_pos") - 1) / F.lit(page)).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("_pos", "item_id", "ts")))
    return (
        b.groupBy(user, p.alias("page"))
        .agg(rows.alias("r"))
        .select(user, "page", F.col("r.item_id").alias("items"), F.col("r.ts").alias("times"))
    )


def chunk_sequences(
    df: DataFrame, max_item_list: int = 25, user: str = "user_id", order=("ts", "item_id"), item="item_id", limit=None,
    sizes: KeySizes | None = None,
) -> DataFrame:
    """Training sequences of ``max_item_list + 1`` items.

    A longer history first loses its oldest ``len mod (max_item_list + 1)`` items.
    """
    size = max_item_list + 1
    b = number_rows(df, [user], order, limit, sizes)
    drop = F.when(F.col("_len") > size, F.col("_len") % F.lit(size)).otherwise(F.lit(0))
    chunk = F.floor((F.col("_pos") - 1 - drop) / F.lit(size)).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("_pos", F.col(item).alias("item"), "ts")))
    return (
        b.where(F.col("_pos") > drop)
        .groupBy(user, chunk.alias("chunk"))
        .agg(rows.alias("r"))
        .select(user, "chunk", F.col("r.item").alias("item_seq"), F.col("r.ts").alias("time_seq"))
    )


def prefix_augment(chunks: DataFrame, user: str = "user_id") -> DataFrame:
    """Every prefix of length two and more of every chunk."""
    return (
        chunks.where(F.size("item_seq") >= 2)
        .withColumn("n", F.explode(F.sequence(F.lit(2), F.size("item_seq"))))
        .select(user, "chunk", F.col("n").cast("long").alias("n"), F.slice("item_seq", F.lit(1), F.col("n")).alias("item_seq"))
    )


def pad_left(seq, length: int, fill=None) -> Column:
    """Left-pad to ``length`` and keep the last ``length`` entries.

    ``fill`` may be a scalar (default 0) or an array column of at least ``length``
    fillers, such as sampled negatives.
    """
    seq = F.col(seq) if isinstance(seq, str) else seq
    if not isinstance(fill, Column):
        fill = F.array_repeat(F.lit(0 if fill is None else fill).cast("long"), length)
    return F.slice(F.concat(fill, seq), -length, length)


def calendar_features(seconds) -> Column:
    """Epoch seconds to [year, month, day, hour, minute, second] in UTC."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds

    def parts(t):
        d = F.timestamp_seconds(t)
        return F.array(F.year(d), F.month(d), F.dayofmonth(d), F.hour(d), F.minute(d), F.second(d))

    return F.transform(seconds, parts)


def next_item_mask(seq, length: int) -> Column:
    """Ones for the real next-item pairs of a padded sequence of ``length`` items."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    ones = F.array_repeat(F.lit(1).cast("long"), F.greatest(F.size(seq) - 1, F.lit(0)))
    return pad_left(ones, length - 1)


def next_item_pairs(chunks: DataFrame, user: str = "user_id") -> DataFrame:
    """(input, target) pairs of neighbouring items inside each chunk."""
    seq = F.col("item_seq")
    steps = F.arrays_zip(
        F.slice(seq, F.lit(1), F.size(seq) - 1).alias("input"), F.slice(seq, F.lit(2), F.size(seq) - 1).alias("target")
    )
    return chunks.where(F.size(seq) >= 2).select(user, "chunk", F.posexplode(steps).alias("step", "p")).select(
        user, "chunk", F.col("step").cast("long").alias("step"), F.col("p.input").alias("input"),
        F.col("p.target").alias("target"),
    )


def dense_ids(df: DataFrame, token: str, order: str = "ts", catalog: DataFrame | None = None) -> DataFrame:
    """Dictionary ``(token, id)`` by first appearance, with the padding entry at 0.

    With a ``catalog`` of ``(token, order)`` its tokens come first and tokens seen only
    in the log are appended.
    """
    # rows are counted down as they are; only tokens become texts.  A time that is missing comes before all others
    firsts = df.groupBy(F.col(token).alias("token")).agg(F.min(order).alias("at"), F.bool_or(F.col(order).isNull()).alias("none"))
    at = F.when(~F.col("none"), F.unix_micros(F.col("at").cast("timestamp")))
    seen = firsts.select(F.col("token").cast("string").alias("token"), F.struct(F.lit(1).alias("tier"), at.alias("at")).alias("o"))
    if catalog is not None:
        listed = catalog.select(
            F.col("token").cast("string").alias("token"),
            F.struct(F.lit(0).alias("tier"), F.col("order").cast("long").alias("at")).alias("o"),
        )
        seen = seen.unionByName(listed)
    first = seen.groupBy("token").agg(F.min("o").alias("o")).select("token", "o.tier", "o.at")
    numbered = index_rows(first, ["tier", "at", "token"], "id").select("token", (F.col("id") + 1).alias("id"))
    pad = df.sparkSession.createDataFrame([(PAD, 0)], "token string, id bigint")
    return pad.unionByName(numbered)


def encode_ids(df: DataFrame, dictionary: DataFrame, column: str, name: str) -> DataFrame:
    """Replace a token column by its dictionary id."""
    d = dictionary.select(F.col("token").alias("_token"), F.col("id").alias(name))
    return df.join(d, F.col(column).cast("string") == F.col("_token"), "left").drop("_token")


def negatives(n, item_num: int, reject, seed: str, *key) -> Column:
    """``n`` uniform ids from 1..item_num-1 that are not in the array ``reject``.

    A slot draws a rank among the allowed ids and finds its id through the gaps of the sorted list, so every
    allowed id is equally likely and no draw is refused: before a rejected id lie as many allowed ones as its
    value less its place, and the rejected ids that lie before the drawn rank are counted by bisection.  Slots are null when
    nothing is allowed.  ``reject=None`` allows any id.
    """
    n = F.lit(n) if isinstance(n, int) else n
    pool = item_num - 1
    draw = lambda j: F.conv(F.substring(draw_hex(seed, *key, j), 1, 15), 16, 10).cast("long")
    slots = F.sequence(F.lit(1), n)
    if reject is None:
        made = F.transform(slots, lambda j: draw(j) % pool + 1)
    else:
        listed = F.filter(F.col(reject) if isinstance(reject, str) else reject, lambda x: (x >= 1) & (x <= pool))
        gaps = F.transform(F.array_sort(F.array_distinct(listed)), lambda d, i: d.cast("long") - 1 - i)
        made = let(gaps, lambda g: F.transform(slots, lambda j: _allowed(draw(j), g, pool)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<bigint>"))


def _allowed(drawn: Column, gaps: Column, pool: int) -> Column:
    """The allowed id of a drawn number; ``gaps`` ascends and tells how many allowed ids lie before each rejected one."""
    free = F.lit(pool).cast("long") - F.size(gaps)
    bits = F.floor(F.log2(F.greatest(F.size(gaps), F.lit(1)).cast("double"))).cast("int")

    def before(rank: Column) -> Column:
        steps = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
        further = lambda at, step: F.when(
            (at + step <= F.size(gaps)) & (F.get(gaps, at + step - 1) <= rank), at + step
        ).otherwise(at)
        return F.aggregate(steps, F.lit(0), further)

    return F.when(free > 0, let(drawn % free, lambda rank: rank + 1 + before(rank)))


def paged_sequences(
    df: DataFrame, page: int = 10_000, user: str = "user_id", order=("ts", "item_id"), item: str = "item_id", limit=None
) -> DataFrame:
    """Histories kept whole: ``(user, page, n_pages, len, items, times)``, pages of at most ``page`` rows.

    A history of any length is held in bounded rows; pages are numbered from the oldest one on, so a reader of the
    last items asks for the last pages only.
    """
    b = number_rows(df, [user], order, limit)
    at = F.floor((F.col("_pos") - 1) / F.lit(page)).cast("long")
    pages = F.ceil(F.col("_len") / F.lit(page)).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("_pos", F.col(item).alias("item"), "ts")))
    return (
        b.groupBy(user, at.alias("page"))
        .agg(F.first(pages).alias("n_pages"), F.first("_len").alias("len"), rows.alias("r"))
        .select(user, "page", "n_pages", "len", F.col("r.item").alias("items"), F.col("r.ts").alias("times"))
    )


def sequence_tail(pages: DataFrame, length: int, page: int, user: str = "user_id") -> DataFrame:
    """The last ``length`` items of paged histories: ``(user, items, times)``; older pages are not read."""
    reach = -(-length // page) + 1
    last = pages.where(F.col("page") >= F.col("n_pages") - reach)
    parts = F.sort_array(F.collect_list(F.struct("page", "items", "times")))
    joined = last.groupBy(user).agg(parts.alias("p"))
    cut = lambda name: F.slice(F.flatten(F.col(f"p.{name}")), -F.least(F.size(F.flatten(F.col("p.items"))), F.lit(length)), length)
    return joined.select(user, cut("items").alias("items"), cut("times").alias("times"))


def whole_history_negatives(
    df: DataFrame, n: int, item_num: int, seed: str, user: str = "user_id", item: str = "item_id", limit=None, sizes: KeySizes | None = None
) -> DataFrame:
    """``n`` uniform ids per user that its whole history, of any length, does not hold: ``(user, slot, item)``.

    The same draw of a rank among the allowed ids as ``negatives``, as a running count per user over rejected ids and draws
    in one order; a hot user is range-sorted over the cluster.  Users whose history holds everything have no rows.
    The history is read once; ``sizes`` of the users saves a count.
    """
    pool = item_num - 1
    sizes = key_sizes(df, [user]) if sizes is None else sizes
    held = F.when(F.col(item).between(1, pool), F.col(item)).otherwise(0).cast("long")
    # entry 0 stands for the user and comes first, so that one numbering gives places and sizes
    entries = df.select(user, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), held))).alias("item")).distinct()
    placed = number_rows(entries, [user], ["item"], limit, KeySizes(2 * sizes.rows, sizes.largest + 1))
    place = F.col("_pos") - 1
    # nothing is known of the history of an unnamed user
    free = F.lit(pool) - F.when(F.col(user).isNotNull(), F.col("_len") - 1).otherwise(0)
    drawn = lambda slot: F.conv(F.substring(draw_hex(seed, user, slot), 1, 15), 16, 10).cast("long") % free
    one = lambda at, slot, counts: F.struct(at.alias("at"), slot.alias("slot"), F.lit(counts).alias("one"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda slot: one(drawn(slot), slot, 0))
    gap = F.array(one(F.col("item") - place, F.lit(0), 1))
    rows = placed.select(user, F.explode(F.when(F.col("item") > 0, gap).when(free > 0, draws)).alias("r")).select(user, "r.*")
    # at equal places rejected ids come first: slot 0
    most = KeySizes(sizes.rows * (n + 1), sizes.largest + n)
    counted = running_sums(rows, [user], ["at", "slot"], {"before": "one"}, limit, most)
    return counted.where("slot > 0").select(user, "slot", (F.col("at") + 1 + F.col("before")).alias("item"))


def item_groups(items: DataFrame, n: int = 5, seed: str = "0") -> DataFrame:
    """Blocks of ``n`` consecutive items, each with ``n`` examples from outside the block.

    Example rows are drawn by position and fetched by an equi-join, so the work is linear
    in the number of items; gaps in ``item_idx`` do not matter.  Returns ``(block, targets, examples)``
    of item structs.
    """
    items = index_rows(items, ["item_idx"], "_n")
    total = items.count()
    info = F.struct("item_idx", "item_id", "title", "description", "sem_id")
    block = F.floor(F.col("_n") / F.lit(n)).cast("long")
    targets = items.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(info)).alias("targets"))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(4 * n)),
        lambda j: F.conv(F.substring(draw_hex(seed, "block", j), 1, 8), 16, 10).cast("long") % total,
    )
    # indices right after the block stand in when the draws repeat too often
    spare = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda j: ((F.col("block") + 1) * n + j) % total)
    outside = F.filter(
        F.array_distinct(F.concat(draws, spare)), lambda i: F.floor(i / F.lit(n)) != F.col("block")
    )
    wanted = targets.select("block", F.posexplode(F.slice(outside, 1, n)).alias("at", "_n"))
    examples = (
        wanted.join(items, "_n")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("at", info.alias("i")))).alias("e"))
        .select("block", F.col("e.i").alias("examples"))
    )
    return targets.join(examples, "block", "left")


def sample_n(df: DataFrame, n: int, key: Sequence[str], order: Sequence, seed: str = "0") -> DataFrame:
    """``n`` reproducible random rows, given back in their old order."""
    return df.orderBy(draw_hex(seed, *key), *key).limit(n).orderBy(*order)


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: str = "0") -> DataFrame:
    """Reproducible random permutation, range-partitioned over the cluster."""
    return df.orderBy(draw_hex(seed, *key), *key)


def slice_fraction(df: DataFrame, order: Sequence, fraction: float = 0.1) -> DataFrame:
    """First ``fraction`` of the rows in ``order``."""
    indexed = index_rows(df, order, "_i")
    keep = int(indexed.count() * fraction)
    return indexed.where(F.col("_i") < keep).drop("_i")


def average_rank(
    df: DataFrame, keys: Sequence[str], score: str, descending: bool = True, limit: int | None = None
) -> DataFrame:
    """Distinct scores per key with their row count and tie-averaged rank.

    Rows with one score are merged before ranking; join back on (keys, score) for a
    per-row rank.
    """
    ties = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("ties"))
    way = F.col(score).desc() if descending else F.col(score).asc()
    ranked = running_sums(ties, keys, [way], {"_upto": "ties"}, limit)
    return ranked.withColumn("avg_rank", F.col("_upto") - F.col("ties") + (F.col("ties") + 1) / 2).drop("_upto")


def time_gap_bucket(df: DataFrame, user: str = "user_id", order=("ts", "item_id"), buckets: int = 128, limit=None, block=None) -> DataFrame:
    """Log-scaled gap in seconds to the user's next row; the last row has gap 0."""
    b = window_blocks(df, [user], order, after=1, limit=limit, block=block)
    w = Window.partitionBy(user, "_blk").orderBy("_pos")
    now = F.unix_seconds(F.col("ts").cast("timestamp"))
    nxt = F.unix_seconds(F.lead("ts").over(w).cast("timestamp"))
    return (
        b.withColumn("gap", F.coalesce(nxt - now, F.lit(0).cast("long")))
        .where(~F.col("_halo"))
        .withColumn("bucket", gap_bucket(F.col("gap"), buckets))
        .drop("_blk", "_halo")
        .withColumnRenamed("_pos", "pos")
    )


def gap_bucket(gap: Column, buckets: int = 128) -> Column:
    """Bucket width 0.301 on the natural logarithm of the absolute gap."""
    raw = F.floor(F.log(F.greatest(F.abs(gap).cast("double"), F.lit(1.0))) / F.lit(0.301)).cast("long")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(buckets)).cast("long")


def time_gap_matrix(seconds, buckets: int = 128) -> Column:
    """Buckets for all i <= j of one bounded sequence: gap from i to the entry after j."""
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds

    def matrix(s):
        ahead = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, -1, 1))
        return F.transform(
            ahead, lambda t, j: F.transform(F.slice(s, F.lit(1), j + 1), lambda u: gap_bucket(t - u, buckets))
        )

    return let(seconds, matrix)


def history_lookup(df: DataFrame, key: Sequence[str], items: DataFrame, info: Sequence[str]) -> DataFrame:
    """Replace a bounded history of item ids by item structs, order and repeats kept."""
    spread = df.select(*key, F.posexplode_outer("history").alias("_at", "item_id"))
    looked = spread.join(items.select("item_id", *info), "item_id", "left")
    entry = F.when(F.col("_at").isNotNull(), F.struct("_at", F.struct("item_id", *info).alias("i")))
    return looked.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("_h")).select(*key, F.col("_h.i").alias("history_info"))
