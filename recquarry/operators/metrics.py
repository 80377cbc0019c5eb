"""Ranking, diversity and value metrics as shared aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recquarry.functions import text as tx
from recquarry.operators.layout import global_running_sums, index_rows, materialize, number_rows, running_sums, top_k

# What each metric needs, whether small is good, and its kind.
METRICS = {
    "hit": {"need": ["rec.topk"], "smaller": False, "kind": "ranking"},
    "mrr": {"need": ["rec.topk"], "smaller": False, "kind": "ranking"},
    "map": {"need": ["rec.topk"], "smaller": False, "kind": "ranking"},
    "recall": {"need": ["rec.topk"], "smaller": False, "kind": "ranking"},
    "ndcg": {"need": ["rec.topk"], "smaller": False, "kind": "ranking"},
    "precision": {"need": ["rec.topk"], "smaller": False, "kind": "ranking"},
    "gauc": {"need": ["rec.meanrank"], "smaller": False, "kind": "ranking"},
    "auc": {"need": ["rec.score", "data.label"], "smaller": False, "kind": "value"},
    "mae": {"need": ["rec.score", "data.label"], "smaller": True, "kind": "value"},
    "rmse": {"need": ["rec.score", "data.label"], "smaller": True, "kind": "value"},
    "logloss": {"need": ["rec.score", "data.label"], "smaller": True, "kind": "value"},
    "itemcoverage": {"need": ["rec.items", "data.num_items"], "smaller": False, "kind": "ranking"},
    "averagepopularity": {"need": ["rec.items", "data.count_items"], "smaller": True, "kind": "ranking"},
    "shannonentropy": {"need": ["rec.items"], "smaller": False, "kind": "ranking"},
    "giniindex": {"need": ["rec.items", "data.num_items"], "smaller": True, "kind": "ranking"},
    "tailpercentage": {"need": ["rec.items", "data.count_items"], "smaller": False, "kind": "ranking"},
}
TOP_METRICS = ["hit", "mrr", "map", "recall", "ndcg", "precision"]
LIST_METRICS = ["itemcoverage", "averagepopularity", "shannonentropy", "giniindex", "tailpercentage"]
VALUE_METRICS = ["auc", "mae", "rmse", "logloss"]


def needed_inputs(names: Sequence[str]) -> set[str]:
    """Inputs the chosen metrics need; ranking and value metrics may not be mixed."""
    unknown = [n for n in names if n.lower() not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    if len({METRICS[n.lower()]["kind"] for n in names}) > 1:
        raise ValueError("ranking and value metrics cannot be evaluated together")
    return {x for n in names for x in METRICS[n.lower()]["need"]}


def _upto(k: int, value: Column) -> Column:
    return F.sum(F.when(F.col("rank") <= k, value).otherwise(F.lit(0.0)))


def _long(wide: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, int | None]]) -> DataFrame:
    """(metric, k, value) rows from aggregate columns."""
    entries = F.array(
        *(
            F.struct(F.lit(m).alias("metric"), F.lit(k).cast("long").alias("k"), F.col(c).cast("double").alias("value"))
            for c, (m, k) in columns.items()
        )
    )
    return wide.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.metric", "e.k", "e.value")


def collect_ranks(scores: DataFrame, k: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Top-k hits with each user's number of positives: ``(user, item, rank, hit, pos_len)``.

    ``scores``: ``(user, item, score, positive)``.  Users without a positive are left out.
    """
    pos = scores.groupBy(user).agg(F.sum("positive").cast("long").alias("pos_len")).where("pos_len > 0")
    best = top_k(scores, [user], [F.col("score").desc(), item], k)
    return best.join(pos, user).select(user, item, "rank", F.col("positive").cast("long").alias("hit"), "pos_len")


def collect_mean_ranks(scores: DataFrame, user: str = "user_id", limit: int | None = None) -> DataFrame:
    """Per user: rank sum of the positives (ties averaged), number of items, of positives."""
    ties = scores.groupBy(user, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("positive").cast("long").alias("pos")
    )
    ranked = running_sums(ties, [user], [F.col("score").desc()], {"upto": "n"}, limit)
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    return ranked.groupBy(user).agg(
        F.sum(F.col("pos") * mean_rank).alias("pos_rank_sum"),
        F.sum("n").cast("long").alias("user_len"),
        F.sum("pos").cast("long").alias("pos_len"),
    )


def collect_all(scores: DataFrame, k: int, user: str = "user_id", item: str = "item_id", limit: int | None = None) -> DataFrame:
    """What all ranking metrics need, from one ordering of each user's scores.

    One row per user: ``(user, pos_rank_sum, user_len, pos_len, top)``; ``top`` holds the first ``k`` items as structs
    ``(rank, item, hit)``.  Rows are numbered once; grouping by score and by user keeps that placement, so ties are averaged and lists are
    cut without another shuffle.
    """
    placed = number_rows(scores.select(user, item, "score", "positive"), [user], [F.col("score").desc(), item], limit)
    entry = F.struct(F.col("_pos").alias("rank"), F.col(item).alias("item"), F.col("positive").cast("long").alias("hit"))
    ties = placed.groupBy(user, "score").agg(
        F.avg("_pos").alias("mean_rank"),
        F.count(F.lit(1)).alias("n"),
        F.sum("positive").cast("long").alias("pos"),
        F.collect_list(F.when(F.col("_pos") <= k, entry)).alias("first"),
    )
    return ties.groupBy(user).agg(
        F.sum(F.col("pos") * F.col("mean_rank")).alias("pos_rank_sum"),
        F.sum("n").cast("long").alias("user_len"),
        F.sum("pos").cast("long").alias("pos_len"),
        F.flatten(F.collect_list(F.when(F.size("first") > 0, F.col("first")))).alias("top"),
    )


def generation_metrics(hits: DataFrame, ks: Sequence[int], run: Sequence[str] = (), user: str = "user_id") -> DataFrame:
    """NDCG, Recall and MRR of generated lists in percent: ``(run, metric, k, value)``.

    ``hits``: one row per (run, user, rank) with ``hit``; every hit counts and NDCG has no
    ideal term.  Each user needs at least one row; a user whose rows all rank below a cut-off
    counts with 0 there.
    """
    h = F.col("hit").cast("double")
    per, cols = [], {}
    for k in ks:
        for name, gain in (("NDCG", h / F.log2(F.col("rank") + 1.0)), ("Recall", h), ("MRR", h / F.col("rank"))):
            c = f"{name}_{k}"
            per.append(_upto(k, gain).alias(c))
            cols[c] = (name, k)
    users = hits.groupBy(*run, user).agg(*per)
    return _long(users.groupBy(*run).agg(*(( F.avg(c) * 100).alias(c) for c in cols)), list(run), cols)


def top_metrics(
    ranks: DataFrame, names: Sequence[str], ks: Sequence[int], run: Sequence[str] = (), user: str = "user_id"
) -> DataFrame:
    """hit, mrr, map, recall, ndcg and precision at every k from one pass.

    ``ranks``: rows of ``collect_ranks``; lists hold at most max(ks) rows per user.
    """
    top = max(ks)
    keys = [*run, user]
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("hit").cast("double")
    rows = ranks.withColumn("_cum", F.sum("hit").over(w))
    per = [F.max("pos_len").alias("pos_len")]
    for k in ks:
        per += [
            _upto(k, h).alias(f"_hits_{k}"),
            F.min(F.when((F.col("rank") <= k) & (F.col("hit") > 0), F.col("rank"))).alias(f"_first_{k}"),
            _upto(k, h * F.col("_cum") / F.col("rank")).alias(f"_ap_{k}"),
            _upto(k, h / F.log2(F.col("rank") + 1.0)).alias(f"_dcg_{k}"),
        ]
    users = rows.groupBy(*keys).agg(*per)
    ideal = [0.0]
    for i in range(1, top + 1):
        ideal.append(ideal[-1] + 1 / math.log2(i + 1))
    idcg = F.array(*(F.lit(x) for x in ideal))
    formulas = {
        "hit": lambda k: F.when(F.col(f"_hits_{k}") > 0, 1.0).otherwise(0.0),
        "mrr": lambda k: F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0)),
        "map": lambda k: F.col(f"_ap_{k}") / F.least(F.col("pos_len"), F.lit(k)),
        "recall": lambda k: F.col(f"_hits_{k}") / F.col("pos_len"),
        "ndcg": lambda k: F.col(f"_dcg_{k}") / F.get(idcg, F.least(F.col("pos_len"), F.lit(k)).cast("int")),
        "precision": lambda k: F.col(f"_hits_{k}") / F.lit(float(k)),
    }
    cols = {f"{n}_{k}": (n, k) for n in names for k in ks}
    means = [F.avg(formulas[n](k)).alias(c) for c, (n, k) in cols.items()]
    return _long(users.groupBy(*run).agg(*means), list(run), cols)


def gauc(mean_ranks: DataFrame) -> DataFrame:
    """Per-user AUC from mean ranks, weighted by the number of positives."""
    n, p, s = F.col("user_len"), F.col("pos_len"), F.col("pos_rank_sum")
    usable = mean_ranks.where((p > 0) & (p < n))
    auc = ((n + 1) * p - p * (p + 1) / 2 - s) / ((n - p) * p)
    out = usable.agg((F.sum(auc * p) / F.sum(p)).alias("gauc"))
    return _long(out, [], {"gauc": ("gauc", None)})


def auc(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties by the trapezoid; NaN when a class is missing."""
    t = df.groupBy(score).agg(
        F.sum(F.when(F.col(truth) > 0, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(truth) > 0, 0).otherwise(1)).cast("long").alias("neg"),
    )
    s = global_running_sums(t, [score], {"neg_upto": "neg"})
    area = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    out = s.agg(F.when((p > 0) & (n > 0), area / (p.cast("double") * n)).otherwise(F.lit(float("nan"))).alias("auc"))
    return _long(out, [], {"auc": ("auc", None)})


def errors(df: DataFrame, names: Sequence[str], truth: str = "truth", score: str = "score", eps: float = 1e-15) -> DataFrame:
    """MAE, RMSE and log loss from one scan."""
    t, s = F.col(truth).cast("double"), F.col(score).cast("double")
    p = F.least(F.greatest(s, F.lit(eps)), F.lit(1 - eps))
    how = {
        "mae": F.avg(F.abs(t - s)),
        "rmse": F.sqrt(F.avg((t - s) * (t - s))),
        "logloss": F.avg(-t * F.log(p) - (1 - t) * F.log(1 - p)),
    }
    return _long(df.agg(*(how[n].alias(n) for n in names)), [], {n: (n, None) for n in names})


def _item_counts(lists: DataFrame, ks: Sequence[int], item: str) -> DataFrame:
    """How often each item is recommended within each k."""
    return lists.groupBy(item).agg(
        *(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias(f"c_{k}") for k in ks)
    )


def _by_k(counts: DataFrame, ks: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"c_{k}").alias("c")) for k in ks))
    return counts.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.k", "e.c").where("c > 0")


def tail_items(counts: DataFrame, tail: float | None = 0.1, item: str = "item_id", count: str = "count") -> DataFrame:
    """Long-tail items: by count when ``tail`` > 1, else the rarest share (one at least)."""
    tail = 0.1 if tail is None or tail <= 0 else tail
    if tail > 1:
        return counts.where(F.col(count) <= tail).select(item)
    ordered = index_rows(counts.select(item, count), [count, item], "_i")
    cut = max(int(ordered.count() * tail), 1)
    return ordered.where(F.col("_i") < cut).select(item)


def list_metrics(
    lists: DataFrame,
    names: Sequence[str],
    ks: Sequence[int],
    num_items: int | None = None,
    counts: DataFrame | None = None,
    tail: float | None = 0.1,
    user: str = "user_id",
    item: str = "item_id",
) -> DataFrame:
    """Diversity metrics of recommended lists ``(user, item, rank)``.

    Lists are first reduced to one row per item, so joins with training counts and the
    rankings run over items, not over recommendations.
    """
    parts = []
    # one row per recommended item and cut-off, written once for all metrics
    flat = materialize(_by_k(_item_counts(lists, ks, item), ks, [item]))
    if {"averagepopularity", "tailpercentage"} & set(names):
        slots = F.col("k") * lists.select(F.count_distinct(user)).first()[0]
    if "itemcoverage" in names:
        got = flat.groupBy("k").agg((F.count(F.lit(1)) / F.lit(float(num_items))).alias("value"))
        parts.append(got.select(F.lit("itemcoverage").alias("metric"), "k", "value"))
    if "averagepopularity" in names:
        known = flat.join(counts.select(item, F.col("count").alias("pop")), item, "left")
        got = known.groupBy("k").agg(F.sum(F.col("c") * F.coalesce("pop", F.lit(0))).alias("s")).select("k", (F.col("s") / slots).alias("value"))
        parts.append(got.select(F.lit("averagepopularity").alias("metric"), "k", "value"))
    if "tailpercentage" in names:
        rare = tail_items(counts, tail, item).withColumn("rare", F.lit(1))
        marked = flat.join(rare, item, "left")
        got = marked.groupBy("k").agg(F.sum(F.col("c") * F.coalesce("rare", F.lit(0))).alias("s")).select("k", (F.col("s") / slots).alias("value"))
        parts.append(got.select(F.lit("tailpercentage").alias("metric"), "k", "value"))
    # few distinct frequencies remain per k
    tally = flat.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m"))
    totals = tally.groupBy("k").agg(F.sum(F.col("c") * F.col("m")).alias("total"), F.sum("m").alias("distinct"))
    if "shannonentropy" in names:
        share = F.col("c") / F.col("total")
        got = tally.join(totals, "k").groupBy("k").agg(
            (F.sum(-share * F.log(share) * F.col("m")) / F.max("distinct")).alias("value")
        )
        parts.append(got.select(F.lit("shannonentropy").alias("metric"), "k", "value"))
    if "giniindex" in names:
        # m items of one frequency fill the positions upto-m+1 .. upto of the sorted tail
        placed = running_sums(tally, ["k"], ["c"], {"upto": "m"}).join(totals, "k")
        m, n = F.col("m").cast("double"), F.lit(float(num_items))
        position_sum = m * (n - F.col("distinct")) + m * (2 * F.col("upto") - m + 1) / 2
        got = placed.groupBy("k").agg(
            (F.sum((2 * position_sum - m * (n + 1)) * F.col("c")) / F.max("total") / n).alias("value")
        )
        parts.append(got.select(F.lit("giniindex").alias("metric"), "k", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluate(
    names: Sequence[str],
    ks: Sequence[int] = (10,),
    scores: DataFrame | None = None,
    values: DataFrame | None = None,
    num_items: int | None = None,
    counts: DataFrame | None = None,
    tail: float | None = 0.1,
    decimals: int | None = 5,
) -> DataFrame:
    """All chosen metrics as ``(metric, k, value)``.

    Ranking metrics read ``scores`` (user_id, item_id, score, positive), value metrics read
    ``values`` (truth, score).  All ranking metrics come from one ordering of the scores (``collect_all``), written as
    one row per user.
    """
    names = [n.lower() for n in names]
    needed_inputs(names)
    parts = []
    top = [n for n in names if n in TOP_METRICS]
    lists = [n for n in names if n in LIST_METRICS]
    if top or lists or "gauc" in names:
        users = materialize(collect_all(scores, max(ks)))
        ranks = users.where("pos_len > 0").select("user_id", "pos_len", F.explode("top").alias("t"))
        ranks = ranks.select("user_id", F.col("t.item").alias("item_id"), "t.rank", "t.hit", "pos_len")
        if top:
            parts.append(top_metrics(ranks, top, ks))
        if lists:
            parts.append(list_metrics(ranks, lists, ks, num_items, counts, tail))
        if "gauc" in names:
            parts.append(gauc(users))
    if "auc" in names:
        parts.append(auc(values))
    err = [n for n in names if n in ("mae", "rmse", "logloss")]
    if err:
        parts.append(errors(values, err))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out if decimals is None else out.withColumn("value", F.round("value", decimals))


def hits_of_outputs(df: DataFrame, keys: Sequence[str], output: str, target: str, exact: bool = False) -> DataFrame:
    """Ranked texts and a target text to ``(keys, rank, hit)`` rows; substring match by default."""
    marks = (
        F.transform(F.col(output), lambda e: F.coalesce(e == F.col(target), F.lit(False))) if exact else tx.hit_vector(output, target)
    )
    return df.select(*keys, F.posexplode_outer(marks).alias("_p", "_h")).select(
        *keys, (F.coalesce("_p", F.lit(0)) + 1).cast("long").alias("rank"), F.coalesce("_h", F.lit(False)).cast("long").alias("hit")
    )


def run_table(metrics: DataFrame, runs: DataFrame, labels: Sequence[str], run: str = "run") -> DataFrame:
    """One row per requested run with a column per label such as ``NDCG@5``.

    Runs without results stay in the table, marked missing.
    """
    wide = metrics.withColumn("name", F.concat_ws("@", "metric", F.col("k").cast("string")))
    table = wide.groupBy(run).pivot("name", list(labels)).agg(F.first("value")).withColumn("_got", F.lit(True))
    return runs.select(run).join(table, run, "left").select(
        run, F.when(F.col("_got"), "evaluated").otherwise("missing").alias("status"), *(F.col(f"`{c}`") for c in labels)
    )


def rank_without_seen(targets: DataFrame, seen: DataFrame, order: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Rank of each user's target in a shared item order after the user's seen items are removed.

    ``order``: ``(item, rank)``.  The rank is the target's own rank less the seen items
    ahead of it, so no user x item list is built; a seen target has no rank.
    """
    t = targets.select(user, F.col(item).alias("_target")).join(
        order.select(F.col(item).alias("_target"), F.col("rank").alias("_rank")), "_target"
    )
    s = seen.select(user, item).distinct().join(order, item)
    ahead = (
        t.join(s, user)
        .groupBy(user)
        .agg(
            F.sum(F.when(F.col("rank") < F.col("_rank"), 1).otherwise(0)).alias("_ahead"),
            F.max(F.when(F.col(item) == F.col("_target"), 1).otherwise(0)).alias("_seen"),
        )
    )
    r = t.join(ahead, user, "left")
    rank = F.when(F.coalesce("_seen", F.lit(0)) == 0, F.col("_rank") - F.coalesce("_ahead", F.lit(0)))
    return r.select(user, F.col("_target").alias(item), rank.cast("long").alias("rank"))
