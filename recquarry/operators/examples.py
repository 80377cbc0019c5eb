"""Chat-style training and test examples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recquarry.functions import text as tx
from recquarry.operators import sequences as sq
from recquarry.operators.clean import before, phase_of
from recquarry.operators.layout import KeySizes, key_sizes, lookup_join


INFO = ["title", "description", "sem_id"]
# Positions of a user whose texts are looked up together.
PACKET = 128


def id_histories(log: DataFrame, max_len: int = 30, sizes: KeySizes | None = None) -> DataFrame:
    """Rows with the references of their previous items; no text enters the user window."""
    sizes = key_sizes(log, ["user_id"]) if sizes is None else sizes
    return sq.history_window(log.withColumn("_ref", F.struct("item_id")), max_len, item="_ref", sizes=sizes).drop("_ref")


def with_texts(
    targets: DataFrame, items: DataFrame, key: Sequence[str] = ("user_id", "pos", "variant"), tasks: int | None = None
) -> DataFrame:
    """Look up the texts of each target (``info``) and of its history, for chosen targets only.

    ``key`` identifies a row, user and position first.  Neighbouring targets of a user share nearly all of their histories, so
    ``PACKET`` positions are looked up together: a target passes on only the references that the one before it did not, they are
    joined to the catalogue and put together again by packet, where a target's own are the last ones up to its place.  Missing
    texts, and those of items that are not in the catalogue, read "NA".  ``tasks`` is the number of tasks the packets are spread over.
    """
    user, pos, *_ = key
    rest = [c for c in targets.columns if c not in (*key, "history")]
    packets = Window.partitionBy(user, "_packet").orderBy(*key[1:])
    t = targets.select(
        *key, "item_id", F.struct(*rest).alias("_rest"), F.concat("history", F.array(F.struct("item_id"))).alias("_refs"),
        F.floor(F.col(pos) / F.lit(PACKET)).alias("_packet"),
    ).withColumn("_old", F.lag("_refs").over(packets)).withColumn("_step", (F.col(pos) - F.lag(pos).over(packets)).cast("int"))
    n, n_old = F.size("_refs"), F.size("_old")
    # what the target before has passed on already: the end of its references is the beginning of these
    t = t.withColumn("_n", n).withColumn("_common", F.greatest(F.least(n - F.col("_step"), n_old), F.lit(0)))
    common = F.col("_common")
    same = F.slice("_refs", F.lit(1), common) == F.slice("_old", n_old - common + 1, common)
    t = t.withColumn("_known", F.when(F.col("_old").isNotNull() & same, common).otherwise(F.lit(0)))
    upto = F.sum(F.col("_n") - F.col("_known")).over(packets.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("_upto", upto.cast("int"))
    # the target itself goes with its own item, whether that is new or not
    own = F.col("_n") - 1
    spread = t.select("*", F.explode(F.sequence(F.least(F.col("_known"), own), own)).alias("_i")).select(
        user, "_packet", F.get("_refs", F.col("_i"))["item_id"].alias("item_id"),
        F.when(F.col("_i") >= F.col("_known"), F.col("_upto") - own + F.col("_i")).alias("_at"),
        F.when(F.col("_i") == own, F.struct(*key[1:], "_upto", "_n", "_rest")).alias("_target"),
    )
    known = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in INFO))
    texts = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.sort_array(F.collect_list(known)).alias("_texts"))
    unknown = F.array(F.struct(*(F.lit("NA").alias(c) for c in INFO)))
    entry = F.transform(F.coalesce("_texts", unknown), lambda x: F.struct("item_id", *(x[c].alias(c) for c in INFO)))
    looked = lookup_join(spread, texts, "item_id").select(
        user, "_packet", "_target", F.when(F.col("_at").isNotNull(), F.struct("_at", entry.alias("i"))).alias("_ref")
    )
    placed = looked.repartition(user, "_packet") if tasks is None else looked.repartition(tasks, user, "_packet")
    # collected lists leave out nulls
    put = placed.groupBy(user, "_packet").agg(F.sort_array(F.collect_list("_ref")).alias("_refs"), F.collect_list("_target").alias("_targets"))
    put = put.select(user, F.col("_refs.i").alias("_refs"), F.explode("_targets").alias("_t"))
    put = put.withColumn("_all", F.flatten(F.slice("_refs", F.col("_t._upto") - F.col("_t._n") + 1, F.col("_t._n"))))
    return put.select(
        user, *(F.col(f"_t.{c}") for c in key[1:]), "_t._rest.*",
        F.slice("_all", F.lit(1), F.size("_all") - 1).alias("history"), F.element_at("_all", -1).alias("info"),
    )


def variants(targets: DataFrame, index: str, test: bool | Column) -> DataFrame:
    """The main rendering of each target and, for training on codes, two auxiliary ones.

    ``shown`` is how the history is written, ``asked`` what is to be predicted.  ``test`` tells the rows that only get the main one.
    """
    def one(number, asked, shown, aux):
        return F.struct(
            F.lit(number).alias("variant"), F.lit(asked).alias("asked"), F.lit(shown).alias("shown"), F.lit(aux).alias("aux")
        )

    kinds = F.array(one(0, index, index, False))
    if index == "sem_id":
        every = F.concat(kinds, F.array(one(1, "title", "sem_id", True), one(2, "sem_id", "title", True)))
        kinds = F.when(F.lit(test) if isinstance(test, bool) else test, kinds).otherwise(every)
    return targets.withColumn("_v", F.explode(kinds)).select("*", "_v.*").drop("_v")


def render(df: DataFrame, prompt: str = tx.PROMPT) -> DataFrame:
    """Add ``messages`` from ``history``, ``info``, ``asked`` and ``shown``."""
    combos = [("title", "title"), ("sem_id", "sem_id"), ("title", "sem_id"), ("sem_id", "title")]
    text = reduce(
        lambda rest, c: F.when(
            (F.col("asked") == c[0]) & (F.col("shown") == c[1]), tx.render_chat("history", "info", c[0], c[1], prompt)
        ).otherwise(rest),
        combos[1:],
        tx.render_chat("history", "info", *combos[0], prompt),
    )
    return df.withColumn("messages", text)


def phase_targets(
    histories: DataFrame, phases: Sequence, min_len: int = 5, max_user_sample: int = 5, seed: str = "0", user: str = "user_id"
) -> DataFrame:
    """Targets of all phases, labelled; only the first phase limits targets per user."""
    labelled = histories.withColumn("phase", phase_of("ts", phases))
    train = (F.col("phase") != "test") & (F.col("pos") >= min_len)
    test = (F.col("phase") == "test") & (F.col("pos") == F.col("len"))
    chosen = labelled.where(train | test)
    if "pretrain" not in [p[0] for p in phases]:
        return chosen
    # in one pass: rows of other phases are not counted
    return sq.cap_per_user(chosen, max_user_sample, seed, user, F.when(F.col("phase") != "pretrain", F.col("pos")))


def build_examples(
    log: DataFrame,
    items: DataFrame,
    phases: Sequence,
    index: str = "title",
    max_len: int = 30,
    min_len: int = 5,
    max_user_sample: int = 5,
    seed: str = "0",
    keep_aux: bool = False,
) -> DataFrame:
    """All phases' examples: ``(phase, user_id, ts, item_id, messages, history)``.

    Histories come from one pass over the log and reach across phase borders; targets and
    variants are chosen, and capped, before any text is fetched.  Only test rows carry the history.
    ``keep_aux`` leaves the flag of auxiliary examples in.
    """
    log = before(log.select("user_id", "item_id", "ts"), phases[-1][2])
    sizes = key_sizes(log, ["user_id"])
    targets = phase_targets(id_histories(log, max_len, sizes), phases, min_len, max_user_sample, seed)
    is_test = F.col("phase") == "test"
    rows = variants(targets, index, is_test)
    if index == "sem_id":
        rows = rows.withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp")))
        rows = sq.sample_variant(
            rows, ["user_id", "item_id", "_ms", "aux"], ["pos", "variant"], seed, F.when(is_test, F.col("pos"))
        ).drop("_ms")
    return render(with_texts(rows, items, tasks=sizes.tasks())).select(
        "phase", "user_id", "ts", "item_id", "messages", F.when(is_test, F.col("history.item_id")).alias("history"),
        *(["aux"] if keep_aux else []),
    )


def item_dialogues(items: DataFrame, n: int = 5, seed: str = "0") -> DataFrame:
    """Text-to-index and index-to-text conversations of consecutive item blocks."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("title", "description", "sem_id")]
    groups = sq.item_groups(items.select("item_idx", "item_id", *blank), n, seed)
    ids = F.array_join(F.transform("targets", lambda t: t["item_id"].cast("string")), ",")
    made = [
        groups.select(
            "block", tx.render_dialogue("targets", "examples", kind).alias("messages"), ids.alias("item_ids"), F.lit(kind).alias("type")
        )
        for kind in ("t2i", "i2t")
    ]
    return made[0].unionByName(made[1])


def truncate_outputs(df: DataFrame, key: Sequence[str], beams: int, output: str = "output") -> DataFrame:
    """First line of each of the first ``beams`` outputs: ``(key, beam, text)``."""
    return df.select(*key, F.posexplode(F.slice(F.col(output), 1, beams)).alias("beam", "_t")).select(
        *key, F.col("beam").cast("long").alias("beam"), tx.first_line("_t").alias("text")
    )


def generation_turns(turns: DataFrame, mode: str, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversations as rows with the last turn replaced by the prefix the generator continues.

    Works row by row after one combined maximum, which is written, so that a conversation of any length can be split.
    """
    last = turns.groupBy(conversation).agg(F.max(order).alias("_last"))
    is_last = F.col(order) == F.col("_last")
    return lookup_join(turns, last, conversation, "inner").select(
        conversation,
        order,
        F.when(is_last, "assistant").otherwise(F.col("role")).alias("role"),
        F.when(is_last, tx.GENERATION_PREFIX[mode]).otherwise(F.col("text")).alias("content"),
    )
