"""Registered queries: per-user sequences, targets, padding, ids, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from recquarry.operators import clean, layout, sequences as sq
from recquarry.plans.bindings import (
    EVENTS, INTER, ITEMS, PHASE_CASE, PHASES, HORIZON, Registry, event_log, interactions, items, table,
)

R = Registry()

SEQ = f"""{INTER}, seq AS (
  SELECT user_id, item_id, ts, row_number() OVER u AS pos, count(*) OVER (PARTITION BY user_id) AS len,
         epoch_ms(ts) // 1000 AS sec
  FROM inter WINDOW u AS (PARTITION BY user_id ORDER BY ts, item_id))"""
HIST = f"""{SEQ}, hist AS (
  SELECT a.user_id, a.pos, a.len, a.ts, a.item_id, coalesce(string_agg(b.item_id::VARCHAR, ',' ORDER BY b.pos), '') AS history,
         count(b.pos) AS n_history
  FROM seq a LEFT JOIN seq b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 30 AND a.pos - 1 GROUP BY ALL)"""


def sec(c="ts"):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def phase(name):
    return next((s, e) for n, s, e in PHASES if n == name)


@R.add("history_window", f"""WITH {HIST} SELECT user_id, item_id, pos, history FROM hist""")
def history_window(spark, sf):
    h = sq.history_window(interactions(spark, sf), 30)
    return h.select("user_id", "item_id", "pos", joined("history").alias("history"))


@R.add("train_targets", f"""
WITH {HIST} SELECT user_id, item_id, pos, history FROM hist
WHERE pos >= 5 AND ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2000-07-01'""")
def train_targets(spark, sf):
    h = sq.train_targets(sq.history_window(clean.before(interactions(spark, sf), HORIZON)), *phase("phase1"))
    return h.select("user_id", "item_id", "pos", joined("history").alias("history"))


@R.add("test_targets", f"""
WITH {HIST} SELECT user_id, item_id, pos, history FROM hist
WHERE pos = len AND ts >= TIMESTAMP '2001-01-01' AND ts < TIMESTAMP '2001-08-02'""")
def test_targets(spark, sf):
    # histories are collected for last rows alone
    h = sq.test_examples(clean.before(interactions(spark, sf), HORIZON), *phase("test"))
    return h.select("user_id", F.col("target").alias("item_id"), F.col("len").alias("pos"), joined("history").alias("history"))


@R.add("cap_per_user", f"""
WITH {SEQ} SELECT user_id, item_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('7#' || user_id || '#' || pos), pos) AS r FROM seq
  WHERE pos >= 5 AND ts < TIMESTAMP '2000-01-01') WHERE r <= 5""")
def cap_per_user(spark, sf):
    n = layout.number_rows(interactions(spark, sf), ["user_id"], ["ts", "item_id"]).withColumnRenamed("_pos", "pos")
    return sq.cap_per_user(sq.train_targets(n, *phase("pretrain")), 5, "7").select("user_id", "item_id", "pos")


@R.add("drop_empty_examples", f"""
WITH {SEQ}, per AS (SELECT user_id, list(item_id ORDER BY pos) FILTER (ts >= TIMESTAMP '2001-06-01' AND pos >= 5) AS ex FROM seq GROUP BY 1)
SELECT user_id, unnest(ex) AS item_id FROM per""")
def drop_empty_examples(spark, sf):
    n = layout.number_rows(interactions(spark, sf), ["user_id"], ["ts", "item_id"])
    return sq.drop_empty_examples(n, (F.col("ts") >= clean.ntz("2001-06-01")) & (F.col("_pos") >= 5))


@R.add("user_sequences", f"""
WITH {SEQ} SELECT user_id, (pos - 1) // 10000 AS page, string_agg(item_id::VARCHAR, ',' ORDER BY pos) AS items,
  string_agg(sec::VARCHAR, ',' ORDER BY pos) AS times FROM seq GROUP BY 1, 2""")
def user_sequences(spark, sf):
    s = sq.user_sequences(interactions(spark, sf))
    times = F.transform("times", lambda t: F.unix_seconds(t.cast("timestamp")))
    return s.select("user_id", "page", joined("items").alias("items"), joined(times).alias("times"))


CHUNKS = f"""{SEQ}, off AS (SELECT *, CASE WHEN len > 26 THEN len % 26 ELSE 0 END AS dropped FROM seq),
chunks AS (SELECT user_id, (pos - 1 - dropped) // 26 AS chunk, list(item_id ORDER BY pos) AS item_seq, list(sec ORDER BY pos) AS sec_seq
  FROM off WHERE pos > dropped GROUP BY 1, 2)"""


@R.add("chunk_sequences", f"""
WITH {CHUNKS} SELECT user_id, chunk, array_to_string(item_seq, ',') AS item_seq, array_to_string(sec_seq, ',') AS time_seq FROM chunks""")
def chunk_sequences(spark, sf):
    c = sq.chunk_sequences(interactions(spark, sf), 25)
    times = F.transform("time_seq", lambda t: F.unix_seconds(t.cast("timestamp")))
    return c.select("user_id", "chunk", joined("item_seq").alias("item_seq"), joined(times).alias("time_seq"))


@R.add("prefix_augment", f"""
WITH {CHUNKS} SELECT user_id, chunk, n, array_to_string(item_seq[1:n], ',') AS item_seq
FROM (SELECT *, unnest(range(2, len(item_seq) + 1)) AS n FROM chunks)""")
def prefix_augment(spark, sf):
    p = sq.prefix_augment(sq.chunk_sequences(interactions(spark, sf), 25))
    return p.select("user_id", "chunk", "n", joined("item_seq").alias("item_seq"))


@R.add("leave_last_out", f"""
WITH {SEQ} SELECT user_id, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY pos) FILTER (pos < len AND pos >= len - 25), '') AS history,
  max(item_id) FILTER (pos = len) AS target FROM seq GROUP BY 1""")
def leave_last_out(spark, sf):
    s = sq.last_items(interactions(spark, sf), 25)
    return s.select("user_id", joined("history").alias("history"), "target")


@R.add("pad_left", f"""
WITH {SEQ}, h AS (SELECT user_id, coalesce(list(item_id ORDER BY pos) FILTER (pos < len AND pos >= len - 25), []) AS s FROM seq GROUP BY 1)
SELECT user_id, array_to_string(list_concat([0 FOR i IN range(25 - len(s))], s), ',') AS item_seq FROM h""")
def pad_left(spark, sf):
    s = sq.last_items(interactions(spark, sf), 25)
    return s.select("user_id", joined(sq.pad_left("history", 25)).alias("item_seq"))


@R.add("calendar_features", f"""
WITH {EVENTS}, e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos,
    count(*) OVER (PARTITION BY user_id) AS len FROM ev),
h AS (SELECT user_id, coalesce(list(make_timestamp((epoch_us(ts) // 1000000) * 1000000) ORDER BY pos) FILTER (pos < len AND pos >= len - 10), []) AS s
  FROM e GROUP BY 1),
p AS (SELECT user_id, list_concat([TIMESTAMP '1970-01-01' FOR i IN range(10 - len(s))], s) AS s FROM h)
SELECT user_id, array_to_string([strftime(t, '%Y-%-m-%-d-%-H-%-M-%-S') FOR t IN s], ',') AS features FROM p""")
def calendar_features(spark, sf):
    s = sq.last_items(event_log(spark, sf).select("user_id", "item_id", "ts"), 10)
    seconds = F.transform("history_ts", lambda t: F.unix_seconds(t.cast("timestamp")))
    parts = sq.calendar_features(sq.pad_left(seconds, 10))
    return s.select(
        "user_id",
        F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), "-")), ",").alias("features"),
    )


@R.add("next_item_pairs", f"""
WITH {CHUNKS}, p AS (SELECT user_id, chunk, unnest(range(1, len(item_seq))) AS i, item_seq FROM chunks)
SELECT user_id, chunk, i - 1 AS step, item_seq[i] AS input, item_seq[i + 1] AS target FROM p""")
def next_item_pairs(spark, sf):
    return sq.next_item_pairs(sq.chunk_sequences(interactions(spark, sf), 25))


@R.add("next_item_mask", f"""
WITH {CHUNKS} SELECT user_id, chunk, repeat('0', CAST(26 - len(item_seq) AS INTEGER)) || repeat('1', CAST(len(item_seq) - 1 AS INTEGER)) AS mask FROM chunks""")
def next_item_mask(spark, sf):
    c = sq.chunk_sequences(interactions(spark, sf), 25)
    mask = F.array_join(F.transform(sq.next_item_mask("item_seq", 26), lambda x: x.cast("string")), "")
    return c.select("user_id", "chunk", mask.alias("mask"))


IDS = f"""{INTER}, first_item AS (SELECT CAST(item_id AS VARCHAR) AS token, min(ts) AS first_at FROM inter GROUP BY 1),
ids AS (SELECT token, row_number() OVER (ORDER BY first_at, token) AS id FROM first_item)"""


@R.add("dense_ids", f"""
WITH {IDS}, first_user AS (SELECT CAST(user_id AS VARCHAR) AS token, min(ts) AS first_at FROM inter GROUP BY 1)
SELECT 'item' AS side, token, id FROM ids UNION ALL SELECT 'item', '[PAD]', 0
UNION ALL SELECT 'user', token, row_number() OVER (ORDER BY first_at, token) FROM first_user UNION ALL SELECT 'user', '[PAD]', 0""")
def dense_ids(spark, sf):
    log = interactions(spark, sf)
    i = sq.dense_ids(log, "item_id").select(F.lit("item").alias("side"), "token", "id")
    u = sq.dense_ids(log, "user_id").select(F.lit("user").alias("side"), "token", "id")
    return i.unionByName(u)


@R.add("encode_ids", f"""
WITH {INTER}, cat AS (SELECT CAST(p_partkey AS VARCHAR) AS token, p_size AS o FROM part WHERE p_size > 25),
all_ AS (SELECT token, 0 AS tier, o::BIGINT AS pos FROM cat UNION ALL SELECT CAST(item_id AS VARCHAR), 1, epoch_us(ts) FROM inter),
f AS (SELECT token, min({{'tier': tier, 'pos': pos}}) AS o FROM all_ GROUP BY 1),
ids AS (SELECT token, row_number() OVER (ORDER BY o.tier, o.pos, token) AS id FROM f)
SELECT user_id, id AS item, epoch_ms(ts) AS ms FROM inter JOIN ids ON token = CAST(item_id AS VARCHAR)""")
def encode_ids(spark, sf):
    log = interactions(spark, sf)
    catalog = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("token"), F.col("p_size").alias("order"))
    out = sq.encode_ids(log, sq.dense_ids(log, "item_id", catalog=catalog), "item_id", "item")
    return out.select("user_id", "item", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


# sequences of dense ids, where every number from 1 on is an item
DENSE = f"""{CHUNKS}, {IDS.replace(INTER + ", ", "")}, pool AS (SELECT count(*) AS pool FROM ids),
dense AS (SELECT user_id, (pos - 1 - dropped) // 26 AS chunk, list(id ORDER BY pos) AS item_seq FROM off JOIN ids ON token = CAST(item_id AS VARCHAR)
  WHERE pos > dropped GROUP BY 1, 2)"""


def gap_sql(name, source, reject):
    """Adds the sorted rejected ids ``d`` and, for each, how many allowed ids lie before it."""
    return f"""{name} AS (SELECT *, [d[i] - i FOR i IN range(1, len(d) + 1)] AS gaps FROM (
  SELECT *, list_sort(list_distinct(list_filter({reject}, lambda x: x BETWEEN 1 AND pool))) AS d FROM {source}, pool))"""


def neg_sql(seed, key, count):
    r = f"(('0x' || substr(md5('{seed}#' || {key} || '#' || j), 1, 15))::BIGINT % (pool - len(d)))"
    return f"[CASE WHEN pool > len(d) THEN {r} + 1 + len(list_filter(gaps, lambda g: g <= {r})) END FOR j IN range(1, {count} + 1)]"


def dense_log(spark, sf):
    """The log with dense item ids, the number of ids with the padding item, and the users' sizes, counted without the ids."""
    log = interactions(spark, sf)
    ids = layout.materialize(sq.dense_ids(log, "item_id"))
    return sq.encode_ids(log, ids, "item_id", "item"), ids.count(), layout.key_sizes(log, ["user_id"])


def dense_chunks(spark, sf):
    log, item_num, sizes = dense_log(spark, sf)
    return sq.chunk_sequences(log, 25, item="item", sizes=sizes), item_num


CHUNK_KEY = "user_id || '#' || chunk"


@R.add("negative_sample", f"""
WITH {DENSE}, {gap_sql("g", "dense", "item_seq")}
SELECT user_id, chunk, array_to_string({neg_sql("n", CHUNK_KEY, "(len(item_seq) - 1)")}, ',') AS negatives FROM g""")
def negative_sample(spark, sf):
    c, item_num = dense_chunks(spark, sf)
    neg = sq.negatives(F.size("item_seq") - 1, item_num, "item_seq", "n", "user_id", "chunk")
    return c.select("user_id", "chunk", joined(neg).alias("negatives"))


@R.add("negative_sample_free", f"""
WITH {DENSE}
SELECT user_id, chunk, array_to_string([('0x' || substr(md5('f#' || user_id || '#' || chunk || '#' || j), 1, 15))::BIGINT % pool + 1 FOR j IN range(1, 9)], ',') AS negatives
FROM dense, pool""")
def negative_sample_free(spark, sf):
    c, item_num = dense_chunks(spark, sf)
    neg = sq.negatives(8, item_num, None, "f", "user_id", "chunk")
    return c.select("user_id", "chunk", joined(neg).alias("negatives"))


PADDED = f"""{DENSE}, {gap_sql("g", "dense", "item_seq")},
padded AS (SELECT user_id, chunk, list_concat({neg_sql("p", CHUNK_KEY, "26")}[len(item_seq) + 1:], item_seq) AS item_seq FROM g)"""


def padded_chunks(spark, sf):
    c, item_num = dense_chunks(spark, sf)
    neg = sq.negatives(26, item_num, "item_seq", "p", "user_id", "chunk")
    return c.select("user_id", "chunk", sq.pad_left("item_seq", 26, neg).alias("item_seq")), item_num


@R.add("pad_with_negatives", f"WITH {PADDED} SELECT user_id, chunk, array_to_string(item_seq, ',') AS item_seq FROM padded")
def pad_with_negatives(spark, sf):
    p, _ = padded_chunks(spark, sf)
    return p.select("user_id", "chunk", joined("item_seq").alias("item_seq"))


@R.add("negative_fixed_count", f"""
WITH {PADDED}, {gap_sql("h", "padded", "item_seq")}
SELECT user_id, chunk, array_to_string({neg_sql("k", CHUNK_KEY, "12")}, ',') AS negatives FROM h""")
def negative_fixed_count(spark, sf):
    """A fixed number of negatives that avoid the padded sequence."""
    p, item_num = padded_chunks(spark, sf)
    neg = sq.negatives(12, item_num, "item_seq", "k", "user_id", "chunk")
    return p.select("user_id", "chunk", joined(neg).alias("negatives"))


@R.add("whole_sequences", f"""
WITH {SEQ} SELECT user_id, (pos - 1) // 10 AS page, any_value((len + 9) // 10) AS n_pages, any_value(len) AS len,
  string_agg(item_id::VARCHAR, ',' ORDER BY pos) AS items FROM seq GROUP BY 1, 2""")
def whole_sequences(spark, sf):
    p = sq.paged_sequences(interactions(spark, sf), 10)
    return p.select("user_id", "page", "n_pages", "len", joined("items").alias("items"))


@R.add("whole_sequence_tail", f"""
WITH {SEQ} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY pos) FILTER (pos > len - 25) AS items,
  string_agg(sec::VARCHAR, ',' ORDER BY pos) FILTER (pos > len - 25) AS times FROM seq GROUP BY 1""")
def whole_sequence_tail(spark, sf):
    t = sq.sequence_tail(sq.paged_sequences(interactions(spark, sf), 10), 25, 10)
    times = F.transform("times", lambda t: F.unix_seconds(t.cast("timestamp")))
    return t.select("user_id", joined("items").alias("items"), joined(times).alias("times"))


@R.add("whole_history_negatives", f"""
WITH {DENSE}, own AS (SELECT user_id, list(id) AS all_ids FROM inter JOIN ids ON token = CAST(item_id AS VARCHAR) GROUP BY 1),
{gap_sql("g", "own", "all_ids")}, n AS (SELECT user_id, {neg_sql("w", "user_id", "8")} AS neg FROM g)
SELECT user_id, unnest(range(1, 9)) AS slot, unnest(neg) AS item FROM n""")
def whole_history_negatives(spark, sf):
    log, item_num, sizes = dense_log(spark, sf)
    w = sq.whole_history_negatives(log, 8, item_num, "w", item="item", sizes=sizes)
    return w.select("user_id", F.col("slot").cast("long").alias("slot"), "item")


@R.add("sample_n", f"""
WITH {ITEMS} SELECT item_id, title FROM (SELECT * FROM items ORDER BY md5('s#' || item_id), item_id LIMIT 50)""")
def sample_n(spark, sf):
    return sq.sample_n(items(spark, sf), 50, ["item_id"], ["item_id"], "s").select("item_id", "title")


@R.add("shuffle_rows", """
SELECT conv_id, turn, row_number() OVER (ORDER BY md5('x#' || conv_id || '#' || turn), conv_id, turn) - 1 AS at FROM conversations""")
def shuffle_rows(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    shuffled = sq.shuffle_rows(c, ["conv_id", "turn"], "x")
    return layout.index_rows(shuffled, [sq.draw_hex("x", "conv_id", "turn"), "conv_id", "turn"], "at")


@R.add("slice_fraction", f"""
WITH {ITEMS}, o AS (SELECT item_id, title, row_number() OVER (ORDER BY title, item_id) AS r, count(*) OVER () AS n FROM items)
SELECT item_id, title, 'rehearsal' AS source FROM o WHERE r <= floor(n * 0.1::DOUBLE)
UNION ALL SELECT item_id, title, 'phase' FROM items WHERE item_id % 2 = 0""")
def slice_fraction(spark, sf):
    all_items = items(spark, sf).select("item_id", "title")
    old = sq.slice_fraction(all_items, ["title", "item_id"], 0.1).withColumn("source", F.lit("rehearsal"))
    return old.unionByName(all_items.where("item_id % 2 = 0").withColumn("source", F.lit("phase")))


@R.add("average_rank", """
SELECT source, doc_id, (rank() OVER (PARTITION BY source ORDER BY n_chars // 100 DESC)
  + (count(*) OVER (PARTITION BY source, n_chars // 100) - 1) / 2)::DOUBLE AS avg_rank FROM documents""")
def average_rank(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.expr("n_chars div 100").alias("score"))
    r = sq.average_rank(d, ["source"], "score")
    return d.join(r, ["source", "score"]).select("source", "doc_id", F.col("avg_rank").cast("double").alias("avg_rank"))


@R.add("time_gap_bucket", f"""
WITH {EVENTS}, g AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev)
SELECT user_id, event_id, coalesce(n - s, 0) AS gap, least(greatest(floor(ln(greatest(abs(coalesce(n - s, 0)), 1)::DOUBLE) / 0.301::DOUBLE), 0), 128)::BIGINT AS bucket FROM g""")
def time_gap_bucket(spark, sf):
    ev = event_log(spark, sf).select("user_id", "event_id", "ts")
    return sq.time_gap_bucket(ev, order=("ts", "event_id")).select("user_id", "event_id", "gap", "bucket")


@R.add("time_gap_matrix", f"""
WITH {CHUNKS}, m AS (SELECT user_id, chunk, sec_seq AS s, list_concat(sec_seq[2:], sec_seq[-1:]) AS nxt FROM chunks)
SELECT user_id, chunk, array_to_string([array_to_string([least(floor(ln(greatest(abs(nxt[j] - s[i]), 1)::DOUBLE) / 0.301::DOUBLE), 128)::BIGINT FOR i IN range(1, j + 1)], ',') FOR j IN range(1, len(s) + 1)], ';') AS buckets FROM m""")
def time_gap_matrix(spark, sf):
    c = sq.chunk_sequences(interactions(spark, sf), 25)
    seconds = F.transform("time_seq", lambda t: F.unix_seconds(t.cast("timestamp")))
    m = sq.time_gap_matrix(seconds)
    return c.select("user_id", "chunk", F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";").alias("buckets"))


@R.add("multi_key_sort", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS at FROM orders""")
def multi_key_sort(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return layout.index_rows(o, ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"], "at").select("o_orderkey", "at")


@R.add("history_lookup", f"""
WITH {SEQ}, {ITEMS}, t AS (SELECT * FROM seq WHERE pos = len AND ts >= TIMESTAMP '2001-01-01')
SELECT t.user_id, coalesce(string_agg(i.title || '/' || i.description, '|' ORDER BY s.pos), '') AS history
FROM t LEFT JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1 LEFT JOIN items i ON i.item_id = s.item_id GROUP BY 1""")
def history_lookup(spark, sf):
    t = sq.test_examples(clean.before(interactions(spark, sf), HORIZON), *phase("test"))
    h = sq.history_lookup(t, ["user_id"], items(spark, sf), ["title", "description"])
    text = F.transform("history_info", lambda i: F.concat(i["title"], F.lit("/"), i["description"]))
    return h.select("user_id", F.array_join(text, "|").alias("history"))


@R.add("history_index_map", f"""
WITH {SEQ}, d AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS item_idx FROM part),
t AS (SELECT * FROM seq WHERE pos = len AND ts >= TIMESTAMP '2001-01-01')
SELECT t.user_id, coalesce(string_agg(d.item_idx::VARCHAR, ',' ORDER BY s.pos), '') AS history_idx
FROM t LEFT JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1 LEFT JOIN d ON d.item_id = s.item_id GROUP BY 1""")
def history_index_map(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_retailprice")
    index = layout.index_rows(p, ["p_retailprice", "item_id"], "item_idx")
    t = sq.test_examples(clean.before(interactions(spark, sf), HORIZON), *phase("test"))
    h = sq.history_lookup(t, ["user_id"], index, ["item_idx"])
    return h.select("user_id", joined(F.col("history_info.item_idx")).alias("history_idx"))
