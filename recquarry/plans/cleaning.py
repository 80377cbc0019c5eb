"""Registered queries: sources, filters, joins and aggregations on logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recquarry.operators import clean
from recquarry.plans.bindings import (
    EVENTS, INTER, ITEMS, PHASE_CASE, PHASES, THRESHOLD, HORIZON, Registry, event_log, interactions, items, table,
)
from recquarry.sources import files

R = Registry()
MS = "epoch_ms(ts)"


def _ms(df):
    return df.withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))


@R.add("read_ratings", """
SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, l_quantity AS rating,
       epoch_ms(o_orderdate) AS "timestamp"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def read_ratings(spark, sf):
    li, od = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    path = files.fresh_path(spark, "ratings")
    (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .select(
            F.col("o_custkey").alias("reviewer"), F.col("l_partkey").alias("product"), F.col("l_quantity").alias("stars"),
            F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time"),
        )
        .write.option("header", True).option("compression", "gzip").csv(path)
    )
    return files.read_ratings(spark, path)


@R.add("read_item_meta", """
SELECT CAST(p_partkey AS VARCHAR) AS item_id,
       CASE WHEN p_size % 10 = 0 THEN 'None' ELSE p_brand || chr(10) || p_type END AS description,
       p_name AS title
FROM part WHERE p_size % 7 <> 0""")
def read_item_meta(spark, sf):
    p = table(spark, sf, "part")
    path = files.fresh_path(spark, "meta")
    p.select(
        F.col("p_partkey").cast("string").alias("parent_asin"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_name")).when(F.col("p_size") % 14 == 0, F.lit("")).alias("title"),
        F.when(F.col("p_size") % 10 != 0, F.array("p_brand", "p_type")).alias("description"),
        F.col("p_retailprice").alias("price"),
    ).write.option("compression", "gzip").json(path)
    return files.read_item_meta(spark, path)


@R.add("read_interactions", f"""
WITH {INTER} SELECT CAST(item_id AS VARCHAR) AS item_id, CAST(user_id AS VARCHAR) AS user_id, {MS} AS "timestamp" FROM inter""")
def read_interactions(spark, sf):
    path = files.fresh_path(spark, "interactions")
    files.write_interactions(interactions(spark, sf), path)
    return files.read_interactions(spark, path)


@R.add("write_interactions_items", f"""
WITH {ITEMS} SELECT CAST(item_id AS VARCHAR) AS item_id, description, title FROM items""")
def write_interactions_items(spark, sf):
    path = files.fresh_path(spark, "items")
    files.write_items(items(spark, sf).select(F.col("item_id").cast("string"), "description", "title"), path)
    return files.read_items(spark, path)


@R.add("vector_store", """
SELECT vec_id AS item_id, vec_id AS item_idx, u.pos - 1 AS pos, CAST(u.x AS DOUBLE) AS value
FROM embeddings, (SELECT vec_id AS v, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) u
WHERE u.v = vec_id""")
def vector_store(spark, sf):
    e = table(spark, sf, "embeddings")
    path = files.fresh_path(spark, "vectors")
    files.write_vectors(e.select(F.col("vec_id").alias("item_id"), F.col("vec_id").alias("item_idx"), "embedding"), path)
    v = files.read_vectors(spark, path)
    return v.select("item_id", "item_idx", F.posexplode("embedding").alias("pos", "value")).select(
        "item_id", "item_idx", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")
    )


@R.add("metric_archive", """
SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n, printf('%.3f', round(avg(value) * 100, 3)) AS mean_value
FROM events GROUP BY 1
UNION ALL
SELECT 'again-' || event_type, CAST(count(*) AS BIGINT), printf('%.3f', round(avg(value) * 100, 3))
FROM events GROUP BY 1""")
def metric_archive(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value") * 100, 3).alias("mean_value")
    )
    path = files.fresh_path(spark, "metrics")
    files.append_metrics(m, path)
    files.append_metrics(m.withColumn("name", F.concat(F.lit("again-"), "name")), path)
    return files.read_metrics(spark, path, "name STRING, n BIGINT, mean_value STRING")


@R.add("valid_title", f"""
WITH {ITEMS} SELECT item_id, title FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN title ELSE '' END AS title FROM items)
WHERE title IS NOT NULL AND length(title) > 0""")
def valid_title(spark, sf):
    dirty = items(spark, sf).select(
        "item_id",
        F.when(F.col("item_id") % 3 == 1, F.col("title")).when(F.col("item_id") % 3 == 2, F.lit("")).alias("title"),
    )
    return clean.valid_title(dirty)


@R.add("min_date_filter", f"""
WITH {INTER} SELECT user_id, item_id, epoch_ms(ts) AS "timestamp", strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM inter WHERE ts >= TIMESTAMP '1998-01-01'""")
def min_date_filter(spark, sf):
    raw = _ms(interactions(spark, sf)).drop("ts")
    return clean.since(raw, "1998-01-01").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@R.add("phase_split", f"""
WITH {INTER} SELECT * FROM (SELECT user_id, item_id, {PHASE_CASE} AS phase FROM inter) WHERE phase IS NOT NULL""")
def phase_split(spark, sf):
    return clean.phase_split(interactions(spark, sf), PHASES).select("user_id", "item_id", "phase")


@R.add("horizon_filter", f"""
WITH {INTER} SELECT user_id, item_id, {MS} AS ms FROM inter WHERE ts < TIMESTAMP '2001-04-01'""")
def horizon_filter(spark, sf):
    df = clean.before(interactions(spark, sf), "2001-04-01")
    return df.select("user_id", "item_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@R.add("normalize_epoch", f"""
WITH {EVENTS} SELECT event_id, micros // 1000000 AS "timestamp" FROM ev""")
def normalize_epoch(spark, sf):
    ev = event_log(spark, sf).select("event_id", F.col("micros").alias("timestamp"))
    return clean.normalize_epoch(ev)


@R.add("eval_cutoff", f"""
WITH {EVENTS} SELECT event_id, micros // 1000000 AS "timestamp" FROM ev WHERE micros // 1000000 < 1705276800""")
def eval_cutoff(spark, sf):
    ev = clean.normalize_epoch(event_log(spark, sf).select("event_id", F.col("micros").alias("timestamp")))
    return clean.before_epoch(ev, 1705276800)


@R.add("active_users", f"""
WITH {INTER}, cut AS (SELECT * FROM inter WHERE ts < TIMESTAMP '2001-01-01')
SELECT user_id, item_id, {MS} AS ms FROM cut
WHERE user_id IN (SELECT user_id FROM cut GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2000-07-01')""")
def active_users(spark, sf):
    cut = clean.before(interactions(spark, sf), THRESHOLD)
    df = clean.active_users(cut, clean.ntz("2000-07-01"))
    return df.select("user_id", "item_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@R.add("user_last_ts", f"""WITH {INTER} SELECT user_id, epoch_ms(max(ts)) AS last_ms FROM inter GROUP BY 1""")
def user_last_ts(spark, sf):
    df = clean.user_last_ts(interactions(spark, sf))
    return df.select("user_id", F.unix_millis(F.col("last_ts").cast("timestamp")).alias("last_ms"))


CATALOG = """cat AS (SELECT p_partkey AS item_id FROM part WHERE p_size > 10)"""


@R.add("semi_join_catalog", f"""
WITH {INTER}, {CATALOG} SELECT user_id, item_id, {MS} AS ms FROM inter WHERE item_id IN (SELECT item_id FROM cat)""")
def semi_join_catalog(spark, sf):
    catalog = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("item_id"))
    return _ms(clean.semi_join(interactions(spark, sf), catalog)).select("user_id", "item_id", F.col("timestamp").alias("ms"))


@R.add("semi_join_survivors", f"""
WITH {INTER}, {ITEMS} SELECT item_id, title FROM items WHERE item_id IN (SELECT item_id FROM inter WHERE ts >= TIMESTAMP '2001-07-01')""")
def semi_join_survivors(spark, sf):
    late = interactions(spark, sf).where(F.col("ts") >= clean.ntz("2001-07-01"))
    return clean.semi_join(items(spark, sf), late).select("item_id", "title")


@R.add("attach_counts", f"""
WITH {INTER}, ic AS (SELECT item_id, count(*) AS item_count FROM inter GROUP BY 1),
uc AS (SELECT user_id, count(*) AS user_count FROM inter GROUP BY 1)
SELECT user_id, item_id, {MS} AS ms, item_count, user_count
FROM inter LEFT JOIN ic USING (item_id) LEFT JOIN uc USING (user_id) WHERE ts >= TIMESTAMP '2000-01-01'""")
def attach_counts(spark, sf):
    log = interactions(spark, sf)
    recent = log.where(F.col("ts") >= clean.ntz("2000-01-01"))
    return _ms(clean.attach_counts(recent, log)).select(
        "user_id", "item_id", F.col("timestamp").alias("ms"), "item_count", "user_count"
    )


@R.add("item_user_counts", f"""
WITH {INTER} SELECT 'item' AS side, item_id AS id, count(*) AS n FROM inter GROUP BY item_id
UNION ALL SELECT 'user', user_id, count(*) FROM inter GROUP BY user_id""")
def item_user_counts(spark, sf):
    log = interactions(spark, sf)
    i = clean.counts(log, "item_id", "n").select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "n")
    u = clean.counts(log, "user_id", "n").select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "n")
    return i.unionByName(u)


FILTERED = f"""kept AS (
  SELECT * FROM inter
  WHERE ts >= TIMESTAMP '1999-01-01'
    AND item_id IN (SELECT item_id FROM inter GROUP BY 1 HAVING count(*) >= 20)
    AND user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 20)),
filtered AS (SELECT * FROM kept WHERE user_id IN (SELECT user_id FROM kept GROUP BY 1 HAVING count(*) >= 20))"""


@R.add("min_interactions_filter", f"""WITH {INTER}, {FILTERED} SELECT user_id, item_id, {MS} AS ms FROM filtered""")
def min_interactions_filter(spark, sf):
    df = clean.min_interactions(interactions(spark, sf), 20, "1999-01-01")
    return df.select("user_id", "item_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@R.add("dataset_profile", f"""
WITH {INTER}, {FILTERED}, both_ AS (SELECT 'before' AS stage, * FROM inter UNION ALL SELECT 'after', * FROM filtered),
agg AS (SELECT stage, count(*) AS points, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM both_ GROUP BY 1)
SELECT stage, 'points' AS metric, points AS n FROM agg UNION ALL SELECT stage, 'users', users FROM agg
UNION ALL SELECT stage, 'items', items FROM agg""")
def dataset_profile(spark, sf):
    log = interactions(spark, sf)
    kept = clean.min_interactions(log, 20, "1999-01-01")
    return clean.profile(log, "before").unionByName(clean.profile(kept, "after"))


@R.add("phase_domain_summary", f"""
WITH d AS (SELECT c_mktsegment AS domain, o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, {PHASE_CASE} AS phase FROM d)
SELECT domain, count(*) FILTER (phase = 'pretrain') AS pretrain_interactions,
  count(*) FILTER (phase = 'phase1') AS phase1_interactions, count(*) FILTER (phase = 'phase2') AS phase2_interactions,
  count(*) FILTER (phase = 'test') AS test_interactions,
  count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM p WHERE phase IS NOT NULL GROUP BY 1""")
def phase_domain_summary(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("domain"))
    df = clean.phase_split(interactions(spark, sf).join(cust, "user_id"), PHASES)
    return clean.phase_domain_summary(df, [p[0] for p in PHASES])


POP = """pop AS (SELECT item_id, pow(1 + sum(exp(-floor(epoch_us(TIMESTAMP '2001-01-01') / 1e6 / 86400 - epoch_us(ts) / 1e6 / 86400)
  * ln(2.0::DOUBLE) / 30)), 0.25::DOUBLE) AS coeff FROM inter WHERE ts < TIMESTAMP '2001-01-01' GROUP BY 1)"""
POP_SQL = POP


@R.add("time_decay_popularity", """
WITH ev AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts FROM events)
SELECT item_id, round(pow(1 + sum(exp(-((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) // 86400000000)::DOUBLE
  * (ln(2.0::DOUBLE) / 3))), 0.25::DOUBLE), 6) AS coeff
FROM ev WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def time_decay_popularity(spark, sf):
    df = clean.decay_popularity(event_log(spark, sf), "2024-01-20", 3, 0.25)
    return df.select("item_id", F.round("coeff", 6).alias("coeff"))


@R.add("dataset_stats", f"""
WITH {INTER}, a AS (SELECT count(*) AS inter_num, count(DISTINCT user_id) AS u, count(DISTINCT item_id) AS i FROM inter)
SELECT u + 1 AS user_num, i + 1 AS item_num, inter_num, round(inter_num::DOUBLE / u, 6) AS avg_actions_of_users,
  round(inter_num::DOUBLE / i, 6) AS avg_actions_of_items,
  round(1 - inter_num::DOUBLE / (u + 1) / (i + 1), 6) AS sparsity FROM a""")
def dataset_stats(spark, sf):
    df = clean.dataset_stats(interactions(spark, sf))
    return df.select(
        "user_num", "item_num", "inter_num",
        *(F.round(c, 6).alias(c) for c in ("avg_actions_of_users", "avg_actions_of_items", "sparsity")),
    )


@R.add("normalized_adjacency", f"""
WITH {INTER}, n AS (SELECT max(user_id) + 1 AS user_num FROM inter),
e AS (SELECT user_id AS u, item_id + user_num AS i FROM inter, n),
d AS (SELECT u AS v, count(*) AS deg FROM e GROUP BY 1 UNION ALL SELECT i, count(*) FROM e GROUP BY 1)
SELECT u AS src, i AS dst, round(1 / sqrt(a.deg::DOUBLE) * (1 / sqrt(b.deg::DOUBLE)), 6) AS weight FROM e JOIN d a ON a.v = u JOIN d b ON b.v = i
UNION ALL
SELECT i, u, round(1 / sqrt(a.deg::DOUBLE) * (1 / sqrt(b.deg::DOUBLE)), 6) FROM e JOIN d a ON a.v = u JOIN d b ON b.v = i""")
def normalized_adjacency(spark, sf):
    log = interactions(spark, sf)
    user_num = log.agg(F.max("user_id")).first()[0] + 1
    df = clean.normalized_adjacency(log, user_num)
    return df.select("src", "dst", F.round("weight", 6).alias("weight"))
