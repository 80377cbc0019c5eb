"""Registered queries: metrics and end-to-end evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recquarry.functions import codes as cx
from recquarry.functions.draws import draw_int, draw_unit
from recquarry.operators import clean, codes as cd, examples as ex, layout, metrics as mt, sequences as sq, vectors as vc
from recquarry.plans.bindings import INTER, ITEMS, HORIZON, PHASES, THRESHOLD, Registry, interactions, items, table
from recquarry.plans.cleaning import POP_SQL
from recquarry.plans.sequencing import SEQ, phase
from recquarry.plans.vectoring import (
    HASHED, LAYERS, N_CODES, beam_sql, beams, codebook, repaired, scored, vectors,
)

R = Registry()
KS = (1, 5, 10)

# score table: every (user, item) of the log with a hash score; positives fall into the test window
SCORES = f"""{INTER}, pairs AS (SELECT user_id, item_id, CASE WHEN max(ts) >= TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END AS positive FROM inter GROUP BY 1, 2),
scores AS (SELECT *, ('0x' || substr(md5('sc#' || user_id || '#' || item_id), 1, 8))::BIGINT % 1000 / 1000.0::DOUBLE AS score FROM pairs),
pl AS (SELECT user_id, sum(positive) AS pos_len FROM scores GROUP BY 1 HAVING sum(positive) > 0),
lists AS (SELECT user_id, item_id, positive AS hit, pos_len, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM scores JOIN pl USING (user_id)),
trained AS (SELECT item_id, count(*) AS pop FROM inter WHERE ts < TIMESTAMP '2001-01-01' GROUP BY 1)"""


def scores(spark, sf):
    pairs = interactions(spark, sf).groupBy("user_id", "item_id").agg(
        F.when(F.max("ts") >= clean.ntz(THRESHOLD), 1).otherwise(0).alias("positive")
    )
    return pairs.withColumn("score", (draw_int("sc", "user_id", "item_id") % 1000) / F.lit(1000.0))


def trained(spark, sf):
    return clean.counts(clean.before(interactions(spark, sf), THRESHOLD), "item_id", "count")


def rounded(df):
    return df.select(*(c for c in df.columns if c != "value"), F.round("value", 6).alias("value"))


def overall(df):
    """Metrics without a cut-off."""
    return rounded(df).drop("k")


def per_user_sql(metric, expr):
    rows = [
        f"SELECT '{metric}' AS metric, CAST({k} AS BIGINT) AS k, round(avg(x), 6) AS value FROM (SELECT user_id, {expr.format(k=k)} AS x FROM lists GROUP BY user_id)"
        for k in KS
    ]
    return f"WITH {SCORES} " + " UNION ALL ".join(rows)


def _top(metric):
    def run(spark, sf):
        return rounded(mt.top_metrics(mt.collect_ranks(scores(spark, sf), max(KS)), [metric], KS))

    return run


IDCG = "list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(max(pos_len), {k}) AS BIGINT) + 1)])"
R.add("h_hit", per_user_sql("hit", "max(CASE WHEN rank <= {k} THEN hit ELSE 0 END)"))(_top("hit"))
R.add("h_mrr", per_user_sql("mrr", "coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1 AND rank <= {k}), 0)"))(_top("mrr"))
R.add("h_recall", per_user_sql("recall", "(sum(hit) FILTER (rank <= {k}))::DOUBLE / max(pos_len)"))(_top("recall"))
R.add("h_precision", per_user_sql("precision", "(sum(hit) FILTER (rank <= {k}))::DOUBLE / {k}"))(_top("precision"))
R.add("h_ndcg", per_user_sql("ndcg", "sum(hit / log2(rank + 1)) FILTER (rank <= {k}) / " + IDCG))(_top("ndcg"))
R.add("h_map", f"WITH {SCORES}, run AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS cum FROM lists) " + " UNION ALL ".join(
    f"SELECT 'map' AS metric, CAST({k} AS BIGINT) AS k, round(avg(x), 6) AS value FROM (SELECT user_id, sum(hit * cum::DOUBLE / rank) FILTER (rank <= {k}) / least(max(pos_len), {k}) AS x FROM run GROUP BY 1)"
    for k in KS))(_top("map"))


@R.add("collect_rank_inputs", f"""
WITH {SCORES}, r AS (SELECT user_id, positive, rank() OVER (PARTITION BY user_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0::DOUBLE AS mr FROM scores)
SELECT user_id, sum(mr) FILTER (positive = 1) AS pos_rank_sum, count(*) AS user_len, sum(positive)::BIGINT AS pos_len FROM r GROUP BY 1 HAVING sum(positive) > 0""")
def collect_rank_inputs(spark, sf):
    m = mt.collect_mean_ranks(scores(spark, sf)).where("pos_len > 0")
    return m.select("user_id", F.col("pos_rank_sum").cast("double").alias("pos_rank_sum"), "user_len", "pos_len")


@R.add("h_gauc", f"""
WITH {SCORES}, p AS (SELECT a.user_id, count(*) AS pairs, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won
  FROM scores a JOIN scores b ON a.user_id = b.user_id AND a.positive = 1 AND b.positive = 0 GROUP BY 1)
SELECT 'gauc' AS metric, round(sum(won / pairs * pos_len) / sum(pos_len), 6) AS value FROM p JOIN pl USING (user_id)""")
def h_gauc(spark, sf):
    return overall(mt.gauc(mt.collect_mean_ranks(scores(spark, sf))))


LABELLED = """lab AS (SELECT quality AS truth, ('0x' || substr(md5('v#' || labels.doc_id), 1, 8))::BIGINT % 100 / 100.0::DOUBLE AS score FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""


def labelled(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return lab.select(F.col("quality").alias("truth"), ((draw_int("v", "doc_id") % 100) / F.lit(100.0)).alias("score"))


@R.add("h_auc", f"""
WITH {LABELLED}, g AS (SELECT score, count(*) FILTER (truth > 0) AS p, count(*) FILTER (truth <= 0) AS n FROM lab GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score) AS cum FROM g)
SELECT 'auc' AS metric, round(sum(p * (cum - n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS value FROM c""")
def h_auc(spark, sf):
    return overall(mt.auc(labelled(spark, sf)))


def _error(metric):
    return lambda spark, sf: overall(mt.errors(labelled(spark, sf), [metric]))


def error_sql(metric, expr):
    return f"WITH {LABELLED} SELECT '{metric}' AS metric, round({expr}, 6) AS value FROM lab"


R.add("h_mae", error_sql("mae", "avg(abs(truth - score))"))(_error("mae"))
R.add("h_rmse", error_sql("rmse", "sqrt(avg((truth - score) ** 2))"))(_error("rmse"))
CLIP = "least(greatest(score, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
R.add("h_logloss", error_sql("logloss", f"avg(CASE WHEN truth = 1 THEN -ln({CLIP}) ELSE -ln(1 - {CLIP}) END)"))(_error("logloss"))


def list_sql(metric, body):
    return f"WITH {SCORES}, nu AS (SELECT count(*) AS users FROM pl), ni AS (SELECT count(*) AS items FROM part) " + " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, CAST({k} AS BIGINT) AS k, round(({body.format(k=k)}), 6) AS value" for k in KS
    )


def _lists(metric, **kw):
    def run(spark, sf):
        ranks = mt.collect_ranks(scores(spark, sf), max(KS))
        num_items = table(spark, sf, "part").count()
        return rounded(mt.list_metrics(ranks, [metric], KS, num_items, trained(spark, sf), **kw))

    return run


R.add("h_item_coverage", list_sql("itemcoverage", "SELECT count(DISTINCT item_id)::DOUBLE / (SELECT items FROM ni) FROM lists WHERE rank <= {k}"))(_lists("itemcoverage"))
R.add("h_average_popularity", list_sql("averagepopularity", "SELECT sum(coalesce(pop, 0))::DOUBLE / {k} / (SELECT users FROM nu) FROM lists LEFT JOIN trained USING (item_id) WHERE rank <= {k}"))(_lists("averagepopularity"))
R.add("h_shannon_entropy", list_sql("shannonentropy", "SELECT sum(-p * ln(p)) / count(*) FROM (SELECT c::DOUBLE / sum(c) OVER () AS p FROM (SELECT item_id, count(*) AS c FROM lists WHERE rank <= {k} GROUP BY 1))"))(_lists("shannonentropy"))
R.add("h_gini", list_sql("giniindex", "SELECT sum((2 * ((SELECT items FROM ni) - n + i) - (SELECT items FROM ni) - 1) * c)::DOUBLE / sum(c)::DOUBLE / (SELECT items FROM ni) FROM (SELECT c, row_number() OVER (ORDER BY c) AS i, count(*) OVER () AS n FROM (SELECT item_id, count(*) AS c FROM lists WHERE rank <= {k} GROUP BY 1))"))(_lists("giniindex"))
R.add("h_tail_percentage", list_sql("tailpercentage", "SELECT count(*)::DOUBLE / {k} / (SELECT users FROM nu) FROM lists WHERE rank <= {k} AND item_id IN (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY pop, item_id) AS i, count(*) OVER () AS n FROM trained) WHERE i <= greatest(floor(n * 0.1::DOUBLE), 1))"))(_lists("tailpercentage"))
R.add("h_tail_percentage_count", list_sql("tailpercentage", "SELECT count(*)::DOUBLE / {k} / (SELECT users FROM nu) FROM lists WHERE rank <= {k} AND item_id IN (SELECT item_id FROM trained WHERE pop <= 20)"))(_lists("tailpercentage", tail=20))


@R.add("evaluate_all", f"""
WITH {SCORES}, run AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS cum FROM lists)
SELECT 'recall' AS metric, CAST(10 AS BIGINT) AS k, round(avg(x), 5) AS value FROM (SELECT user_id, sum(hit) FILTER (rank <= 10)::DOUBLE / max(pos_len) AS x FROM lists GROUP BY 1)
UNION ALL SELECT 'map', 10, round(avg(x), 5) FROM (SELECT user_id, sum(hit * cum::DOUBLE / rank) FILTER (rank <= 10) / least(max(pos_len), 10) AS x FROM run GROUP BY 1)
UNION ALL SELECT 'itemcoverage', 10, round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM part), 5) FROM lists WHERE rank <= 10""")
def evaluate_all(spark, sf):
    n = table(spark, sf, "part").count()
    return mt.evaluate(["recall", "map", "itemcoverage"], (10,), scores(spark, sf), num_items=n)


RANKING = ["hit", "mrr", "map", "recall", "ndcg", "precision", "gauc", "itemcoverage", "averagepopularity", "shannonentropy", "giniindex", "tailpercentage"]
VALUES = ["auc", "mae", "rmse", "logloss"]


def together(*names):
    """The twins of single metrics as one table."""
    whole = {"h_gauc", "h_auc", "h_mae", "h_rmse", "h_logloss"}
    k = lambda n: "NULL::BIGINT AS k" if n in whole else "k"
    return " UNION ALL ".join(f"SELECT metric, {k(n)}, value FROM ({R.sql[n]})" for n in names)


@R.add("evaluate_ranking", together(
    "h_hit", "h_mrr", "h_map", "h_recall", "h_ndcg", "h_precision", "h_gauc", "h_item_coverage", "h_average_popularity", "h_shannon_entropy", "h_gini", "h_tail_percentage"))
def evaluate_ranking(spark, sf):
    n = table(spark, sf, "part").count()
    return mt.evaluate(RANKING, KS, scores(spark, sf), num_items=n, counts=trained(spark, sf), decimals=6)


@R.add("evaluate_values", together("h_auc", "h_mae", "h_rmse", "h_logloss"))
def evaluate_values(spark, sf):
    return mt.evaluate(VALUES, KS, values=labelled(spark, sf), decimals=6)


def e_metrics_sql(source, ks=(5, 10, 20), run=""):
    by = f"{run}, " if run else ""
    grp = f" GROUP BY {run}" if run else ""
    rows = []
    for k in ks:
        for name, gain in (("NDCG", "hit / log2(rank + 1)"), ("Recall", "hit"), ("MRR", "hit / rank::DOUBLE")):
            rows.append(
                f"SELECT {by}'{name}' AS metric, CAST({k} AS BIGINT) AS k, round(avg(x) * 100, 6) AS value FROM (SELECT {by}user_id, coalesce(sum(({gain})::DOUBLE) FILTER (rank <= {k}), 0) AS x FROM {source} GROUP BY {by}user_id){grp}"
            )
    return " UNION ALL ".join(rows)


@R.add("e_ndcg_recall_mrr", f"WITH {SCORES} {e_metrics_sql('lists')}")
def e_ndcg_recall_mrr(spark, sf):
    return rounded(mt.generation_metrics(mt.collect_ranks(scores(spark, sf), 20), (5, 10, 20)))


@R.add("flagship_popularity_eval", f"""
WITH {SEQ}, {POP_SQL}, tgt AS (SELECT user_id, item_id, pos FROM seq WHERE pos = len AND ts >= TIMESTAMP '2001-01-01' AND ts < TIMESTAMP '2001-08-02'),
seen AS (SELECT DISTINCT t.user_id, s.item_id FROM tgt t JOIN seq s ON s.user_id = t.user_id AND s.pos < t.pos),
lists AS (SELECT t.user_id, p.item_id, CASE WHEN p.item_id = t.item_id THEN 1 ELSE 0 END AS hit,
  row_number() OVER (PARTITION BY t.user_id ORDER BY round(p.coeff, 9) DESC, p.item_id) AS rank FROM tgt t, pop p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = t.user_id AND s.item_id = p.item_id))
{e_metrics_sql('lists', (5, 10, 20, 500))}""")
def flagship_popularity_eval(spark, sf):
    log = layout.number_rows(clean.before(interactions(spark, sf), HORIZON), ["user_id"], ["ts", "item_id"])
    log = layout.materialize(log.withColumnRenamed("_pos", "pos").withColumnRenamed("_len", "len"))
    pop = clean.decay_popularity(log, THRESHOLD, 30, 0.25)
    order = layout.index_rows(pop, [F.round("coeff", 9).desc(), "item_id"], "rank").select("item_id", (F.col("rank") + 1).alias("rank"))
    targets = sq.test_targets(log, *phase("test"))
    ranks = mt.rank_without_seen(targets, log.where("pos < len"), order)
    every = targets.select("user_id").join(ranks.select("user_id", "rank"), "user_id", "left")
    hits = every.select(
        "user_id", F.coalesce("rank", F.lit(1)).alias("rank"), F.when(F.col("rank").isNotNull(), 1).otherwise(0).alias("hit")
    )
    return rounded(mt.generation_metrics(hits, (5, 10, 20, 500)))


# generated titles: the titles of the last five history items, in both directions as two runs
TITLE_RUNS = f"""{SEQ}, {ITEMS}, {POP_SQL}, tgt AS (SELECT user_id, item_id, pos FROM seq WHERE pos = len AND ts >= TIMESTAMP '2001-01-01'),
hist AS (SELECT t.user_id, s.item_id, s.pos, t.pos AS at_pos FROM tgt t JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1),
beams AS (SELECT 'latest' AS run, user_id, i.title FROM hist h JOIN items i ON i.item_id = h.item_id WHERE h.pos >= at_pos - 3
  UNION ALL SELECT 'earlier', user_id, i.title FROM hist h JOIN items i ON i.item_id = h.item_id WHERE h.pos BETWEEN at_pos - 5 AND at_pos - 3)"""


def title_outputs(spark, sf):
    """Outputs of two runs: ``(run, user_id, item_id, history, output)``, best first."""
    titles = items(spark, sf).select("item_id", "title")
    log = clean.before(interactions(spark, sf), HORIZON).join(titles, "item_id")
    log = log.withColumn("info", F.struct("item_id", "title"))
    t = sq.test_examples(log, *phase("test"), item="info").withColumn("item_id", F.col("target.item_id"))
    # generators answer with more than a title; only the first line counts
    said = F.reverse(F.transform("history", lambda h: F.concat(F.lit(" "), h["title"], F.lit("\nDescription: generated"))))
    runs = F.array(
        F.struct(F.lit("latest").alias("run"), F.slice(said, 1, 5).alias("output")),
        F.struct(F.lit("earlier").alias("run"), F.slice(said, 3, 5).alias("output")),
    )
    out = t.select("user_id", "item_id", F.col("history.item_id").alias("history"), F.explode(runs).alias("r"))
    return out.select("r.run", "user_id", "item_id", "history", "r.output")


def rank_hits(ranked, targets):
    """Ranked items against each query's target; a query without ranked items keeps a row without a hit."""
    j = targets.join(ranked, "query_id", "left")
    hit = F.when(F.col("item_id") == F.col("target"), 1).otherwise(0)
    return j.select("query_id", F.coalesce("rank", F.lit(1)).alias("rank"), hit.alias("hit"))


@R.add("eval_title", f"""
WITH {TITLE_RUNS}, txt AS (SELECT 'q:' || title AS id, title AS t FROM (SELECT DISTINCT title FROM items) UNION ALL SELECT 'i:' || item_id, title || ' ' || description FROM items), {HASHED},
vec AS (SELECT txt.id, list(coalesce(s, 0)::DOUBLE ORDER BY i) AS v FROM txt CROSS JOIN range(0, 64) r(i) LEFT JOIN hb ON hb.id = txt.id AND b = i GROUP BY 1),
qv AS (SELECT substr(id, 3) AS title, v AS q FROM vec WHERE id LIKE 'q:%'), iv AS (SELECT substr(id, 3)::BIGINT AS item_id, v FROM vec WHERE id LIKE 'i:%'),
sim AS (SELECT title, item_id, sqrt(list_dot_product(q, q)) + sqrt(list_dot_product(v, v)) - 2 * list_dot_product(q, v) AS d FROM qv, iv),
best AS (SELECT run, user_id, item_id, min(d) AS d FROM beams JOIN sim USING (title) GROUP BY 1, 2, 3),
resc AS (SELECT run, user_id, item_id, CASE WHEN coalesce(coeff, 0) = 0 THEN 'Infinity'::DOUBLE ELSE d / coeff END AS d FROM best LEFT JOIN pop USING (item_id)
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = best.user_id AND h.item_id = best.item_id)),
lists AS (SELECT r.run, r.user_id, CASE WHEN r.item_id = t.item_id THEN 1 ELSE 0 END AS hit,
  row_number() OVER (PARTITION BY r.run, r.user_id ORDER BY round(d, 9), r.item_id) AS rank FROM resc r JOIN tgt t USING (user_id)),
every AS (SELECT x.run, t.user_id, coalesce(l.rank, 1) AS rank, coalesce(l.hit, 0) AS hit FROM tgt t CROSS JOIN (VALUES ('latest'), ('earlier')) x(run)
  LEFT JOIN lists l ON l.run = x.run AND l.user_id = t.user_id)
{e_metrics_sql('every', (5, 10, 20), 'run')}""")
def eval_title(spark, sf):
    outputs = layout.materialize(title_outputs(spark, sf).withColumn("query_id", F.concat_ws("#", "run", "user_id")))
    texts = ex.truncate_outputs(outputs, ["query_id", "history"], 3)
    queries = texts.select("query_id", F.col("text").alias("key"), F.col("history").alias("gone"))
    # equal texts are embedded and searched once
    encoded = vc.hash_embed(texts.select("text").distinct().withColumn("t", F.col("text")), "text", "t", name="vector")
    encoded = layout.materialize(encoded.withColumnRenamed("text", "key"))
    its = items(spark, sf)
    pop = clean.decay_popularity(interactions(spark, sf), THRESHOLD, 30, 0.25)
    iv = vc.hash_embed(its.select("item_id", F.concat_ws(" ", "title", "description").alias("t")), "item_id", "t", name="vector")
    iv = layout.materialize(iv.join(pop, "item_id", "left"))
    best = vc.rank_shared(queries, encoded, iv, 20, "l2", rescale=True)
    hits = rank_hits(best, outputs.select("query_id", F.col("item_id").alias("target")))
    named = hits.withColumn("run", F.split_part("query_id", F.lit("#"), F.lit(1)))
    return rounded(mt.generation_metrics(named, (5, 10, 20), ["run"], "query_id"))


# generated codes: the constrained beams of the user's latest history item that has a vector
CODE_RUNS = f"""{SEQ}, tgt AS MATERIALIZED (SELECT user_id, item_id, pos FROM seq WHERE pos = len AND ts >= TIMESTAMP '2001-01-01'),
lastv AS MATERIALIZED (SELECT t.user_id, max_by(s.item_id, s.pos) AS vec FROM tgt t JOIN seq s ON s.user_id = t.user_id AND s.pos BETWEEN t.pos - 30 AND t.pos - 1
  WHERE s.item_id IN (SELECT vec_id FROM embeddings) GROUP BY 1),
{scored("WHERE vec_id IN (SELECT vec FROM lastv)")}, {beam_sql()}"""


def code_outputs(spark, sf):
    """``(user_id, item_id, history, output)`` with codes as text, best beam first.

    Users without a vector in their history have an empty output.
    """
    known = vectors(spark, sf).select("item_id", F.lit(True).alias("has"))
    log = clean.before(interactions(spark, sf), HORIZON).join(known, "item_id", "left")
    log = log.withColumn("info", F.struct("item_id", F.coalesce("has", F.lit(False)).alias("has")))
    t = sq.test_examples(log, *phase("test"), item="info").withColumn("item_id", F.col("target.item_id"))
    usable = F.filter("history", lambda h: h["has"])
    t = layout.materialize(
        t.select(
            "user_id", "item_id", F.col("history.item_id").alias("history"), F.get(F.reverse(usable), F.lit(0))["item_id"].alias("vec")
        )
    )
    codes = repaired(spark, sf)
    # only vectors that a user asks for are searched
    asked = t.where("vec is not null").select(F.col("vec").alias("query_id")).distinct()
    b = beams(spark, sf, codes, asked).withColumn("sem_id", cx.format_sem_id("codes"))
    said = b.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sem_id"))).alias("o"))
    said = said.select(F.col("query_id").alias("vec"), F.col("o.sem_id").alias("output"))
    none = F.array().cast("array<string>")
    return t.join(said, "vec", "left").withColumn("output", F.coalesce("output", none)), codes


TEXT_OF = "'<a_' || prefix[1] || '><b_' || prefix[2] || '><c_' || prefix[3] || '><d_' || prefix[4] || '>'"


@R.add("join_predictions", f"""
WITH {CODE_RUNS}, said AS MATERIALIZED (SELECT query_id, string_agg({TEXT_OF}, ' ' ORDER BY rank) AS output FROM b4 GROUP BY 1)
SELECT t.user_id, t.item_id, r.sem_id AS target, coalesce(s.output, '') AS output
FROM tgt t LEFT JOIN lastv l USING (user_id) LEFT JOIN said s ON s.query_id = l.vec LEFT JOIN repaired r ON r.item_idx = t.item_id""")
def join_predictions(spark, sf):
    out, codes = code_outputs(spark, sf)
    target = codes.select(F.col("item_idx").alias("item_id"), F.trim("sem_id").alias("target"))
    return out.join(target, "item_id", "left").select("user_id", "item_id", "target", F.array_join("output", " ").alias("output"))


def exact_hit(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


@R.add("eval_sem_id", f"""
WITH {CODE_RUNS}, lists AS (SELECT t.user_id, coalesce(b.rank, 1) AS rank, {exact_hit(f"contains({TEXT_OF}, r.sem_id)")} AS hit
  FROM tgt t LEFT JOIN lastv l USING (user_id) LEFT JOIN b4 b ON b.query_id = l.vec LEFT JOIN repaired r ON r.item_idx = t.item_id)
{e_metrics_sql('lists', (1, 3, 5))}""")
def eval_sem_id(spark, sf):
    out, codes = code_outputs(spark, sf)
    target = codes.select(F.col("item_idx").alias("item_id"), F.trim("sem_id").alias("target"))
    hits = mt.hits_of_outputs(out.join(target, "item_id", "left"), ["user_id"], "output", "target")
    return rounded(mt.generation_metrics(hits, (1, 3, 5)))


@R.add("eval_sem_id_distance", f"""
WITH {CODE_RUNS}, bv AS (SELECT query_id, rank, [cb0.c[i] + cb1.c[i] + cb2.c[i] + cb3.c[i] FOR i IN range(1, 65)] AS q FROM b4
  JOIN cb cb0 ON cb0.layer = 0 AND cb0.code = prefix[1] JOIN cb cb1 ON cb1.layer = 1 AND cb1.code = prefix[2]
  JOIN cb cb2 ON cb2.layer = 2 AND cb2.code = prefix[3] JOIN cb cb3 ON cb3.layer = 3 AND cb3.code = prefix[4]),
sim AS (SELECT query_id, item_id, min(sqrt(list_dot_product(q, q)) + sqrt(list_dot_product(v, v)) - 2 * list_dot_product(q, v)) AS d FROM bv, emb WHERE rank <= 2 GROUP BY 1, 2),
lists AS (SELECT l.user_id, {exact_hit('s.item_id = t.item_id')} AS hit, row_number() OVER (PARTITION BY l.user_id ORDER BY round(d, 9), s.item_id) AS rank
  FROM lastv l JOIN sim s ON s.query_id = l.vec JOIN tgt t USING (user_id)
  WHERE NOT EXISTS (SELECT 1 FROM seq h WHERE h.user_id = l.user_id AND h.item_id = s.item_id AND h.pos BETWEEN t.pos - 30 AND t.pos - 1)),
every AS (SELECT t.user_id, coalesce(l.rank, 1) AS rank, coalesce(l.hit, 0) AS hit FROM tgt t LEFT JOIN lists l USING (user_id))
{e_metrics_sql('every', (5, 10, 20))}""")
def eval_sem_id_distance(spark, sf):
    out, _ = code_outputs(spark, sf)
    out = layout.materialize(out)
    texts = ex.truncate_outputs(out, ["user_id", "history"], 2)
    queries = texts.select(F.col("user_id").alias("query_id"), F.col("text").alias("key"), F.col("history").alias("gone"))
    # equal codes are decoded and searched once
    decoded = cd.decode_codes(
        queries.select("key").distinct().withColumn("codes", cx.parse_sem_id("key", LAYERS, N_CODES)), codebook(spark, sf), n_layers=LAYERS
    ).select("key", "vector")
    best = vc.rank_shared(queries, layout.materialize(decoded), vectors(spark, sf), 20, "l2")
    hits = rank_hits(best, out.select(F.col("user_id").alias("query_id"), F.col("item_id").alias("target")))
    return rounded(mt.generation_metrics(hits, (5, 10, 20), user="query_id"))


@R.add("run_metric_table", f"""
WITH {SCORES}, runs AS (SELECT c_custkey AS user_id, c_mktsegment AS run FROM customer WHERE c_mktsegment <> 'MACHINERY'),
l AS (SELECT run, lists.* FROM lists JOIN runs USING (user_id)),
m AS (SELECT run, avg(a) * 100 AS r5, avg(b) * 100 AS m5 FROM (SELECT run, user_id, coalesce(sum(hit) FILTER (rank <= 5), 0)::DOUBLE AS a,
  coalesce(sum(hit / rank::DOUBLE) FILTER (rank <= 5), 0) AS b FROM l GROUP BY 1, 2) GROUP BY 1)
SELECT s.run, CASE WHEN m.run IS NULL THEN 'missing' ELSE 'evaluated' END AS status, round(r5, 6) AS "Recall@5", round(m5, 6) AS "MRR@5"
FROM (SELECT DISTINCT c_mktsegment AS run FROM customer) s LEFT JOIN m USING (run)""")
def run_metric_table(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("run"))
    ranks = mt.collect_ranks(scores(spark, sf), 5)
    m = mt.generation_metrics(ranks.join(c.where("run <> 'MACHINERY'"), "user_id"), (5,), ["run"])
    return mt.run_table(rounded(m), c.select("run").distinct(), ["Recall@5", "MRR@5"])
