"""Registered queries: vectors, nearest neighbours, semantic codes and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from recquarry.functions import codes as cx, text as tx, vectors as vx
from recquarry.functions.draws import draw_int
from recquarry.operators import clean, codes as cd, layout, sequences as sq, vectors as vc
from recquarry.plans.bindings import INTER, ITEMS, HORIZON, THRESHOLD, Registry, interactions, item_vectors, items, table
from recquarry.plans.cleaning import POP_SQL
from recquarry.plans.sequencing import SEQ, joined, phase
from recquarry.sources import files

R = Registry()

# Codebook of the registered queries: layer l, code c is vector 16 l + c.
N_CODES, LAYERS = 16, 4

EMB = "emb AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
CB = """cb AS (SELECT vec_id // 16 AS layer, vec_id % 16 AS code, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 64)"""


def sub_sql(a, b):
    return f"[{a}[i] - {b}[i] FOR i IN range(1, len({a}) + 1)]"


def codes_cte():
    parts = [EMB, CB, "r0 AS (SELECT item_id AS item_idx, v AS r FROM emb)"]
    for layer in range(LAYERS):
        parts.append(
            f"n{layer} AS MATERIALIZED (SELECT item_idx, arg_min(code, {{'d': round(list_dot_product(r, r) + list_dot_product(c, c) - 2 * list_dot_product(r, c), 9), 'code': code}}) AS code "
            f"FROM r{layer}, cb WHERE layer = {layer} GROUP BY 1)"
        )
        parts.append(
            f"r{layer + 1} AS MATERIALIZED (SELECT item_idx, {sub_sql('r', 'c')} AS r FROM r{layer} JOIN n{layer} USING (item_idx) JOIN cb USING (code) WHERE layer = {layer})"
        )
    joins = " ".join(f"JOIN n{i} USING (item_idx)" for i in range(1, LAYERS))
    parts.append(
        "codes AS MATERIALIZED (SELECT n0.item_idx, [" + ", ".join(f"n{i}.code" for i in range(LAYERS)) + f"]::INTEGER[] AS codes FROM n0 {joins})"
    )
    return ", ".join(parts)


CODES = codes_cte()
NEAR = """near AS (SELECT a.code, list(b.code ORDER BY round(list_distance(a.c, b.c), 9), a.code <> b.code, b.code)::INTEGER[] AS nb
  FROM cb a, cb b WHERE a.layer = 3 AND b.layer = 3 GROUP BY 1)"""
REPAIRED = f"""{CODES}, {NEAR}, grp AS (SELECT codes[1:3] AS prefix, list(codes[4] ORDER BY item_idx) AS own, list(item_idx ORDER BY item_idx) AS ids FROM codes GROUP BY 1),
book AS (SELECT list(nb ORDER BY code) AS nbs FROM near),
folded AS (SELECT prefix, ids, list_reduce(list_transform(own, lambda c: [c]), lambda acc, x:
  list_append(acc, coalesce(list_filter(nbs[x[1] + 1], lambda n: NOT list_contains(acc, n))[1], x[1])), []::INTEGER[]) AS new FROM grp, book),
fixed AS (SELECT unnest(ids) AS item_idx, prefix, unnest(new) AS last FROM folded),
repaired AS MATERIALIZED (SELECT item_idx, list_append(prefix, last) AS codes, '<a_' || prefix[1] || '><b_' || prefix[2] || '><c_' || prefix[3] || '><d_' || last || '>' AS sem_id FROM fixed)"""


def vectors(spark, sf):
    return item_vectors(spark, sf).select(F.col("item_id"), F.col("embedding").alias("vector"))


def codebook(spark, sf):
    e = table(spark, sf, "embeddings").where(F.col("vec_id") < N_CODES * LAYERS)
    return e.select(
        F.expr(f"cast(vec_id div {N_CODES} as int)").alias("layer"),
        (F.col("vec_id") % N_CODES).cast("int").alias("code"),
        F.col("embedding").cast("array<double>").alias("centroid"),
    )


def encoded(spark, sf, keep_errors=False):
    return cd.residual_encode(vectors(spark, sf).withColumnRenamed("item_id", "item_idx"), codebook(spark, sf), keep_errors)


def repaired(spark, sf):
    """Collision-free codes with their text; written once because several steps read them."""
    fixed = cd.resolve_collisions(encoded(spark, sf), cd.code_neighbors(codebook(spark, sf)))
    return layout.materialize(fixed.withColumn("sem_id", cx.format_sem_id("codes")))


# users of the vector queries: mean of their items' vectors before the test window
USERVEC = f"""{SEQ}, {EMB}, uitems AS (SELECT user_id, item_id FROM inter WHERE ts < TIMESTAMP '2001-01-01'),
uv AS (SELECT user_id AS query_id, list(x ORDER BY i) AS q FROM (
  SELECT user_id, i, avg(v[i]) AS x FROM uitems JOIN emb USING (item_id), range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"""


def user_vectors(spark, sf):
    """Users' mean vectors, and their items among those that have one."""
    past = clean.before(interactions(spark, sf), THRESHOLD)
    members = vc.member_counts(past, "user_id", vectors(spark, sf))
    means = vc.mean_of_members(members, vectors(spark, sf)).withColumnRenamed("key", "query_id")
    return means, members.select(F.col("key").alias("query_id"), "item_id")


@R.add("l2_normalize", """
SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-6), 6) AS value
FROM embeddings, range(1, 65) r(i)""")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vx.l2_normalize("embedding")).alias("pos", "value"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@R.add("mean_pool", """
SELECT label, i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2""")
def mean_pool(spark, sf):
    m = vc.mean_pool(table(spark, sf, "embeddings"), "label")
    return m.select("label", F.posexplode("embedding").alias("pos", "value")).select(
        F.col("label").cast("int").alias("label"), F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


HASHED = """w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM txt),
hb AS (SELECT id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(md5(word), 9, 2))::BIGINT < 128 THEN 1 ELSE -1 END) AS s FROM w GROUP BY 1, 2)"""


@R.add("batch_embed", f"""
WITH txt AS (SELECT doc_id AS id, text AS t FROM documents), {HASHED}
SELECT txt.id AS doc_id, i AS pos, coalesce(s, 0)::DOUBLE AS value FROM txt CROSS JOIN range(0, 64) r(i) LEFT JOIN hb ON hb.id = txt.id AND b = i""")
def batch_embed(spark, sf):
    e = vc.hash_embed(table(spark, sf, "documents"), "doc_id", "text")
    return e.select("doc_id", F.posexplode("embedding").alias("pos", "v")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("value")
    )


def _hash_model():
    """Plug-in twin of the default encoder."""
    import hashlib
    import re

    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), 64), dtype=np.float32)
        for r, t in enumerate(texts):
            for w in re.split(r"[\W_]+", str(t).lower()):
                if w:
                    h = hashlib.md5(w.encode()).hexdigest()
                    out[r, int(h[:8], 16) % 64] += 1 if int(h[8:10], 16) < 128 else -1
        return out

    return predict


@R.add("batch_embed_model", f"""
WITH txt AS (SELECT p_partkey AS id, p_name AS t FROM part), {HASHED}
SELECT txt.id AS item_id, i AS pos, coalesce(s, 0)::DOUBLE AS value FROM txt CROSS JOIN range(0, 64) r(i) LEFT JOIN hb ON hb.id = txt.id AND b = i""")
def batch_embed_model(spark, sf):
    e = vc.model_embed(items(spark, sf), "title", _hash_model, 64)
    return e.select("item_id", F.posexplode("embedding").alias("pos", "v")).select(
        "item_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("value")
    )


@R.add("all_pairs_score", f"""
WITH {USERVEC} SELECT query_id, count(*) AS n_items, round(sum(list_dot_product(q, v)), 6) AS total, round(max(list_dot_product(q, v)), 6) AS best
FROM uv, emb GROUP BY 1""")
def all_pairs_score(spark, sf):
    q, _ = user_vectors(spark, sf)
    s = vc.score_summary(layout.materialize(q), vectors(spark, sf))
    return s.select("query_id", "n_items", F.round("total", 6).alias("total"), F.round("best", 6).alias("best"))


def ranked_sql(score, way, k=10, extra="", where="NOT EXISTS (SELECT 1 FROM uitems u WHERE u.user_id = s.query_id AND u.item_id = s.item_id)"):
    return f"""s AS (SELECT query_id, item_id, round({score}, 9) AS score FROM uv, emb {extra}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, item_id) AS rank FROM s WHERE {where})
SELECT query_id, item_id, rank, score FROM ranked WHERE rank <= {k}"""


NORMS = "sqrt(list_dot_product(q, q)) + sqrt(list_dot_product(v, v)) - 2 * list_dot_product(q, v)"


def ranked(df):
    return df.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "score")


@R.add("knn_l2", f"WITH {USERVEC}, {ranked_sql(NORMS, 'ASC')}")
def knn_l2(spark, sf):
    q, seen = user_vectors(spark, sf)
    return ranked(vc.rank_catalog(layout.materialize(q), vectors(spark, sf), 10, "l2", seen))


@R.add("knn_l2sq", f"WITH {USERVEC}, {ranked_sql('list_dot_product(q, q) + list_dot_product(v, v) - 2 * list_dot_product(q, v)', 'ASC')}")
def knn_l2sq(spark, sf):
    q, seen = user_vectors(spark, sf)
    return ranked(vc.rank_catalog(layout.materialize(q), vectors(spark, sf), 10, "l2sq", seen))


@R.add("popularity_rescale_join", f"""
WITH {USERVEC}, {POP_SQL}, {ranked_sql(f"CASE WHEN coalesce(coeff, 0) = 0 THEN 'Infinity'::DOUBLE ELSE ({NORMS}) / coeff END", 'ASC', extra='LEFT JOIN pop USING (item_id)')}""")
def popularity_rescale_join(spark, sf):
    q, seen = user_vectors(spark, sf)
    pop = clean.decay_popularity(interactions(spark, sf), THRESHOLD, 30, 0.25)
    its = vectors(spark, sf).join(pop, "item_id", "left").withColumn("coeff", F.coalesce("coeff", F.lit(0.0)))
    return ranked(vc.rank_catalog(layout.materialize(q), its, 10, "l2", seen, rescale=True))


# every user's last three vectors before the test window are its beams
BEAMS = f"""{SEQ}, {EMB}, uitems AS (SELECT user_id, item_id FROM inter WHERE ts < TIMESTAMP '2001-01-01'),
uv AS (SELECT user_id AS query_id, v AS q FROM (
  SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r
  FROM inter JOIN emb USING (item_id) WHERE ts < TIMESTAMP '2001-01-01') WHERE r <= 3)"""


@R.add("knn_cosine", f"""
WITH {BEAMS}, s AS (SELECT query_id, item_id, round(max(list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v))), 9) AS score FROM uv, emb GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s
  WHERE NOT EXISTS (SELECT 1 FROM uitems u WHERE u.user_id = s.query_id AND u.item_id = s.item_id))
SELECT query_id, item_id, rank, score FROM ranked WHERE rank <= 10""")
def knn_cosine(spark, sf):
    past = clean.before(interactions(spark, sf), THRESHOLD)
    beams = vc.last_vectors(past, vectors(spark, sf), 3).withColumnRenamed("user_id", "query_id")
    seen = past.select(F.col("user_id").alias("query_id"), "item_id")
    return ranked(vc.rank_catalog(layout.materialize(beams), vectors(spark, sf), 10, "cosine", seen))


@R.add("catalog_score", f"""WITH {USERVEC}, {ranked_sql('list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v))', 'DESC', k=20)}""")
def catalog_score(spark, sf):
    q, seen = user_vectors(spark, sf)
    q = q.withColumn("vector", vx.l2_normalize("vector", None)).where("vector is not null")
    its = vectors(spark, sf).withColumn("vector", vx.l2_normalize("vector", None))
    return ranked(vc.rank_catalog(layout.materialize(q), its, 20, "dot", seen))


@R.add("catalog_score_pad", f"""WITH {USERVEC}, {ranked_sql('list_dot_product(q, v)', 'DESC', k=20, where='item_id <> 0 AND NOT EXISTS (SELECT 1 FROM uitems u WHERE u.user_id = s.query_id AND u.item_id = s.item_id)')}""")
def catalog_score_pad(spark, sf):
    """Full ranking by products where id 0 is the padding item."""
    q, seen = user_vectors(spark, sf)
    return ranked(vc.rank_catalog(layout.materialize(q), vectors(spark, sf), 20, "dot", seen, pad_id=0))


@R.add("exclude_seen", f"""
WITH {INTER} SELECT DISTINCT user_id, item_id FROM inter a WHERE ts >= TIMESTAMP '2000-01-01'
  AND NOT EXISTS (SELECT 1 FROM inter b WHERE b.user_id = a.user_id AND b.item_id = a.item_id AND b.ts < TIMESTAMP '2000-01-01')""")
def exclude_seen(spark, sf):
    log = interactions(spark, sf)
    new = log.where(F.col("ts") >= clean.ntz("2000-01-01")).select("user_id", "item_id").distinct()
    return vc.exclude_seen(new, clean.before(log, "2000-01-01"))


@R.add("topk_per_query", """
SELECT o_custkey AS user_id, l_partkey AS item_id, quantity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY quantity DESC, l_partkey) AS rank
  FROM (SELECT o_custkey, l_partkey, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE rank <= 5""")
def topk_per_query(spark, sf):
    li, od = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    q = li.join(od, li.l_orderkey == od.o_orderkey).groupBy(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")
    ).agg(F.sum("l_quantity").alias("quantity"))
    return layout.top_k(q, ["user_id"], [F.col("quantity").desc(), "item_id"], 5).withColumn("rank", F.col("rank").cast("long"))


NEGS = f"""{USERVEC}, last AS (SELECT user_id AS query_id, max_by(item_id, {{'t': ts, 'i': item_id}}) AS positive FROM inter JOIN emb USING (item_id)
  WHERE ts < TIMESTAMP '2001-01-01' GROUP BY 1), n AS (SELECT count(*) AS n FROM emb),
pairs AS (SELECT query_id, ('0x' || substr(md5('h#' || query_id || '#' || j), 1, 8))::BIGINT % n AS item_id FROM last, n, range(0, 120) r(j)),
sc AS (SELECT p.query_id, round(list_dot_product(pv.v, nv.v) / sqrt(list_dot_product(pv.v, pv.v)) / sqrt(list_dot_product(nv.v, nv.v)), 9) <= 0.3::DOUBLE AS kept,
  round(list_dot_product(q, nv.v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(nv.v, nv.v)), 9)
  > round(list_dot_product(q, pv.v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(pv.v, pv.v)), 9) AS above
  FROM pairs p JOIN last USING (query_id) JOIN uv USING (query_id) JOIN emb pv ON pv.item_id = positive JOIN emb nv ON nv.item_id = p.item_id),
per AS (SELECT query_id, count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND above) AS above FROM sc GROUP BY 1)"""


@R.add("hard_negative_filter", f"""
WITH {NEGS} SELECT round(avg(kept + 1), 6) AS mean_kept, """ + ", ".join(
    f"round(avg(CASE WHEN above < {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS top{k}_acc" for k in (1, 5, 10, 50, 100)) + " FROM per")
def hard_negative_filter(spark, sf):
    q, _ = user_vectors(spark, sf)
    emb = vectors(spark, sf)
    n = emb.count()
    past = clean.before(interactions(spark, sf), THRESHOLD).join(emb.select("item_id"), "item_id", "left_semi")
    last = past.groupBy(F.col("user_id").alias("anchor_id")).agg(F.max_by("item_id", F.struct("ts", "item_id")).alias("positive"))
    anchors = last.join(q.withColumnRenamed("query_id", "anchor_id"), "anchor_id")
    pairs = last.select("anchor_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("j")).select(
        "anchor_id", (draw_int("h", "anchor_id", "j") % n).alias("item_id")
    )
    r = vc.hard_negative_report(anchors, pairs, emb, 0.3)
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


# codes -----------------------------------------------------------------------


ITERATIONS = 10


def fit_cte():
    """The Lloyd steps of every layer, one materialised table each; ``cb`` is the fitted codebook."""
    parts = [EMB, "f0 AS MATERIALIZED (SELECT item_id AS item_idx, v AS r FROM emb)"]
    near = "arg_min(code, {'d': round(list_dot_product(r, r) + list_dot_product(c, c) - 2 * list_dot_product(r, c), 9), 'code': code})"
    for l in range(LAYERS):
        parts.append(f"""c{l}_0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ('0x' || substr(md5('k0#{l}#' || item_idx), 1, 8))::BIGINT, item_idx) - 1 AS code, r AS c
  FROM f{l} QUALIFY code < {N_CODES})""")
        for i in range(ITERATIONS + 1):
            parts.append(f"a{l}_{i} AS MATERIALIZED (SELECT item_idx, any_value(r) AS r, {near} AS code FROM f{l}, c{l}_{i} GROUP BY 1)")
            if i < ITERATIONS:
                parts.append(f"""c{l}_{i + 1} AS MATERIALIZED (SELECT o.code, coalesce(m.c, o.c) AS c FROM c{l}_{i} o LEFT JOIN (
  SELECT code, list(x ORDER BY p) AS c FROM (SELECT code, p, avg(r[p]) AS x FROM a{l}_{i}, range(1, 65) d(p) GROUP BY 1, 2) GROUP BY 1) m USING (code))""")
        parts.append(f"f{l + 1} AS MATERIALIZED (SELECT item_idx, {sub_sql('r', 'c')} AS r FROM a{l}_{ITERATIONS} JOIN c{l}_{ITERATIONS} USING (code))")
    parts.append("cb AS (" + " UNION ALL ".join(f"SELECT {l} AS layer, code, c FROM c{l}_{ITERATIONS}" for l in range(LAYERS)) + ")")
    joins = " ".join(f"JOIN a{l}_{ITERATIONS} a{l} USING (item_idx)" for l in range(1, LAYERS))
    parts.append(
        f"codes AS MATERIALIZED (SELECT a0.item_idx, [" + ", ".join(f"a{l}.code" for l in range(LAYERS)) + f"]::INTEGER[] AS codes FROM a0_{ITERATIONS} a0 {joins})"
    )
    return ", ".join(parts)


FITTED = fit_cte()
# the chain after the fit is that of the fixed codebook
FITTED_REPAIRED = REPAIRED.replace(CODES, FITTED)


def coded_items(spark, sf):
    return vectors(spark, sf).withColumnRenamed("item_id", "item_idx")


def fitted_codebook(spark, sf):
    """Fits the codebook on the catalogue and writes it as a table that later steps read."""
    book = cd.fit_residual_codebooks(coded_items(spark, sf), LAYERS, N_CODES, ITERATIONS, 0)
    path = files.fresh_path(spark, "codebook")
    book.write.parquet(path)
    return spark.read.schema(book.schema).parquet(path)


@R.add("fit_residual_codebooks", f"WITH {FITTED} SELECT layer, code::INTEGER AS code, round(sqrt(list_dot_product(c, c)), 6) AS length FROM cb")
def fit_residual_codebooks(spark, sf):
    return fitted_codebook(spark, sf).select("layer", "code", F.round(vx.norm("centroid"), 6).alias("length"))


@R.add("fitted_code_report", f"""
WITH {FITTED}, per AS ({" UNION ALL ".join(f"SELECT {l} AS layer, a.code, count(*) AS n, sum(list_dot_product(f.r, f.r) / 64) AS d FROM a{l}_{ITERATIONS} a JOIN f{l + 1} f USING (item_idx) GROUP BY 2" for l in range(LAYERS))})
SELECT layer::BIGINT AS layer, (SELECT count(*) FROM cb WHERE cb.layer = per.layer) AS codes, sum(n)::BIGINT AS items, count(*) AS used, max(n) AS largest,
  sum(n)::BIGINT AS nearest, round(sum(d) / sum(n), 6) AS loss, sum(d) / sum(n) <= coalesce(lag(sum(d) / sum(n)) OVER (ORDER BY layer), 'Infinity'::DOUBLE) AS not_rising
FROM per GROUP BY layer""")
def fitted_code_report(spark, sf):
    r = layout.materialize(cd.codebook_report(coded_items(spark, sf), fitted_codebook(spark, sf)))
    before = r.select((F.col("layer") + 1).alias("layer"), F.col("loss").alias("before"))
    judged = r.join(before, "layer", "left").withColumn("not_rising", F.coalesce(F.col("loss") <= F.col("before"), F.lit(True)))
    return judged.drop("before").withColumn("loss", F.round("loss", 6))


@R.add("fitted_sem_id", f"WITH {FITTED_REPAIRED} SELECT item_idx, array_to_string(codes, ',') AS codes, sem_id FROM repaired")
def fitted_sem_id(spark, sf):
    """The whole chain: fit, encode, repair collisions, write as text."""
    book = fitted_codebook(spark, sf)
    fixed = cd.resolve_collisions(cd.residual_encode(coded_items(spark, sf), book), cd.code_neighbors(book))
    return fixed.select("item_idx", joined("codes").alias("codes"), cx.format_sem_id("codes").alias("sem_id"))


@R.add("residual_encode", f"WITH {CODES} SELECT item_idx, array_to_string(codes, ',') AS codes FROM codes")
def residual_encode(spark, sf):
    return encoded(spark, sf).select("item_idx", joined("codes").alias("codes"))


@R.add("quantization_error", f"WITH {CODES} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS layer, round(avg(list_dot_product(r, r) / 64), 6) AS loss FROM r{i + 1}" for i in range(LAYERS)))
def quantization_error(spark, sf):
    q = cd.quantization_error(encoded(spark, sf, True), 64)
    return q.select("layer", F.round("loss", 6).alias("loss"))


@R.add("code_neighbors", f"WITH {CB}, {NEAR} SELECT code, array_to_string(nb, ',') AS neighbors FROM near")
def code_neighbors(spark, sf):
    n = cd.code_neighbors(codebook(spark, sf))
    return n.select(F.col("code").cast("long").alias("code"), joined("neighbors").alias("neighbors"))


@R.add("max_cluster_size", f"""
WITH {CODES}, p AS (SELECT codes[1:3] AS prefix, count(*) AS n FROM codes GROUP BY 1), f AS (SELECT codes, count(*) AS n FROM codes GROUP BY 1)
SELECT (SELECT max(n) FROM p) AS max_cluster_size, CAST((SELECT coalesce(sum(n), 0) FROM f WHERE n > 1) AS BIGINT) AS colliding_items,
  (SELECT count(*) FROM codes) AS items""")
def max_cluster_size(spark, sf):
    return cd.collision_report(encoded(spark, sf), 3)


@R.add("resolve_collisions", f"WITH {REPAIRED} SELECT item_idx, array_to_string(codes, ',') AS codes FROM repaired")
def resolve_collisions(spark, sf):
    return repaired(spark, sf).select("item_idx", joined("codes").alias("codes"))


@R.add("unresolved_collisions", f"""
WITH {REPAIRED}, f AS (SELECT codes, count(*) AS n FROM repaired GROUP BY 1), p AS (SELECT codes[1:3] AS prefix, count(*) AS n FROM repaired GROUP BY 1)
SELECT (SELECT max(n) FROM p) AS max_cluster_size, CAST((SELECT coalesce(sum(n), 0) FROM f WHERE n > 1) AS BIGINT) AS colliding_items,
  (SELECT count(*) FROM repaired) AS items""")
def unresolved_collisions(spark, sf):
    return cd.collision_report(repaired(spark, sf), 3)


@R.add("format_sem_id", f"""
WITH {CODES} SELECT item_idx, '<a_' || codes[1] || '><b_' || codes[2] || '><c_' || codes[3] || '><d_' || codes[4] || '>' AS sem_id FROM codes""")
def format_sem_id(spark, sf):
    return encoded(spark, sf).select("item_idx", cx.format_sem_id("codes").alias("sem_id"))


@R.add("attach_sem_id", f"""
WITH {REPAIRED}, {ITEMS} SELECT items.item_id, title, sem_id FROM items LEFT JOIN repaired USING (item_idx)""")
def attach_sem_id(spark, sf):
    r = repaired(spark, sf).select("item_idx", "sem_id")
    return items(spark, sf).join(r, "item_idx", "left").select("item_id", "title", F.trim("sem_id").alias("sem_id"))


# texts that carry codes of neighbouring layers, out-of-range codes and repeats
CODE_TEXT = """txt AS (SELECT vec_id, 'item <a_' || vec_id % 20 || '> and <b_' || vec_id % 300 || '><d_' || label || '> <e_1> <a_' || (vec_id * 7) % 16 || '>' AS t FROM embeddings)"""


def code_text(spark, sf):
    v, label = F.col("vec_id"), F.col("label").cast("string")
    s = lambda c: c.cast("string")
    t = F.concat(
        F.lit("item <a_"), s(v % 20), F.lit("> and <b_"), s(v % 300), F.lit("><d_"), label, F.lit("> <e_1> <a_"), s((v * 7) % 16), F.lit(">")
    )
    return table(spark, sf, "embeddings").select("vec_id", t.alias("t"))


PARSED = f"""{CODE_TEXT}, parsed AS (SELECT vec_id, [(vec_id * 7) % 16, CASE WHEN vec_id % 300 < 16 THEN vec_id % 300 ELSE -1 END, -1,
  (SELECT CASE WHEN label < 16 THEN label ELSE -1 END FROM embeddings e WHERE e.vec_id = txt.vec_id)] AS codes FROM txt)"""


@R.add("parse_sem_id", f"WITH {PARSED} SELECT vec_id, array_to_string(codes, ',') AS codes FROM parsed")
def parse_sem_id(spark, sf):
    return code_text(spark, sf).select("vec_id", joined(cx.parse_sem_id("t", LAYERS, N_CODES)).alias("codes"))


@R.add("decode_sem_id", f"""
WITH {PARSED}, {CB}, hit AS (SELECT vec_id, c FROM parsed, range(0, 4) r(l) LEFT JOIN cb ON layer = l AND code = codes[l + 1])
SELECT vec_id, i - 1 AS pos, round(sum(coalesce(c[i], 0)), 6) AS value FROM hit, range(1, 65) d(i) GROUP BY 1, 2""")
def decode_sem_id(spark, sf):
    p = code_text(spark, sf).withColumn("codes", cx.parse_sem_id("t", LAYERS, N_CODES))
    v = cd.decode_codes(p, codebook(spark, sf), n_layers=LAYERS)
    return v.select("vec_id", F.posexplode("vector").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")
    )


@R.add("code_token_map", f"""
WITH {CODES} SELECT item_idx, l AS layer, codes[l + 1]::BIGINT AS code, 151669 + l * 16 + codes[l + 1] AS token,
  '<' || chr((97 + l)::INTEGER) || '_' || codes[l + 1] || '>' AS content FROM codes, range(0, 4) r(l)""")
def code_token_map(spark, sf):
    c = encoded(spark, sf).select("item_idx", F.posexplode("codes").alias("l", "c"))
    c = c.withColumn("token", cx.code_to_token("l", "c", layer_size=N_CODES))
    back = cx.token_to_code("token", layer_size=N_CODES)
    return c.select("item_idx", back["layer"].alias("layer"), back["code"].alias("code"), "token").withColumn(
        "content", F.concat(F.lit("<"), F.char(F.col("layer").cast("int") + 97), F.lit("_"), F.col("code").cast("string"), F.lit(">"))
    )


@R.add("code_vocabulary", f"""
WITH {CODES}, used AS (SELECT l, codes[l + 1] AS c, count(*) AS n FROM codes, range(0, 4) r(l) GROUP BY 1, 2)
SELECT 151669 + l.l * 16 + c.c AS id, '<' || chr((97 + l.l)::INTEGER) || '_' || c.c || '>' AS content, coalesce(n, 0) AS items
FROM range(0, 4) l(l) CROSS JOIN range(0, 16) c(c) LEFT JOIN used ON used.l = l.l AND used.c = c.c""")
def code_vocabulary(spark, sf):
    return cd.code_vocabulary(encoded(spark, sf), layer_size=N_CODES)


# prompts: two text tokens, then the first codes of the item; every seventh is off the catalogue
TOKENS = f"""{REPAIRED}, toks AS (SELECT item_idx, list_concat([11, 151000 + item_idx]::BIGINT[],
  [151669 + l * 16 + CASE WHEN item_idx % 7 = 0 AND l + 1 = item_idx % 5 THEN (codes[l + 1] + 5) % 16 ELSE codes[l + 1] END FOR l IN range(0, item_idx % 5)]) AS tokens FROM repaired)"""


def token_lists(spark, sf):
    n = (F.col("item_idx") % 5).cast("int")
    off = (F.col("item_idx") % 7 == 0)
    toks = F.transform(
        F.slice("codes", F.lit(1), n),
        lambda c, i: cx.code_to_token(i, F.when(off & (i + 1 == n), (c + 5) % N_CODES).otherwise(c), layer_size=N_CODES),
    )
    head = F.array(F.lit(11).cast("long"), (F.col("item_idx") + 151000).cast("long"))
    codes = repaired(spark, sf)
    return codes.select("item_idx", F.concat(head, toks).alias("tokens")), codes


@R.add("rq_tail", f"""
WITH {TOKENS} SELECT item_idx, array_to_string(list_filter(tokens, lambda t: t >= 151669), ',') AS tail FROM toks""")
def rq_tail(spark, sf):
    t, _ = token_lists(spark, sf)
    return t.select("item_idx", joined(cx.code_tail("tokens", layer_size=N_CODES)).alias("tail"))


PREFIXES = """steps AS (SELECT l AS level, codes[1:l] AS prefix, codes[l + 1] AS nxt FROM repaired, range(0, 4) r(l)),
prefixes AS MATERIALIZED (SELECT level, prefix, list(DISTINCT nxt ORDER BY nxt) AS nexts FROM steps GROUP BY 1, 2)"""


@R.add("prefix_table", f"""WITH {REPAIRED}, {PREFIXES}
SELECT level, array_to_string(prefix, ',') AS prefix, array_to_string(nexts, ',') AS next_codes FROM prefixes""")
def prefix_table(spark, sf):
    p = cd.prefix_table(repaired(spark, sf), LAYERS)
    return p.select(F.col("level").cast("long").alias("level"), joined("prefix").alias("prefix"), joined("next_codes").alias("next_codes"))


@R.add("legal_next", f"""
WITH {TOKENS}, {PREFIXES}, t AS (SELECT item_idx, list_filter(tokens, lambda t: t >= 151669) AS tail FROM toks),
c AS (SELECT item_idx, [(tail[i + 1] - 151669 - i * 16)::INTEGER FOR i IN range(0, len(tail))] AS code, len(tail) AS n FROM t),
w AS (SELECT item_idx, n, nexts, EXISTS (SELECT 1 FROM repaired r WHERE r.codes = code) AS whole FROM c LEFT JOIN prefixes ON level = n AND prefix = code),
f AS (SELECT item_idx, CASE WHEN n = 4 AND whole THEN 4 WHEN n BETWEEN 1 AND 3 AND nexts IS NOT NULL THEN n ELSE 0 END AS pos,
  CASE WHEN n BETWEEN 1 AND 3 AND nexts IS NOT NULL THEN nexts ELSE (SELECT nexts FROM prefixes WHERE level = 0) END AS legal FROM w)
SELECT item_idx, pos, CASE WHEN pos = 4 THEN '2' ELSE array_to_string([151669 + pos * 16 + x FOR x IN legal], ',') END AS legal FROM f""")
def legal_next(spark, sf):
    t, codes = token_lists(spark, sf)
    n = cd.legal_next(t, cd.prefix_table(codes, LAYERS), eos=2, n_layers=LAYERS, layer_size=N_CODES)
    return n.select("item_idx", F.col("pos").cast("long").alias("pos"), joined("legal_tokens").alias("legal"))


BEAM_W = 5
def scored(asked=""):
    """Prefixes and log-scores of the queries, which ``asked`` may restrict."""
    return f"""{REPAIRED}, {PREFIXES}, qv AS MATERIALIZED (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings {asked}),
lp AS MATERIALIZED (SELECT query_id, layer, code, -list_distance(q, c) AS logp FROM qv, cb)"""


def beam_sql():
    parts = ["b0 AS (SELECT query_id, []::INTEGER[] AS prefix, 0.0::DOUBLE AS score FROM qv)"]
    for l in range(LAYERS):
        parts.append(f"""g{l} AS MATERIALIZED (SELECT b.query_id, list_append(b.prefix, x.nxt) AS prefix, b.score + logp AS score
  FROM b{l} b JOIN (SELECT prefix, unnest(nexts) AS nxt FROM prefixes WHERE level = {l}) x ON x.prefix = b.prefix
  JOIN lp ON lp.query_id = b.query_id AND lp.layer = {l} AND lp.code = x.nxt)""")
        parts.append(f"""b{l + 1} AS MATERIALIZED (SELECT query_id, prefix, score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY round(score, 9) DESC, prefix) AS rank FROM g{l}) WHERE rank <= {BEAM_W})""")
    return ", ".join(parts)


BEAM = f"{scored()}, {beam_sql()}"


def beam_scores(spark, sf, asked=None):
    """Log-scores per query and layer: minus the distance to every centroid of the layer.

    Only for the queries of ``asked``, ``(query_id)``, where that is given.
    """
    q = vectors(spark, sf).select(F.col("item_id").alias("query_id"), "vector")
    if asked is not None:
        q = q.join(asked, "query_id", "left_semi")
    # one row: a codebook whose size is a parameter
    layers = codebook(spark, sf).groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("b"))
    book = layers.agg(F.sort_array(F.collect_list(F.struct("layer", "b")))["b"].alias("book"))
    one = F.explode(F.array(F.lit(1)))
    rows = q.withColumn("_one", one).join(F.broadcast(book.withColumn("_one", one)), "_one")
    logp = F.transform("book", lambda b: F.transform(b, lambda c: -vx.norm(vx.subtract(c["centroid"], F.col("vector")))))
    return rows.select("query_id", logp.alias("logp"))


def beams(spark, sf, codes, asked=None):
    return cd.constrained_beam(beam_scores(spark, sf, asked), cd.prefix_table(codes, LAYERS), BEAM_W, LAYERS)


@R.add("constrained_beam", f"WITH {BEAM} SELECT query_id, rank, array_to_string(prefix, ',') AS codes, round(score, 6) AS score FROM b4")
def constrained_beam(spark, sf):
    b = beams(spark, sf, repaired(spark, sf))
    return b.select("query_id", F.col("rank").cast("long").alias("rank"), joined("codes").alias("codes"), F.round("score", 6).alias("score"))
