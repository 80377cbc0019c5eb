"""Registered queries: merging of checkpoint tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recquarry.operators import layout, merge as mg
from recquarry.plans.bindings import Registry, table
from recquarry.sources import files

R = Registry()
MODELS = ["target", "source"]
STEPS = ["base", "source", "target"]


def checkpoints(spark, sf):
    """Three aligned models: the vectors themselves and the vectors one and seven ids on."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    base = e.select(F.lit("base").alias("model"), F.concat(F.lit("layer_"), "label").alias("param"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("values"))
    parts = base
    for name, shift in (("source", 1), ("target", 7)):
        moved = e.select(((F.col("vec_id") - shift + n) % n).alias("chunk"), F.col("embedding").alias("values"))
        keys = base.select("param", "chunk")
        parts = parts.unionByName(moved.join(keys, "chunk").select(F.lit(name).alias("model"), "param", "chunk", "values"))
    return parts


# long form: one row per value
P = """n AS (SELECT count(*) AS n FROM embeddings),
p AS (SELECT 'layer_' || a.label AS param, a.vec_id AS chunk, i - 1 AS pos, a.embedding[i]::DOUBLE AS base, s.embedding[i]::DOUBLE AS source, t.embedding[i]::DOUBLE AS target
  FROM embeddings a, n, range(1, 65) r(i), embeddings s, embeddings t WHERE s.vec_id = (a.vec_id + 1) % n AND t.vec_id = (a.vec_id + 7) % n)"""


def long(df):
    return df.select("param", "chunk", F.posexplode("values").alias("pos", "v")).select(
        "param", "chunk", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value")
    )


def out_sql(expr, source="p", extra=""):
    return f"SELECT param, chunk, pos, round({expr}, 6) AS value FROM {source} {extra}"


def add(name, expr, fn, extra=""):
    R.add(name, f"WITH {P} {out_sql(expr, extra=extra)}")(lambda spark, sf: long(fn(checkpoints(spark, sf))))


@R.add("checkpoint_table", f"""
WITH {P} SELECT 'base' AS model, param, chunk, pos, base AS value FROM p UNION ALL SELECT 'source', param, chunk, pos, source FROM p
UNION ALL SELECT 'target', param, chunk, pos, target FROM p""")
def checkpoint_table(spark, sf):
    path = files.fresh_path(spark, "checkpoints")
    files.write_checkpoint(checkpoints(spark, sf), path)
    c = files.read_checkpoints(spark, path, STEPS)
    return c.select("model", "param", "chunk", F.posexplode("values").alias("pos", "v")).select(
        "model", "param", "chunk", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("value")
    )


@R.add("exclude_params", """
SELECT 'layer_' || label AS param, count(*) AS chunks FROM embeddings WHERE NOT ('layer_' || label LIKE 'layer_1%' OR 'layer_' || label = 'layer_3') GROUP BY 1""")
def exclude_params(spark, sf):
    base = mg.model_rows(checkpoints(spark, sf), "base")
    kept = mg.exclude_params(base, ["layer_1", "yer_2", "layer_3$"])
    return kept.groupBy("param").agg(F.count(F.lit(1)).alias("chunks"))


@R.add("param_align", f"""
WITH {P} SELECT param, chunk, count(*) AS n, round(sum(base * source + source * target), 6) AS mix FROM p GROUP BY 1, 2""")
def param_align(spark, sf):
    a = mg.align(checkpoints(spark, sf), STEPS)
    cell = F.zip_with(mg.of("base"), mg.of("source"), lambda x, y: x * y)
    cell2 = F.zip_with(mg.of("source"), mg.of("target"), lambda x, y: x * y)
    total = F.aggregate(F.concat(cell, cell2), F.lit(0.0), lambda s, x: s + x)
    return a.select("param", "chunk", F.size(cell).cast("long").alias("n"), F.round(total, 6).alias("mix"))


@R.add("missing_params", """
SELECT 'target' AS model, 'layer_' || label AS param FROM embeddings GROUP BY label HAVING label % 3 = 0""")
def missing_params(spark, sf):
    c = checkpoints(spark, sf).where("model <> 'target' OR cast(substring(param, 7) AS int) % 3 <> 0")
    return mg.missing_params(c, STEPS)


def _override(c):
    return mg.override(mg.model_rows(c, "base"), mg.model_rows(c, "source").where("param < 'layer_4'"))


add("param_override", "CASE WHEN param < 'layer_4' THEN source ELSE base END", _override)
add(
    "retain_prefix", "CASE WHEN param LIKE 'layer\\_1%' ESCAPE '\\' THEN source ELSE base END",
    lambda c: mg.retain_prefix(mg.model_rows(c, "base"), mg.model_rows(c, "source"), "layer_1"),
)
# token rows are 16 values wide here; rows from 1002 on of two tensors come from the source
add(
    "retain_sem_id_rows",
    "CASE WHEN param IN ('layer_1', 'layer_2') AND (chunk * 64 + pos) // 16 >= 1002 THEN source ELSE target END",
    lambda c: mg.retain_rows(mg.model_rows(c, "target"), mg.model_rows(c, "source"), 16, 64, 1002, ["layer_1", "layer_2"]),
)
add("average_merge", "(source + target) / 2", lambda c: mg.average_merge(c, MODELS))
add("task_vector", "target - base", lambda c: mg.task_vector(c, "base", "target"))
add(
    "task_vector_add", "(target - base) + (source - base)",
    lambda c: mg.add_vectors(mg.task_vector(c, "base", "target"), mg.task_vector(c, "base", "source")),
)
add("task_vector_mul", "(target - base) * 0.3::DOUBLE", lambda c: mg.multiply_vector(mg.task_vector(c, "base", "target"), 0.3))
add(
    "task_vector_hadamard", "(target - base) * (source - base)",
    lambda c: mg.multiply_vector(mg.task_vector(c, "base", "target"), mg.task_vector(c, "base", "source")),
)
add(
    "apply_task_vector", "base + 0.7::DOUBLE * (target - base)",
    lambda c: mg.apply_vector(mg.model_rows(c, "base"), mg.task_vector(c, "base", "target", ["layer_2"]), 0.7),
    "WHERE param NOT LIKE 'layer\\_2%' ESCAPE '\\'",
)
add("extrapolate_linear", "target + 0.4::DOUBLE * (target - source)", lambda c: mg.extrapolate_linear(c, STEPS, 0.4))
add(
    "extrapolate_moving_average", "target + 0.4::DOUBLE * ((target - source) + (source - base)) / 2",
    lambda c: mg.extrapolate_moving_average(c, STEPS, 0.4),
)
add(
    "extrapolate_acceleration", "target + (target - source) + 0.5::DOUBLE * ((target - source) - (source - base))",
    lambda c: mg.extrapolate_acceleration(c, STEPS),
)
add(
    "fuse_exponential_decay", "base + (0.8::DOUBLE * (source - base) + (target - base)) / 1.8::DOUBLE",
    lambda c: mg.fuse_decay(c, "base", ["source", "target"]),
)
add("task_arithmetic_merge", "target + 0.05::DOUBLE * (target - source)", lambda c: mg.task_arithmetic_merge(c, "base", MODELS))

TIES = f"""{P}, sc AS (SELECT *, (target - base) * 0.6::DOUBLE AS a, (source - base) * 0.4::DOUBLE AS b FROM p),
k AS (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS k FROM sc),
ta AS (SELECT abs(a) AS t FROM (SELECT a, row_number() OVER (ORDER BY abs(a)) AS r FROM sc), k WHERE r = k),
tb AS (SELECT abs(b) AS t FROM (SELECT b, row_number() OVER (ORDER BY abs(b)) AS r FROM sc), k WHERE r = k),
tr AS (SELECT param, chunk, pos, base, CASE WHEN abs(a) >= ta.t THEN a ELSE 0 END AS a, CASE WHEN abs(b) >= tb.t THEN b ELSE 0 END AS b FROM sc, ta, tb),
mj AS (SELECT sign(sum(sign(a + b))) AS major FROM tr),
sg AS (SELECT tr.*, CASE WHEN a + b = 0 THEN major ELSE sign(a + b) END AS sgn FROM tr, mj),
kp AS (SELECT *, CASE WHEN a * sgn > 0 THEN a ELSE 0 END AS ka, CASE WHEN b * sgn > 0 THEN b ELSE 0 END AS kb FROM sg),
ties AS (SELECT *, base + CASE WHEN ka <> 0 AND kb <> 0 THEN (ka + kb) / 2 ELSE ka + kb END AS value FROM kp)"""


@R.add("ties_trim", f"WITH {TIES} SELECT param, chunk, pos, round(a, 6) AS a, round(b, 6) AS b FROM tr")
def ties_trim(spark, sf):
    t = mg.ties_trimmed(checkpoints(spark, sf), "base", MODELS, 0.8, 0.4)
    return t.select("param", "chunk", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "v")).select(
        "param", "chunk", F.col("pos").cast("long").alias("pos"), F.round("v.a", 6).alias("a"), F.round("v.b", 6).alias("b")
    )


@R.add("ties_elect_sign", f"WITH {TIES} SELECT param, chunk, pos, sgn::DOUBLE AS value FROM sg")
def ties_elect_sign(spark, sf):
    t = mg.elect_signs(mg.ties_trimmed(checkpoints(spark, sf), "base", MODELS, 0.8, 0.4))
    return long(t.select("param", "chunk", F.col("sign").alias("values")))


@R.add("ties_merge", f"WITH {TIES} SELECT param, chunk, pos, round(value, 6) AS value FROM ties")
def ties_merge(spark, sf):
    return long(mg.ties_merge(checkpoints(spark, sf), "base", MODELS, source_coeff=0.4))


def rnd(seed):
    return f"('0x' || substr(md5('{seed}#' || param || '#' || (chunk * 64 + pos)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


add(
    "mask_random", f"CASE WHEN {rnd('m')} < 0.25 THEN 0 ELSE (target - base) / 0.75::DOUBLE END",
    lambda c: mg.mask_random(mg.task_vector(c, "base", "target"), 0.25, True, "m"),
)
KTH = """k AS (SELECT param, CAST(floor(count(*) * {rate}::DOUBLE) AS BIGINT) AS k FROM p GROUP BY 1),
kth AS (SELECT r.param, r.m AS kth FROM (SELECT param, abs({v}) AS m, row_number() OVER (PARTITION BY param ORDER BY abs({v})) AS r FROM p) r JOIN k ON k.param = r.param AND r.r = k.k)"""


@R.add("mask_magnitude", f"""WITH {P}, {KTH.format(rate=0.3, v='target - base')}
SELECT p.param, chunk, pos, round(CASE WHEN abs(target - base) <= kth THEN 0 ELSE (target - base) / 0.7::DOUBLE END, 6) AS value FROM p JOIN kth USING (param)""")
def mask_magnitude(spark, sf):
    v = layout.materialize(mg.task_vector(checkpoints(spark, sf), "base", "target"))
    return long(mg.mask_magnitude(v, 0.3))


@R.add("mask_weights", f"""WITH {P}, {KTH.format(rate=0.3, v='target')}
SELECT 'delta' AS kind, param, chunk, pos, round(base + CASE WHEN {rnd('0#target')} < 0.2 THEN 0 ELSE (target - base) / 0.8::DOUBLE END, 6) AS value FROM p
UNION ALL SELECT 'weight', p.param, chunk, pos, round(CASE WHEN abs(target) <= kth THEN 0 ELSE target END, 6) FROM p JOIN kth USING (param)""")
def mask_weights(spark, sf):
    c = checkpoints(spark, sf)
    a = long(mg.mask_weights(c, "base", "target", 0.2)).withColumn("kind", F.lit("delta"))
    b = long(mg.mask_weights(c, "base", "target", 0.3, "finetuned_weight", "magnitude", False)).withColumn("kind", F.lit("weight"))
    return a.unionByName(b)


MASKED = f"""{P.replace("p AS (", "raw AS (")}, p AS (SELECT param, chunk, pos, base,
  base + CASE WHEN {rnd('0#target')} < 0.1 THEN 0 ELSE (target - base) / 0.9::DOUBLE END AS target,
  base + CASE WHEN {rnd('0#source')} < 0.1 THEN 0 ELSE (source - base) / 0.9::DOUBLE END AS source FROM raw)"""


@R.add("mask_merge", f"WITH {TIES.replace(P, MASKED).replace('0.6::DOUBLE', '0.5::DOUBLE').replace('0.4::DOUBLE', '0.5::DOUBLE')} SELECT param, chunk, pos, round(value, 6) AS value FROM ties")
def mask_merge(spark, sf):
    return long(mg.mask_merge(checkpoints(spark, sf), "base", MODELS))


@R.add("mask_merge_stored", f"WITH {TIES.replace(P, MASKED).replace('0.6::DOUBLE', '0.5::DOUBLE').replace('0.4::DOUBLE', '0.5::DOUBLE')} SELECT param, chunk, pos, round(value, 6) AS value FROM ties")
def mask_merge_stored(spark, sf):
    """The same over a table bucketed by chunk, where the models need no shuffle."""
    store = files.store_checkpoints(checkpoints(spark, sf), f"checkpoints_{uuid.uuid4().hex}", 8)
    return long(mg.mask_merge(store, "base", MODELS))


R.add("mask_merge_average", f"WITH {MASKED} {out_sql('(source + target) / 2')}")(
    lambda spark, sf: long(mg.mask_merge(checkpoints(spark, sf), "base", MODELS, method="average_merging"))
)


@R.add("merge_models", f"""WITH {P}
SELECT 'average' AS run, param, chunk, pos, round(CASE WHEN param IN ('layer_1', 'layer_2') AND (chunk * 64 + pos) // 16 >= 1002 OR param = 'layer_5' THEN source ELSE (source + target) / 2 END, 6) AS value FROM p
UNION ALL SELECT 'arithmetic', param, chunk, pos, round(target + 0.05::DOUBLE * (target - source), 6) FROM p""")
def merge_models(spark, sf):
    c = checkpoints(spark, sf)
    a = mg.merge_models(
        c, "base", "source", ["target"], "average_merging", "sem_id", 16, 64, 1002, ["layer_1", "layer_2"], exclude=["layer_5$"]
    )
    b = mg.merge_models(c, "base", "source", ["target"], "task_arithmetic")
    return long(a).withColumn("run", F.lit("average")).unionByName(long(b).withColumn("run", F.lit("arithmetic")))


@R.add("merge_grid", """
WITH g AS (SELECT a.n_name AS source, b.n_name AS target, s AS split, m AS method FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25,
  (VALUES ('pretrain'), ('phase1')) x(s), (VALUES ('ties_merging'), ('average_merging')) y(m))
SELECT source, split, method, 'merged-' || substr(source, 1, 3) || '-' || substr(target, 1, 3) || '-' || split || '-sem_id-' || substr(method, 1, 4) || '-sca=1.0' AS name,
  'merged-' || substr(source, 1, 3) || '-pretrain' || 'phase1-title-' || substr(method, 1, 4) AS span_name,
  '/ckpt/' || source || '-' || split || '-sem_id/epoch_' || CASE WHEN split = 'pretrain' THEN '2' ELSE '1' END AS path FROM g""")
def merge_grid(spark, sf):
    n = table(spark, sf, "nation")
    other = n.select(((F.col("n_nationkey") + 24) % 25).alias("n_nationkey"), F.col("n_name").alias("target"))
    g = n.join(other, "n_nationkey").select(
        F.col("n_name").alias("source"), "target", F.explode(F.array(F.lit("pretrain"), F.lit("phase1"))).alias("split")
    )
    g = g.withColumn("method", F.explode(F.array(F.lit("ties_merging"), F.lit("average_merging"))))
    args = F.create_map(F.lit("scaling_coefficient"), F.lit("1.0"))
    one = F.array("target")
    return g.select(
        "source", "split", "method",
        mg.merged_name(F.lit("sem_id"), F.col("source"), one, F.array("split"), F.col("method"), args).alias("name"),
        mg.merged_name(F.lit("title"), F.col("source"), one, F.array(F.lit("pretrain"), F.lit("phase1")), F.col("method")).alias("span_name"),
        mg.checkpoint_path("/ckpt", F.col("source"), F.col("split"), "sem_id").alias("path"),
    )
