"""Merging of model checkpoints held as parameter tables.

A checkpoint table has rows ``(model, param, chunk, values)``; ``values`` is a slice of
the flattened parameter and ``chunk`` its number, cut alike in every model.  All models
of a chunk are brought together by one shuffle (``align``); after that the methods are
row-local arithmetic on arrays, plus a few scalars from global aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.functions import vectors as vx
from recquarry.functions.arrays import let
from recquarry.functions.draws import draw_unit
from recquarry.operators.layout import broadcast_if_small, kth_smallest_magnitude, materialize

# First code token row and the tensors that carry token rows.
CODE_ROW_START = 151669
TOKEN_TENSORS = ("lm_head.weight", "model.embed_tokens.weight")
KEY = ["param", "chunk"]


def exclude_params(df: DataFrame, patterns: Sequence[str] | None, column: str = "param") -> DataFrame:
    """Drop parameters whose name matches a pattern from its beginning."""
    if not patterns:
        return df
    return df.where(~reduce(lambda a, b: a | b, [F.col(column).rlike(f"^(?:{p})") for p in patterns]))


def align(ckpt: DataFrame, models: Sequence[str], exclude: Sequence[str] | None = None) -> DataFrame:
    """One row per chunk with a map from model to values; one entry per model at most."""
    rows = exclude_params(ckpt.where(F.col("model").isin(list(models))), exclude)
    pairs = F.collect_list(F.struct("model", F.col("values").cast("array<double>").alias("values")))
    return rows.groupBy(*KEY).agg(F.map_from_entries(pairs).alias("m"))


def of(model: str) -> Column:
    """Values of one model in an aligned row; a missing parameter is an error."""
    v = F.try_element_at(F.col("m"), F.lit(model))
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"model {model} lacks parameter "), F.col("param")))).otherwise(v)


def _result(df: DataFrame, values: Column) -> DataFrame:
    return df.select(*KEY, values.alias("values"))


def model_rows(ckpt: DataFrame, model: str) -> DataFrame:
    return ckpt.where(F.col("model") == model).select(*KEY, F.col("values").cast("array<double>").alias("values"))


def missing_params(ckpt: DataFrame, models: Sequence[str]) -> DataFrame:
    """Parameters that some model lacks: ``(model, param)``."""
    names = ckpt.where(F.col("model").isin(list(models))).select("model", "param").distinct()
    expected = names.select("param").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return expected.join(names, ["model", "param"], "left_anti").select("model", "param")


def override(model: DataFrame, params: DataFrame) -> DataFrame:
    """A model with the given parameters copied over its own."""
    new = params.select(*KEY, F.col("values").alias("_new"))
    return _result(model.join(new, KEY, "left"), F.coalesce("_new", "values"))


def retain_prefix(model: DataFrame, source: DataFrame, prefix: str) -> DataFrame:
    """All parameters whose name starts with ``prefix`` come from ``source``."""
    return override(model, source.where(F.col("param").startswith(prefix)))


def retain_rows(
    model: DataFrame,
    source: DataFrame,
    width: int,
    chunk_size: int,
    start_row: int = CODE_ROW_START,
    params: Sequence[str] = TOKEN_TENSORS,
) -> DataFrame:
    """Rows from ``start_row`` on of the named tensors come from ``source``.

    Only chunks of those tensors that reach the first such row are joined.
    """
    first = start_row * width
    reach = F.col("param").isin(list(params)) & ((F.col("chunk") + 1) * chunk_size > first)
    new = source.where(reach).select(*KEY, F.col("values").alias("_new"))
    mixed = F.zip_with(
        F.transform(F.col("values"), lambda v, i: F.struct(v.alias("v"), (F.col("chunk") * chunk_size + i).alias("i"))),
        F.col("_new"),
        lambda old, n: F.when(old["i"] >= first, n).otherwise(old["v"]),
    )
    return _result(model.join(new, KEY, "left"), F.when(F.col("_new").isNotNull(), mixed).otherwise(F.col("values")))


# combining whole models -------------------------------------------------------


def _mean(arrays: Column) -> Column:
    """Element-wise mean of an array of arrays."""
    total = F.aggregate(
        F.slice(arrays, F.lit(2), F.size(arrays)), F.get(arrays, F.lit(0)), lambda acc, x: vx.add(acc, x)
    )
    return let(F.size(arrays).cast("double"), lambda n: F.transform(total, lambda x: x / n))


def average_merge(ckpt: DataFrame, models: Sequence[str], exclude: Sequence[str] | None = None) -> DataFrame:
    """Mean over the models that have the parameter."""
    return _result(align(ckpt, models, exclude), _mean(F.map_values("m")))


def task_vector(ckpt: DataFrame, base: str, tuned: str, exclude: Sequence[str] | None = None) -> DataFrame:
    return _result(align(ckpt, [base, tuned], exclude), vx.subtract(of(tuned), of(base)))


def _paired(a: DataFrame, b: DataFrame, values: Callable[[Column, Column], Column]) -> DataFrame:
    rows = a.select(*KEY, F.col("values").alias("_a")).join(b.select(*KEY, F.col("values").alias("_b")), KEY, "full")
    lost = F.raise_error(F.concat(F.lit("only one vector has parameter "), F.col("param")))
    either = F.col("_a").isNull() | F.col("_b").isNull()
    return _result(rows, F.when(either, lost).otherwise(values(F.col("_a"), F.col("_b"))))


def add_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, vx.add)


def multiply_vector(a: DataFrame, by) -> DataFrame:
    """By a float, or element by element with another vector."""
    if isinstance(by, DataFrame):
        return _paired(a, by, vx.multiply)
    if not isinstance(by, float):
        raise TypeError("scale must be a float or a task vector")
    return _result(a, vx.scale("values", by))


def apply_vector(base: DataFrame, vector: DataFrame, scale: float = 1.0) -> DataFrame:
    """base + scale * vector, for the parameters of the vector."""
    v = vector.select(*KEY, vx.scale("values", scale).alias("_v"))
    return _result(base.join(v, KEY), vx.add("values", "_v"))


def _need(steps: Sequence[str], n: int) -> None:
    if len(steps) < n:
        raise ValueError(f"need at least {n} checkpoints")


def extrapolate_linear(ckpt: DataFrame, steps: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Last checkpoint plus alpha times its last change."""
    _need(steps, 2)
    now, was = of(steps[-1]), of(steps[-2])
    return _result(align(ckpt, steps[-2:]), vx.add(now, vx.scale(vx.subtract(now, was), alpha)))


def extrapolate_moving_average(ckpt: DataFrame, steps: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Last checkpoint plus alpha times the mean change, which is (last - first) / (n - 1)."""
    _need(steps, 2)
    now, first = of(steps[-1]), of(steps[0])
    change = vx.scale(vx.subtract(now, first), alpha / (len(steps) - 1))
    return _result(align(ckpt, [steps[0], steps[-1]]), vx.add(now, change))


def extrapolate_acceleration(ckpt: DataFrame, steps: Sequence[str], alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """Last checkpoint plus its velocity and acceleration."""
    _need(steps, 3)
    a, b, c = (of(s) for s in steps[-3:])
    v1, v2 = vx.subtract(b, a), vx.subtract(c, b)
    moved = vx.add(vx.scale(v2, alpha), vx.scale(vx.subtract(v2, v1), beta))
    return _result(align(ckpt, steps[-3:]), vx.add(c, moved))


def fuse_decay(ckpt: DataFrame, base: str, steps: Sequence[str], decay: float = 0.8) -> DataFrame:
    """base + sum of w_i (M_i - base), later checkpoints weighing more."""
    _need(steps, 1)
    raw = [decay ** (len(steps) - 1 - i) for i in range(len(steps))]
    parts = [vx.scale(vx.subtract(of(s), of(base)), w / sum(raw)) for s, w in zip(steps, raw)]
    return _result(align(ckpt, [base, *steps]), reduce(vx.add, parts, of(base)))


def task_arithmetic_merge(ckpt: DataFrame, base: str, models: Sequence[str], scaling: float = 0.05) -> DataFrame:
    """Linear extrapolation over [base, source, targets...]; only the last two count.

    ``models`` lists the targets first and the source last.
    """
    if not isinstance(scaling, float):
        raise TypeError("scaling must be a float")
    return extrapolate_linear(ckpt, [base, *reversed(models)], scaling)


# sign-elected sparse merging -----------------------------------------------------


def trim_thresholds(vectors: DataFrame, columns: Sequence[str], rate: float) -> dict[str, float | None]:
    """k-th smallest magnitude of each vector column over all parameters, k = int(n * rate).

    None stands for k = 0.  One scalar per model comes back to the driver.
    """
    cells = vectors.select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("which"), F.col(c).alias("v")) for c in columns))).alias("e")
    ).select("e.which", "e.v")
    found = kth_smallest_magnitude(cells, "which", "v", rate)
    return {r["which"]: r["kth"] for r in found.select("which", "kth").collect()}


def trim(column: str, threshold: float | None) -> Column:
    if threshold is None:
        return F.col(column)
    return F.transform(F.col(column), lambda v: F.when(F.abs(v) >= F.lit(threshold), v).otherwise(0.0))


def elect_signs(vectors: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``sign``: sign of the column sum, zeros taking the majority sign."""
    own = F.zip_with(F.col(a), F.col(b), lambda x, y: F.signum(x + y))
    total = vectors.agg(F.sum(F.aggregate(own, F.lit(0.0), lambda s, x: s + x))).first()[0] or 0.0
    major = float((total > 0) - (total < 0))
    return vectors.withColumn("sign", F.transform(own, lambda s: F.when(s == 0, F.lit(major)).otherwise(s)))


def ties_trimmed(
    ckpt: DataFrame, base: str, models: Sequence[str], rate: float = 0.8, source_coeff: float = 0.5,
    exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Scaled and trimmed task vectors ``a`` (target) and ``b`` (source), and ``base``.

    The aligned vectors are written once: thresholds, majority sign and result read them.
    """
    if len(models) != 2:
        raise ValueError("exactly two models can be merged by sign election")
    named = [F.col("base"), *(F.col(f"_w{i}") for i in range(2))]
    columns = [of(base), *(of(m) for m in models)]
    rows = align(ckpt, [base, *models], exclude).select(*KEY, *(c.alias(n) for c, n in zip(columns, ("base", "_w0", "_w1"))))
    return _trimmed(rows, *named, rate, source_coeff)


def _trimmed(rows: DataFrame, base: Column, target: Column, source: Column, rate: float, source_coeff: float) -> DataFrame:
    a = vx.scale(vx.subtract(target, base), 1.0 - source_coeff)
    b = vx.scale(vx.subtract(source, base), source_coeff)
    kept = materialize(rows.select(*KEY, base.alias("base"), a.alias("a"), b.alias("b")))
    limits = trim_thresholds(kept, ["a", "b"], rate)
    return kept.select(*KEY, "base", *(trim(c, limits.get(c)).alias(c) for c in ("a", "b")))


def ties_merge(
    ckpt: DataFrame, base: str, models: Sequence[str], rate: float = 0.8, scaling: float = 1.0, source_coeff: float = 0.5,
    exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Trim, elect signs, keep agreeing values (averaged where both agree), add to the base."""
    if not isinstance(scaling, float):
        raise TypeError("scaling must be a float")
    return _elected(ties_trimmed(ckpt, base, models, rate, source_coeff, exclude), scaling)


def _elected(trimmed: DataFrame, scaling: float) -> DataFrame:
    signed = elect_signs(trimmed)

    def agreeing(c):
        return F.zip_with(F.col(c), F.col("sign"), lambda v, s: F.when(v * s > 0, v).otherwise(0.0))

    merged = F.zip_with(
        agreeing("a"), agreeing("b"), lambda x, y: F.when((x != 0) & (y != 0), (x + y) / 2).otherwise(x + y)
    )
    return _result(signed, vx.add("base", vx.scale(merged, scaling)))


# masking ---------------------------------------------------------------------


def mask_random(vector: DataFrame, rate: float, rescale: bool = True, seed: str = "0", chunk_size: int = 64) -> DataFrame:
    """Zero each value with probability ``rate``, drawn from its parameter name and index."""
    _check_rate(rate)
    return _result(vector, _random_mask(F.col("values"), rate, rescale, seed, chunk_size))


def _random_mask(values: Column, rate: float, rescale: bool, seed: str, chunk_size: int) -> Column:
    index = lambda i: F.col("chunk") * chunk_size + i
    masked = F.transform(values, lambda v, i: F.when(draw_unit(seed, "param", index(i)) < rate, 0.0).otherwise(v))
    return _rescaled(masked, rate, rescale)


def mask_magnitude(vector: DataFrame, rate: float, rescale: bool = True) -> DataFrame:
    """Per parameter, zero the values up to the k-th smallest magnitude; ties go too."""
    _check_rate(rate)
    limits = broadcast_if_small(kth_smallest_magnitude(vector, "param", "values", rate).select("param", "kth"))
    return _result(vector.join(limits, "param", "left"), _magnitude_mask(F.col("values"), F.col("kth"), rate, rescale))


def _magnitude_mask(values: Column, kth: Column, rate: float, rescale: bool) -> Column:
    masked = F.transform(values, lambda v: F.when(kth.isNotNull() & (F.abs(v) <= kth), 0.0).otherwise(v))
    return _rescaled(masked, rate, rescale)


def _check_rate(rate: float) -> None:
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"mask rate {rate} is outside [0, 1]")


def _check_mask(weight_format: str, strategy: str) -> None:
    if weight_format not in ("delta_weight", "finetuned_weight"):
        raise ValueError(f"unknown weight format {weight_format}")
    if strategy not in ("random", "magnitude"):
        raise ValueError(f"unknown mask strategy {strategy}")


def _rescaled(values: Column, rate: float, rescale: bool) -> Column:
    return vx.scale(values, 1 / (1 - rate)) if rescale and rate != 1.0 else values


def mask_weights(
    ckpt: DataFrame, base: str, tuned: str, rate: float = 0.1, weight_format: str = "delta_weight",
    strategy: str = "random", rescale: bool = True, seed: str = "0", chunk_size: int = 64,
    exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Masked parameters of one model, masking either its weights or its change from the base."""
    _check_mask(weight_format, strategy)
    delta = weight_format == "delta_weight"
    vector = task_vector(ckpt, base, tuned, exclude) if delta else exclude_params(model_rows(ckpt, tuned), exclude)
    if strategy == "random":
        masked = mask_random(vector, rate, rescale, f"{seed}#{tuned}", chunk_size)
    else:
        masked = mask_magnitude(materialize(vector), rate, rescale)
    return apply_vector(model_rows(ckpt, base), masked) if delta else masked


def mask_merge(
    ckpt: DataFrame, base: str, models: Sequence[str], rates: Sequence[float] | None = None, method: str = "ties_merging",
    weight_format: str = "delta_weight", strategy: str = "random", rescale: bool = True, seed: str = "0",
    chunk_size: int = 64, exclude: Sequence[str] | None = None, **kw,
) -> DataFrame:
    """Mask every model, then merge the masked models with another method.

    The models are aligned once; masking and merging are arithmetic in the aligned rows, with one threshold per
    model and parameter for magnitudes.  Over a table bucketed by chunk (``files.store_checkpoints``) nothing of a whole
    model is shuffled.
    """
    if method not in ("average_merging", "task_arithmetic", "ties_merging"):
        raise ValueError(f"unknown method {method}")
    if method == "ties_merging" and len(models) != 2:
        raise ValueError("exactly two models can be merged by sign election")
    _check_mask(weight_format, strategy)
    rates = list(rates) if rates else [0.1] * len(models)
    for rate in rates:
        _check_rate(rate)
    delta = weight_format == "delta_weight"
    # excluded parameters are never masked; task arithmetic still merges them
    plain = F.lit(False) if not exclude else reduce(lambda a, b: a | b, [F.col("param").rlike(f"^(?:{p})") for p in exclude])
    rows = align(ckpt, [base, *models], exclude if method != "task_arithmetic" else None).withColumn("_plain", plain)
    start = F.when(F.col("_plain"), F.try_element_at("m", F.lit(base))).otherwise(of(base)) if delta else F.try_element_at("m", F.lit(base))
    own = [F.try_element_at("m", F.lit(m)) for m in models]
    # masks of changes need the parameter in every model
    vectors = [vx.subtract(of(m), F.col("base")) if delta else own[i] for i, m in enumerate(models)]
    rows = rows.select(*KEY, "_plain", start.alias("base"), "m")
    rows = rows.select(
        *KEY, "_plain", "base",
        *(o.alias(f"_o{i}") for i, o in enumerate(own)),
        *(F.when(~F.col("_plain"), v).alias(f"_v{i}") for i, v in enumerate(vectors)),
    )
    if strategy == "magnitude":
        rows = materialize(rows)
        limits = _limits(rows, models, rates)
        rows = rows.join(limits, "param", "left")
        masks = [_magnitude_mask(F.col(f"_v{i}"), F.col(f"_kth{i}"), r, rescale) for i, r in enumerate(rates)]
    else:
        seeds = [f"{seed}#{m}" for m in models]
        masks = [_random_mask(F.col(f"_v{i}"), r, rescale, s, chunk_size) for i, (r, s) in enumerate(zip(rates, seeds))]
    masked = [vx.add("base", m) if delta else m for m in masks]
    weights = [F.when(F.col("_plain"), F.col(f"_o{i}")).otherwise(w) for i, w in enumerate(masked)]
    if method == "average_merging":
        known = F.filter(F.array(*weights), lambda w: w.isNotNull())
        return _result(rows.withColumn("_w", known).where(F.size("_w") > 0), _mean(F.col("_w")))
    rows = rows.select(*KEY, "base", *(w.alias(f"_w{i}") for i, w in enumerate(weights)))
    if method == "task_arithmetic":
        now, was = F.col("_w0"), F.col("_w1") if len(models) > 1 else F.col("base")
        return _result(rows, vx.add(now, vx.scale(vx.subtract(now, was), kw.get("scaling", 1.0))))
    trimmed = _trimmed(rows, F.col("base"), F.col("_w0"), F.col("_w1"), kw.get("rate", 0.8), kw.get("source_coeff", 0.5))
    return _elected(trimmed, kw.get("scaling", 1.0))


def _limits(rows: DataFrame, models: Sequence[str], rates: Sequence[float]) -> DataFrame:
    """Mask threshold of every parameter, one column ``_kth<i>`` per model."""
    out = rows.select("param").distinct()
    for i, rate in enumerate(rates):
        some = rows.where(F.col(f"_v{i}").isNotNull())
        out = out.join(kth_smallest_magnitude(some, "param", f"_v{i}", rate).select("param", F.col("kth").alias(f"_kth{i}")), "param", "left")
    return broadcast_if_small(out)


METHODS = {
    "average_merging": lambda ckpt, base, models, **kw: average_merge(ckpt, models, kw.get("exclude")),
    "task_arithmetic": lambda ckpt, base, models, **kw: task_arithmetic_merge(ckpt, base, models, kw.get("scaling", 0.05)),
    "ties_merging": lambda ckpt, base, models, **kw: ties_merge(ckpt, base, models, **kw),
    "mask_merging": lambda ckpt, base, models, **kw: mask_merge(ckpt, base, models, **kw),
}


def merge_models(
    ckpt: DataFrame, base: str, source: str, targets: Sequence[str], method: str, mode: str = "title",
    token_width: int | None = None, chunk_size: int = 64, start_row: int = CODE_ROW_START,
    token_tensors: Sequence[str] = TOKEN_TENSORS, **kw,
) -> DataFrame:
    """Merge targets with the source model and return the complete merged model.

    Parameters a method leaves out keep the base values (for averaging, the source's).
    For codes the rows of the code tokens are taken from the source.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    models = [*targets, source]
    start = source if method == "average_merging" else base
    merged = override(model_rows(ckpt, start), METHODS[method](ckpt, start, models, **kw))
    if mode == "sem_id":
        merged = retain_rows(merged, model_rows(ckpt, source), token_width, chunk_size, start_row, token_tensors)
    return merged


# run names --------------------------------------------------------------------


def merged_name(mode, source, targets, splits, method, args=None) -> Column:
    """Name of a merge run; ``targets`` and ``splits`` are arrays, ``args`` a map or None."""
    several = (F.size(targets) > 1) & (F.size(splits) > 1)
    middle = F.when(
        F.size(splits) == 1,
        F.concat(F.array_join(F.transform(targets, lambda t: F.substring(t, 1, 3)), ""), F.lit("-"), F.get(splits, F.lit(0))),
    ).otherwise(F.array_join(splits, ""))
    name = F.concat(
        F.lit("merged-"), F.substring(source, 1, 3), F.lit("-"), middle, F.lit("-"), mode, F.lit("-"), F.substring(method, 1, 4)
    )
    if args is not None:
        pairs = F.transform(F.map_entries(args), lambda e: F.concat(F.substring(e["key"], 1, 3), F.lit("="), e["value"].cast("string")))
        name = F.concat(name, F.lit("-"), F.array_join(pairs, "-"))
    return F.when(several, F.raise_error(F.lit("splits and targets cannot both be several"))).otherwise(name)


def checkpoint_path(root: str, domain, split, mode: str) -> Column:
    stem = F.concat(F.lit(f"{root}/"), domain, F.lit("-"), split)
    if mode not in ("title", "sem_id"):
        return stem
    return F.concat(stem, F.lit(f"-{mode}/epoch_"), F.when(split == "pretrain", "2").otherwise("1"))
