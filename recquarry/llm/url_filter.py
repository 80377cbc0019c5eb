"""URL filter: list rules first, then a character language-model ratio.

URLs that a rule decides are the training data.  For accepted and rejected URLs two
variable-order Markov models of characters are built: counts of four-character strings are
aggregated once, shorter contexts are sums over them, and each order is smoothed towards the
next lower one.  A URL's value is the mean log-likelihood ratio of its characters, so that
long and short URLs compare.  It is calibrated on the training URLs: the cut lies between
the class means, at the same number of standard deviations from both.

Defined cases: a null URL, or one without ``://``, has an empty host and an empty path; no rule fits
it and its value is that of the empty string.  Without training URLs of both
classes the verdict is ``allow``.  Repeated rows each get their verdict; extra columns are
left alone.  Equal rule lengths cannot both fit one URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import broadcast_checked, free_names, stored
from recquarry.llm.exact_dedup import LOWER, UPPER

ORDER = 4  # characters in a counted string: three of context and the next one
STRENGTH = 4.0  # weight of the next lower order, in observations
START, END = "\u0002", "\u0003"
Rule = tuple[str, str]  # verdict, "host/path"


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def model_text(host: Column, path: Column) -> Column:
    """What the models read: host and path in lower case, every digit as 0, between end marks."""
    plain = F.translate(F.lower(F.concat(host, path)), "123456789", "000000000")
    return F.concat(F.lit(START * (ORDER - 1)), plain, F.lit(END))


def _grams(texts: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length("text") - ORDER + 1)
    return texts.select("*", F.explode_outer(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(ORDER)))).alias("gram"))


def ratios(texts: DataFrame) -> DataFrame:
    """Log-likelihood ratio (gram, ratio) of the last character of every four-character string.

    ``texts`` has one row per distinct text with the weights ``allow`` and ``block``.
    """
    base = stored(
        _grams(texts).groupBy("gram").agg(F.sum("allow").cast("double").alias("allow"), F.sum("block").cast("double").alias("block")),
        "grams",
    )
    sums = base.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("allow", "block"))).first()  # two numbers
    letters = max(base.select(F.substring("gram", ORDER, 1).alias("c")).distinct().count(), 1)
    out = base.select("gram")
    # from single characters up: p_k = (count + strength * p_(k-1)) / (context + strength)
    prob = {c: F.lit(1.0 / letters) for c in ("allow", "block")}
    for k in range(1, ORDER + 1):
        key, context = F.substring("gram", ORDER - k + 1, k), F.substring("gram", ORDER - k + 1, k - 1)
        counts = base.groupBy(key.alias(f"g{k}")).agg(*(F.sum(c).alias(f"{c}{k}") for c in ("allow", "block")))
        out = out.withColumn(f"g{k}", key).join(counts, f"g{k}")
        if k > 1:
            contexts = base.groupBy(context.alias(f"x{k}")).agg(*(F.sum(c).alias(f"{c}_x{k}") for c in ("allow", "block")))
            out = out.withColumn(f"x{k}", context).join(contexts, f"x{k}")
        for c in ("allow", "block"):
            below = F.lit(float(sums[c])) if k == 1 else F.col(f"{c}_x{k}")
            prob[c] = (F.col(f"{c}{k}") + F.lit(STRENGTH) * prob[c]) / (below + F.lit(STRENGTH))
    return out.select("gram", (F.log(prob["allow"]) - F.log(prob["block"])).alias("ratio"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """The input with host, path, rule, verdict and value; those five names are replaced if present."""
    host, path = host_and_path(url)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parts = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("verdict", verdict)
    key, found_value = free_names(parts, "url_text", "url_value")
    parts = parts.withColumn(key, model_text(F.col("host"), F.col("path")))
    # one row per distinct text from here on; the weights count the decided pages
    decided = [(F.col("verdict") == v).cast("long") for v in ("allow", "block")]
    texts = parts.select(F.col(key).alias("text"), *(F.coalesce(d, F.lit(0)).alias(v) for d, v in zip(decided, ("allow", "block"))))
    texts = stored(texts.groupBy("text").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "urls")
    table = broadcast_checked(stored(ratios(texts), "ratios"))
    values = _grams(texts.select("text")).join(table, "gram").groupBy("text").agg(F.round(F.avg("ratio"), 9).alias("value"))
    values = stored(values, "values")
    weighed = values.join(texts, "text")
    moments = weighed.agg(
        *(F.sum(F.col(v) * F.col("value") ** p).alias(f"{v}{p}") for v in ("allow", "block") for p in (0, 1, 2))
    ).first()  # six sums
    cut = None
    if moments["allow0"] and moments["block0"]:
        mean = {v: moments[f"{v}1"] / moments[f"{v}0"] for v in ("allow", "block")}
        spread = {v: max(moments[f"{v}2"] / moments[f"{v}0"] - mean[v] ** 2, 1e-12) ** 0.5 for v in mean}
        cut = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
    judged = F.lit("allow") if cut is None else F.when(F.col(found_value) < F.lit(round(cut, 9)), "block").otherwise("allow")
    out = parts.join(values.select(F.col("text").alias(key), F.col("value").alias(found_value)), key, "left")
    out = out.withColumn("verdict", F.coalesce("verdict", judged))
    return out.withColumn("value", F.col(found_value)).drop(key, found_value)
