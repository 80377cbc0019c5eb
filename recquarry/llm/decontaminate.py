"""Benchmark decontamination with templates.

Numbers, names and units become typed placeholders, so that a question asked with other
parameters keeps its template.  Windows of template tokens are hashed; documents meet the
benchmark in a hash join.  Matched windows of one alignment (document position minus item
position) must fill the slots consistently.  A name inside a sentence that stands for two names breaks the
alignment.  Of other values the document value with most windows stays, and windows with another one are left
out, but for windows whose values equal the item's.  A document is contaminated by an item if enough of the
item's windows are left.

Tokens are runs of letters, or numbers with inner points and commas.  A name is a capitalised word; at the
beginning of a sentence it may be a plain word too, and windows are hashed in all readings that leave
``MIN_WORDS`` - 1 plain words.  A unit is a word
of ``UNITS`` after a number; other words
count in lower case.  Windows with fewer than ``MIN_WORDS`` plain words are left out: they would match
anything.  Items shorter than a window are one window of their own length.  Items without any such window
are found as a whole, token by token with their values; an item of one word is found wherever that word is.

Defined cases: null and empty texts have no windows and are clean; items without tokens match
nothing; an empty benchmark leaves all documents clean.  Rows repeated with the same id and
text get the same result.  Repeated benchmark items count as one of them each.  A null id is a value
like any other.  Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recquarry.llm.common import broadcast_checked, free_names, held, stored, text_or_empty

WINDOW = 6
MIN_WORDS = 4
MIN_SHARE = 0.4
TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+|[.!?\n]"
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "oz",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "kwh", "watts",
]
NUMBER, NAME, UNIT = "\u0001n", "\u0001p", "\u0001u"
# A capitalised word that begins a sentence; read as a name its slot value is marked ``FIRST``.
EITHER, FIRST = "\u0002", "\u0001q"


# Tokens of a piece of text; windows that begin in it may reach into the next one.
PIECE = 256
# Largest number of distinct window hashes, of 8 bytes each, that is broadcast to the documents.
HASH_ROWS = 1_000_000
PLAIN_KIND, NUMBER_KIND, NAME_KIND, UNIT_KIND, EITHER_KIND = range(5)
LITERAL = 1 << 9  # marks the code of a window that is read with its values


def _mark(tokens: str) -> Column:
    """Slots as a placeholder followed by their value, words in lower case, sentence ends left out."""

    # tokens that begin with an ASCII digit or letter are told apart by comparison, all others by patterns
    def number(t):
        return ((t >= "0") & (t < ":")) | ((t >= "{") & t.rlike(r"^\p{N}"))

    def mark(t, i):
        before, low = F.get(tokens, i - 1), F.lower(t)
        begins = (i == 0) | before.isin(".", "!", "?", "\n")
        return (
            F.when(t.isin(".", "!", "?", "\n"), None)
            .when(number(t), F.concat(F.lit(NUMBER), t))
            .when(number(before) & low.isin(UNITS), F.concat(F.lit(UNIT), low))
            .when(~((t >= "a") & (t < "{")) & t.rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.when(begins, EITHER).otherwise(NAME), low))
            .otherwise(low)
        )

    return F.array_compact(F.transform(tokens, mark))


def templates(table: DataFrame, text: str, *columns: Column) -> DataFrame:
    """``columns`` plus the array ``marked``."""
    cut = table.select(*columns, text_or_empty(text).alias("tokens"))
    return held(cut, tokens=F.regexp_extract_all("tokens", F.lit(TOKEN), F.lit(0)), marked=_mark("tokens")).drop("tokens")


def _packed(t: Column) -> Column:
    """Hash of the value of a marked token; the last three bits hold its kind."""
    kind = F.when(t.startswith(NUMBER), NUMBER_KIND).when(t.startswith(NAME), NAME_KIND).when(t.startswith(UNIT), UNIT_KIND).otherwise(EITHER_KIND)
    marked = F.xxhash64(_value(t)).bitwiseAND(F.lit(-8)).bitwiseOR(kind.cast("long"))
    return F.when(t >= "\u0003", F.xxhash64(t).bitwiseAND(F.lit(-8))).otherwise(marked)


def _readings(widths: list[int], literal: list[int]) -> Column:
    """Codes of the windows that start at a token, by the places of sentence beginnings among the next ``WINDOW`` tokens.

    A code is 64 times the width plus the places that are read as names, and ``LITERAL`` for a window with its values.
    A name that may be a word leaves one plain word less, so there are at most width - ``MIN_WORDS`` + 1 of them.
    """
    codes = []
    for begins in range(1 << WINDOW):
        named = [
            width << WINDOW | places
            for width in widths
            for places in range(1 << width)
            if places & begins == places and places.bit_count() <= width - MIN_WORDS + 1
        ]
        codes.append(named + [LITERAL | width << WINDOW for width in literal])
    return F.expr("array(" + ", ".join(f"array({', '.join(map(str, c))})" for c in codes) + ")")


def windows(t: DataFrame, keep: list[str], widths: list[int], literal: list[int] | None = None) -> DataFrame:
    """Rows (keep, pos, code, h) of all windows of all widths in all readings; ``marked`` and ``at`` are for ``filled``.

    Only the cut into pieces uses functions over arrays; windows are hashed from plain columns, in compiled code.
    """
    t = held(t.where(F.size("marked") > 0), v=F.transform("marked", _packed))
    reach = PIECE + WINDOW - 1
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("v") - 1, F.lit(PIECE)),
        lambda i: F.struct(i.alias("start"), F.slice("v", i + 1, reach).alias("v"), F.slice("marked", i + 1, reach).alias("marked")),
    )
    t = t.select(*keep, F.inline(pieces))
    shifted = F.arrays_zip(*(F.slice("v", j + 1, PIECE) for j in range(WINDOW)))
    t = t.select(*keep, "start", "marked", F.size("v").alias("n"), F.posexplode(shifted).alias("at", "z"))
    token = [F.col("z").getField(str(j)) for j in range(WINDOW)]
    begins = F.lit(0)
    for j in range(WINDOW):
        begins = begins + F.when(token[j].bitwiseAND(F.lit(7)) == EITHER_KIND, 1 << j).otherwise(0)
    t = t.select(*keep, "start", "marked", "n", "at", "z", F.explode(F.get(_readings(widths, literal or []), begins)).alias("code"))
    width = _width(F.col("code"))
    t = t.where(F.col("at") + width <= F.col("n"))
    read = []
    for j in range(WINDOW):
        value, kind = token[j].bitwiseAND(F.lit(-8)), token[j].bitwiseAND(F.lit(7))
        named = F.col("code").bitwiseAND(F.lit(1 << j)) != 0
        template = F.when(named, F.lit(NAME_KIND).cast("long")).when(kind.isin(PLAIN_KIND, EITHER_KIND), value).otherwise(kind)
        read.append(F.when(width > j, F.when(F.col("code") >= LITERAL, value).otherwise(template)))
    h = F.xxhash64(F.col("code").bitwiseAND(F.lit(~((1 << WINDOW) - 1))), *read)
    return t.select(*keep, (F.col("start") + F.col("at")).alias("pos"), "code", h.alias("h"), "marked", "at")


def _width(code: Column) -> Column:
    return F.shiftright(code.bitwiseAND(F.lit(LITERAL - 1)), WINDOW)


def filled(found: DataFrame) -> DataFrame:
    """Windows with ``slots``, their filled placeholders in order, in place of ``marked`` and ``at``."""
    code = F.col("code")

    def read(x, j):
        named = F.call_function("shiftright", code, j).bitwiseAND(F.lit(1)) == 1
        return F.when(named, F.concat(F.lit(FIRST), F.substring(x, 2, 1 << 30))).otherwise(F.ltrim(x, F.lit(EITHER)))

    tokens = F.transform(F.slice("marked", F.col("at") + 1, _width(code)), read)
    return found.withColumn("slots", F.filter(tokens, lambda x: x.startswith("\u0001"))).drop("marked", "at")


def _value(t: Column) -> Column:
    """A marked token without its marks."""
    return F.when(t.startswith("\u0001"), F.substring(t, 3, 1 << 30)).otherwise(F.ltrim(t, F.lit(EITHER)))


def item_templates(items: DataFrame, item_id: str, text: str) -> DataFrame:
    t = templates(items, text, F.col(item_id).alias("item"), F.xxhash64(text_or_empty(text)).alias("ik"))
    return stored(t.dropDuplicates(["item", "ik"]), "templates")


def benchmark_windows(t: DataFrame) -> tuple[DataFrame, list[int]]:
    """Windows of all items: (item, ik, pos, h, slots, n_windows), stored; and their widths."""
    t = t.withColumn("wide", F.least(F.size("marked"), F.lit(WINDOW))).where(F.col("wide") >= MIN_WORDS)
    widths = sorted(r[0] for r in t.select("wide").distinct().collect())  # at most WINDOW numbers
    found = windows(t, ["item", "ik", "wide"], widths or [WINDOW])
    found = filled(found.where(_width(F.col("code")) == F.col("wide")))
    sure = F.filter("slots", lambda x: ~x.startswith(FIRST))
    found = found.where((F.size(sure) <= F.col("wide") - MIN_WORDS) & (F.size("slots") <= F.col("wide") - MIN_WORDS + 1))
    found = stored(found.select("item", "ik", "pos", "h", "slots"), "benchmark-windows")
    size = found.groupBy("item", "ik").agg(F.count_distinct("pos").alias("n_windows"))
    same = (F.col("a.item").eqNullSafe(F.col("b.item"))) & (F.col("a.ik") == F.col("b.ik"))
    return stored(found.alias("a").join(size.alias("b"), same).select("a.*", "b.n_windows"), "benchmark-windows"), widths


def literal_windows(items: DataFrame, bench: DataFrame) -> tuple[DataFrame, list[int]]:
    """Windows with values of the items that have no others: (item, ik, ipos, h, n_windows), stored; and their widths."""
    has = bench.select(F.col("item").alias("h_item"), F.col("ik").alias("h_ik")).distinct()
    bare = items.where(F.size("marked") > 0).join(has, F.col("item").eqNullSafe(F.col("h_item")) & (F.col("ik") == F.col("h_ik")), "left_anti")
    bare = stored(bare.withColumn("wide", F.least(F.size("marked"), F.lit(WINDOW))), "whole-items")
    widths = sorted(r[0] for r in bare.select("wide").distinct().collect())  # at most WINDOW numbers
    bare = bare.withColumn("n_windows", F.size("marked") - F.col("wide") + 1)
    found = windows(bare, ["item", "ik", "wide", "n_windows"], [], widths or [WINDOW]).where(_width(F.col("code")) == F.col("wide"))
    return stored(found.select("item", "ik", F.col("pos").alias("ipos"), "h", "n_windows"), "literal-windows"), widths


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, k, item, share): share of an item's windows found in the document."""
    asked = item_templates(items, item_id, item_text)
    bench, widths = benchmark_windows(asked)
    exact, literal = literal_windows(asked, bench)
    hashes = stored(bench.select("h").union(exact.select("h")).distinct(), "window-hashes")
    t = templates(docs, text, F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("k"))
    every = windows(t, ["id", "k"], widths or [WINDOW], literal)
    if hashes.limit(HASH_ROWS + 1).count() <= HASH_ROWS:
        hits = filled(every.join(F.broadcast(hashes), "h"))
    else:
        hits = filled(every).join(hashes, "h")  # slots first, so that no pieces of texts are shuffled
    hits = stored(hits.select("id", "k", "pos", "code", "h", "slots"), "hit-windows")

    shift = (F.col("pos") - F.col("ipos")).alias("shift")
    side = bench.select("h", "item", "ik", "n_windows", F.col("pos").alias("ipos"), F.col("slots").alias("islots"))
    met = hits.where(F.col("code") < LITERAL).join(broadcast_checked(side), "h")
    met = stored(met.select("id", "k", "item", "ik", "n_windows", "ipos", shift, "slots", "islots"), "matched-windows")
    # one row per window of the item first, then their number: at most n_windows rows for a document
    once = consistent(met).select("id", "k", "item", "ik", "n_windows", "ipos").distinct()
    found = once.groupBy("id", "k", "item", "ik", "n_windows").agg(F.count(F.lit(1)).alias("n")).select(
        "id", "k", "item", (F.col("n") / F.col("n_windows")).alias("share")
    )
    whole = hits.where(F.col("code") >= LITERAL).join(broadcast_checked(exact), "h")
    whole = whole.groupBy("id", "k", "item", "ik", "n_windows", shift).agg(F.count_distinct("ipos").alias("n")).where("n = n_windows")
    return found.unionByName(whole.select("id", "k", "item", F.lit(1.0).alias("share")).distinct())


def consistent(hits: DataFrame) -> DataFrame:
    """The matched windows that fill the slots of their alignment consistently."""
    key = ["id", "k", "item", "ik", "shift"]
    filled = hits.where(F.size("islots") > 0).select(*key, "ipos", "islots", "slots", F.explode(F.arrays_zip("islots", "slots")).alias("z"))
    filled = filled.select(
        *key, "ipos", "islots", "slots",
        F.regexp_replace("z.islots", "^" + FIRST, NAME).alias("value"),
        _value(F.col("z.slots")).alias("filling"),
        (F.col("z.islots").startswith(NAME) & F.col("z.slots").startswith(NAME)).alias("certain"),
    )
    counted = filled.groupBy(*key, "value", "filling").agg(F.count_distinct("ipos").alias("n"), F.max("certain").alias("certain"))
    mixed = counted.groupBy(*key, "value").agg(
        F.count(F.lit(1)).alias("fillings"),
        F.count_if("certain").alias("names"),
        F.max_by("filling", F.struct("n", F.col("filling") == _value(F.col("value")), "filling")).alias("best"),
    )
    mixed = stored(mixed.where("fillings > 1"), "mixed-slots")
    renamed = mixed.select(*(F.col(c).alias(f"b_{c}") for c in (*key, "value", "best")), "names")
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in key]
    sound = hits.join(renamed.where("names > 1").select(*(f"b_{c}" for c in key)).distinct(), on, "left_anti")
    literal = F.transform("islots", _value) == F.transform("slots", _value)
    minor = filled.join(renamed, [*on, F.col("value") == F.col("b_value")]).where((F.col("filling") != F.col("b_best")) & ~literal)
    window = [*key, "ipos", "islots", "slots"]
    minor = minor.select(*(F.col(c).alias(f"m_{c}") for c in window)).distinct()
    return sound.join(minor, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in window], "left_anti")


def contaminated(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, **names) -> DataFrame:
    """One row (id, k, n_items, share) per contaminated document; ``k`` is the hash of its text."""
    found = matches(docs, items, **names).where(F.col("share") >= min_share)
    return found.groupBy("id", "k").agg(F.count_distinct("item").alias("n_items"), F.max("share").alias("share"))


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, share."""
    found = contaminated(docs, items, doc_id=doc_id, text=text, **names)
    found = found.select(F.col("id").alias("fid"), F.col("k").alias("fk"), "n_items", "share")
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("k"))
    joined = ids.join(found, (F.col("k") == F.col("fk")) & F.col("doc_id").eqNullSafe(F.col("fid")), "left")
    return joined.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The clean documents with all their columns, whatever their names."""
    found = contaminated(docs, items, doc_id=doc_id, text=text, **names)
    hit_id, hit_key, key = free_names(docs, "hit_id", "hit_key", "key")
    found = stored(found.select(F.col("id").alias(hit_id), F.col("k").alias(hit_key)), "contaminated")
    tagged = docs.withColumn(key, F.xxhash64(text_or_empty(text)))
    clean = tagged.join(broadcast_checked(found), (F.col(key) == F.col(hit_key)) & F.col(doc_id).eqNullSafe(F.col(hit_id)), "left_anti")
    return clean.drop(key)
