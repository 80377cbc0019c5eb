"""Text and message expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recquarry.functions.arrays import let

# Message layout that generated outputs are parsed by.
THINK_PREFIX = "<think>\n\n</think>\n\n"
ITEM_LABEL = {"title": "Title: ", "sem_id": "Item Index: "}
ANSWER_LABEL = {"title": "Recommended Item Title: ", "sem_id": "Recommended Item Index: "}
GENERATION_PREFIX = {"title": "Recommended Item Title:", "sem_id": "Recommended Item Index: "}
BLOCK_SEPARATOR = {"title": "\n\n", "sem_id": "\n"}

# Default wording; callers may pass their own.
PROMPT = (
    "Recommend the next {index} for this user. The purchases below run from the oldest to the newest.\n\n"
    "Purchases:\n"
)
T2I_PROMPT = "Give the item index that belongs to the title and description.\nExamples:\n{examples}\n"
I2T_PROMPT = "Give the title and description that belong to the item index.\nExamples:\n{examples}\n"
EMBEDDING_INSTRUCTION = "Turn the item described here into one vector."
INDEX_NAME = {"title": "item title", "sem_id": "item index"}


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text_block(title, description) -> Column:
    return F.concat(F.lit("Title: "), _c(title), F.lit("\nDescription: "), _c(description))


def index_block(sem_id) -> Column:
    return F.concat(F.lit(ITEM_LABEL["sem_id"]), _c(sem_id))


def item_block(item, kind: str) -> Column:
    """Text of one history item held as struct(title, description, sem_id)."""
    item = _c(item)
    if kind == "title":
        return text_block(item["title"], item["description"])
    return index_block(item["sem_id"])


def render_chat(history, target, index: str, index_prompt: str | None = None, prompt: str = PROMPT) -> Column:
    """Two-message training example from a list of item structs and a target struct."""
    shown = index_prompt or index
    blocks = F.array_join(
        F.transform(_c(history), lambda h: item_block(h, shown)), BLOCK_SEPARATOR[shown]
    )
    question = F.concat(F.lit(prompt.format(index=INDEX_NAME[index]) + "\n"), blocks)
    answer = F.concat(F.lit(THINK_PREFIX + ANSWER_LABEL[index]), _c(target)[index])
    return F.array(message("user", question), message("assistant", answer))


def render_dialogue(targets, examples, kind: str, prompt: str | None = None) -> Column:
    """Multi-turn text-to-index (``t2i``) or index-to-text (``i2t``) conversation."""
    targets, examples = _c(targets), _c(examples)

    def text(i):
        return text_block(i["title"], i["description"])

    def index(i):
        return index_block(i["sem_id"])

    ask, answer = (text, index) if kind == "t2i" else (index, text)
    head, tail = (prompt or (T2I_PROMPT if kind == "t2i" else I2T_PROMPT)).split("{examples}")
    shown = F.array_join(F.transform(examples, lambda e: F.concat(ask(e), F.lit("\n"), answer(e))), "\n")
    opening = F.concat(F.lit(head), shown, F.lit(tail))
    turns = F.transform(
        targets,
        lambda t, i: F.array(
            message("user", F.when(i == 0, F.concat(opening, ask(t))).otherwise(ask(t))),
            message("assistant", F.concat(F.lit(THINK_PREFIX), answer(t))),
        ),
    )
    return F.flatten(turns)


def generation_prompt(messages, mode: str) -> Column:
    """Replace the last message by the assistant prefix the generator continues."""
    m = _c(messages)
    return F.concat(
        F.slice(m, F.lit(1), F.size(m) - 1), F.array(message("assistant", F.lit(GENERATION_PREFIX[mode])))
    )


def embedding_prompt(title, description=None, instruction: str = EMBEDDING_INSTRUCTION) -> Column:
    head = F.concat(F.lit(instruction + "\nTitle: "), _c(title))
    return head if description is None else F.concat(head, F.lit("\nDescription: "), _c(description))


def _nothing(key: str) -> Column:
    """Values that say nothing: null, empty text, "nan", and zero or false where the column is no text."""
    value = F.col(key).cast("string")
    is_text = F.typeof(F.col(key)) == "string"
    zero = value.rlike(r"^-?0+(\.0*)?([eE][+-]?\d+)?$|^(false|NaN)$")
    return F.col(key).isNull() | value.isin("", "nan") | (~is_text & zero)


def item_text(prompt: str, keys: list[str], known=None) -> Column:
    """Prompt followed by ``key: value`` for every key with a value; empty for unknown items."""
    parts = [
        F.when(_nothing(k), F.lit("")).otherwise(F.concat(F.lit(f"{k}: "), F.col(k).cast("string"))) for k in keys
    ]
    text = F.concat(F.lit(prompt), *parts)
    return text if known is None else F.when(_c(known), text).otherwise(F.lit(""))


def words(text) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def first_words(text, n: int) -> Column:
    """The text up to the end of its n-th whitespace token, or the whole text."""
    text = _c(text)
    head = F.regexp_extract(text, rf"^(?:\s*\S+){{0,{n}}}", 0)
    # only a further token makes it a cut
    return let(
        F.struct(text.alias("all"), head.alias("head")),
        lambda t: F.when(F.rlike(F.substr(t["all"], F.length(t["head"]) + 1), F.lit(r"\S")), t["head"]).otherwise(t["all"]),
    )


def truncate_description(title, description, max_tokens: int = 64) -> Column:
    """Cut title+description to ``max_tokens`` and keep what follows the title.

    A changed length is marked with "..."; when the title itself was cut, the whole
    truncated text takes the place of the description.
    """
    title, description = _c(title), _c(description)
    return after_title(first_words(F.concat(title, description), max_tokens), title, description)


def after_title(kept: Column, title: Column, description: Column) -> Column:
    """What follows the title in a cut text, marked with "..." if it differs in length from the description."""

    def rest(text):
        at = F.instr(text, title)
        return F.when(at > 0, F.substr(text, at + F.length(title))).otherwise(text)

    return let(let(kept, rest), lambda r: F.when(F.length(r) != F.length(description), F.concat(r, F.lit("..."))).otherwise(description))


def pack_tokens(lists, max_len: int, emb_slots: int = 1) -> Column:
    """Token lists of one batch end to end: struct(ids, lengths, positions).

    Each list is cut to ``max_len`` and followed by ``emb_slots`` zero ids; positions are
    right-aligned to ``max_len``.
    """
    cut = F.transform(_c(lists), lambda t: F.slice(t, 1, max_len))
    zeros = F.array_repeat(F.lit(0).cast("long"), emb_slots)
    return F.struct(
        F.flatten(F.transform(cut, lambda t: F.concat(t, zeros))).alias("ids"),
        F.transform(cut, lambda t: (F.size(t) + emb_slots).cast("long")).alias("lengths"),
        F.flatten(
            F.transform(
                cut,
                lambda t: F.transform(
                    F.sequence(F.lit(1), F.size(t) + emb_slots), lambda i: (i - 1 + max_len - F.size(t)).cast("long")
                ),
            )
        ).alias("positions"),
    )


def strip(text) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def first_line(text) -> Column:
    return F.get(F.split(strip(text), "\n"), F.lit(0))


def hit_vector(results, target) -> Column:
    """Whether each ranked text contains the target text."""
    return F.transform(_c(results), lambda e: F.coalesce(F.contains(e, _c(target)), F.lit(False)))


def fixed_decimals(x, precision: int) -> Column:
    """Text of a double with ``precision`` decimals, rounded from its exact binary value.

    ``format_string`` rounds the shortest decimal form instead, which differs on values
    such as 0.15 that lie just below a tie; only values near a tie take the exact way.
    """
    x = _c(x).cast("double")
    mag = F.abs(x)
    whole = F.floor(mag)
    # the fraction in units of 2**-81, from three exact 27-bit pieces
    unit, rest, exact = F.lit(float(2**27)), mag - whole, None
    for _ in range(3):
        piece = F.floor(rest * unit)
        rest = rest * unit - piece
        digits = piece.cast("decimal(9,0)")
        exact = digits if exact is None else exact * F.lit(2**27).cast("decimal(9,0)") + digits
    scaled = exact.cast("decimal(25,0)") * F.lit(10**precision).cast("decimal(8,0)")
    one, half = (F.lit(str(2**e)).cast("decimal(25,0)") for e in (81, 80))
    down, left = F.call_function("div", scaled, one), scaled % one
    up = (left > half) | ((left == half) & (down % 2 == 1))
    frac = down + F.when(up, 1).otherwise(0)
    carry = frac >= 10**precision
    whole = whole + F.when(carry, 1).otherwise(0)
    digits = F.lpad(F.when(carry, F.lit(0)).otherwise(frac).cast("string"), precision, "0")
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("." if precision else ""), digits if precision else F.lit(""))
    shifted = mag * F.lit(float(10**precision))
    near_tie = (F.abs(shifted - F.floor(shifted) - 0.5) < 1e-3) & (mag < 1e15)
    return F.when(near_tie, text).when(x.isNotNull(), F.format_string(f"%.{precision}f", x))


def format_floats(df: DataFrame, precision: int = 6) -> DataFrame:
    """Every float column as fixed-precision text; nulls stay null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(fixed_decimals(c, precision).alias(c) if c in floats else F.col(c) for c in df.columns))
