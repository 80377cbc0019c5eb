"""Semantic codes and the token ids they map to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recquarry.functions.arrays import let

# Token layout of the code vocabulary.
START_ID = 151669
CODES_PER_LAYER = 256
N_LAYERS = 4


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def format_sem_id(codes) -> Column:
    """Codes to ``<a_1><b_2>...``."""
    return F.array_join(
        F.transform(
            _c(codes), lambda c, i: F.concat(F.lit("<"), F.char(i + 97), F.lit("_"), c.cast("string"), F.lit(">"))
        ),
        "",
    )


def parse_sem_id(text, n_layers: int = N_LAYERS, layer_size: int = CODES_PER_LAYER) -> Column:
    """Text to one code per layer; absent or out-of-range layers give -1, later copies win."""
    found = F.transform(
        F.regexp_extract_all(_c(text), F.lit(r"(<[a-z]_\d+>)"), 1),
        lambda t: F.struct(
            (F.ascii(F.substring(t, 2, 1)) - 97).alias("layer"),
            F.regexp_extract(t, r"_(\d+)>", 1).try_cast("int").alias("code"),
        ),
    )
    valid = F.filter(found, lambda x: (x["layer"] < n_layers) & (x["code"] < layer_size))

    def last(marks, layer: int) -> Column:
        here = F.filter(marks, lambda x: x["layer"] == layer)
        return F.coalesce(F.try_element_at(here, F.lit(-1))["code"], F.lit(-1))

    return let(valid, lambda marks: F.array(*(last(marks, i) for i in range(n_layers))))


def code_to_token(layer, code, start: int = START_ID, layer_size: int = CODES_PER_LAYER) -> Column:
    return (F.lit(start) + _c(layer) * layer_size + _c(code)).cast("long")


def in_window(token, start: int = START_ID, n_layers: int = N_LAYERS, layer_size: int = CODES_PER_LAYER) -> Column:
    return (_c(token) >= start) & (_c(token) < start + n_layers * layer_size)


def token_to_code(token, start: int = START_ID, n_layers: int = N_LAYERS, layer_size: int = CODES_PER_LAYER) -> Column:
    """struct(layer, code); null outside the code window."""
    off = _c(token) - start
    layer = F.floor(off / F.lit(layer_size)).cast("long")
    return F.when(
        in_window(token, start, n_layers, layer_size), F.struct(layer.alias("layer"), (off - layer * layer_size).alias("code"))
    )


def code_tail(tokens, start: int = START_ID, n_layers: int = N_LAYERS, layer_size: int = CODES_PER_LAYER) -> Column:
    """Longest suffix of at most ``n_layers`` tokens that all lie in the code window."""
    t = _c(tokens)
    n = F.size(t)

    def from_end(i: int) -> Column:
        return F.coalesce(in_window(F.get(t, n - F.lit(i)), start, n_layers, layer_size), F.lit(False))

    # number of trailing in-window tokens, counted up to n_layers
    run = reduce(
        lambda inner, i: F.when(from_end(i), F.lit(1) + inner).otherwise(F.lit(0)), range(n_layers, 0, -1), F.lit(0)
    )
    return F.when(run > 0, F.slice(t, n - run + 1, F.greatest(run, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
