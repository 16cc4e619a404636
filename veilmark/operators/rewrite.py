"""Bring tokens back to the rows their values came from."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.rewrite import key_pattern, replace_values
from veilmark.operators.common import join_on_value, small

#: Values of one row up to which its text is rewritten by an alternation of them, whose time is values times text.
LARGE_MAP = 64


def widest(hits: DataFrame, key: list[str], n_hits: int) -> int:
    """The largest number of hits of one row key, or an upper bound that is within :data:`LARGE_MAP`."""
    if n_hits <= LARGE_MAP:
        return n_hits
    return hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def exchanger(mapping: dict[str, str], word_boundary: bool):
    """Function that exchanges the keys of *mapping* in a text in one pass, the longest at each place.

    At a place every length of key is looked up once, so time does not grow with the number of keys.
    """
    lengths = sorted({len(k) for k in mapping if k}, reverse=True)
    heads = {k[:1] for k in mapping}

    def inner(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at] == "_" or unicodedata.category(text[at])[0] in "LN")

    def exchange(text: str) -> str:
        out, done, at = [], 0, 0
        while at < len(text):
            if text[at] in heads and not (word_boundary and inner(text, at - 1)):
                for n in lengths:
                    token = mapping.get(text[at : at + n]) if at + n <= len(text) else None
                    if token is not None and not (word_boundary and inner(text, at + n)):
                        out += [text[done:at], token]
                        done = at = at + n
                        break
                else:
                    at += 1
            else:
                at += 1
        return "".join([*out, text[done:]])

    return exchange


def _exchanged(word_boundary: bool):
    @F.pandas_udf("string")
    def run(texts: pd.Series, keys: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else exchanger(dict(zip(k, v)), word_boundary)(t) for t, k, v in zip(texts, keys, tokens)
        ], dtype=object)

    return run


def value_maps(hits: DataFrame, key: list[str], lookup: DataFrame, lookup_bytes: int, bound: int) -> DataFrame:
    """Per row key the map of its own values to tokens.

    The map of one key is bounded by its own text.
    """
    pair = F.struct("value", "token")
    return (
        join_on_value(hits.select(*key, "value"), lookup, lookup_bytes, bound)
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_set(pair)).alias("mapping"))
    )


def rewrite_text(
    df: DataFrame,
    key: list[str],
    text_col: str,
    maps: DataFrame,
    maps_bytes: int,
    bound: int,
    *,
    word_boundary: bool = False,
    has_hits: str | None = None,
    large: bool = False,
) -> DataFrame:
    """Replace values in *text_col* by the map of the row's key.

    Maps within *bound* are broadcast, so texts stay where they are.  Larger ones meet the
    texts in a shuffle; the condition *has_hits* then keeps texts without any span out of it.
    *large* tells that some maps may have more than :data:`LARGE_MAP` values; their texts are rewritten by look-up.
    """
    columns = df.columns
    pattern = F.expr(key_pattern("mapping", word_boundary))
    new = F.expr(replace_values(f"`{text_col}`", "mapping", "pattern")).alias(text_col)

    def joined(rows: DataFrame) -> DataFrame:
        wide = F.coalesce(F.size("mapping"), F.lit(0)) > LARGE_MAP
        with_pattern = maps.withColumn("pattern", F.when(~wide, pattern) if large else pattern)
        both = rows.join(small(with_pattern, maps_bytes, bound), key, "left")

        def written(some: DataFrame, text) -> DataFrame:
            return some.select(*[text if c == text_col else F.col(f"`{c}`") for c in columns])

        if not large:
            return written(both, new)
        look_up = _exchanged(word_boundary)(F.col(f"`{text_col}`"), F.map_keys("mapping"), F.map_values("mapping")).alias(text_col)
        return written(both.filter(~wide), new).unionByName(written(both.filter(wide), look_up))

    if maps_bytes <= bound or has_hits is None:
        return joined(df)
    return joined(df.filter(has_hits)).unionByName(df.filter(f"NOT ({has_hits})"))
