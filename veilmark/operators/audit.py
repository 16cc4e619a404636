"""Proof that no registered value is still visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.config import Settings
from veilmark.functions.rewrite import tokens_in
from veilmark.operators import detect as DET
from veilmark.operators import dictionary as D
from veilmark.operators.registry import forward


def own_leaks(redacted: DataFrame, text_col: str, key: Sequence[str], hits: DataFrame) -> DataFrame:
    """Values found in a text before that its redacted form still shows.

    An equi-join on the row key: every text is compared with its own values only.
    """
    own = hits.groupBy(*key).agg(F.collect_set("value").alias("_values"))
    visible = F.filter("_values", lambda v: F.contains(F.col(text_col), v))
    return redacted.join(own, list(key)).select(*key, F.explode(visible).alias("value"))


def registry_leaks(
    redacted: DataFrame, text_col: str, key: Sequence[str], registry: DataFrame, settings: Settings
) -> DataFrame:
    """Any registered value, exact in case, visible in any text: ``key + (value, etype)``.

    Runs the dictionary search over the registry, hence by a rare-gram index if it is large.
    """
    spark = redacted.sparkSession
    values = forward(registry).select(F.col("value").alias("term")).distinct()
    search = Settings(
        company_terms=values,
        dictionary_chars=settings.dictionary_chars,
        small_dictionary_terms=settings.small_dictionary_terms,
    )
    dictionary = D.load(spark, search)
    found = D.find(redacted, list(key), text_col, dictionary)
    seen = DET.span_rows(found, list(key), "spans").select(*key, "value").distinct()
    types = registry.filter("active").select("value", "etype")
    exempt = list(settings.subject_keys) or [""]
    return (
        seen.join(types, "value")
        .filter(~F.col("etype").isin(*sorted(settings.dropped_types) or [""]))
        .filter(~F.lower("value").isin(*exempt))
        .select(*key, "value", "etype")
    )


def existing_tokens(df: DataFrame, text_col: str, key: Sequence[str]) -> DataFrame:
    """Bracket tokens present before a run; restoring could not tell them from its own."""
    token = F.expr(f"explode({tokens_in(DET.ident(text_col))})").alias("token")
    return df.select(*key, token).filter(F.col("token").rlike(r"^\[[A-Z_]+_[0-9]+(_FIRST|_LAST)?\]$"))
