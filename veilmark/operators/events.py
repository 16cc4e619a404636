"""Registration events: what a run wants to enter into the registry, and in which order.

An event is ``(value, etype, kind, anchor, seq)``.  ``seq`` is a total order over the
whole run, so the result does not depend on partitioning::

    seq = (phase, src, ord, col, rank, sub)

``phase`` 0 is the roster, 1 the data; ``src`` the roster position or the ordinal of the
table; ``ord`` the row's order columns; ``col`` the place of the column within the row;
``rank`` the place of the span within the cell; ``sub`` 1 and 2 for name parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Kinds that take a number.
PERSON, PLAIN, TOKEN = "person", "plain", "token"
# Kinds that follow another value.
FIRST, LAST, ALIAS, EMAIL_OF = "first", "last", "alias_of", "email_of"
CARD = "card"

COLUMNS = ["value", "etype", "kind", "anchor", "seq"]


def seq(src: Column, order: Column, col: Column, rank: Column, phase: int = 1) -> Column:
    return F.struct(
        F.lit(phase).alias("phase"),
        src.cast("bigint").alias("src"),
        order.alias("ord"),
        col.cast("int").alias("col"),
        rank.cast("int").alias("rank"),
        F.lit(0).alias("sub"),
    )


def order_struct(order_by: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)])


def order_type(df: DataFrame, order_by: list[str]) -> StructType:
    return df.select(order_struct(order_by).alias("o")).schema["o"].dataType


def span_kind(etype: Column, masks: dict) -> Column:
    kind = F.when(etype == "PERSON", PERSON)
    if "CREDIT_CARD" in masks:
        kind = kind.when(etype == "CREDIT_CARD", CARD)
    return kind.otherwise(TOKEN)


def from_spans(spans: DataFrame, masks: dict, src: Column | None = None) -> DataFrame:
    """Events of span rows that carry ``ord``, ``rank``, ``etype`` and ``value``."""
    place = seq(F.lit(0) if src is None else src, F.col("ord"), F.lit(0), F.col("rank"))
    return spans.select(
        "value", "etype", span_kind(F.col("etype"), masks).alias("kind"),
        F.lit(None).cast("string").alias("anchor"), place.alias("seq"),
    )
