"""Exchange tokens by their original values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.rewrite import restore_tokens, tokens_in
from veilmark.operators.common import join_on_value, measure, stage
from veilmark.operators.detect import ident
from veilmark.operators.registry import reverse


def restore(
    df: DataFrame, columns: Sequence[str], registry: DataFrame, key: Sequence[str] = (), bound: int = 32 << 20
) -> DataFrame:
    """Restore the tokens in *columns*; unknown tokens and masks stay as they are.

    Rows without a bracket token pass by.  The others are written once with their tokens, which are
    looked up by join, so the registry may be of any size; every row then gets back a map of just
    its own tokens.  Rows are told apart by their place in that table, *key* may repeat or be left out.
    """
    # Looked up by token, which therefore plays the part of the value here.
    back = reverse(registry).select(F.col("token").alias("value"), F.col("value").alias("original"))
    _, back_bytes = measure(registry, "value", "token")
    found = ", ".join(tokens_in(ident(c)) for c in columns)
    marked = df.withColumn("_tokens", F.expr(f"array_distinct(concat({found}))"))
    held = stage(marked.filter("size(_tokens) > 0")).withColumn("_row", F.monotonically_increasing_id())
    present = held.select("_row", F.explode("_tokens").alias("value"))
    maps = (
        join_on_value(present, back, back_bytes, bound)
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", "original"))).alias("_map"))
    )
    restored = held.join(maps, "_row", "left").select(
        *[F.expr(restore_tokens(ident(c), "_map")).alias(c) if c in columns else F.col(ident(c)) for c in df.columns]
    )
    rest = marked.filter("size(_tokens) = 0").drop("_tokens")
    return restored.unionByName(rest)
