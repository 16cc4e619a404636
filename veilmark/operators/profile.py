"""How well a column serves as the anchor of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import scalars as S


def anchor_profile(df: DataFrame, anchor: str, fields: Sequence[str]) -> DataFrame:
    """One row per field that is to follow the anchor.

    ``field``; ``cells``: cells that are not empty; ``without_anchor``: those in rows without an anchor value,
    which are registered on their own; ``values``: distinct values in rows with one; ``shared_values``: values
    seen under more than one anchor, which all get the token of the first; ``most_anchors``: the most
    anchors of one value.  Each row is read once; values are counted per anchor before they are shuffled
    on, so a value that fills a third of the table is one short row per task.
    """
    key = S.cell_text(F.col(f"`{anchor}`"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), S.cell_text(F.col(f"`{f}`")).alias("value")) for f in fields])
    long = df.select(key.alias("anchor"), F.inline(cells)).filter("value IS NOT NULL")
    pairs = long.groupBy("field", "value", "anchor").agg(F.count(F.lit(1)).alias("n"))
    per_value = pairs.groupBy("field", "value").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("anchor").isNull(), F.col("n")).otherwise(0)).alias("alone"),
        F.count("anchor").alias("anchors"),
    )
    return per_value.groupBy("field").agg(
        F.sum("n").alias("cells"), F.sum("alone").alias("without_anchor"), F.count_if(F.col("anchors") > 0).alias("values"),
        F.count_if(F.col("anchors") > 1).alias("shared_values"), F.max("anchors").alias("most_anchors"),
    )
