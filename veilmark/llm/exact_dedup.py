"""Exact deduplication in which only possibly repeated texts are shuffled.

Pass one counts how often each cell of a Bloom filter is hit and keeps the cells hit twice
or more: the filter of possibly repeated hashes.  Pass two tests every row against it.  A row
that fails the test has a text of its own and passes straight through; the others are grouped
by SHA-256, aggregated on the map side first, so a text with a third of all rows sends one
row per task.  The filter has a fixed greatest size (``max_cells``); when the table outgrows
it, more rows are shuffled and the result stays the same.

Defined cases: a null text counts as empty; a null id loses to any id; of rows with equal id
and text one stays; an empty table gives an empty result; other columns are carried as they
are, whatever their names.  Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import MAX_CELLS, bloom_cells, bloom_hits, bloom_words, cut, join_groups, text_or_empty


def with_possible_repeats(rows: DataFrame, max_cells: int) -> DataFrame:
    """Add ``_again``: the hash ``_h`` may occur twice.  *rows* are evaluated twice."""
    cells = bloom_cells(rows.count(), most=max_cells)
    return bloom_hits(rows, bloom_words(rows.select("_h"), cells, at_least=2), "_h", cells, "_again")


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays.  Repeated rows of that same id are all
    marked kept, as they cannot be told apart; :func:`dedup` leaves one of them.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("_h")
    )
    tagged = cut(with_possible_repeats(rows, max_cells).drop("_h"))
    own = tagged.filter(~F.col("_again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    repeated = tagged.filter("_again").drop("_again")
    groups = cut(
        repeated.groupBy("text_sha256").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
    )
    judged = join_groups(repeated, groups, "text_sha256", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return own.unionByName(judged)


def _rank(id_col: str) -> Column:
    return F.struct(F.col(f"_row.{id_col}").isNotNull().alias("has_id"), F.col(f"_row.{id_col}").alias("id"))


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS
) -> DataFrame:
    """The rows of *docs* that stay, one per text, with all their columns."""
    text = text_or_empty(text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_h"))
    tagged = with_possible_repeats(rows, max_cells)
    own = tagged.filter(~F.col("_again")).select("_row.*")
    digest = F.sha2(text_or_empty(f"_row.{text_col}"), 256)
    winners = (
        tagged.filter("_again")
        .groupBy(digest.alias("_digest"))
        .agg(F.max_by("_row", _rank(id_col)).alias("_row"))
        .select("_row.*")
    )
    return own.union(winners)
