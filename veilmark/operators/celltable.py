"""Rows that bring their own columns: ``names`` and ``texts`` as arrays, one layout per file.

Files of one folder differ in their columns.  Here every row carries them, and the role of each cell
follows from the layout of its own file, by expressions: nothing is merged between files, and their
number and variety are not limited.  Cells become the same rows as those of
:mod:`veilmark.operators.structured`, with ``at``, the place of a cell in its row, beside ``col``, its
place in the order of numbering.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.config import Settings
from veilmark.functions import scalars as S
from veilmark.functions.patterns import ANCHOR_CANDIDATES
from veilmark.functions.rewrite import key_pattern, replace_values
from veilmark.functions.spans import lit
from veilmark.operators import detect as DET
from veilmark.operators import dictionary as D
from veilmark.operators import events as E
from veilmark.operators import structured as STR
from veilmark.operators.common import join_on_value, small


@dataclass(frozen=True)
class CellPlan:
    """Rows with ``names, texts, layout`` and how to treat them."""

    df: DataFrame
    key: list[str]
    order_by: list[str]
    src: int = 0
    anchor: str | None = None
    force_fields: tuple[str, ...] = ()


def anchor_name(settings: Settings, argument: str | None, layout: str = "layout") -> str:
    """Expression: the anchor among the names of *layout*, as :func:`structured.resolve_anchor` chooses it."""
    tries = []
    for wanted in (argument, settings.anchor_field):
        if wanted:
            tries.append(f"CASE WHEN array_contains({layout}, {lit(wanted)}) THEN {lit(wanted)} END")
            tries.append(f"try_element_at(filter({layout}, c -> lower(c) = {lit(wanted.lower())}), -1)")
    tries += [f"try_element_at(filter({layout}, c -> lower(c) = {lit(c)}), -1)" for c in ANCHOR_CANDIDATES]
    return f"coalesce({', '.join(tries)})"


def _in(values: Sequence[str], value: str) -> str:
    return f"{value} IN ({', '.join(lit(v) for v in values)})" if values else "false"


def cells(plan: CellPlan, settings: Settings) -> DataFrame:
    """Non-empty cells ``k*, ord, anchor, at, col, role, text``; without an anchor value others are not scanned."""
    correlated = list(dict.fromkeys(settings.correlated_fields))
    role = (
        f"CASE WHEN names[i] = _anchor_name THEN '{STR.ANCHOR}' "
        f"WHEN _anchor_name IS NOT NULL AND {_in(correlated, 'names[i]')} THEN '{STR.CORRELATED}' "
        f"WHEN {_in(plan.force_fields or tuple(settings.force_fields), 'names[i]')} THEN '{STR.FORCED}' ELSE '{STR.SCANNED}' END"
    )
    listed = f"array({', '.join(lit(c) for c in correlated)})" if correlated else "CAST(array() AS array<string>)"
    col = (
        f"CAST(CASE c.role WHEN '{STR.ANCHOR}' THEN 0 WHEN '{STR.CORRELATED}' THEN array_position({listed}, c.name) "
        f"ELSE {len(correlated) + 1} + c.at END AS int)"
    )
    all_cells = f"transform(texts, (t, i) -> named_struct('at', i, 'name', names[i], 'role', {role}, 'text', {S.cell_text_sql('t')}))"
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(plan.key)]
    anchor = f"try_element_at(transform(filter(_cells, c -> c.role = '{STR.ANCHOR}'), c -> c.text), 1)"
    rows = plan.df.withColumn("_anchor_name", F.expr(anchor_name(settings, plan.anchor)))
    rows = rows.withColumn("_cells", F.expr(all_cells)).withColumn("_anchor", F.expr(anchor))
    wanted = f"c.text IS NOT NULL AND (c.role <> '{STR.SCANNED}' OR _anchor_name IS NULL OR _anchor IS NOT NULL)"
    spread = f"transform(filter(_cells, c -> {wanted}), c -> named_struct('at', c.at, 'col', {col}, 'role', c.role, 'text', c.text))"
    return rows.select(
        *keys, E.order_struct(plan.order_by).alias("ord"), F.col("_anchor").alias("anchor"), F.expr(f"inline({spread})")
    )


def kept(plan: CellPlan) -> list[str]:
    return [*[f"k{i}" for i in range(len(plan.key))], "ord", "at", "col", "anchor"]


def hit_rows(plan: CellPlan, settings: Settings, dictionary: D.Dictionary, all_cells: DataFrame) -> DataFrame:
    """Hits of all *all_cells*: whole ones of anchor, correlated and forced cells, detected ones of the others."""
    keep = kept(plan)
    scanned = all_cells.filter(F.col("role") == STR.SCANNED)
    detected = DET.detect(scanned, "text", [*keep, "text"], settings, dictionary)
    inside = STR._hit_rows(detected, keep, STR.scanned_hits(settings))
    whole = STR._hit_rows(all_cells.filter(F.col("role") != STR.SCANNED), keep, STR.direct_hits(settings))
    return whole.unionByName(inside)


def apply_tokens(plan: CellPlan, settings: Settings, hits: DataFrame, hits_bytes: int, lookup: DataFrame, lookup_bytes: int) -> DataFrame:
    """``texts`` with the tokens written in; a cell is rewritten by its own hits only."""
    bound = settings.broadcast_bytes
    keys = [f"k{i}" for i in range(len(plan.key))]
    entries = (
        join_on_value(hits.select(*keys, "at", "whole", "value"), lookup, lookup_bytes, bound)
        .groupBy(*keys).agg(F.collect_set(F.struct("at", "whole", "value", "token")).alias("_entries"))
    )
    same = [F.col(k) == F.col(f"k{i}") for i, k in enumerate(plan.key)]
    df = plan.df.join(small(entries, hits_bytes, bound), same, "left")
    text = S.cell_text_sql("t")
    own = "filter(_entries, e -> e.at = i)"
    whole = f"try_element_at(transform(filter(o.own, e -> e.whole AND e.value = {text}), e -> e.token), 1)"
    mapped = "map_from_entries(transform(array_distinct(transform(o.own, e -> named_struct('value', e.value, 'token', e.token))), e -> struct(e.value, e.token)))"
    changed = replace_values(text, "m.map", "m.pattern")
    one = f"transform(array(named_struct('map', {mapped})), n -> named_struct('map', n.map, 'pattern', {key_pattern('n.map', settings.word_boundary)}))"
    inner = f"transform({one}, m -> coalesce({whole}, {changed}))[0]"
    exempt = DET.is_subject(text, settings)
    cell = (
        f"transform(array(named_struct('own', {own})), o -> "
        f"CASE WHEN coalesce(size(o.own), 0) <= 0 OR {exempt} THEN t ELSE coalesce({inner}, t) END)[0]"
    )
    new = F.expr(f"CASE WHEN _entries IS NULL THEN texts ELSE transform(texts, (t, i) -> {cell}) END").alias("texts")
    return df.select(*[new if c == "texts" else F.col(f"`{c}`") for c in plan.df.columns])


def events(hits: DataFrame, src: int) -> DataFrame:
    return STR.events(hits, src)
