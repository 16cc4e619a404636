"""Tables: an anchor column ties the other columns of a row to one person.

Each table is laid out as cells ``(key, ord, col, role, text, anchor)``.  ``col`` is the
place of the cell in its row: anchor first, then the correlated columns in configured
order, then the rest in table order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from veilmark.config import Settings
from veilmark.functions import scalars as S
from veilmark.functions.patterns import ANCHOR_CANDIDATES
from veilmark.functions.rewrite import key_pattern, replace_values
from veilmark.operators import detect as DET
from veilmark.operators import dictionary as D
from veilmark.operators import events as E
from veilmark.operators.common import join_on_value, small

ANCHOR, CORRELATED, FORCED, SCANNED = "anchor", "correlated", "forced", "scanned"
ENTRIES = "array<struct<col:int,whole:boolean,value:string,token:string>>"
HIT = "array<struct<value:string,etype:string,kind:string,whole:boolean,rank:int>>"


def resolve_anchor(columns: Sequence[str], argument: str | None, configured: str | None) -> str | None:
    """Argument, then configuration, then the usual names; exact spelling goes first."""
    folded = {c.lower(): c for c in columns}
    for wanted in (argument, configured):
        if wanted and wanted in columns:
            return wanted
        if wanted and wanted.lower() in folded:
            return folded[wanted.lower()]
    return next((folded[c] for c in ANCHOR_CANDIDATES if c in folded), None)


@dataclass(frozen=True)
class TablePlan:
    """A table and the role of each of its columns."""

    df: DataFrame
    key: list[str]
    order_by: list[str]
    anchor: str | None
    roles: dict[str, str]
    src: int = 0

    def columns_of(self, *roles: str) -> list[str]:
        return [c for c, r in self.roles.items() if r in roles]

    @property
    def direct(self) -> list[str]:
        return self.columns_of(ANCHOR, CORRELATED, FORCED)


def plan_table(
    df: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str] | None,
    settings: Settings,
    *,
    anchor: str | None = None,
    force_fields: Sequence[str] | None = None,
    scan: Sequence[str] | None = None,
    src: int = 0,
) -> TablePlan:
    """Assign roles.  *scan* limits detection to some columns; by default all others.

    Key columns that are not text are left out of that default and keep their type.
    """
    anchor_col = resolve_anchor(df.columns, anchor, settings.anchor_field)
    correlated = [c for c in dict.fromkeys(settings.correlated_fields) if c in df.columns]
    forced = set(settings.force_fields if force_fields is None else force_fields)
    roles: dict[str, str] = {}
    if anchor_col is not None:
        roles[anchor_col] = ANCHOR
        roles.update({c: CORRELATED for c in correlated if c != anchor_col})
    for c in df.columns:
        if c not in roles:
            if c in forced:
                roles[c] = FORCED
            elif c in scan if scan is not None else c not in key or df.schema[c].dataType == StringType():
                roles[c] = SCANNED
    order = list(order_by) if order_by else list(key)
    return TablePlan(df, list(key), order, anchor_col, roles, src)


def raw_text(df: DataFrame, name: str) -> str:
    """A cell as text; nested values as JSON."""
    nested = isinstance(df.schema[name].dataType, (StructType, ArrayType, MapType))
    return f"to_json({DET.ident(name)})" if nested else f"CAST({DET.ident(name)} AS STRING)"


def cells(plan: TablePlan, roles: Sequence[str]) -> DataFrame:
    """Non-empty cells.  Without an anchor value a row's other cells are not scanned."""
    anchor = S.cell_text_sql(raw_text(plan.df, plan.anchor)) if plan.anchor else "CAST(NULL AS STRING)"

    def cell(i: int, name: str, role: str) -> str:
        text = S.cell_text_sql(raw_text(plan.df, name))
        if role == SCANNED and plan.anchor:
            text = f"CASE WHEN _anchor IS NOT NULL THEN {text} END"
        return f"named_struct('col', {i}, 'role', '{role}', 'text', {text})"

    wanted = ", ".join(cell(i, c, r) for i, (c, r) in enumerate(plan.roles.items()) if r in roles)
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(plan.key)]
    return (
        plan.df.withColumn("_anchor", F.expr(anchor))
        .select(
            *keys, E.order_struct(plan.order_by).alias("ord"), F.col("_anchor").alias("anchor"),
            F.expr(f"inline_outer(array({wanted}))"),
        )
        .filter("text IS NOT NULL")
    )


def is_whole_name(spans: str = "entities", text: str = "text") -> str:
    """Condition: a person is among the spans and they cover at least 70 % of the cell."""
    covered = f"aggregate({spans}, 0, (n, s) -> n + s.`end` - s.start)"
    return f"exists({spans}, s -> s.etype = 'PERSON') AND {covered} / length({text}) >= 0.7"


def scanned_hits(settings: Settings) -> str:
    """Hits of a detected cell: the whole cell as one name, or its allowed spans."""
    card = f"WHEN s.etype = 'CREDIT_CARD' THEN '{E.CARD}' " if "CREDIT_CARD" in settings.active_masks else ""
    kind = f"CASE WHEN s.etype = 'PERSON' THEN '{E.PERSON}' {card}ELSE '{E.TOKEN}' END"
    name = (
        f"array(named_struct('value', text, 'etype', 'PERSON', 'kind', '{E.PERSON}', 'whole', true, 'rank', 0))"
    )
    parts = (
        f"transform(filter(entities, s -> {DET.allowed(settings)}), (s, i) -> named_struct("
        f"'value', s.value, 'etype', s.etype, 'kind', {kind}, 'whole', false, 'rank', i))"
    )
    found = f"CASE WHEN {is_whole_name()} THEN {name} ELSE {parts} END"
    return f"CASE WHEN NOT {DET.is_subject('text', settings)} THEN {found} END"


def direct_hits(settings: Settings) -> str:
    """Hit of an anchor, correlated or forced cell, taken whole and without detection.

    An exempt anchor still gives its row a person; its own cell stays as it is.
    """
    mail = "contains(text, '@')"
    etype = f"CASE WHEN {mail} AND role <> '{ANCHOR}' THEN 'EMAIL' ELSE 'PERSON' END"
    kind = (
        f"CASE WHEN role = '{ANCHOR}' THEN '{E.PERSON}' "
        f"WHEN role = '{CORRELATED}' AND anchor IS NULL THEN CASE WHEN {mail} THEN '{E.TOKEN}' ELSE '{E.PLAIN}' END "
        f"WHEN role = '{CORRELATED}' THEN CASE WHEN {mail} THEN '{E.EMAIL_OF}' ELSE '{E.ALIAS}' END "
        f"WHEN {mail} THEN '{E.TOKEN}' ELSE '{E.PERSON}' END"
    )
    hit = f"array(named_struct('value', text, 'etype', {etype}, 'kind', {kind}, 'whole', true, 'rank', 0))"
    return f"CASE WHEN role = '{ANCHOR}' OR NOT {DET.is_subject('text', settings)} THEN {hit} END"


def _hit_rows(found: DataFrame, keep: list[str], hit: str) -> DataFrame:
    return (
        found.select(*keep, F.expr(f"explode_outer(CAST({hit} AS {HIT}))").alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(*keep, "hit.*")
    )


def _kept(plan: TablePlan) -> list[str]:
    return [*[f"k{i}" for i in range(len(plan.key))], "ord", "col", "anchor"]


def direct_rows(plan: TablePlan, settings: Settings) -> DataFrame:
    """Hit rows ``k*, ord, col, anchor, value, etype, kind, whole, rank`` of whole cells."""
    return _hit_rows(cells(plan, (ANCHOR, CORRELATED, FORCED)), _kept(plan), direct_hits(settings))


def scanned_rows(plan: TablePlan, settings: Settings, dictionary: D.Dictionary) -> DataFrame:
    """The same rows for detected cells."""
    keep = _kept(plan)
    detected = DET.detect(cells(plan, (SCANNED,)), "text", [*keep, "text"], settings, dictionary)
    return _hit_rows(detected, keep, scanned_hits(settings))


def spare(rows: DataFrame, settings: Settings, anchored: bool) -> DataFrame:
    """Hit rows without the values of a table of data subjects; an anchor still gives its row a person."""
    subjects = DET.subject_keys_table(settings)
    if subjects is None:
        return rows
    anchor = F.col("col") == 0 if anchored else F.lit(False)
    return rows.filter(anchor).unionByName(DET.without(rows.filter(~anchor), F.lower(S.strip(F.col("value"))), subjects))


def events(hit_rows: DataFrame, src: int) -> DataFrame:
    place = E.seq(F.lit(src), F.col("ord"), F.col("col"), F.col("rank"))
    linked = F.col("kind").isin(E.ALIAS, E.EMAIL_OF)
    return hit_rows.select(
        "value", "etype", "kind", F.when(linked, F.col("anchor")).alias("anchor"), place.alias("seq")
    )


def apply_tokens(
    plan: TablePlan,
    settings: Settings,
    scanned: DataFrame | None,
    scanned_bytes: int,
    lookup: DataFrame,
    lookup_bytes: int,
) -> DataFrame:
    """Write the tokens back; column order stays, columns in a role become strings.

    With a *lookup* small enough to broadcast, whole cells are exchanged in place, column
    by column and without a shuffle; only hits inside scanned cells travel by row key.
    Otherwise all hits do, in one round however many columns there are.
    """
    bound = settings.broadcast_bytes
    narrow = lookup_bytes <= bound
    df, in_place = _exchange_cells(plan, lookup) if narrow else (plan.df, {})
    travelling = [scanned] if scanned is not None else []
    if not narrow and plan.direct:
        travelling.append(direct_rows(plan, settings))
        scanned_bytes = lookup_bytes
    if travelling:
        keys = [f"k{i}" for i in range(len(plan.key))]
        entries = (
            join_on_value(reduce(DataFrame.unionByName, travelling), lookup, lookup_bytes, bound)
            .groupBy(*keys)
            .agg(F.collect_set(F.struct("col", "whole", "value", "token")).alias("_entries"))
        )
        same = [F.col(k) == F.col(f"k{i}") for i, k in enumerate(plan.key)]
        df = df.join(small(entries, scanned_bytes, bound), same, "left")
    else:
        df = df.withColumn("_entries", F.expr(f"CAST(NULL AS {ENTRIES})"))
    place = {c: i for i, c in enumerate(plan.roles)}
    df = _with_cell_maps(df, {c: place[c] for c in plan.columns_of(SCANNED)}, settings.word_boundary)

    def output(name: str) -> str:
        if name not in plan.roles:
            return DET.ident(name)
        cell = raw_text(plan.df, name)
        text = S.cell_text_sql(cell)
        exempt = DET.is_subject(text, settings)
        if name in in_place:
            return f"coalesce(CASE WHEN NOT {exempt} THEN {in_place[name]} END, {cell})"
        own = f"filter(_entries, e -> e.col = {place[name]})"
        # By value as well, so rows that repeat a key do not get each other's tokens.
        whole = f"try_element_at(transform(filter({own}, e -> e.whole AND e.value = {text}), e -> e.token), 1)"
        if plan.roles[name] != SCANNED:
            return f"coalesce(CASE WHEN NOT {exempt} THEN {whole} END, {cell})"
        i = place[name]
        changed = replace_values(text, f"_map{i}", f"_pattern{i}")
        return f"CASE WHEN _pattern{i} IS NULL THEN {cell} ELSE coalesce({whole}, {changed}) END"

    return df.select(*[F.expr(output(c)).alias(c) for c in plan.df.columns])


def _with_cell_maps(df: DataFrame, places: dict[str, int], word_boundary: bool) -> DataFrame:
    """Per scanned column the map of its own values, and the pattern of their keys."""
    own = "transform(filter(_entries, e -> e.col = {}), e -> struct(e.value, e.token))"
    maps = {f"_map{i}": F.expr(f"map_from_entries({own.format(i)})") for i in places.values()}
    patterns = {f"_pattern{i}": F.expr(key_pattern(f"_map{i}", word_boundary)) for i in places.values()}
    return df.withColumns(maps).withColumns(patterns) if places else df


def _exchange_cells(plan: TablePlan, lookup: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Broadcast joins for the whole-cell columns; returns where to find the new cells."""
    df, new = plan.df, {}
    for i, c in enumerate(plan.direct):
        side = lookup.select(F.col("value").alias(f"_v{i}"), F.col("token").alias(f"_t{i}"))
        text = F.expr(S.cell_text_sql(raw_text(plan.df, c)))
        df = df.join(F.broadcast(side), text == F.col(f"_v{i}"), "left")
        new[c] = f"_t{i}"
    return df, new
