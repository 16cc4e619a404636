"""The public jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.config import Settings, for_dsar, for_redact
from veilmark.functions import scalars as S
from veilmark.operators import audit as AUD
from veilmark.operators import celltable as CELL
from veilmark.operators import detect as DET
from veilmark.operators import dictionary as D
from veilmark.operators import events as E
from veilmark.operators import registry as REG
from veilmark.operators import restore as RES
from veilmark.operators import rewrite as REW
from veilmark.operators import roster as ROS
from veilmark.operators import structured as STR
from veilmark.operators.common import cut, measure, spread, stage


#: Of staged texts, the rows with something to replace.
HAS_SPANS = "coalesce(size(_spans), 0) > 0"


@dataclass(frozen=True)
class TextInput:
    """Texts of a run.  See :func:`pseudonymise_text` for the fields."""

    df: DataFrame
    text_col: str
    key: Sequence[str]
    order_by: Sequence[str] | None = None
    document: Sequence[str] | None = None

    @property
    def order(self) -> list[str]:
        return list(self.order_by or self.key)


@dataclass(frozen=True)
class TableInput:
    """A table of a run.  See :func:`pseudonymise_table` for the fields."""

    df: DataFrame
    key: Sequence[str]
    order_by: Sequence[str] | None = None
    scan: Sequence[str] | None = None


@dataclass(frozen=True)
class CellInput:
    """Rows that bring their own columns: ``names, texts, layout``, as in :mod:`veilmark.operators.celltable`."""

    df: DataFrame
    key: Sequence[str]
    order_by: Sequence[str] | None = None


@dataclass(frozen=True)
class RunResult:
    """Rewritten inputs by name, the registry after the run, and the rows it added."""

    outputs: dict[str, DataFrame]
    registry: DataFrame
    added: DataFrame
    hits: dict[str, DataFrame]

    @property
    def df(self) -> DataFrame:
        (only,) = self.outputs.values()
        return only

    @property
    def only_hits(self) -> DataFrame:
        (only,) = self.hits.values()
        return only


def run(
    inputs: dict[str, TextInput | TableInput | CellInput],
    settings: Settings | None = None,
    *,
    previous: DataFrame | Callable[[DataFrame], REG.Previous] | None = None,
    anchor: str | None = None,
    force_fields: Sequence[str] | None = None,
    interleave: bool = False,
) -> RunResult:
    """Texts and tables with one registry.

    *previous* is an earlier registry, or a function that gives the part of it that the events of
    this run need.

    Values are numbered input by input in the given order, or, with *interleave*, by the
    order columns alone.  The order columns must have the same types in all inputs.
    """
    settings = settings or Settings()
    spark = next(iter(inputs.values())).df.sparkSession
    dictionary = D.load(spark, settings)
    order = _common_order(inputs)
    parts = {}
    for i, (name, given) in enumerate(inputs.items()):
        src = 0 if interleave else i
        if isinstance(given, TextInput):
            parts[name] = _TextPart(given, settings, dictionary, src)
        elif isinstance(given, CellInput):
            order_by = list(given.order_by or given.key)
            plan = CELL.CellPlan(given.df, list(given.key), order_by, src, anchor, tuple(force_fields or ()))
            parts[name] = _CellPart(plan, settings, dictionary)
        else:
            plan = STR.plan_table(
                given.df, given.key, given.order_by, settings,
                anchor=anchor, force_fields=force_fields, scan=given.scan, src=src,
            )
            parts[name] = _TablePart(plan, settings, dictionary)
    events = reduce(DataFrame.unionByName, [e for p in parts.values() for e in p.events])
    subjects = DET.subject_keys_table(settings)
    bounds = [p.bound for p in parts.values()]
    bound = None if None in bounds else sum(bounds)
    linked = any(p.linked for p in parts.values())
    usernames = None
    if settings.roster is not None:
        roster = ROS.placed(settings.roster)
        events = ROS.events(roster, order).unionByName(events)
        usernames, bound = ROS.usernames(roster), None
    if previous is not None:
        previous = REG.whole(previous) if isinstance(previous, DataFrame) else previous(events)
    added = cut(
        REG.build(
            events, settings.active_masks, bound=bound, previous=previous, usernames=usernames,
            linked=linked, single_task_rows=settings.single_task_rows,
        )
    )
    registry = added if previous is None else previous.rows.unionByName(added)
    lookup = REG.forward(registry)
    if subjects is not None:
        lookup = stage(DET.without(lookup, F.lower(S.strip(F.col("value"))), subjects))
    _, lookup_bytes = measure(lookup, "value", "token")
    outputs = {name: part.rewrite(lookup, lookup_bytes) for name, part in parts.items()}
    return RunResult(outputs, registry, added, {n: p.hits for n, p in parts.items() if p.hits is not None})


def _common_order(inputs):
    types = {
        name: E.order_type(i.df, list(i.order_by or i.key)) for name, i in inputs.items()
    }
    first = next(iter(types.values()))
    if any(t.simpleString() != first.simpleString() for t in types.values()):
        raise ValueError(f"order columns differ in type: { {n: t.simpleString() for n, t in types.items()} }")
    return first


class _TextPart:
    """Detection and rewriting of one text input.

    The input is read and searched once: rows and their spans are written as a columnar table,
    from which the events take the spans only and the rewriting takes the texts.  Spans that need
    joins, as with an oversized dictionary or policies as tables, are written without texts.
    """

    linked = False

    def __init__(self, given: TextInput, settings: Settings, dictionary: D.Dictionary, src: int) -> None:
        self.given, self.settings = given, settings
        key = [*given.key, "_ord"]
        in_row = DET.in_row(settings, dictionary)
        rows = spread(given.df, keep=not in_row).withColumn("_ord", E.order_struct(given.order))
        self.held = None
        if in_row:
            self.held = stage(DET.with_entities(rows, given.text_col, settings, dictionary, True, "_spans"))
            kept = self.held.filter(HAS_SPANS).select(*key, "_spans")
        else:
            kept = stage(DET.detect(rows, given.text_col, key, settings, dictionary, True).withColumnRenamed("entities", "_spans"))
        self.hits = DET.span_rows(kept, key, "_spans").withColumnRenamed("_ord", "ord")
        self.bound, self.bytes = measure(self.hits, "value")
        self.events = [E.from_spans(self.hits, settings.active_masks, F.lit(src))]

    def rewrite(self, lookup: DataFrame, lookup_bytes: int) -> DataFrame:
        given, settings = self.given, self.settings
        scope = list(given.document or given.key)
        maps = REW.value_maps(self.hits, scope, lookup, lookup_bytes, settings.broadcast_bytes)
        has_hits = HAS_SPANS if self.held is not None and given.document is None else None
        large = REW.widest(self.hits, scope, self.bound) > REW.LARGE_MAP
        out = REW.rewrite_text(
            # Per value a map holds the value, its token and its part of the pattern.
            given.df if self.held is None else self.held, scope, given.text_col, maps, 4 * self.bytes,
            settings.broadcast_bytes, word_boundary=settings.word_boundary, has_hits=has_hits, large=large,
        )
        return out.select(*[f"`{c}`" for c in given.df.columns])


class _TablePart:
    """Detection and rewriting of one table."""

    hits = None

    def __init__(self, plan: STR.TablePlan, settings: Settings, dictionary: D.Dictionary) -> None:
        if plan.columns_of(STR.SCANNED):
            plan = replace(plan, df=spread(plan.df, keep=True))
        self.plan, self.settings = plan, settings
        self.scanned, self.bytes = None, 0
        self.bound: int | None = 0
        self.events = []
        self.linked = STR.CORRELATED in plan.roles.values()
        if plan.direct:
            # As many rows as the table has cells, so these are read again, not stored.
            self.events.append(STR.events(STR.spare(STR.direct_rows(plan, settings), settings, plan.anchor is not None), plan.src))
            self.bound = None
        if plan.columns_of(STR.SCANNED):
            rows = stage(STR.spare(STR.scanned_rows(plan, settings, dictionary), settings, False))
            n, size = measure(rows, "value")
            self.events.append(STR.events(rows, plan.src))
            self.bound = None if self.bound is None else n
            if n:
                self.scanned, self.bytes = rows, 4 * size

    def rewrite(self, lookup: DataFrame, lookup_bytes: int) -> DataFrame:
        return STR.apply_tokens(self.plan, self.settings, self.scanned, self.bytes, lookup, lookup_bytes)


class _CellPart:
    """Detection and rewriting of rows with columns of their own."""

    hits, bound = None, None

    def __init__(self, plan: CELL.CellPlan, settings: Settings, dictionary: D.Dictionary) -> None:
        self.plan, self.settings = plan, settings
        self.linked = bool(settings.correlated_fields)
        self.rows = stage(STR.spare(CELL.hit_rows(plan, settings, dictionary, CELL.cells(plan, settings)), settings, True))
        _, self.bytes = measure(self.rows, "value")
        self.events = [CELL.events(self.rows, plan.src)]

    def rewrite(self, lookup: DataFrame, lookup_bytes: int) -> DataFrame:
        return CELL.apply_tokens(self.plan, self.settings, self.rows, 4 * self.bytes, lookup, lookup_bytes)


def pseudonymise_text(
    df: DataFrame,
    text_col: str,
    key: Sequence[str],
    settings: Settings | None = None,
    *,
    order_by: Sequence[str] | None = None,
    previous: DataFrame | None = None,
    document: Sequence[str] | None = None,
) -> RunResult:
    """Replace the sensitive values of a text column by tokens (or masks).

    *key* identifies a row.  *order_by* gives the order in which values are numbered
    (default: the key) and must be total.  *previous* continues an earlier registry.
    With *document*, a subset of the key, rows are paragraphs: values found in any
    paragraph are replaced in all paragraphs of the same document.
    """
    return run({"text": TextInput(df, text_col, key, order_by, document)}, settings, previous=previous)


def pseudonymise_table(
    df: DataFrame,
    key: Sequence[str],
    settings: Settings | None = None,
    *,
    order_by: Sequence[str] | None = None,
    anchor: str | None = None,
    force_fields: Sequence[str] | None = None,
    scan: Sequence[str] | None = None,
    previous: DataFrame | None = None,
) -> RunResult:
    """Replace the sensitive values of a table.

    The anchor column ties the correlated columns of a row to one person; forced columns
    are replaced whole; the others (or just *scan*) go through detection.  Columns with a
    role come back as text.
    """
    return run(
        {"table": TableInput(df, key, order_by, scan)}, settings,
        previous=previous, anchor=anchor, force_fields=force_fields,
    )


def pseudonymise_tables(
    tables: dict[str, TableInput], settings: Settings | None = None, **options
) -> RunResult:
    """Several tables with one registry; the anchor is chosen per table."""
    return run(dict(tables), settings, **options)


def redact_text(
    df: DataFrame, text_col: str, key: Sequence[str], settings: Settings | None = None, *,
    profile: str | None = None, passthrough: Iterable[str] = (), **options,
) -> DataFrame:
    """One-time redaction of texts: masks, 13 types, no registry kept."""
    job = for_redact(settings or Settings(), profile, passthrough)
    return pseudonymise_text(df, text_col, key, job, **options).df


def redact_table(
    df: DataFrame, key: Sequence[str], settings: Settings | None = None, *,
    profile: str | None = None, passthrough: Iterable[str] = (), **options,
) -> DataFrame:
    """One-time redaction of a table."""
    job = for_redact(settings or Settings(), profile, passthrough)
    return pseudonymise_table(df, key, job, **options).df


def dsar_text(
    df: DataFrame, text_col: str, key: Sequence[str], subject: dict, settings: Settings | None = None, **options
) -> DataFrame:
    """Everything but the data subject's own values is masked or tokenised."""
    return pseudonymise_text(df, text_col, key, for_dsar(settings or Settings(), subject), **options).df


def dsar_table(
    df: DataFrame, key: Sequence[str], subject: dict, settings: Settings | None = None, **options
) -> DataFrame:
    return pseudonymise_table(df, key, for_dsar(settings or Settings(), subject), **options).df


def restore(df: DataFrame, columns: Sequence[str], registry: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return RES.restore(df, columns, registry, key)


def audit(
    redacted: DataFrame, text_col: str, key: Sequence[str], registry: DataFrame,
    settings: Settings | None = None, hits: DataFrame | None = None,
) -> DataFrame:
    """Rows for values still visible.  With *hits*, each text is checked for its own values."""
    if hits is not None:
        return AUD.own_leaks(redacted, text_col, key, hits)
    return AUD.registry_leaks(redacted, text_col, key, registry, settings or Settings())


def redact_folder(*args, **kwargs):
    from veilmark.plans.folder import redact_folder as run

    return run(*args, **kwargs)
