"""Detection: text in, non-overlapping spans out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.config import Settings
from veilmark.functions import scalars as S
from veilmark.functions import spans as SP
from veilmark.functions.patterns import PATTERN_RULES, rules_of
from veilmark.functions.scalars import strip_sql
from veilmark.operators import dictionary as D


def ident(column: str) -> str:
    """Column name as SQL expression text."""
    return "`" + column.replace("`", "``") + "`"


def pattern_spans(text: str, settings: Settings) -> str:
    """Spans of the pattern recognisers that the mode asks for."""
    rules = rules_of(settings.entity_types)
    if settings.domain_suffixes is not None:
        rules = [r for r in rules if r.etype != "DOMAIN"]
    return SP.rules_spans(text, (*rules, *settings.rules))


def _listed(values) -> str:
    return "(" + ", ".join(SP.lit(v) for v in values) + ")"


def settle(spans: str, settings: Settings) -> str:
    """Resolve overlaps and drop excluded terms.

    A term spelled exactly like its lower-cased exclusion never enters the contest; in
    any other spelling it is dropped afterwards and still blocks what it overlaps.
    """
    excluded = settings.excluded_keys
    if not excluded:
        return SP.drop_overlaps(spans)
    entering = f"filter({spans}, s -> s.value NOT IN {_listed(excluded)})"
    return f"filter({SP.drop_overlaps(entering)}, s -> lower(s.value) NOT IN {_listed(excluded)})"


def allowed(settings: Settings, span: str = "s") -> str:
    """Condition on a span: neither a type that passes through nor a subject value."""
    tests = []
    if settings.dropped_types:
        tests.append(f"{span}.etype NOT IN {_listed(sorted(settings.dropped_types))}")
    if settings.subject_keys:
        tests.append(f"NOT {is_subject(f'{span}.value', settings)}")
    return " AND ".join(tests) or "true"


def is_subject(value: str, settings: Settings) -> str:
    keys = settings.subject_keys
    return f"coalesce(lower({strip_sql(value)}) IN {_listed(keys)}, false)" if keys else "false"


def _found(text_col: str, settings: Settings, dictionary: D.Dictionary | None) -> Column:
    """All spans of a text, overlaps included."""
    text = ident(text_col)
    parts = [F.expr(pattern_spans(text, settings))]
    if dictionary is not None and not dictionary.empty:
        parts.append(D.spans(text_col, dictionary))
    if settings.ner is not None:
        model = settings.ner(F.col(text_col)).cast(SP.SPANS_TYPE)
        parts.append(F.filter(model, lambda s: s["etype"].isin(*settings.entity_types)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def with_entities(
    df: DataFrame, text_col: str, settings: Settings, dictionary: D.Dictionary, only_allowed: bool = False,
    name: str = "entities",
) -> DataFrame:
    """Add ``entities`` (or *name*): the settled spans of a text, best first.

    Needs a dictionary that is searched in the row.  With *only_allowed*, types that pass
    through and subject values are left out.
    """
    spans = settle("_found", settings)
    if only_allowed:
        spans = f"filter({spans}, s -> {allowed(settings)})"
    whole = f"CASE WHEN {ident(text_col)} IS NOT NULL THEN {spans} END"
    return df.withColumn("_found", _found(text_col, settings, dictionary)).withColumn(
        name, F.expr(whole)
    ).drop("_found")


def detect(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    settings: Settings,
    dictionary: D.Dictionary | None = None,
    only_allowed: bool = False,
) -> DataFrame:
    """Rows ``keep + entities``, without the text.

    With an oversized dictionary, or policies and domain endings as tables, spans become rows, meet
    the tables in joins and are put together per row key; rows without spans are left out then.
    """
    dictionary = D.load(df.sparkSession, settings) if dictionary is None else dictionary
    if in_row(settings, dictionary):
        return with_entities(df, text_col, settings, dictionary, only_allowed).select(*keep, "entities")
    passes = [df.select(*keep, _found(text_col, settings, dictionary if dictionary.in_row else None).alias("spans"))]
    if not dictionary.in_row:
        passes.append(D.find(df, keep, text_col, dictionary))
    if settings.domain_suffixes is not None and "DOMAIN" in settings.entity_types:
        passes.append(domains_by_table(df, keep, text_col, settings.domain_suffixes))
    together = reduce(DataFrame.unionByName, passes)
    # Texts without spans drop out here; the outer form is explained in span_rows.
    found = together.select(F.struct(*keep).alias("_key"), F.explode_outer("spans").alias("span")).filter(F.col("span").isNotNull())
    excluded = excluded_table(settings)
    if excluded is not None:
        # Spelled as excluded, a term does not enter the contest.
        found = without(found, F.col("span.value"), excluded)
    per_key = found.groupBy("_key").agg(F.collect_list("span").alias("spans"))
    spans = settle("spans", settings)
    if only_allowed:
        spans = f"filter({spans}, s -> {allowed(settings)})"
    settled = per_key.select("_key", F.expr(spans).alias("entities"))
    subjects = subject_keys_table(settings) if only_allowed else None
    if excluded is not None or subjects is not None:
        rows = settled.select("_key", F.posexplode("entities").alias("rank", "span"))
        if excluded is not None:
            rows = without(rows, F.lower("span.value"), excluded)
        if subjects is not None:
            rows = without(rows, F.lower(S.strip(F.col("span.value"))), subjects)
        ranked = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("rank", "span"))).alias("rs"))
        settled = ranked.select("_key", F.transform("rs", lambda r: r["span"]).alias("entities"))
    return settled.select("_key.*", "entities")


def in_row(settings: Settings, dictionary: D.Dictionary) -> bool:
    """Whether all spans of a text can be found and settled without leaving its row."""
    return dictionary.in_row and not settings.by_tables


def excluded_table(settings: Settings) -> DataFrame | None:
    """``key``: the excluded terms in lower case, if they come as a table."""
    terms = settings.exclude_terms
    return terms.select(F.lower("term").alias("key")).distinct() if isinstance(terms, DataFrame) else None


def subject_keys_table(settings: Settings) -> DataFrame | None:
    """``key``: the data subjects' values, trimmed and in lower case, if they come as a table."""
    values = settings.subject_values
    return values.select(F.lower(S.strip(F.col("value"))).alias("key")).distinct() if isinstance(values, DataFrame) else None


def without(rows: DataFrame, value: Column, keys: DataFrame) -> DataFrame:
    """The *rows* whose *value* is not among the *keys*; rows without a value stay."""
    return rows.join(keys.withColumnRenamed("key", "_unwanted"), value == F.col("_unwanted"), "left_anti")


def domains_by_table(df: DataFrame, keep: list[str], text_col: str, suffixes: DataFrame) -> DataFrame:
    """Rows ``keep + spans``: domain names whose last labels are one of *suffixes*.

    A name is looked up once for each number of labels that a suffix may have.
    """
    rule = PATTERN_RULES["DOMAIN"]
    known = suffixes.select(F.lower(F.ltrim(S.strip(F.col("suffix")), F.lit("."))).alias("_ending")).filter("_ending <> ''").distinct()
    most = known.agg(F.max(F.size(F.split("_ending", r"\."))).alias("n")).first()["n"] or 0
    names = df.select(F.struct(*keep).alias("_key"), F.expr(f"explode({SP.candidates(ident(text_col), rule)})").alias("hit"))
    labels = names.withColumn("_labels", F.split(F.lower("hit.value"), r"\."))
    endings = F.expr(f"transform(sequence(1, least(size(_labels) - 1, {max(most, 1)})), n -> array_join(slice(_labels, -n, n), '.'))")
    met = labels.select("_key", "hit", F.explode(endings).alias("_ending")).join(known, "_ending").dropDuplicates(["_key", "hit"])
    return met.groupBy("_key").agg(F.collect_list("hit").alias("hits")).select(
        "_key.*", F.expr(SP.as_spans("hits", "'DOMAIN'", rule.score)).alias("spans")
    )


def span_rows(detected: DataFrame, keep: list[str], spans_col: str = "entities") -> DataFrame:
    """One row per span with its ``rank``.

    The outer form keeps the optimiser from repeating the detection in a pushed-down
    size check; rows without spans are removed right after.
    """
    return (
        detected.select(*keep, F.posexplode_outer(spans_col).alias("rank", "span"))
        .filter(F.col("span").isNotNull())
        .select(*keep, "rank", "span.*")
    )
