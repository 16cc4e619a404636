"""Scalar column helpers; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions.spans import lit

WS = "[" + P.SPACE + "]"


# The same characters as a set for trimming, which is far cheaper than a pattern.
BLANKS = "".join(
    map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_sql(expression: str) -> str:
    """:func:`strip` as SQL expression text."""
    return f"btrim({expression}, {lit(BLANKS)})"


def cell_text_sql(expression: str) -> str:
    """:func:`cell_text` as SQL expression text."""
    stripped = strip_sql(expression)
    empty = ", ".join(lit(w) for w in P.EMPTY_WORDS)
    return f"CASE WHEN {stripped} <> '' AND lower({stripped}) NOT IN ({empty}) THEN {stripped} END"


def cell_text(c: Column) -> Column:
    """Trimmed text of a cell; NULL when the cell counts as empty."""
    s = strip(c.cast("string"))
    return F.when((s != "") & ~F.lower(s).isin(*P.EMPTY_WORDS), s)


def words(name: Column) -> Column:
    return F.split(strip(name), f"{WS}+")


def first_word(name: Column) -> Column:
    return F.element_at(words(name), 1)


def last_word(name: Column) -> Column:
    return F.element_at(words(name), -1)


def is_multi_word(name: Column) -> Column:
    return F.size(words(name)) >= 2


def initials(name: Column) -> Column:
    """``John Doe`` -> ``J.D.``"""
    return F.array_join(
        F.transform(words(name), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), ""
    )


def token(etype: Column, n: Column) -> Column:
    return F.format_string("[%s_%d]", etype, n)


def email_token(n: Column) -> Column:
    return F.format_string("[EMAIL_PERSON_%d]", n)


def surface_token(n: Column, part: Column) -> Column:
    """Token of a first or last name: ``[PERSON_1_FIRST]``."""
    return F.format_string("[PERSON_%d_%s]", n, F.upper(part))


def person_number(tok: Column) -> Column:
    """Number inside a person token or mask; NULL for any other token."""
    in_token = F.regexp_extract(tok, r"(?i)\[PERSON_([0-9]+)", 1)
    in_mask = F.regexp_extract(tok, r"^([0-9]+)_", 1)
    n = F.when(in_token != "", in_token).when(in_mask != "", in_mask)
    return n.cast("bigint")


def card_mask(card: Column, rule: dict | None = None) -> Column:
    """Keep the first and last digits, fill the middle; short numbers are filled whole."""
    opts = {**P.CARD_MASK_DEFAULTS, **(rule or {})}
    first, last, fill = int(opts["keep_first"]), int(opts["keep_last"]), str(opts["fill_char"])
    digits = F.regexp_replace(card, "[^0-9]", "")
    n = F.length(digits)
    tail = F.right(digits, F.lit(last)) if last > 0 else F.lit("")
    middle = F.repeat(F.lit(fill), n - (first + last))
    return F.when(n <= first + last, F.repeat(F.lit(fill), n)).otherwise(
        F.concat(F.substring(digits, 1, first), middle, tail)
    )


def redacted_name(path: Column, force_suffix: Column | str | None = None) -> Column:
    """``a/b.csv`` -> ``a/b.redacted.csv``; *force_suffix* replaces the suffix."""
    return _with_tag(path, "redacted", force_suffix)


def restored_name(path: Column) -> Column:
    return _with_tag(path, "restored", None)


def _with_tag(path: Column, tag: str, force_suffix) -> Column:
    # A leading dot belongs to the stem, so the suffix needs a character before it.
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(suffix))
    if force_suffix is None:
        end = suffix
    else:
        end = F.lit(force_suffix) if isinstance(force_suffix, str) else force_suffix
    return F.concat(stem, F.lit(f".{tag}"), end)
