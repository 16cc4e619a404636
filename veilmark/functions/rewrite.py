"""Single-pass replacement of values by tokens, and of tokens by values.

As in :mod:`veilmark.functions.spans`, arguments and results are SQL expression text.
"""

from __future__ import annotations

from veilmark.functions.patterns import TOKEN
from veilmark.functions.spans import _compare, lit, quote

_LEFT_EDGE, _RIGHT_EDGE = r"(?<![\p{L}\p{N}_])(?:", r")(?![\p{L}\p{N}_])"


def _weave(text: str, pattern: str, pick: str) -> str:
    """Rebuild *text* with each match ``hit`` of *pattern* exchanged by *pick*."""
    pieces = (
        f"zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
        f"(gap, hit) -> concat(gap, coalesce({pick}, '')))"
    )
    return f"array_join({pieces}, '')"


def longest_first(keys: str) -> str:
    """Alternation of literal *keys*, longest first."""
    ordered = f"array_sort({keys}, {_compare('-length(@)', '@')})"
    return f"array_join(transform({ordered}, k -> {quote('k')}), '|')"


def key_pattern(mapping: str, word_boundary: bool = False) -> str:
    """Pattern of all keys of *mapping*; NULL if there are none.

    By default a key also matches inside longer words; *word_boundary* limits it to
    whole words.
    """
    pattern = longest_first(f"map_keys({mapping})")
    if word_boundary:
        pattern = f"concat({lit(_LEFT_EDGE)}, {pattern}, {lit(_RIGHT_EDGE)})"
    return f"CASE WHEN coalesce(size({mapping}), 0) > 0 THEN {pattern} END"


def replace_values(text: str, mapping: str, pattern: str) -> str:
    """Exchange every occurrence of every key of *mapping* by its token, longest first.

    *mapping* and *pattern* (from :func:`key_pattern`) should be plain columns: lambdas
    that refer to an outer lambda's variable cannot be arguments of a Python UDF, and the
    result of this function may well become one.
    """
    return f"CASE WHEN {pattern} IS NULL THEN {text} ELSE {_weave(text, pattern, f'{mapping}[hit]')} END"


def tokens_in(text: str) -> str:
    """Distinct bracket tokens of *text*, upper-cased; empty for NULL."""
    found = f"array_distinct(transform(regexp_extract_all({text}, {lit(TOKEN)}, 0), t -> upper(t)))"
    return f"coalesce({found}, CAST(array() AS array<string>))"


def restore_tokens(text: str, mapping: str) -> str:
    """Exchange known tokens (any case) by their values; unknown ones stay."""
    woven = _weave(text, lit(TOKEN), f"coalesce({mapping}[upper(hit)], hit)")
    return f"CASE WHEN coalesce(size({mapping}), 0) <= 0 THEN {text} ELSE {woven} END"
