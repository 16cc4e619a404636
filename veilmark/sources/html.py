"""HTML to plain text, as an expression: text between tags, joined by blanks.

Script and style text stays in, as it may hold sensitive values; comments and declarations go.
Character references with a closing semicolon are resolved outside of scripts.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.spans import lit

#: Elements whose content is no markup.
_RAW = "|".join(rf"<{name}\b[^>]*>.*?</{name}\s*>" for name in ("script", "style"))
MARKUP = rf"""(?is){_RAW}|<!--.*?-->|<![^>]*>|<\?[^>]*>|</?[a-z](?:[^>"']+|"[^"]*"|'[^']*')*>"""
RAW_CONTENT = r"(?is)^<(?:script|style)\b[^>]*>(.*)</[^<]*>$"
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _named() -> str:
    return "map(" + ", ".join(f"{lit(n)}, {lit(chr(c))}" for n, c in name2codepoint.items()) + ")"


def _resolved(text: str) -> str:
    """*text* with its character references resolved; unknown ones stay."""
    code = (
        "CASE WHEN substr(r, 2, 2) IN ('#x', '#X') THEN CAST(conv(substr(r, 4, length(r) - 4), 16, 10) AS INT) "
        "WHEN substr(r, 2, 1) = '#' THEN CAST(substr(r, 3, length(r) - 3) AS INT) END"
    )
    valid = "c BETWEEN 1 AND 1114111 AND NOT c BETWEEN 55296 AND 57343"
    char = (
        f"transform(array({code}), c -> CASE WHEN {valid} THEN decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') "
        f"ELSE coalesce({_named()}[substr(r, 2, length(r) - 2)], r) END)[0]"
    )
    woven = (
        f"array_join(zip_with(split({text}, {lit(REFERENCE)}, -1), regexp_extract_all({text}, {lit(REFERENCE)}, 0), "
        f"(g, r) -> concat(g, CASE WHEN r IS NULL THEN '' ELSE {char} END)), '')"
    )
    return f"CASE WHEN contains({text}, '&') THEN {woven} ELSE {text} END"


def text_of(html: str) -> str:
    """Expression: the text of the expression *html*.  An angle bracket that opens no tag is a piece of its own."""
    data = f"CASE WHEN contains(d, '<') THEN transform(regexp_extract_all(d, '[^<]+|<', 0), x -> {_resolved('x')}) ELSE array({_resolved('d')}) END"
    pieces = (
        f"flatten(zip_with(split({html}, {lit(MARKUP)}, -1), regexp_extract_all({html}, {lit(MARKUP)}, 0), "
        f"(d, m) -> concat({data}, array(coalesce(regexp_extract(m, {lit(RAW_CONTENT)}, 1), '')))))"
    )
    return f"CASE WHEN {html} IS NOT NULL THEN array_join(filter({pieces}, p -> p <> ''), ' ') END"


def html_text(column: str) -> Column:
    """The text of an HTML column; NULL stays NULL."""
    return F.expr(text_of("`" + column.replace("`", "``") + "`"))
