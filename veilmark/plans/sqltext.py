"""Pieces of the comparison SQL (DuckDB dialect) shared by the registered queries."""

from __future__ import annotations

from veilmark.functions import patterns as P
from veilmark.functions.patterns import PATTERN_RULES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(digits: str) -> str:
    """Condition: the digit string passes the Luhn check."""
    n = f"length({digits})"
    digit = f"CAST(substr({digits}, CAST({n} - i AS INTEGER), 1) AS INTEGER)"
    doubled = f"CASE WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
    value = f"CASE WHEN i % 2 = 0 THEN {digit} ELSE {doubled} END"
    return f"list_sum(list_transform(range({n}), lambda i: {value})) % 10 = 0"


def iban(compact: str) -> str:
    """Condition: the compact account number passes mod 97."""
    turned = f"(substr({compact}, 5) || substr({compact}, 1, 4))"
    code = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    codes = f"list_transform(string_split({turned}, ''), lambda c: CAST({code} AS BIGINT))"
    fold = "CASE WHEN x < 10 THEN (acc * 10 + x) % 97 ELSE (acc * 100 + x) % 97 END"
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), {codes}), lambda acc, x: {fold}) = 1"


CHECKS = {
    "is_ipv4": f"regexp_matches(value, {lit(P.IP_VALID)})",
    "is_secret": f"""regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND round(log2(length(value)) - list_sum(
      list_transform(list_transform(list_distinct(string_split(value, '')), lambda c: length(value) - length(replace(value, c, ''))), lambda n: n * log2(n))) / length(value), 9) >= {P.SECRET_BITS}""",
    "is_ipv6": f"""regexp_matches(value, '[0-9]') AND len(string_split(value, '::')) <= 2
      AND list_bool_and(list_transform(string_split(value, '::'), lambda p, i: (p = '' AND len(string_split(value, '::')) = 2)
        OR regexp_matches(p, {lit(P.IP6_GROUPS)}) OR (i = len(string_split(value, '::')) AND regexp_matches(p, {lit(P.IP6_TAIL)}))))
      AND CASE WHEN contains(value, '::') THEN
        list_sum(list_transform(string_split(value, '::'), lambda p: CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ':')) + CAST(contains(p, '.') AS INTEGER) END)) BETWEEN 1 AND 7
        ELSE len(string_split(value, ':')) + CAST(contains(value, '.') AS INTEGER) = 8 END""",
    "is_domain": f"regexp_matches(lower(value), {lit(P.DOMAIN_VALID)})",
    "is_card": luhn("regexp_replace(value, '[ -]', '', 'g')"),
    "is_iban": iban("replace(value, ' ', '')"),
}


def spans(source: str, key: str, text: str, etype: str, rule=None) -> str:
    """SELECT of ``key, etype, value, s, e, score`` for one pattern rule."""
    rule = rule or PATTERN_RULES[etype]
    pattern = lit(rule.pattern)
    check = CHECKS[rule.check] if rule.check else "TRUE"
    return f"""
      SELECT {key}, '{etype}' AS etype, value, s, CAST(s + length(value) AS INTEGER) AS e,
             CAST({rule.score} AS DECIMAL(3,2)) AS score
      FROM (SELECT {key}, hits[i] AS value,
                   CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                     + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS INTEGER) AS s
            FROM (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
                  FROM (SELECT {key}, regexp_extract_all({text}, {pattern}) AS hits,
                               string_split_regex({text}, {pattern}) AS gaps FROM {source})))
      WHERE {check}"""


def settled(source: str, key: str, text: str, tiers: list[str], tag: str = "", entering: str = "TRUE") -> str:
    """CTEs ending in ``ents{tag}``: spans of all tiers, better tiers first, no overlaps.

    *entering* is a condition on the spans that take part.  Valid where spans of equal score never overlap, or the earlier tier is the longer.
    """
    parts = []
    for i, etype in enumerate(tiers):
        parts.append(f"raw{tag}{i} AS (SELECT * FROM ({spans(source, key, text, etype)}) WHERE {entering})")
        blocked = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM acc{tag}{j} b WHERE b.{key} = a.{key} AND a.s < b.e AND b.s < a.e)"
            for j in range(i)
        )
        parts.append(f"acc{tag}{i} AS (SELECT * FROM raw{tag}{i} a WHERE {blocked or 'TRUE'})")
    union = " UNION ALL ".join(f"SELECT * FROM acc{tag}{i}" for i in range(len(tiers)))
    parts.append(
        f"ents{tag} AS (SELECT *, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY score DESC, e - s DESC, s) AS rnk FROM ({union}))"
    )
    return ",\n".join(parts)


STANDARD_TIERS = ["EMAIL", "CREDIT_CARD", "URL", "IP", "DOMAIN", "PHONE"]
REDACT_TIERS = ["EMAIL", "CREDIT_CARD", "IBAN_CODE", "AMOUNT", "URL", "IP", "MAC_ADDRESS", "DOMAIN", "PHONE"]


def numbered(source: str, order: str, tag: str = "") -> str:
    """CTEs ending in ``reg{tag}``: first-seen values of *source* numbered per type."""
    return f"""
      first{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY {order}) AS nth
                                    FROM {source}) WHERE nth = 1),
      reg{tag} AS (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY {order}) AS n,
                   '[' || etype || '_' || row_number() OVER (PARTITION BY etype ORDER BY {order}) || ']' AS token
                   FROM first{tag})"""


def rewritten(texts: str, key: str, text: str, pairs: str) -> str:
    """SELECT of ``key, text`` with the (key, value, token) *pairs* replaced, longest first.

    Equal to one pass as long as no value occurs inside a token or straddles another.
    """
    return f"""
      SELECT t.{key}, coalesce(list_reduce(list_prepend({{'v': t.{text}, 't': ''}}, m.pairs),
               lambda acc, x: {{'v': replace(acc.v, x.v, x.t), 't': ''}}).v, t.{text}) AS text
      FROM {texts} t LEFT JOIN (
        SELECT {key}, list({{'v': value, 't': token}} ORDER BY length(value) DESC, value) AS pairs
        FROM (SELECT DISTINCT {key}, value, token FROM {pairs}) GROUP BY {key}) m ON m.{key} = t.{key}"""
