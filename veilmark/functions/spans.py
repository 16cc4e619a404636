"""Spans of a text as an array, without leaving the JVM.

A span is ``STRUCT<etype, value, start, end, score>``; offsets count characters and
``end`` is exclusive.  The functions take and give SQL expression text: such nested
expressions cost one call to parse, against thousands to assemble from Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from veilmark.functions import patterns as P
from veilmark.functions.patterns import PatternRule

SPAN_TYPE = "struct<etype:string,value:string,start:int,end:int,score:decimal(3,2)>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
HITS_TYPE = "array<struct<value:string,start:int,end:int>>"
NO_SPANS = f"CAST(array() AS {SPANS_TYPE})"
NO_HITS = f"CAST(array() AS {HITS_TYPE})"

# Appending to an array copies it, so running sums go block by block.
_BLOCK = 256


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Bind *value* to *name* so that *body*, an array, may use it more than once."""
    return f"flatten(transform(array({value}), {name} -> {body}))"


def _place(pairs: str) -> str:
    """(gap, hit) pairs -> hits with offsets, by prefix sums of the lengths."""
    width = "length(p.gap) + coalesce(length(p.hit), 0)"
    blocks = (
        f"transform(sequence(0, CAST(ceil(size({pairs}) / {_BLOCK}) AS INT) - 1), "
        f"b -> slice({pairs}, b * {_BLOCK} + 1, {_BLOCK}))"
    )
    origins = (
        "aggregate(bs, named_struct('at', 0, 'out', CAST(array() AS array<int>)), "
        f"(o, blk) -> named_struct('at', o.at + aggregate(blk, 0, (w, p) -> w + {width}), "
        "'out', array_append(o.out, o.at)), o -> o.out)"
    )
    hit = (
        "named_struct('value', p.hit, 'start', a.at + length(p.gap), "
        f"'end', a.at + {width})"
    )
    placed = (
        f"aggregate(blk, named_struct('at', org, 'out', {NO_HITS}), "
        f"(a, p) -> named_struct('at', a.at + {width}, 'out', array_append(a.out, {hit})), a -> a.out)"
    )
    laid_out = let(blocks, "bs", f"flatten(zip_with(bs, {origins}, (blk, org) -> {placed}))")
    return f"filter({laid_out}, h -> h.value IS NOT NULL)"


def find_all(text: str, pattern: str, hint: str | None = None, guard: str | None = None) -> str:
    """All matches of *pattern*, itself an expression, as an array of (value, start, end).

    ``split`` yields the gaps and ``regexp_extract_all`` the matches; both run only on
    texts that hold a match at all.
    """
    tests = [f"contains({text}, {lit(hint)})"] if hint is not None else []
    tests += [f"rlike({text}, {lit(guard)})"] if guard is not None else []
    tests.append(f"rlike({text}, {pattern})")
    pairs = (
        f"zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
        "(g, h) -> named_struct('gap', g, 'hit', h))"
    )
    return f"CASE WHEN {' AND '.join(tests)} THEN {let(pairs, 'ps', _place('ps'))} ELSE {NO_HITS} END"


def as_spans(hits: str, etype: str, score: str) -> str:
    """Label hits; *etype* and *score* are expressions."""
    return (
        f"transform({hits}, h -> named_struct('etype', {etype}, 'value', h.value, "
        f"'start', h.start, 'end', h.`end`, 'score', CAST({score} AS DECIMAL(3,2))))"
    )


def is_ipv4(v: str) -> str:
    return f"rlike({v}, {lit(P.IP_VALID)})"


def is_ipv6(v: str) -> str:
    """At most one ``::``, groups of up to four hex digits, eight in all or fewer around ``::``.

    The last two groups may be an IPv4 address.  An address without any decimal digit is not
    told from code such as ``a::b`` and does not count.
    """
    last = "i = size(ps) - 1"
    fine = f"(p = '' AND size(ps) = 2) OR rlike(p, {lit(P.IP6_GROUPS)}) OR ({last} AND rlike(p, {lit(P.IP6_TAIL)}))"
    units = "CASE WHEN p = '' THEN 0 WHEN contains(p, '.') THEN size(split(p, ':')) + 1 ELSE size(split(p, ':')) END"
    total = f"aggregate(transform(ps, p -> {units}), 0, (n, u) -> n + u)"
    whole = f"CASE size(ps) WHEN 1 THEN {total} = 8 WHEN 2 THEN {total} BETWEEN 1 AND 7 ELSE false END"
    parts = f"split({v}, '::', -1)"
    good = f"forall(transform(ps, (p, i) -> {fine}), b -> b) AND {whole}"
    return f"(rlike({v}, '[0-9]') AND exists(transform(array({parts}), ps -> {good}), b -> b))"


def is_secret(v: str) -> str:
    """Letters and digits, and at least ``SECRET_BITS`` of entropy per character."""
    counts = "transform(array_distinct(cs), c -> CAST(size(filter(cs, x -> x = c)) AS DOUBLE))"
    lost = f"aggregate({counts}, 0D, (b, n) -> b + n * log2(n))"
    bits = f"round(log2(size(cs)) - {lost} / size(cs), 9)"
    spread = f"exists(transform(array(split({v}, '')), cs -> {bits}), b -> b >= {P.SECRET_BITS})"
    return f"(rlike({v}, '[0-9]') AND rlike({v}, '[A-Za-z]') AND {spread})"


def is_domain(v: str) -> str:
    return f"rlike(lower({v}), {lit(P.DOMAIN_VALID)})"


def is_card(v: str) -> str:
    return f"luhn_check(regexp_replace({v}, '[ -]', ''))"


def is_iban(v: str) -> str:
    """ISO 7064 mod-97 check, folded over the characters so no big number is built."""
    compact = f"replace({v}, ' ', '')"
    turned = f"concat(substr({compact}, 5), substr({compact}, 1, 4))"
    step = (
        "CASE WHEN ascii(ch) < 58 THEN (acc * 10 + ascii(ch) - 48) % 97 "
        "ELSE (acc * 100 + ascii(ch) - 55) % 97 END"
    )
    return f"aggregate(split({turned}, ''), 0, (acc, ch) -> {step}) = 1"


CHECKS = {"is_ipv4": is_ipv4, "is_ipv6": is_ipv6, "is_domain": is_domain, "is_card": is_card, "is_iban": is_iban, "is_secret": is_secret}


def candidates(text: str, rule: PatternRule) -> str:
    """Hits of a rule's pattern, not checked yet."""
    return find_all(text, lit(rule.fast or rule.pattern), rule.hint, rule.guard)


def rule_spans(text: str, rule: PatternRule) -> str:
    hits = candidates(text, rule)
    if rule.check is not None:
        hits = f"filter({hits}, c -> {CHECKS[rule.check]('c.value')})"
    return as_spans(hits, lit(rule.etype), rule.score)


def rules_spans(text: str, rules: Sequence[PatternRule]) -> str:
    """Spans of several rules.  One cheap test first rules out texts that none can match."""
    tests = dict.fromkeys(_signal(text, rule) for rule in rules)
    found = ", ".join(rule_spans(text, rule) for rule in rules)
    return f"CASE WHEN {' OR '.join(tests)} THEN concat({found}) ELSE {NO_SPANS} END"


def _signal(text: str, rule: PatternRule) -> str:
    """Condition that holds wherever the rule matches."""
    if rule.pair:
        return f"rlike({text}, {lit(P.PAIR)})"
    if rule.hint is not None:
        return f"contains({text}, {lit(rule.hint)})"
    return f"rlike({text}, {lit(rule.guard or rule.pattern)})"


def quote(literal: str) -> str:
    """Escape a literal for use inside a Java pattern."""
    special = lit(r"([\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])")
    return f"regexp_replace({literal}, {special}, {lit(chr(92) * 2 + '$1')})"


def _compare(*keys: str) -> str:
    """Comparator body over ``l`` and ``r``: ascending in *keys*, written with ``@``."""
    arms = "".join(
        f"WHEN {k.replace('@', 'l')} < {k.replace('@', 'r')} THEN -1 "
        f"WHEN {k.replace('@', 'l')} > {k.replace('@', 'r')} THEN 1 "
        for k in keys
    )
    return f"(l, r) -> CASE {arms}ELSE 0 END"


# Higher score, then longer, then further left comes first.
_PRIORITY = ("-@.score", "@.start - @.`end`", "@.start", "@.etype")


def by_priority(spans: str) -> str:
    return f"array_sort({spans}, {_compare(*_PRIORITY)})"


def _settle(island: str) -> str:
    """Greedy choice inside one group of touching spans."""
    taken = "exists(won, w -> s.start < w.`end` AND w.start < s.`end`)"
    greedy = (
        f"aggregate({by_priority(island)}, {NO_SPANS}, "
        f"(won, s) -> CASE WHEN {taken} THEN won ELSE array_append(won, s) END)"
    )
    return f"CASE WHEN size({island}) <= 1 THEN {island} ELSE {greedy} END"


def drop_overlaps(spans: str) -> str:
    """Keep the best span wherever spans overlap; result ordered by priority.

    Spans are first cut into islands that do not touch each other, so the pairwise
    comparison stays inside an island and the whole costs one pass over the sorted spans.
    """
    by_start = f"array_sort(found, {_compare('@.start', *_PRIORITY)})"
    zero = f"named_struct('done', {NO_SPANS}, 'open', {NO_SPANS}, 'edge', 0)"
    step = (
        "named_struct("
        f"'done', CASE WHEN x.start >= acc.edge THEN concat(acc.done, {_settle('acc.open')}) ELSE acc.done END, "
        f"'open', CAST(CASE WHEN x.start >= acc.edge THEN array(x) ELSE array_append(acc.open, x) END AS {SPANS_TYPE}), "
        "'edge', greatest(acc.edge, x.`end`))"
    )
    sweep = f"aggregate({by_start}, {zero}, (acc, x) -> {step}, acc -> concat(acc.done, {_settle('acc.open')}))"
    return let(spans, "found", f"CASE WHEN size(found) <= 1 THEN found ELSE {by_priority(sweep)} END")
