"""Dictionary recognisers: terms found anywhere in a text, ignoring case.

A term matches as a substring, without word boundaries, and every term is searched on
its own, so matches of different terms may overlap; overlap resolution follows later.

Three ways, chosen by the measured size of the term table:

* few terms: one alternation rules a text out, then each term is located by expression;
* up to ``dictionary_chars`` characters: an automaton is broadcast and each text is read
  once, in Arrow batches;
* beyond that: a rare-gram index (:mod:`veilmark.operators.gram_index`).  Terms and texts
  meet in one equi-join, giving rows of spans instead of an array column.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.config import Settings
from veilmark.functions.patterns import SCORES
from veilmark.functions.spans import NO_SPANS, SPANS_TYPE, as_spans, find_all, lit, quote
from veilmark.operators import gram_index as G
from veilmark.operators.gram_index import fold

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


@dataclass(frozen=True)
class Dictionary:
    """A measured term table and how to search it: within the row, or by an index of *n_terms* terms."""

    terms: DataFrame | None
    literal: tuple[tuple[str, str, str], ...]
    in_row: bool = True
    n_terms: int = 0

    @property
    def empty(self) -> bool:
        return self.terms is None and not self.literal


def term_table(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """All configured terms as ``(term, etype, score)``."""
    parts = []
    company = settings.company_terms
    if isinstance(company, DataFrame):
        parts.append(company.select("term", F.lit("COMPANY").alias("etype"), _score("COMPANY")))
    elif company:
        rows = [(t,) for t in company]
        parts.append(
            spark.createDataFrame(rows, "term string").select(
                "term", F.lit("COMPANY").alias("etype"), _score("COMPANY")
            )
        )
    if settings.roster is not None:
        roster = settings.roster
        names = [F.col(c) for c in ("full_name", "username") if c in roster.columns]
        parts.append(
            roster.select(F.explode(F.array(*names)).alias("term")).select(
                "term", F.lit("PERSON").alias("etype"), _score("ROSTER")
            )
        )
    if settings.lexicon is not None:
        scores = F.create_map(*[F.lit(x) for t in ("PERSON", "ORG", "LOC") for x in (t, SCORES[t])])
        parts.append(settings.lexicon.select("term", "etype", scores[F.col("etype")].alias("score")))
    if not parts:
        return None
    union = reduce(DataFrame.unionByName, parts)
    wanted = F.col("etype").isin(*settings.entity_types)
    return union.filter(F.col("term").isNotNull() & (F.col("term") != "") & wanted).distinct()


def _score(key: str) -> Column:
    return F.lit(SCORES[key]).alias("score")


def load(spark: SparkSession, settings: Settings) -> Dictionary:
    """Measure the terms and decide on the way to search them."""
    company = settings.company_terms
    if settings.roster is None and settings.lexicon is None and not isinstance(company, DataFrame):
        listed = tuple((t, "COMPANY", SCORES["COMPANY"]) for t in dict.fromkeys(company) if t)
        if len(listed) <= settings.small_dictionary_terms:
            return Dictionary(None, listed)
    terms = term_table(spark, settings)
    if terms is None:
        return Dictionary(None, ())
    row = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).first()
    n, chars = int(row["n"]), int(row["chars"] or 0)
    if n == 0:
        return Dictionary(None, ())
    if n <= settings.small_dictionary_terms and chars <= min(64 * settings.small_dictionary_terms, settings.dictionary_chars):
        return Dictionary(None, tuple(sorted(tuple(r) for r in terms.collect())))
    if chars <= settings.dictionary_chars:
        return Dictionary(terms, ())
    return Dictionary(G.index(terms), (), False, n)


def spans(text_col: str, dictionary: Dictionary) -> Column:
    """Matches of an in-row dictionary as a span array."""
    if not dictionary.in_row:
        raise ValueError("this dictionary is searched by its index; use find()")
    if dictionary.literal:
        return F.expr(_literal_spans(f"`{text_col}`", dictionary.literal))
    if dictionary.terms is None:
        return F.expr(NO_SPANS)
    return _automaton_column(F.col(text_col), dictionary.terms)


def find(df: DataFrame, keep: list[str], text_col: str, dictionary: Dictionary) -> DataFrame:
    """Matches of any dictionary as rows ``keep + spans``.

    With an oversized dictionary, texts without a match have no row.
    """
    if dictionary.in_row:
        return df.select(*keep, spans(text_col, dictionary).alias("spans"))
    return G.search(df, keep, text_col, dictionary.terms, dictionary.n_terms)


def _literal_spans(text: str, terms) -> str:
    """Expression text: an alternation rules texts out, then each term is located."""
    listed = ", ".join(
        f"named_struct('term', {lit(t)}, 'etype', {lit(e)}, 'score', {s})" for t, e, s in terms
    )
    each = find_all(text, f"concat('(?iu)', {quote('d.term')})")
    located = as_spans(each, "d.etype", "d.score")
    any_term = "(?iu)" + "|".join(re.sub(r"([\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])", r"\\\1", t) for t, _, _ in terms)
    found = f"flatten(transform(array({listed}), d -> {located}))"
    return f"CASE WHEN rlike({text}, {lit(any_term)}) THEN {found} ELSE {NO_SPANS} END"


def _automaton_column(text: Column, terms: DataFrame) -> Column:
    """Search by automaton; *terms* is known to be within the broadcast bound."""
    if ahocorasick is None:
        warnings.warn("pyahocorasick is not installed: dictionary terms are searched one by one", stacklevel=2)
    context = terms.sparkSession.sparkContext
    shared = context.broadcast([tuple(r) for r in terms.select("term", "etype", "score").collect()])

    @F.pandas_udf("array<struct<etype:string,value:string,start:int,end:int,score:string>>")
    def search(texts: pd.Series) -> pd.Series:
        finder = _finder(shared)
        return texts.map(lambda t: finder(t) if t else [])

    return search(text).cast(SPANS_TYPE)


_LAST: tuple = (None, None)


def _finder(shared):
    """Search function for a broadcast term list, built once per Python worker."""
    global _LAST
    if _LAST[0] is not shared:
        _LAST = (shared, _build_finder(shared.value))
    return _LAST[1]


def _build_finder(terms):
    kinds: dict[str, list] = {}
    for term, etype, score in terms:
        # Terms that differ in case only match the same text.
        labels = kinds.setdefault(fold(term), [])
        if (etype, score) not in labels:
            labels.append((etype, score))
    scan = _automaton_scan(kinds) if ahocorasick is not None else _plain_scan(kinds)

    def find(text: str) -> list[dict]:
        found, taken = [], {}
        for end, key in scan(fold(text)):
            start = end - len(key)
            # One term never overlaps itself.
            if start >= taken.get(key, 0):
                taken[key] = end
                for etype, score in kinds[key]:
                    found.append(
                        {"etype": etype, "value": text[start:end], "start": start, "end": end, "score": score}
                    )
        return found

    return find


def _automaton_scan(keys):
    if not keys:
        return lambda text: ()
    automaton = ahocorasick.Automaton()
    for key in keys:
        automaton.add_word(key, key)
    automaton.make_automaton()
    return lambda text: ((last + 1, key) for last, key in automaton.iter(text))


def _plain_scan(keys):
    def scan(text):
        for key in keys:
            at = text.find(key)
            while at >= 0:
                yield at + len(key), key
                at = text.find(key, at + len(key))

    return scan
