"""Periodic runs of words: a dictionary of basic factors finds them, copies of a period are collapsed.

A run is a stretch of words with smallest period q (words q apart are the same) that is at
least ``max(min_words, 2 * q)`` long and that no neighbouring word extends.

Method, on word numbers of many texts at once (arrays of a bounded size; one text is never cut):

* *Dictionary of basic factors*: level k names every factor of 2^k words by the pair of names of
  its halves.  Factors that occur once in their text get no name, so levels end where repeats end.
* *Successors*: per name the occurrences are sorted; those within twice the factor's length of
  each other are looked at.  Occurrences in equal steps of at most half the factor's length are an
  arithmetic progression, whose step is a proposed period; its inner members are otherwise only
  paired with ends.  A run of period q, 2^k <= q < 2^(k+1), has a factor of level k at two places
  q apart of which one is an end or both are neighbours in one progression, and any window holds a
  bounded number of ends: the proposals are complete and their number is linear per level.
* *Extension*: a proposal grows both ways by halving steps over the levels.
* *Deduplication*: of proposals with one stretch the smallest period stays.

All work is narrow: rows stay where they are, nothing is shuffled.  A text of n words takes 4 n
bytes per level of its longest repeat and about 100 n bytes of work arrays.

Defined cases: a null or empty text has no words and no runs, its collapsed form is empty; ids may
be null or repeat, rows stand for themselves; further columns are not looked at (``collapse`` keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import batches

#: Shortest run that is reported, in words.
MIN_WORDS = 12
#: Characters of text whose word arrays are worked on at once.
BATCH_CHARS = 1 << 20
NOTHING = np.empty(0, np.int64)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def name_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, different ones in different texts, and where each text begins."""
    found: list[int] = []
    starts = [0]
    for words in texts:
        known: dict[bytes, int] = {}
        base = len(found)
        # A word's name is its first place, so no two texts share one.
        found += [known.setdefault(w, base + i) for i, w in enumerate(words)]
        starts.append(len(found))
    return np.array(found, np.int64), np.array(starts, np.int64)


def basic_factors(names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level ``(names, places, firsts)``; factors that occur once are named -1.

    *places* has the occurrences of repeated factors, ordered by name and place; *firsts* flags the
    first one of every name.  Names of different texts differ, so factors never cross texts.
    """
    n, level, key, at = len(names), 0, names, np.arange(len(names))
    while len(at):
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        alone = new & np.append(new[1:], True)
        at, new = at[~alone], new[~alone]
        named = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
        named[at] = np.cumsum(new) - 1
        if not len(at):
            return
        yield named, at, new
        step = 1 << level
        at = np.sort(at)
        at = at[at + step < n]
        other = named[at + step]
        at, other = at[other >= 0], other[other >= 0]
        key = named[at].astype(np.int64) * n + other
        level += 1


def proposals(at: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` for the occurrences of the repeated factors of *size* words."""
    none = 1 << 62
    step = np.diff(at, append=0)
    step[np.append(first[1:], True)] = none
    before = np.concatenate([[none], step[:-1]])
    near = (step < 2 * size) | (before < 2 * size)
    at, step, before, first = at[near], step[near], before[near], first[near]
    inner = (step == before) & (2 * step <= size)
    places, periods = [], []

    def propose(left: np.ndarray, right: np.ndarray) -> None:
        places.append(at[left])
        periods.append(at[right] - at[left])

    # Names may have lost far members above; a name's group is told by its first named place.
    group = np.cumsum(_group_starts(at, step))
    k = np.arange(len(at))
    # The step of every progression, at its first member.
    opens = np.flatnonzero((step < 2 * size) & ~((before == step) & inner))
    propose(opens, opens + 1)
    ends = np.flatnonzero(~inner)
    # Every occurrence with the ends after it, and every end with the inner members after it.
    for members, side in ((k, 1), (k[inner], -1)):
        slot = np.searchsorted(ends, members, "right" if side > 0 else "left") - (side < 0)
        while len(members):
            inside = (slot >= 0) & (slot < len(ends))
            members, slot = members[inside], slot[inside]
            other = ends[slot]
            close = (group[other] == group[members]) & (np.abs(at[other] - at[members]) < 2 * size)
            members, slot, other = members[close], slot[close], other[close]
            propose(np.minimum(members, other), np.maximum(members, other))
            slot = slot + side
    return np.concatenate(places), np.concatenate(periods)


def _group_starts(at: np.ndarray, step: np.ndarray) -> np.ndarray:
    starts = np.ones(len(at), bool)
    # Neighbours belong together if the step recorded before filtering leads from one to the next.
    starts[1:] = at[:-1] + step[:-1] != at[1:]
    return starts


def find_runs(names: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs in *names*, ordered by start and period."""
    levels, places, periods, sizes = [], [], [], []
    for k, (named, at, first) in enumerate(basic_factors(names)):
        levels.append(named)
        # Level k shows periods of 2^k to 2^(k+1), and all shorter ones in runs of 2^(k+1) words and
        # more, so the levels below the first that fits into every run twice need no look.
        if 4 << k <= min_words:
            continue
        where, period = proposals(at, first, 1 << k)
        places.append(where)
        periods.append(period)
        sizes.append(np.full(len(where), 1 << k, np.int64))
    if not places or not sum(map(len, places)):
        return NOTHING, NOTHING, NOTHING
    where, period, size = map(np.concatenate, (places, periods, sizes))
    order = np.lexsort((where, period))
    where, period, size = where[order], period[order], size[order]
    # A proposal inside the stretch that the one before it has shown to repeat is the same run.
    again = np.zeros(len(where), bool)
    again[1:] = (period[1:] == period[:-1]) & (where[1:] <= where[:-1] + size[:-1])
    where, period = where[~again], period[~again]

    right = where + period
    ahead, back = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    n = len(names)
    for k in range(len(levels) - 1, -1, -1):
        named, step = levels[k], 1 << k
        for reach, sign in ((ahead, 1), (back, -1)):
            a, b = (where + ahead, right + ahead) if sign > 0 else (where - back - step, right - back - step)
            ok = (a >= 0) & (b < n)
            left_name = named[np.where(ok, a, 0)]
            same = ok & (left_name >= 0) & (left_name == named[np.where(ok, b, 0)])
            reach[same] += step
    start, length = where - back, back + ahead + period
    long = length >= np.maximum(min_words, 2 * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Flags of the words that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def _work(texts: list[str | None], min_words: int):
    """Per text ``(word count, runs, collapsed text)``."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    names, begins = name_words(split)
    start, length, period = find_runs(names, min_words)
    keep = kept_words(len(names), start, length, period)
    of = np.searchsorted(start, begins)
    for i, words in enumerate(split):
        a, b = begins[i], begins[i + 1]
        here = slice(of[i], of[i + 1])
        flags = keep[a:b]
        left = words if flags.all() else [w for w, f in zip(words, flags.tolist()) if f]
        runs = [
            {"start": s, "length": m, "period": p}
            for s, m, p in zip((start[here] - a).tolist(), length[here].tolist(), period[here].tolist())
        ]
        yield len(words), runs, b" ".join(left).decode("utf-8", "surrogatepass")


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``; runs by start, then period."""
    out_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts, BATCH_CHARS):
                n, found, left = zip(*_work(texts[a:b], min_words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(found, out_runs), pa.array(left, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """*docs* with all columns; texts that hold runs keep one period of each, words joined by one space."""
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(at).to_pylist()
            for a, b in batches(texts, BATCH_CHARS):
                new = [t if not found else left for t, (_, found, left) in zip(texts[a:b], _work(texts[a:b], min_words))]
                columns = [c.slice(a, b - a) for c in batch.columns]
                columns[at] = pa.array(new, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def plant(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` in which a tenth of the documents, chosen by a checksum of the id, repeats its tail.

    With ``h`` the CRC-32 of the decimal id, ``g = h / 10`` and n words, documents with ``h % 10 = 0``
    get word ``a + (i - a) % p`` at every place ``i >= a``, where ``a = g % n`` and
    ``p = 1 + (n - a) / (3 + g % 8)``, divisions rounded down.  A null id is not chosen.
    """
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = F.expr("coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0, false)")
    looped = rows.withColumn("w", F.when(chosen, words)).withColumn("g", F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10"))
    looped = looped.withColumn("a", F.expr("CASE WHEN size(w) > 0 THEN cast(g % size(w) AS int) END"))
    looped = looped.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) AS int)"))
    turned = F.expr(
        "concat_ws(' ', transform(sequence(0, size(w) - 1), i -> get(w, if(i < a, i, a + (i - a) % p))))"
    )
    return looped.select("doc_id", F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The rows of :func:`runs` with the longest run spelled out and checksums of runs and text."""
    best = F.expr(
        "array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN if(x.length > y.length, -1, 1) "
        "WHEN x.start <> y.start THEN if(x.start < y.start, -1, 1) WHEN x.period < y.period THEN -1 "
        "WHEN x.period > y.period THEN 1 ELSE 0 END)"
    )
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    one = found.withColumn("best", F.get(best, F.lit(0)))
    return one.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
