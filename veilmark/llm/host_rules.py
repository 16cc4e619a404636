"""Quality rules on documents, then on hosts: a host whose documents mostly fail is left out as a whole.

Every text is measured on its own (words, symbols, repeated lines, repeated 8-word windows) and
fails or passes the base rules.  Failures are summed by host.  A host with few documents says
little about itself, so its rate is shrunk towards that of all hosts: a beta prior is fitted to
the hosts by moments and the posterior mean is compared with the limit.  The verdicts go back to
the documents by a join in which large hosts are broadcast, so one host may hold a third of all
rows.

Defined cases: a null text has no words and fails; rows without a host form one group of
unknown origin, which is never rejected as a whole; empty table, empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import batches, cut, join_groups, word_hashes

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
HOST_LIMIT = 0.5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(found: list[list[bytes]]) -> np.ndarray:
    """Per text the words that lie in an 8-word window found twice or more in that text.

    Windows are named by doubling: names of 2, 4 and 8 words are made of two names of half the
    length.  Names carry their text, so windows of different texts never meet.
    """
    sizes = np.array([len(w) for w in found], np.int64)
    result = np.zeros(len(found), np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return result
    owner = np.repeat(np.arange(len(found)), sizes)
    name = pd.factorize(word_hashes([w for ws in found for w in ws]))[0].astype(np.int64)
    name = pd.factorize(owner * (int(name.max()) + 1) + name)[0].astype(np.int64)
    for step in (1, 2, 4):
        name = pd.factorize(name[:-step] * (int(name.max()) + 1) + name[step:])[0].astype(np.int64)
    again = np.bincount(name)[name] > 1
    edge = np.zeros(total + 1, np.int64)
    edge[: len(again)] += again
    edge[WINDOW : WINDOW + len(again)] -= again
    covered = np.cumsum(edge[:-1]) > 0
    np.add.at(result, owner[covered], 1)
    return result


def measure_texts(texts: list[str | None]) -> dict[str, list[int]]:
    """The base measures of *texts*, by name."""
    out: dict[str, list[int]] = {m: [] for m in MEASURES}
    for a, b in batches(texts):
        found = []
        for text in texts[a:b]:
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            ws = raw.split()
            found.append(ws)
            seen, again = set(), 0
            for line in raw.split(b"\n"):
                if line in seen:
                    again += bool(line.split(None, 1))
                else:
                    seen.add(line)
            out["n_words"].append(len(ws))
            out["word_chars"].append(len(text) - len(raw) + sum(map(len, ws)))
            out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
            out["n_dup_lines"].append(again)
        out["n_repeat_words"] += repeated_words(found).tolist()
    return out


def measured(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of every row with its measures and ``base_failed``."""
    kept = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("_text"))
    fields = ", ".join(f"{m} bigint" for m in MEASURES)
    schema = kept.select(*columns).schema.simpleString()[len("struct<") : -1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            last = batch.num_columns - 1
            got = measure_texts(batch.column(last).to_pylist())
            arrays = [batch.column(i) for i in range(last)] + [pa.array(got[m], pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *MEASURES])

    few = F.col("n_words") < MIN_WORDS
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    return kept.mapInArrow(run, f"{schema}, {fields}").withColumn("base_failed", few | repeats)


@dataclass(frozen=True)
class Prior:
    """A beta distribution of failure rates: ``alpha`` failures and ``beta`` passes seen beforehand."""

    alpha: float
    beta: float


def fit_prior(hosts: DataFrame) -> Prior:
    """Fit the prior to ``(n, failed)`` of all hosts by moments.

    The spread of the host rates beyond what counts of this size show by chance gives the
    weight of the prior: hosts that differ much are shrunk little.  The weight lies between
    one document and 10,000; without any spread, or with all or no documents failing, the
    rates of all hosts are pulled together by the largest weight.
    """
    n, failed, squares, k, spread = hosts.agg(
        F.sum("n"), F.sum("failed"), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1)),
        F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")),
    ).first()
    if not n:
        return Prior(1.0, 1.0)
    mean = failed / n
    by_chance = mean * (1 - mean)
    free = n - squares / n - (k - 1)
    weight = 10_000.0
    if by_chance > 0 and free > 0:
        # spread: sum of n * rate**2, so this is the weighted sum of squared differences.
        alike = (spread - n * mean * mean - (k - 1) * by_chance) / (free * by_chance)
        if alike > 0:
            weight = min(max(1 / alike - 1, 1.0), 10_000.0)
    return Prior(mean * weight, (1 - mean) * weight)


def host_verdicts(rows: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``_host, n, failed, host_rate, host_failed`` by host of *rows* (``_host``, ``base_failed``)."""
    hosts = cut(
        rows.groupBy("_host").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")
        )
    )
    prior = fit_prior(hosts)
    rate = (F.col("failed") + prior.alpha) / (F.col("n") + (prior.alpha + prior.beta))
    known = F.col("_host") != ""
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", known & (F.col("host_rate") > host_limit))


def _host(name: str):
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias("_host")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """One row per document with its measures, ``base_failed``, ``host_rate`` and ``kept``."""
    base = docs.select(F.col(id_col).alias("doc_id"), _host(host_col), F.col(text_col).alias("_body"))
    rows = cut(measured(base, ["doc_id", "_host"], "_body"))
    hosts = host_verdicts(rows, host_limit)
    joined = join_groups(rows, hosts, "_host", "n")
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return joined.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), "host_rate")


def clean(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT
) -> DataFrame:
    """The rows of *docs* that stay, with all their columns; texts are not shuffled.

    Rows of failed hosts fall out by a list of those hosts.  That list has no proven size, so
    it is joined by key; hosts in good standing do not take part.
    """
    base = docs.select(_host(host_col), F.col(text_col).alias("_body"))
    bad = host_verdicts(measured(base, ["_host"], "_body"), host_limit).filter("host_failed")
    bad = cut(bad.select("_host", "n"))
    names = docs.columns
    packed = docs.select(F.struct("*").alias("_row"), _host(host_col), F.col(text_col).alias("_body"))
    kept = _passing(packed)
    if not bad.isEmpty():
        mark = bad.withColumn("_bad", F.lit(True))
        # A host outside the list keeps its rows where they are; large listed hosts are broadcast.
        kept = kept.join(F.broadcast(_large(mark)), "_host", "left_anti")
        rest = mark.join(_large(mark).select("_host"), "_host", "left_anti")
        kept = kept if rest.isEmpty() else kept.join(rest.select("_host"), "_host", "left_anti")
    return kept.select("_row.*").toDF(*names)


def _large(hosts: DataFrame) -> DataFrame:
    """Listed hosts with at least a thousandth of the listed rows: a thousand at most."""
    total = hosts.agg(F.sum("n")).first()[0] or 0
    return hosts.filter(F.col("n") * 1000 >= total).select("_host")


def _passing(packed: DataFrame) -> DataFrame:
    schema = packed.select("_row", "_host").schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            got = measure_texts(batch.column(2).to_pylist())
            n, repeats = np.array(got["n_words"]), np.array(got["n_repeat_words"])
            good = ~((n < MIN_WORDS) | (repeats * 100 > n * MAX_REPEAT_PERCENT))
            yield batch.select([0, 1]).filter(pa.array(good))

    return packed.mapInArrow(run, schema)
