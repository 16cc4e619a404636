"""Removal of long repeated byte strings, with a logarithmic family of suffix-array levels.

A string of ``window`` bytes is repeated if it starts at two places of the corpus.  Every byte
covered by a repeated string is removed, judged on the texts as they came.

*Sampling.*  Of the suffixes of a text only those are indexed that start at the leftmost
smallest ``gram`` of some window (grams of 64 bytes in the order of their hashes).  The choice
depends on the bytes of the window alone, so equal windows choose the same suffix at the same
place, and every window has one.

*Index family.*  A batch of texts gives a suffix array: its sampled suffixes, sorted by their
first bytes within shards of the gram's fingerprint.  The batch is scanned against itself and
against every level; fingerprints found twice are possible long matches.  Then it becomes a
level of rank 0, and two levels of one rank are merged into one of the next rank, so there are
as many levels as the number of batches has binary ones and a suffix is rewritten once per rank.

*Exact matches.*  A window is a candidate if the suffix it chose has a repeated fingerprint.  For each sampled suffix the bytes around it that hold its candidate windows go to
the shard of its fingerprint, where equal windows are found by their hashes.  Fingerprints with
more than ``BIG`` places are not gathered: their windows are counted by hash with partial sums.
Windows that repeat inside one text are found there, and only their first place is sent.
Equal texts are recognised by digest, so one of them stands for all.

Windows are compared by 64-bit hashes within one fingerprint, 128 bits in all.

Defined cases: a null text counts as empty; texts shorter than the window keep all bytes; ids
may be null or repeat, each row gets its own result; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm.common import cut, join_groups, mix, possibly_in, shared_folder, text_or_empty

WINDOW = 400
GRAM = 64
BIG = 50_000
BATCHES = 4
_SEGMENT = 1 << 20
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = _SEGMENT + (1 << 12)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def rolling(raw: bytes, size: int) -> np.ndarray:
    """Hash of the *size* bytes at every place of *raw*; it depends on those bytes only."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers()
    values = _TABLE[np.frombuffer(raw, np.uint8)]
    out = np.empty(n, np.uint64)
    for a in range(0, n, _SEGMENT):
        b = min(n, a + _SEGMENT)
        part = values[a : b + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * down[: len(part)], out=sums[1:])
        out[a:b] = (sums[size:] - sums[:-size]) * up[: b - a]
    return mix(out)


def sample(raw: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place of the suffix chosen by each window, hash of the gram at each place)``."""
    h = rolling(raw, gram)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, window - gram + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return (low & _LOW).astype(np.int64), h


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def suffixes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``head, fp, key, pos, n`` of the sampled suffixes of *texts* ``(key, body)``.

    ``head`` orders suffixes by their first 8 bytes; ``n`` counts the places of the gram in
    the text, of which ``pos`` is the first.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            heads, fps, keys, places, counts = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < window:
                    continue
                chosen, h = sample(raw, window, gram)
                at = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
                fp, first, n = np.unique(h[at], return_index=True, return_counts=True)
                pos = at[first]
                eight = np.frombuffer(raw, np.uint8)[pos[:, None] + np.arange(8)]
                heads.append(np.ascontiguousarray(eight).view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63))
                fps.append(fp)
                keys += [key] * len(fp)
                places.append(pos)
                counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(heads)), _signed(np.concatenate(fps)), pa.array(keys, pa.binary()),
                     pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(counts), pa.int64())],
                    names=["head", "fp", "key", "pos", "n"],
                )

    return texts.mapInArrow(run, "head bigint, fp bigint, key binary, pos bigint, n bigint")


class IndexFamily:
    """Levels of suffix arrays below *folder*; :meth:`add` scans and takes in one batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.n_written = spark, folder, 0
        self.levels: list[tuple[int, str]] = []
        self.hits: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/level-{self.n_written}"
        self.n_written += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(n, "fp").sortWithinPartitions("head", "fp", "key").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        """Take in the sampled suffixes of new texts (see :func:`suffixes`)."""
        path = self._write(batch)
        own = self.spark.read.parquet(path).groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        found = own.filter("c > 1 OR n > 1").select("fp", "c")
        if self.levels:
            before = self.suffixes().select("fp").distinct()
            found = found.unionByName(own.filter("c = 1 AND n = 1").join(before, "fp", "left_semi").select("fp", "c"))
        self.hits.append(cut(found))
        self.levels.append((0, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._write(self.spark.read.parquet(a, b))))

    def suffixes(self) -> DataFrame:
        return self.spark.read.parquet(*[path for _, path in self.levels])

    def repeated(self) -> DataFrame:
        """``fp, places``: fingerprints met twice or more, with about as many places as there are."""
        union = functools.reduce(DataFrame.unionByName, self.hits)
        return cut(union.groupBy("fp").agg(F.sum("c").alias("places")))


# -- exact matches ---------------------------------------------------------------------------------


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of true values."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def around(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """From *texts* ``(key, body, fps, big)``: windows to compare and windows already known.

    Rows ``fp, big, key, first, last, bytes``: windows starting at ``first .. last``, whose bytes
    are given; without ``bytes`` they are repeated inside their text.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: list[tuple] = []
            for key, text, fps, big in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                chosen, h = sample(raw, window, gram)
                at = np.flatnonzero(np.diff(chosen, prepend=-1))
                repeated = np.isin(h[chosen[at]], np.array(fps, np.int64).view(np.uint64))
                open_ = np.flatnonzero(np.repeat(repeated, np.diff(at, append=len(chosen))))
                if not len(open_):
                    continue
                _, first, back, n = np.unique(
                    rolling(raw, window)[open_], return_index=True, return_inverse=True, return_counts=True
                )
                inside = np.zeros(len(chosen), bool)
                inside[open_[n[back] > 1]] = True
                for a, b in zip(*_runs(inside)):
                    out.append((int(h[a].view(np.int64)), False, key, int(a), int(b), None))
                sent = np.sort(open_[first])
                cuts = np.flatnonzero(np.diff(chosen[sent])) + 1
                large = set(big or ())
                for part in np.split(sent, cuts):
                    a, b = int(part[0]), int(part[-1])
                    fp = int(h[chosen[a]].view(np.int64))
                    out.append((fp, fp in large, key, a, b, raw[a : b + window]))
            if out:
                kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    names=["fp", "big", "key", "first", "last", "bytes"],
                )

    return texts.mapInArrow(run, "fp bigint, big boolean, key binary, first bigint, last bigint, bytes binary")


def _matching(rows: list[tuple], window: int) -> list[tuple[bytes, int, int]]:
    """``(key, first, last)`` of repeated windows among *rows*, which hold whole fingerprints."""
    found = [(key, first, last) for _, key, first, last, raw in rows if raw is None]
    rows = [r for r in rows if r[4] is not None]
    if not rows:
        return found
    salt = mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    # Hashing the bytes of many rows at once; windows across two rows are left out.
    joined = b"".join(r[4] for r in rows)
    sizes = np.array([len(r[4]) - window + 1 for r in rows])
    begins = np.cumsum([0, *[len(r[4]) for r in rows[:-1]]])
    index = np.repeat(begins - np.cumsum([0, *sizes[:-1]]), sizes) + np.arange(sizes.sum())
    h = rolling(joined, window)[index] ^ np.repeat(salt, sizes)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = 0
    for (_, key, first, _, _), n in zip(rows, sizes.tolist()):
        if again[at : at + n].any():
            found += [(key, first + int(a), first + int(b)) for a, b in zip(*_runs(again[at : at + n]))]
        at += n
    return found


def _batch(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    keys, firsts, lasts = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())],
        names=["key", "first", "last"],
    )


def gathered(rows: DataFrame, window: int, chunk: int = 1 << 20) -> DataFrame:
    """Repeated windows ``key, first, last``; rows of one fingerprint meet in one task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in parts:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= chunk and row[0] != held[-1][0]:
                    if found := _matching(held, window):
                        yield _batch(found)
                    held, size = [], 0
                held.append(row)
                size += len(row[4] or b"")
        if held and (found := _matching(held, window)):
            yield _batch(found)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("fp", "key", "first", "last", "bytes").repartition(n, "fp").sortWithinPartitions("fp")
    return dealt.mapInArrow(run, "key binary, first bigint, last bigint")


def counted(rows: DataFrame, window: int) -> DataFrame:
    """The same for fingerprints with very many places: windows are counted by hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for fp, key, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                h = rolling(raw, window)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h ^ mix(np.array([fp], np.int64).view(np.uint64))), pa.array([key] * len(h), pa.binary()),
                     pa.array(np.arange(first, first + len(h)), pa.int64())],
                    names=["h", "key", "first"],
                )

    hashed = rows.select("fp", "key", "first", "bytes").mapInArrow(run, "h bigint, key binary, first bigint")
    repeated = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return join_groups(hashed, repeated, "h", "n").select("key", "first", F.col("first").alias("last"))


def covered(n_bytes: int, firsts: np.ndarray, lasts: np.ndarray, window: int) -> np.ndarray:
    """Which of *n_bytes* bytes lie in a window of the runs."""
    edge = np.zeros(n_bytes + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, lasts + window, -1)
    return np.cumsum(edge[:-1]) > 0


# -- the operator ----------------------------------------------------------------------------------


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def matches(
    docs: DataFrame, text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, n_batches: int = BATCHES,
    big: int = BIG,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(classes, bodies, runs)``.

    classes: ``key, copies`` of texts that can have a window; bodies: ``key, body`` of those with
    repeated suffixes; runs: ``key, firsts, lasts``, arrays of the repeated windows of a text.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "suffixes")
    text = text_or_empty(text_col)
    rows = docs.select(_key(text).alias("key"), text.alias("body")).filter(F.octet_length("body") >= window)
    classes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")))

    slot = F.pmod(F.xxhash64("key"), F.lit(n_batches)).alias("batch")
    columns = ["head", "fp", "key", "pos", "n"]
    # Rows of equal texts are alike; partial sums leave one of them per task.
    suffixes(rows, window, gram).withColumn("batch", slot).write.partitionBy("batch").parquet(f"{folder}/new")
    family = IndexFamily(spark, folder)
    new = spark.read.parquet(f"{folder}/new") if not classes.isEmpty() else None
    for k in range(n_batches if new is not None else 0):
        # The rows of a text are alike in all its copies.
        family.add(new.filter(F.col("batch") == k).select(*columns).dropDuplicates(["fp", "key"]))
    if new is None:
        none = spark.createDataFrame([], "key binary, firsts array<bigint>, lasts array<bigint>")
        return classes, spark.createDataFrame([], "key binary, body string"), none

    hits = family.repeated()
    seeds = join_groups(family.suffixes().select("fp", "key"), hits, "fp", "places")
    large = F.collect_list(F.when(F.col("places") > big, F.col("fp")))
    seeds = cut(seeds.groupBy("key").agg(F.collect_list("fp").alias("fps"), large.alias("big")))
    keys = seeds.select(F.xxhash64("key").alias("k"))
    likely = possibly_in(rows, F.xxhash64("key"), keys, seeds.count())
    path = f"{folder}/bodies"
    # One body per text: partial aggregation leaves one copy per task before the shuffle.
    likely.dropDuplicates(["key"]).join(seeds, "key").select("key", "body", "fps", "big").write.parquet(path)
    bodies = spark.read.parquet(path)

    parts = around(bodies, window, gram)
    if hits.filter(F.col("places") > big).isEmpty():
        found = gathered(parts, window)
    else:
        path = f"{folder}/parts"
        parts.write.parquet(path)
        parts = spark.read.parquet(path)
        found = gathered(parts.filter("NOT big"), window).unionByName(counted(parts.filter("big"), window))
    runs = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("r"))
    runs = cut(runs.select("key", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts")))
    return classes, bodies.select("key", "body"), runs


def _affected(classes: DataFrame, runs: DataFrame) -> DataFrame:
    """``key, copies, firsts, lasts`` of the texts that lose bytes; copies of one text lose all."""
    return cut(classes.join(runs, "key", "left").filter("copies > 1 OR firsts IS NOT NULL"))


def spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            removed, runs_, digests = [], [], []
            for body, firsts, lasts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8)
                out = covered(len(raw), np.array(firsts), np.array(lasts), window)
                removed.append(int(out.sum()))
                runs_.append(len(_runs(out)[0]))
                digests.append(hashlib.sha256(raw[~out].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digests, pa.string())],
                names=["key", "n_removed", "n_spans", "kept_sha256"],
            )

    text = text_or_empty(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), _key(text).alias("key"),
            F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("_own"),
        )
    )
    classes, bodies, runs = matches(docs, text_col, window=window, **options)
    cut_up = bodies.join(runs, "key").mapInArrow(run, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    some = classes.join(cut_up, "key", "left")
    changed = cut(some.filter("copies > 1 OR n_removed IS NOT NULL"))
    joined = join_groups(rows, changed, "key", "copies", "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_own")).alias("kept_sha256"),
    )


def without_bytes(text: str, firsts: list[int], lasts: list[int], window: int) -> str:
    """*text* without the characters all of whose bytes are covered."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = covered(len(raw), np.array(firsts), np.array(lasts), window)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(out, lead)
    return raw[~np.repeat(whole, np.diff(lead, append=len(raw)))].tobytes().decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """*docs* with repeated strings taken out of the texts; all columns and rows stay.

    A character goes if all its bytes are covered, so texts stay valid UTF-8.  A column
    ``n_chars`` is set to the new length.
    """
    text = text_or_empty(text_col)
    classes, _, runs = matches(docs, text_col, window=window, **options)
    changed = _affected(classes, runs)
    packed = docs.select(F.struct("*").alias("_row"), _key(text).alias("key"), text.alias("_text"))
    joined = join_groups(packed, changed, "key", "copies", "left")
    shape = joined.select("_row").schema[0]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [
                t if copies is None else "" if copies > 1 else without_bytes(t, firsts, lasts, window)
                for t, copies, firsts, lasts in zip(*(batch.column(k).to_pylist() for k in range(1, 5)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_new"])

    done = joined.select("_row", "_text", "copies", "firsts", "lasts").mapInArrow(
        run, T.StructType([shape, T.StructField("_new", T.StringType())])
    )
    columns = []
    for field in docs.schema:
        old = F.col("_row").getField(field.name)
        new = {text_col: F.when(old.isNotNull(), F.col("_new")), "n_chars": F.char_length("_new").cast(field.dataType)}
        columns.append(new.get(field.name, old).alias(field.name))
    return done.select(*columns)
