"""Helpers shared by the corpus operators: shared files, lookups on skewed keys, Bloom filters, words."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.common import checkpoint_folder, cut

__all__ = [
    "cut", "shared_folder", "bound_batches", "open_output", "open_input", "attempt_name", "join_groups", "bloom_cells",
    "bloom_words", "bloom_hits", "possibly_in", "text_or_empty", "words", "word_hashes", "mix", "batches",
]

HOT_SHARE = 1000
MAX_CELLS = 1 << 26


# -- files ---------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def open_output(uri: str):
    """A stream that writes the file *uri*; its folder is made where the store has folders."""
    store, path = _resolve(_plain(uri))
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_input(uri: str):
    """A seekable reader of the file *uri*; only the bytes asked for are read."""
    store, path = _resolve(_plain(uri))
    return store.open_input_file(path)


def _plain(uri: str) -> str:
    # Hadoop prints file URIs with one slash.
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def attempt_name(stem: str, suffix: str) -> str:
    """A file name no other attempt of a task uses; readers take the names in the manifest only."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def bound_batches(spark: SparkSession, n_bytes: int = 4 << 20) -> None:
    """Let Arrow batches of this session hold about *n_bytes*, unless the session has set its own bound.

    The usual bound is a number of rows, which bounds nothing where texts are long.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(n_bytes))


# -- joins ---------------------------------------------------------------------------------------


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join *rows* with one row per *key* in *groups*; ``size`` is the group's row count.

    Groups with at least a thousandth of all grouped rows, so a thousand at most, are
    broadcast and their rows stay where they are; only the others are shuffled.  Both
    arguments are used more than once and should be cheap to evaluate again.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE >= F.lit(max(total, 1))
    large = groups.filter(hot)
    common = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.filter(~hot), key, how)
    return common.unionByName(rest.select(*common.columns))


# -- Bloom filters as DataFrames -------------------------------------------------------------------


def bloom_cells(n_rows: int, per_row: int = 16, most: int = MAX_CELLS) -> int:
    """Filter cells for *n_rows*: a power of two, *most* at the most, which bounds the broadcast."""
    cells = 1 << 10
    while cells < n_rows * per_row and cells < most:
        cells <<= 1
    return cells


def _cells(h: str, cells: int) -> tuple[str, str]:
    return f"({h} & {cells - 1}L)", f"(shiftrightunsigned({h}, 32) & {cells - 1}L)"


def bloom_words(hashes: DataFrame, cells: int, at_least: int = 1) -> DataFrame:
    """``(word, bits)``: 64-cell words of the filter cells that *at_least* so many rows hit.

    *hashes* has one BIGINT column.  With two, the filter holds the possibly repeated
    hashes.  A row hits two cells, or one if both are the same.
    """
    (h,) = hashes.columns
    a, b = _cells(f"`{h}`", cells)
    hit = hashes.select(F.expr(f"explode(array_distinct(array({a}, {b})))").alias("cell"))
    counted = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    bit = F.expr("shiftleft(1L, cast(cell & 63 AS INT))")
    return counted.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bloom_hits(df: DataFrame, words_: DataFrame, h: str, cells: int, flag: str) -> DataFrame:
    """Add the boolean *flag*: both cells of hash *h* are set.  At most ``cells / 64`` words are broadcast."""
    a, b = _cells(f"`{h}`", cells)
    for name, cell in (("_w1", a), ("_w2", b)):
        side = F.broadcast(words_.select(F.col("word").alias(name), F.col("bits").alias(f"{name}_bits")))
        df = df.withColumn(name, F.expr(f"shiftright({cell}, 6)")).join(side, name, "left")
        is_set = F.expr(f"shiftright({name}_bits, cast({cell} & 63 AS INT)) & 1L") == 1
        df = df.withColumn(f"{name}_set", F.coalesce(is_set, F.lit(False))).drop(name, f"{name}_bits")
    return df.withColumn(flag, F.col("_w1_set") & F.col("_w2_set")).drop("_w1_set", "_w2_set")


def possibly_in(df: DataFrame, h: Column, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of *df* whose hash may be among *keys* (one BIGINT column): a cheap test before a shuffle.

    No row whose hash is among the keys is lost; others may stay and fall out in the join.
    """
    cells = bloom_cells(n_keys)
    tested = bloom_hits(df.withColumn("_h", h), bloom_words(keys, cells), "_h", cells, "_in")
    return tested.filter("_in").drop("_h", "_in")


# -- words ---------------------------------------------------------------------------------------


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, which is what ``bytes.split`` cuts; A-Z lowered if asked."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value


_CACHE = _Hashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those of frequent words are kept by the worker, up to a fixed number."""
    return np.fromiter(map(_CACHE.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def batches(texts: list[str | None], limit: int = 1 << 20):
    """Index ranges of *texts* with about *limit* characters each, so that work arrays stay small."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
