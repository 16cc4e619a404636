"""Near-duplicate groups: MinHash bands for candidates, sequential Bayesian pruning, exact checks.

1.  Every text becomes its set of 5-word shingles (64-bit hashes), a digest of the set and a
    signature of 128 minima.  Texts with the same set are one class; only classes go on.
2.  Classes that agree in one of 32 bands of 4 minima are candidates.
3.  Candidates are compared 32 minima at a time.  After each batch the chance that a pair with so
    many agreements still has the wanted similarity is known (beta posterior under a uniform
    prior); below ``MISS`` the pair is dropped.
4.  A pair goes no further if the parity bitmaps of its sets differ in more bits than similar sets
    may in shingles; this loses no link.
5.  Survivors are checked on the full sets.  Checked links are the only ones that count.

Groups are what is asked for, not pairs.  First every member of a bucket is compared with the
bucket's smallest and largest class only.  Links found this way join most classes of a bucket;
then pairs are compared inside tasks only where a bucket still holds several components, and
only across components.  Large buckets are split into blocks, so no task gets a whole bucket.
There the pairs that pass 3 and 4 are checked on the full sets at once, and only links that join
two components leave the task, at most one for each of its rows.  No pair of one bucket that could join two
components is left uncompared.

A pair at the threshold is missed by the bands with a chance of 5e-6.

Defined cases: texts without words are linked with nothing; with fewer than five words the whole
sequence is the one shingle; rows without an id are kept, have no component and are linked with
nothing; rows that repeat an id share its verdict if their texts are equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import (
    batches, bloom_cells, bloom_hits, bloom_words, cut, join_groups, mix, possibly_in, text_or_empty, word_hashes, words,
)
from veilmark.llm.graph import components, refine

SHINGLE = 5
SIMILAR, OF = 75, 100
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BATCH = 32
BITS = 512
MISS = 1e-6
BLOCK = 1024

_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(ws: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a word list."""
    h = word_hashes(ws)
    size = min(SHINGLE, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    acc = np.full(n, size, np.uint64)
    for k in range(size):
        acc = mix(acc * _STEP + h[k : k + n])
    return np.unique(acc)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each non-empty set, 16 bits each."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), MINIMA), np.uint16)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat((joined * factor) >> np.uint64(32), starts) & np.uint64(0xFFFF)
    return out


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Per set ``BITS`` bits, each the parity of the set's hashes that fall on it, and the set's size."""
    sizes = np.array([len(s) for s in sets], np.int64)
    cells = (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64) + np.repeat(np.arange(len(sets)) * BITS, sizes)
    odd = (np.bincount(cells, minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
    return np.concatenate([np.packbits(odd, axis=1).view(np.int64), sizes[:, None]], axis=1)


def within_reach(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of rows of ``bitmaps`` may be similar enough: sets differ in no fewer shingles than bits."""
    differ = np.bitwise_count((one[..., :-1] ^ other[..., :-1]).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    differ = np.maximum(differ, np.abs(one[..., -1] - other[..., -1]))
    return (OF + SIMILAR) * differ <= (OF - SIMILAR) * (one[..., -1] + other[..., -1])


def least_agreement(similar: float = SIMILAR / OF, miss: float = MISS) -> list[tuple[int, int]]:
    """``(minima compared, agreements below which the pair is dropped)`` after each batch.

    With m of n agreements and a uniform prior, the similarity has a beta(m+1, n-m+1)
    posterior, and the chance that it is at least t is that of at most m hits in n+1 tries.
    """
    table = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
            if below >= miss:
                table.append((n, m))
                break
    return table


_LEAST = least_agreement()


def agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Indices of the rows of *many* that stay candidates of *one* through all batches."""
    left, hits, done = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for n, least in _LEAST:
        hits = hits + (many[left, done:n] == one[done:n]).sum(axis=1)
        stay = hits >= least
        left, hits, done = left[stay], hits[stay], n
        if not len(left):
            break
    return left


# -- profiles and classes --------------------------------------------------------------------------


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, n_shingles, digest, sig``: the minima, four of a band in a number, then the bitmap and size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(2).to_pylist()
            counts, digests, sigs = [], [], []
            for a, b in batches(texts):
                sets = [shingle_set(words(t, lower=True)) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                found = iter(np.concatenate([signatures(full).view(np.int64), bitmaps(full)], axis=1) if full else ())
                for s in sets:
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(next(found) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "h", "n_shingles", "digest", "sig"],
            )

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, h bigint, n_shingles bigint, digest binary, sig array<bigint>")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per set: ``node, digest, rep, h, sig, size``; ``rep`` is its smallest document."""
    first = F.min(F.struct("doc_id", "h", "sig"))
    grouped = (
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("size"))
    )
    flat = cut(grouped.select("digest", F.col("f.doc_id").alias("rep"), F.col("f.h").alias("h"), "f.sig", "size"))
    return flat.withColumn("node", F.monotonically_increasing_id())


# -- candidates ------------------------------------------------------------------------------------


def buckets_of(classes: DataFrame) -> DataFrame:
    """``bucket, node, n, lo, hi`` of all buckets with two classes or more."""
    keys = F.transform(F.slice("sig", 1, BANDS), lambda v, i: F.xxhash64(i, v))
    members = classes.select("node", F.explode(keys).alias("bucket"))
    shared = cut(
        members.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        .filter("n > 1")
    )
    likely = possibly_in(members, F.col("bucket"), shared.select("bucket"), shared.count())
    return cut(join_groups(likely, shared, "bucket", "n"))


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that pass all batches of minima and the bitmaps."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n = batch.num_rows
            (one, one_map), (other, other_map) = (_unpacked(batch.column(i), n) for i in (2, 3))
            hits, done, stay = np.zeros(n, np.int64), 0, np.ones(n, bool)
            for upto, least in _LEAST:
                hits[stay] += (one[stay, done:upto] == other[stay, done:upto]).sum(axis=1)
                stay &= hits >= least
                done = upto
            stay[stay] = within_reach(one_map[stay], other_map[stay])
            yield batch.select([0, 1]).filter(pa.array(stay))

    def side(end: str) -> DataFrame:
        return classes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _unpacked(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The minima and the bitmaps of *n* signatures."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(n, BANDS + BITS // 64 + 1)
    return np.ascontiguousarray(rows[:, :BANDS]).view(np.uint16), np.ascontiguousarray(rows[:, BANDS:])


def star_pairs(buckets: DataFrame) -> DataFrame:
    low = buckets.filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    high = buckets.filter("node <> hi").select(F.col("node").alias("a"), F.col("hi").alias("b"))
    return low.unionByName(high).distinct()


def open_members(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """``bucket, node, comp, main, n_main, n_out`` of the buckets that still hold several components.

    ``main`` tells the members of the bucket's largest component, ``n_main`` and ``n_out`` count them and the others.
    """
    placed = cut(
        buckets.select("bucket", "node", "n").join(comps, "node", "left")
        .select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
    )
    mixed = cut(
        placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("n").alias("size"))
        .filter("x <> y").select("bucket", "size")
    )
    rows = cut(join_groups(placed, mixed, "bucket", "size"))
    largest = F.max(F.struct("k", "comp")).alias("top")
    sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(largest, F.sum("k").alias("size"))
    sizes = cut(sizes.select("bucket", F.col("top.comp").alias("top"), F.col("top.k").alias("n_main"), "size"))
    return join_groups(rows.drop("size"), sizes, "bucket", "size").select(
        "bucket", "node", "comp", (F.col("comp") == F.col("top")).alias("main"), "n_main", (F.col("size") - F.col("n_main")).alias("n_out")
    )


def open_pairs(
    buckets: DataFrame, comps: DataFrame, classes: DataFrame, block: int = BLOCK,
    texts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pruned pairs ``(a, b)`` of one bucket that lie in different components.

    Members of the largest component only meet the others, so their blocks do not meet each other.

    *texts* gives ``(node, body)`` for a table of nodes.  With it pairs are checked on the full sets where they meet,
    and only links that join two components of the meeting are given: they connect all that its
    links connect and are fewer than its members, however many pairs there are.
    """
    members = cut(open_members(buckets, comps))
    rows = members.join(classes.select("node", "sig"), "node")
    if texts is not None:
        rows = rows.join(texts(members.select("node").distinct()), "node")
    out_blocks, main_blocks = (F.ceil(F.col(n) / block).cast("int") for n in ("n_out", "n_main"))
    place, whole = F.xxhash64("node"), F.col("n_out") + F.col("n_main") <= block
    parted = F.when(F.col("main"), out_blocks + F.pmod(place, main_blocks)).otherwise(F.pmod(place, out_blocks))
    own = F.when(whole, 0).otherwise(parted).cast("int")
    last = F.when(whole, 1).when(F.col("main"), out_blocks).otherwise(out_blocks + main_blocks) - 1
    # A block meets the other blocks of its bucket once; within a task rows of a meeting stand together.
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    key = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    keyed = met.select("bucket", *key, "own", "node", "comp", "sig", *(["body"] if texts is not None else []))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "i", "j"]
    dealt = keyed.repartition(n_parts, *order).sortWithinPartitions(*order)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in parts:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and tuple(keys[0]) != held_key:
                yield from _meet(held)
                held = []
            bounds = [0, *ends.tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if held and a > 0:
                    yield from _meet(held)
                    held = []
                held.append(batch.slice(a, b - a))
                held_key = tuple(keys[a])
        if held:
            yield from _meet(held)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
    own, node, comp = (group.column(k).to_numpy() for k in (3, 4, 5))
    values, comp, counts = np.unique(comp, return_inverse=True, return_counts=True)
    if len(values) < 2:
        return
    minima, maps = _unpacked(group.column(6), len(node))
    sets = _Sets(group.column(7)) if group.num_columns > 7 else None
    # Members of the largest component need no turn of their own: the others come to them.
    outside = np.flatnonzero(comp != counts.argmax())
    turn = np.full(len(node), len(node), np.int64)
    turn[outside] = np.arange(len(outside))
    a_out, b_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in outside:
        partners = (comp != comp[k]) & (turn > turn[k])
        if i != j:
            partners &= own != own[k]
        index = np.flatnonzero(partners)
        near = index[agreeing(minima[k], minima[index])]
        near = near[within_reach(maps[k], maps[near])]
        if sets is not None:
            links = []
            while len(near):
                # One of each component has its turn; those of components joined by then are done.
                head = near[np.unique(comp[near], return_index=True)[1]]
                good = head[sets.similar(k, head)]
                links += good.tolist()
                comp[np.isin(comp, comp[good])] = comp[k]
                near = near[(comp[near] != comp[k]) & ~np.isin(near, head)]
            near = np.array(links, np.int64)
        a_out.append(np.minimum(node[k], node[near]))
        b_out.append(np.maximum(node[k], node[near]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])


class _Sets:
    """Shingle sets of packed texts, made when needed; up to ``KEPT`` hashes are remembered."""

    KEPT = 1 << 21

    def __init__(self, bodies: pa.Array) -> None:
        self.bodies, self.unpack = bodies, zstandard.ZstdDecompressor()
        self.made: dict[int, np.ndarray] = {}
        self.size = 0

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self.made:
            found = _packed_set(self.unpack, self.bodies[k].as_py())
            if self.size > self.KEPT:
                self.made, self.size = {}, 0
            self.made[k] = found
            self.size += len(found)
        return self.made[k]

    def similar(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of *others* are similar enough to *k*."""
        one = self[int(k)]
        return np.array([_similar(one, self[int(o)]) for o in others], bool)


# -- exact check -----------------------------------------------------------------------------------


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, body``: packed texts of the classes *wanted* ``(node, rep, h)``.

    Texts of other documents are left out by a Bloom filter before the shuffle.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in parts:
            bodies = [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["node", "body"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys = wanted.select(F.xxhash64("rep", "h").alias("k"))
    likely = possibly_in(rows, F.xxhash64("rep", "h"), keys, wanted.count())
    found = likely.join(wanted, ["rep", "h"]).select("node", "t").mapInArrow(run, "node bigint, body binary")
    return cut(found.dropDuplicates(["node"]))


def _packed_set(unpack: zstandard.ZstdDecompressor, body: bytes) -> np.ndarray:
    return shingle_set(words(unpack.decompress(body).decode("utf-8", "surrogatepass"), lower=True))


def _similar(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return OF * both >= SIMILAR * (len(one) + len(other) - both)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, one = None, None
        for batch in parts:
            good = []
            for a, x, y in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if a != last:
                    last, one = a, _packed_set(unpack, x)
                good.append(_similar(one, _packed_set(unpack, y)))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def side(end: str) -> DataFrame:
        return texts.select(F.col("node").alias(end), F.col("body").alias(f"body_{end}"))

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "body_a", "body_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


# -- the operator ----------------------------------------------------------------------------------


def _components(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def texts(nodes: DataFrame) -> DataFrame:
        return texts_of(docs, cut(classes.select("node", "rep", "h").join(nodes, "node")), id_col, text_col)

    buckets = buckets_of(classes)
    first = cut(prune(star_pairs(buckets), classes))
    ends = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    comps = components(cut(confirm(first, texts(ends))))
    more = cut(open_pairs(buckets, comps, classes, texts=texts))
    return comps if more.isEmpty() else refine(comps, more)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, h`` (``h``: hash of the text)."""
    rows = cut(profiles(docs, id_col, text_col))
    classes = classes_of(rows)
    comps = _components(docs, classes, id_col, text_col)
    named = classes.join(comps, "node", "left").select("digest", "size", "rep", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(least, "comp").select("digest", "size", "component_id"))
    linked = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    body = rows.drop("sig")
    alone = body.filter(~linked).withColumn("component_id", F.col("doc_id"))
    joined = join_groups(body.filter(linked), named, "digest", "size").select(*alone.columns)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return alone.unionByName(joined).select("doc_id", "n_shingles", "component_id", kept, "h")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that stay, one document per group, with all their columns.

    Only rows that may be on the list of those to drop are shuffled; they meet it by id and text hash.
    """
    dropped = cut(
        groups(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_i"), F.col("h").alias("_t")).distinct()
    )
    place = F.col(id_col).cast("bigint").alias("_i"), F.xxhash64(text_or_empty(text_col)).alias("_t")
    return without(docs.select(F.struct("*").alias("_row"), *place), dropped).select("_row.*")


def without(packed: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose ``_i, _t`` is not among *dropped*; most never leave their task."""
    cells = bloom_cells(dropped.count())
    key = F.xxhash64("_i", "_t").alias("_k")
    tested = bloom_hits(packed.select("*", key), bloom_words(dropped.select(key), cells), "_k", cells, "_in")
    stay = tested.filter(~F.col("_in")).drop("_in")
    return stay.unionByName(tested.filter("_in").drop("_in").join(dropped, ["_i", "_t"], "left_anti"))
