"""Removal of lines that nearly repeat an earlier line: an exact set-similarity join.

A line's tokens are its distinct words.  They are ordered by rarity in the whole corpus, counted
in a fixed number of hash cells.  Two lines of Jaccard similarity 0.9 or more share one of the
first ``n - ceil(0.9 n) + 1`` tokens of each (prefix filter); their sizes differ little (length
filter), what follows the shared tokens must be long enough (positional filter), and their parity
bitmaps differ in no more bits than the sets may in tokens.  What is left is verified on the full
sets.  A line is removed if an earlier line, by document id and place, is similar to it.

Most lines are like no other.  Two sets of similarity 0.9 differ in at most ``h`` tokens, which follows
from their sizes, so of ``h + 1`` parts into which tokens are dealt by hash one is the same in both.  A
first pass sends a hash of each part (``signatures``) in packed rows to where equal ones meet; lines
none of whose parts occurs twice have no partner and stay out of all that follows.

Lines with equal sets are one set from the start.  To decide about a set one earlier partner is
enough: the first that passes the filters is verified, and only sets whose partner fails get all
their others verified, in a second meeting of the tokens those sets have.  Frequent tokens are split into
blocks that meet pairwise, so no task gets a whole list and pairs are written only where they pass the
filters.  Prefix entries are made from the sets when they are needed and never written down.

Defined cases: null texts have no lines; lines with fewer than ``MIN_TOKENS`` distinct words stay;
rows without an id come before all others; rows that repeat id and text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import batches, bloom_cells, bloom_hits, bloom_words, join_groups, mix, possibly_in, text_or_empty
from veilmark.operators.common import stage

MIN_TOKENS = 5
#: Similarity as a fraction, so that thresholds are exact.
SIMILAR, OF = 9, 10
CELLS = 1 << 18
BLOCK = 4096
#: Signatures a task gathers before it deals them out, and how many shards a shuffle partition has.
HELD = 1 << 20
SHARDS = 4
#: Cells of the filter of possible lines at most, which bounds its broadcast to 32 MB.
MOST_CELLS = 1 << 28
#: Token counts and filter cells are added up in slices of so many.
COUNT_SLICE, CELL_SLICE = 1 << 14, 1 << 20


def _up(a, b):
    return -(-a // b)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_SEED = 42


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def text_tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(place, hash)`` of the words of *raw*; the hashes are Spark's ``xxhash64`` of their bytes.

    All words of fewer than 32 bytes are hashed at once, step by step of the algorithm.
    """
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    at, size = edges[::2], edges[1::2] - edges[::2]
    padded = raw + bytes(8)
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    h = size.astype(np.uint64) + np.uint64((int(_P5) + _SEED) % (1 << 64))
    for k in range(3):
        some = np.flatnonzero((size >= 8 * k + 8) & (size < 32))
        lane = _rotated(eight[at[some] + 8 * k] * _P2, 31) * _P1
        h[some] = _rotated(h[some] ^ lane, 27) * _P1 + _P4
    some = np.flatnonzero((size & 4 != 0) & (size < 32))
    lane = (eight[at[some] + (size[some] & ~7)] & np.uint64(0xFFFFFFFF)) * _P1
    h[some] = _rotated(h[some] ^ lane, 23) * _P2 + _P3
    for k in range(3):
        some = np.flatnonzero(((size & 3) > k) & (size < 32))
        lane = (eight[at[some] + (size[some] & ~3) + k] & np.uint64(255)) * _P5
        h[some] = _rotated(h[some] ^ lane, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h = h ^ (h >> np.uint64(32))
    for k in np.flatnonzero(size >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k] + size[k]], _SEED)
    return at, h


def token_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same as Spark's ``xxhash64``: their low bits are the words' cells."""
    return text_tokens(b" ".join(found))[1]


def line_tokens(line: bytes) -> np.ndarray:
    return np.unique(text_tokens(line)[1])


def _distinct(tokens: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted by line and token."""
    values, rank = np.unique(tokens, return_inverse=True)
    bits = np.int64(len(values)).item().bit_length()
    key = np.sort((line << bits) | rank)
    key = key[np.diff(key, prepend=-1) != 0]
    return values[key & ((1 << bits) - 1)], key >> bits


def line_sets(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the lines of *texts* that take part ``row, number, n``, their distinct tokens one after the other
    (sorted), and the hashes of all words."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(raws)
    at, words = text_tokens(raw)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    tokens, line = _distinct(words, np.searchsorted(ends, at))
    n = np.bincount(line, minlength=len(ends) + 1)
    part = np.flatnonzero(n >= MIN_TOKENS)
    begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
    first = np.searchsorted(ends, begins)
    row = np.searchsorted(first, part, side="right") - 1
    return row, part - first[row], n[part], tokens[(n >= MIN_TOKENS)[line]], words


# -- which lines can have a partner ---------------------------------------------------------------------


def _bands() -> np.ndarray:
    edges = [OF - 1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 6 // 5))
    return np.array(edges)


#: A band holds the sizes from an edge to the next; smaller sets are similar to equal ones only.
BANDS = _bands()
#: Parts of the pairs whose smaller set is in the band: one more than tokens they may differ in.
PARTS = (BANDS[1:] - 1 + (BANDS[1:] - 1) * OF // SIMILAR) // (SIMILAR + OF) + 1


def set_ids(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """40 bits of a hash of each set; *tokens* has the sets one after the other."""
    if not len(n):
        return np.empty(0, np.uint64)
    return mix(np.add.reduceat(mix(tokens), np.cumsum(n) - n)) & np.uint64((1 << 40) - 1)


def signatures(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(set, signature)``: similar sets share one, and equal sets share all.

    A set has the parts of its own band, and those of the band below if a smaller partner may be there.
    """
    high = np.searchsorted(BANDS, n, side="right") - 1
    low = np.searchsorted(BANDS, _up(SIMILAR * n, OF), side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    small = np.flatnonzero(high < 0)
    sets, out = [small], [set_ids(tokens, n)[small]]
    for band, has in ((high, high >= 0), (low, (low >= 0) & (low != high))):
        parts = np.where(has, PARTS[band], 0)
        begins = np.cumsum(parts) - parts
        mine = has[owner]
        t, o = tokens[mine], owner[mine]
        cell = begins[o] + (((t >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, cell, mix(t))
        which = np.repeat(np.arange(len(n)), parts)
        number = np.arange(len(sums)) - begins[which]
        sets.append(which)
        out.append(mix(sums ^ mix(((band[which] + 1) << 32 | number).astype(np.uint64))))
    return np.concatenate(sets), np.concatenate(out)


def survey(docs: DataFrame, text_col: str) -> DataFrame:
    """``slice, data``: sums of the token counts of a slice of cells, or (-1) ids of sets with a signature
    that occurs twice."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = n_parts * SHARDS
    schema = "slice int, data binary"

    def rows(numbers: list[int], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["slice", "data"])

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, found = (np.concatenate(x) for x in zip(*held))
        # Two rows say that a set has copies; very frequent lines send no more.
        order = np.argsort(found + ids * np.uint64(0x9E3779B97F4A7C15))
        ids, found = ids[order], found[order]
        more = np.ones(len(ids), bool)
        more[2:] = (ids[2:] != ids[:-2]) | (found[2:] != found[:-2])
        ids, found = ids[more], found[more]
        shard = (found >> np.uint64(48)).astype(np.int64) % n_shards
        order = np.argsort(shard, kind="stable")
        packed = np.empty((len(order), 11), np.uint8)
        packed[:, :6] = found[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        packed[:, 6:] = ids[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        numbers, begins = np.unique(shard[order], return_index=True)
        return rows((-1 - numbers).tolist(), [x.tobytes() for x in np.split(packed, begins[1:])])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        held, size = [], 0
        for batch in parts:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                _, _, n, tokens, all_words = line_sets(texts[a:b])
                counts += np.bincount((all_words & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                which, found = signatures(tokens, n)
                held.append((set_ids(tokens, n)[which], found))
                size += len(found)
                if size >= HELD:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)
        yield rows(list(range(CELLS // COUNT_SLICE)), [x.tobytes() for x in np.split(counts, CELLS // COUNT_SLICE)])

    def met(number: int, data: list[bytes]) -> pa.RecordBatch:
        if number >= 0:
            return rows([number], [np.sum([np.frombuffer(x, np.int64) for x in data], axis=0).tobytes()])
        packed = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 11)
        wide = np.zeros((2, len(packed), 8), np.uint8)
        wide[0, :, :6], wide[1, :, :5] = packed[:, :6], packed[:, 6:]
        found, ids = wide.reshape(2, -1).view("<u8")
        order = np.argsort(found)
        same = found[order][1:] == found[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] = same
        twice[:-1] |= same
        return rows([-1], [np.unique(ids[order[twice]]).tobytes()])

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, data = None, []
        for batch in parts:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != number and data:
                    yield met(number, data)
                    data = []
                number = k
                data.append(x)
        if data:
            yield met(number, data)

    texts = docs.select(text_or_empty(text_col).alias("t"))
    shards = texts.mapInArrow(run, schema).repartition(n_parts, "slice").sortWithinPartitions("slice")
    return stage(shards.mapInArrow(meet, schema))


def token_counts(surveyed: DataFrame) -> np.ndarray:
    """How often the tokens of each hash cell occur; a fixed number of cells."""
    out = np.zeros(CELLS, np.int64)
    for row in surveyed.filter("slice >= 0").collect():
        out[row.slice * COUNT_SLICE : (row.slice + 1) * COUNT_SLICE] = np.frombuffer(row.data, np.int64)
    return out


def _filter_cells(ids: np.ndarray, cells: int) -> list[np.ndarray]:
    h = mix(ids)
    return [(x & np.uint64(cells - 1)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def possible_ids(surveyed: DataFrame) -> np.ndarray:
    """A Bloom filter, in bytes of cells, of the ids of sets that may have a partner."""
    ids = surveyed.filter("slice < 0").select("data")
    n_ids = (ids.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // 8
    cells = bloom_cells(n_ids, most=MOST_CELLS)
    width = min(cells, CELL_SLICE)
    schema = "slice int, data binary"

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for data in batch.column(0).to_pylist():
                hit = np.unique(np.concatenate(_filter_cells(np.frombuffer(data, np.uint64), cells)))
                numbers, begins = np.unique(hit // width, return_index=True)
                places = [(x % width).astype(np.int32).tobytes() for x in np.split(hit, begins[1:])][: len(numbers)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(places, pa.binary())], names=["slice", "data"])

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in parts:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(number, np.zeros(width, bool))[np.frombuffer(data, np.int32)] = True
        for number, bits in held.items():
            full = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([full], pa.binary())], names=["slice", "data"])

    n_parts = max(1, cells // width)
    filled = ids.mapInArrow(spread, schema).repartition(n_parts, "slice").mapInArrow(fill, schema)
    out = np.zeros(cells // 8, np.uint8)
    for row in filled.collect():
        out[row.slice * width // 8 : (row.slice + 1) * width // 8] = np.frombuffer(row.data, np.uint8)
    return out


def may_match(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    hits = [(bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 for cell in _filter_cells(ids, 8 * len(bits))]
    return (hits[0] & hits[1]).astype(bool)


# -- sketches and their meetings -----------------------------------------------------------------------


def _sketches(found: list[bytes] | np.ndarray, sizes: list[int] | np.ndarray, rarity: np.ndarray) -> tuple:
    """Of lines with *sizes* words each, all in *found* (words or their hashes): which take part, and their
    ``digest, n, lo, hi, prefix`` (an Arrow array each)."""
    tokens = found if isinstance(found, np.ndarray) else token_hashes(found)
    line = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, line))
    tokens, line = tokens[order], line[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
    tokens, line = tokens[new], line[new]
    n = np.bincount(line, minlength=len(sizes))
    part = np.flatnonzero(n >= MIN_TOKENS)
    kept = (n >= MIN_TOKENS)[line]
    tokens, n = tokens[kept], n[part]
    ends = np.cumsum(n)
    begins = ends - n
    raw = tokens.tobytes()
    digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())]
    place = tokens >> np.uint64(50)
    bit = np.uint64(1) << (place & np.uint64(63))
    high = (place & np.uint64(64)) != 0
    words = [np.bitwise_xor.reduceat(np.where(w, bit, np.uint64(0)), begins) if len(n) else np.empty(0, np.uint64)
             for w in (~high, high)]
    owner = np.repeat(np.arange(len(n)), n)
    by_rarity = np.lexsort((tokens, rarity[(tokens & np.uint64(CELLS - 1)).astype(np.int64)], owner))
    size = n - _up(SIMILAR * n, OF) + 1
    first = np.arange(len(tokens)) - begins[owner] < size[owner]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[by_rarity][first].view(np.int64)))
    lo, hi = (pa.array(w.view(np.int64)) for w in words)
    return part, pa.array(digests, pa.binary()), pa.array(n.astype(np.int64)), lo, hi, prefix


def lines(docs: DataFrame, counts, possible, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, line, digest, n, lo, hi, prefix`` of the lines that take part; those that
    cannot have a partner by the filter *possible* have their place only."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, bits = counts.value, possible.value
        for batch in parts:
            texts = batch.column(2).to_pylist()
            for a, b in batches(texts):
                row, number, n, tokens, _ = line_sets(texts[a:b])
                if not len(row):
                    continue
                may = may_match(set_ids(tokens, n), bits)
                _, *sketch = _sketches(tokens[np.repeat(may, n)], n[may], rarity)
                at = pa.array(a + row)
                theirs = pa.array(np.cumsum(may) - 1, mask=~may)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), *[c.take(theirs) for c in sketch]],
                    names=NAMES,
                )

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
    return rows.mapInArrow(
        run, "doc_id bigint, h bigint, line int, digest binary, n bigint, lo bigint, hi bigint, prefix array<bigint>"
    )


NAMES = ["doc_id", "h", "line", "digest", "n", "lo", "hi", "prefix"]


def shared_tokens(sets: DataFrame) -> DataFrame:
    """``token, c``: prefix tokens of two sets or more and their number of sets."""
    tokens = sets.select(F.explode("prefix").alias("token"))
    return stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))


def index(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """Prefix entries of the *shared* tokens, dealt into blocks that meet pairwise.

    Few tokens fill more than one block; only entries that may be theirs are joined with the counts.
    Entries of other tokens that pass the Bloom test stay alone or meet as they should.
    """
    entries = sets.select(
        F.posexplode("prefix").alias("pos", "token"), "node", "n", "lo", "hi", F.coalesce("first.doc_id", F.lit(0)).alias("d"),
        F.col("first.h").alias("h"), F.col("first.line").alias("l"), F.col("first.has_id").cast("int").alias("g"), "wanted",
    )
    likely = possibly_in(entries, F.col("token"), shared.select("token"), shared.count())
    large = shared.filter(F.col("c") > BLOCK)
    cells = bloom_cells(large.count())
    tested = bloom_hits(likely, bloom_words(large.select("token"), cells), "token", cells, "_large")
    alone = tested.filter("NOT _large").select("*", F.lit(None).cast("bigint").alias("c"))
    met = join_groups(tested.filter("_large"), large, "token", "c", "left").unionByName(alone)
    blocks = F.ceil(F.coalesce("c", F.lit(1)) / BLOCK).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *ENTRY)


ENTRY = ["own", "node", "n", "pos", "lo", "hi", "d", "h", "l", "g", "wanted"]
#: Lists up to this size are met by distance, all at once; longer ones row by row of a matrix.
SHORT = 48
MATRIX = 1 << 18


def _alike(v: dict, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the parity bitmaps of entries *a* and *b* leave room for *need* common tokens."""
    differ = (np.bitwise_count(v["lo"][a] ^ v["lo"][b]).astype(np.int64) + np.bitwise_count(v["hi"][a] ^ v["hi"][b]))
    return differ <= v["n"][a] + v["n"][b] - 2 * need


def _passing(v: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of entries (*a* earlier than *b*) pass all filters."""
    need = _up(SIMILAR * (v["n"][a] + v["n"][b]), SIMILAR + OF)
    ok = np.minimum(v["left"][a], v["left"][b]) >= need
    ok &= (v["i"][b] == v["j"][b]) | (v["own"][a] != v["own"][b])
    at = np.flatnonzero(ok)
    ok[at] = _alike(v, a[at], b[at], need[at])
    return ok


def _partners(v: dict, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of whole lists; the columns *v* are in no special order."""
    order = np.lexsort((v["l"], v["h"], v["d"], v["g"], v["j"], v["i"], v["token"]))
    v = {c: x[order] for c, x in v.items()}
    v["left"] = v["n"] - v["pos"]
    new = np.ones(len(order), bool)
    new[1:] = (v["token"][1:] != v["token"][:-1]) | (v["i"][1:] != v["i"][:-1]) | (v["j"][1:] != v["j"][:-1])
    begins = np.flatnonzero(new)
    sizes = np.diff([*begins, len(order)])
    begin = np.repeat(begins, sizes)
    rows = np.flatnonzero(v["wanted"] & (np.repeat(sizes, sizes) <= SHORT))
    none = np.empty(0, np.int64)
    a_out, b_out, first = [none], [none], np.full(len(order), -1)
    for distance in range(1, SHORT):
        rows = rows[rows - distance >= begin[rows]]
        if not len(rows):
            break
        b = rows[_passing(v, rows - distance, rows)]
        if every:
            a_out.append(b - distance)
            b_out.append(b)
        else:
            # Distances grow, so what stays is the earliest.
            first[b] = b - distance
    found = np.flatnonzero(first >= 0)
    a_out.append(first[found])
    b_out.append(found)
    for start, size in zip(begins[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
        wanted = start + np.flatnonzero(v["wanted"][start : start + size])
        step = max(1, MATRIX // size)
        for k in range(0, len(wanted), step):
            b = wanted[k : k + step]
            a = np.arange(start, b[-1])
            total = v["n"][b][:, None] + v["n"][a]
            ok = np.minimum(v["left"][b][:, None], v["left"][a]) >= _up(SIMILAR * total, SIMILAR + OF)
            ok &= a < b[:, None]
            y, x = np.nonzero(ok)
            x, y = a[x], b[y]
            good = _passing(v, x, y)
            x, y = x[good], y[good]
            if not every:
                y, at = np.unique(y, return_index=True)
                x = x[at]
            a_out.append(x)
            b_out.append(y)
    return v["node"][np.concatenate(a_out)], v["node"][np.concatenate(b_out)]


def candidates(entries: DataFrame, every: bool) -> DataFrame:
    """``(a, b)``: *a* is an earlier set that passes all filters; one of them per list, or every one."""
    n_parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["token", "i", "j"]
    dealt = entries.repartition(n_parts, *order).sortWithinPartitions(*order)
    names = [*order, *ENTRY]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole_lists():
            held: list[dict] = []
            for batch in parts:
                v = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
                v |= {c: v[c].view(np.uint64) for c in ("lo", "hi")} | {c: v[c].astype(np.int64) for c in ("n", "pos")}
                last = [v[c] == v[c][-1] for c in order]
                tail = int(np.flatnonzero(~(last[0] & last[1] & last[2]))[-1]) + 1 if not all(x.all() for x in last) else 0
                if tail or (held and any(held[-1][c][-1] != v[c][0] for c in order)):
                    held.append({c: x[:tail] for c, x in v.items()})
                    yield {c: np.concatenate([h[c] for h in held]) for c in names}
                    held = []
                held.append({c: x[tail:] for c, x in v.items()})
            if held:
                yield {c: np.concatenate([h[c] for h in held]) for c in names}

        for v in whole_lists():
            a, b = _partners(v, every)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full token sets are similar enough."""

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            nodes, tokens = [], []
            for wanted_lines, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts_of = text.encode("utf-8", "surrogatepass").split(b"\n")
                for one in wanted_lines:
                    nodes.append(one["node"])
                    tokens.append(line_tokens(parts_of[one["line"]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # A document's text is read once, however many of its lines are wanted.
    places = ends.join(sets, "node").select("first.doc_id", "first.h", F.struct("first.line", "node").alias("one"))
    wanted = stage(places.groupBy("doc_id", "h").agg(F.collect_list("one").alias("lines")))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys = wanted.select(F.xxhash64("doc_id", "h").alias("k"))
    likely = possibly_in(rows, F.xxhash64("doc_id", "h"), keys, wanted.count())
    same = likely["doc_id"].eqNullSafe(wanted["doc_id"]) & (likely["h"] == wanted["h"])
    found = likely.join(wanted, same).select("lines", "t").mapInArrow(fetch, "node bigint, tokens binary")
    found = stage(found.dropDuplicates(["node"]))
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("tokens").alias(f"t{end}")), end)
    return stage(pairs.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, line, gone`` of every line that takes part; ``h`` is the hash of the document's text."""
    spark = docs.sparkSession
    surveyed = survey(docs, text_col)
    counts = spark.sparkContext.broadcast(token_counts(surveyed))
    possible = spark.sparkContext.broadcast(possible_ids(surveyed))
    found = stage(lines(docs, counts, possible, id_col, text_col))
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "h", "line")
    open_ = found.filter("digest IS NOT NULL")
    grouped = open_.groupBy("digest").agg(
        F.min(F.struct(place.alias("first"), "n", "lo", "hi", "prefix")).alias("s"), F.count(F.lit(1)).alias("size")
    )
    sets = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "size", "s.*"))
    shared = shared_tokens(sets)
    first = stage(candidates(index(sets.withColumn("wanted", F.lit(True)), shared), every=False))
    good = confirmed(first, sets, docs, id_col, text_col).select(F.col("b").alias("node")).distinct()
    failed = stage(first.select(F.col("b").alias("node")).distinct().join(good, "node", "left_anti"))
    if not failed.isEmpty():
        marked = stage(sets.join(failed.withColumn("wanted", F.lit(True)), "node", "left").select(
            *sets.columns, F.coalesce("wanted", F.lit(False)).alias("wanted")))
        theirs = marked.filter("wanted").select(F.explode("prefix").alias("token")).distinct()
        again = index(marked, stage(shared.join(theirs, "token", "left_semi")))
        others = stage(candidates(again, every=True).join(first, ["a", "b"], "left_anti"))
        more = confirmed(others, sets, docs, id_col, text_col)
        good = good.unionByName(more.select(F.col("b").alias("node")).distinct())
    matched = good.withColumn("matched", F.lit(True))
    decided = stage(sets.join(matched, "node", "left").select("digest", "size", "first", "matched"))
    gone = F.coalesce("matched", F.lit(False)) | ~place.eqNullSafe(F.col("first"))
    settled = join_groups(open_.select("doc_id", "h", "line", "digest"), decided, "digest", "size").select(
        "doc_id", "h", "line", gone.alias("gone")
    )
    alone = found.filter("digest IS NULL").select("doc_id", "h", "line", F.lit(False).alias("gone"))
    return settled.unionByName(alone)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*docs* without the removed lines; all rows and columns stay, and so does the order of the lines left."""
    lost = removed(docs, id_col, text_col).filter("gone").groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines"))
    packed = docs.select(F.struct("*").alias("_d"))
    old = F.col("_d")[text_col]
    same = F.col("_d")[id_col].cast("bigint").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(old, F.lit(""))) == F.col("h"))
    left = F.filter(F.split(old, "\n"), lambda line, k: ~F.array_contains("lines", k))
    new = F.when(F.col("lines").isNull(), old).otherwise(F.array_join(left, "\n"))
    return packed.join(lost, same, "left").select(
        *[(new if c == text_col else F.col("_d")[c]).alias(c) for c in docs.columns]
    )


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines`` that take part, ``n_removed, first_removed`` (line from 0)."""
    per = removed(docs, id_col, text_col).groupBy("doc_id", "h").agg(
        F.size(F.collect_set("line")).cast("bigint").alias("n_lines"),
        F.size(F.collect_set(F.when(F.col("gone"), F.col("line")))).cast("bigint").alias("n_removed"),
        F.min(F.when(F.col("gone"), F.col("line"))).alias("first_removed"),
    )
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"))
    same = rows["doc_id"].eqNullSafe(per["doc_id"]) & (rows["h"] == per["h"])
    zero = F.lit(0).cast("bigint")
    return rows.join(per, same, "left").select(
        rows["doc_id"], F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_removed", zero).alias("n_removed"),
        "first_removed",
    )
