"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents are range-sorted by length, and so are the gaps of open sequences.  One superstep
takes all documents of one length, longest first.  Their successor in the sorted gaps is the
smallest gap that is large enough; as all of them want the same gaps, the conflict is resolved
by rank: the k-th document of the length gets the k-th sequence with that gap, the next ones
go on to the next larger gap.  The gaps taken shrink and are sorted in anew, and the step
repeats; where nothing fits, new sequences are opened for the rest of that length.

Lengths and gaps are whole numbers up to the capacity, so a sorted list is a list of runs, at
most one length or gap class per number.  The sweep over runs needs counts by length only, and
its result is a list of matches (ranks of one length <-> sequences in a row), both of a size
that depends on the capacity and not on the number of documents.  Ranking, and giving every
document its sequence, are done by all tasks on their own rows.

Defined cases: a null text counts as empty and has the end id alone; ids may be null or repeat,
each row is packed; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm.common import batches, cut, text_or_empty
from veilmark.llm.tokens import END_ID, KEEP, encoder

CAPACITY = 2048
#: The sweep keeps one run list per length, so the capacity bounds what the driver holds.
MAX_CAPACITY = 1 << 20
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenise(
    docs: DataFrame, tokenizer_path: str, kind: str = "word", *, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", end_id: int = END_ID, keep: int = KEEP,
) -> DataFrame:
    """Pieces of at most *capacity* ids: ``doc_id, piece, start, length, ids_crc32``; texts stay where they are."""
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, kind, keep)
        for batch in parts:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for a, b in batches(texts):
                for name, ids in zip(names[a:b], encode(texts[a:b])):
                    raw = ids + end
                    out += [
                        (name, k, at // 4, len(piece := raw[at : at + step]) // 4, zlib.crc32(piece))
                        for k, at in enumerate(range(0, len(raw), step))
                    ]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PIECE.split(", ")]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECE)


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Matches for *counts* documents of each length.

    Rows ``length, rank, n, sequence, offset``: the documents of that length with ranks
    ``rank .. rank+n-1`` go into sequences ``sequence .. sequence+n-1``, each at *offset*.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    matches: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                n_new = -(-(total - rank) // (capacity // length))
                give(capacity, opened, n_new)
                opened += n_new
                continue
            gap = open_gaps[at]
            first, free = gaps[gap].pop()
            n = min(free, total - rank)
            if n < free:
                gaps[gap].append((first + n, free - n))
            if not gaps[gap]:
                open_gaps.pop(at)
            matches.append((length, rank, n, first, capacity - gap))
            give(gap - length, first, n)
            rank += n
    return np.array(matches, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to *pieces*, which have a ``length`` of 1 to *capacity*."""
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be between 1 and {MAX_CAPACITY}")
    spark = pieces.sparkSession
    columns = pieces.columns
    numbered = cut(pieces).withColumn("_row", F.monotonically_increasing_id())
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The row number splits documents of one length over several ranges.
    ranged = numbered.repartitionByRange(n_parts, "length", "_row").sortWithinPartitions("length", "_row")
    placed = cut(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()))

    # Ranges follow the lengths, so there are about as many rows as lengths and ranges together.
    part = F.shiftright("_at", 33)
    runs = sorted(
        tuple(r) for r in placed.groupBy(part.alias("p"), "length").agg(F.count(F.lit(1))).collect()
    )
    counts: dict[int, int] = defaultdict(int)
    local: dict[int, int] = defaultdict(int)
    shifts: dict[tuple[int, int], int] = {}
    for p, length, n in runs:
        shifts[p, length] = counts[length] - local[p]
        counts[length] += n
        local[p] += n
    matches = sweep(counts, capacity)
    by_rank = matches[np.lexsort((matches[:, 1], matches[:, 0]))]
    held = spark.sparkContext.broadcast((shifts, by_rank))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_shifts, table = held.value
        first_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in parts:
            at = batch.column(batch.num_columns - 1).to_numpy()
            length = batch.column(columns.index("length")).to_numpy()
            sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            p = at >> 33
            group = p * (capacity + 1) + length
            for g in np.unique(group):
                mine = group == g
                size = int(g % (capacity + 1))
                rank = (at[mine] & ((1 << 33) - 1)) + known_shifts[int(g // (capacity + 1)), size]
                a, b = first_of[size], first_of[size + 1]
                k = a + np.searchsorted(table[a:b, 1], rank, "right") - 1
                sequence[mine] = table[k, 3] + rank - table[k, 1]
                offset[mine] = table[k, 4]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*placed.drop("_at").schema.fields, *added])
    return placed.mapInArrow(run, schema)
