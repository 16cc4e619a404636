"""Searching texts for a dictionary of any size: an index of rare grams.

Every term is represented by one of its grams (stretches of a fixed number of characters), the one
that the fewest terms share.  A text is read once; of its grams, those that no term is represented by
are ruled out by a Bloom filter of bounded size, the others meet the terms in one equi-join.  What
comes back to a text are the places where a term would have to stand, and each is compared with the
text itself.  Only texts with such a place leave their task, and no term is ever collected.

Characters are compared in folded case, one by one, so places are those of the original text.  A
hot gram makes a skewed join partition, which adaptive execution splits on the side of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.spans import SPANS_TYPE
from veilmark.operators.common import HOT_SHARE, stage

#: Lengths of grams; a term has grams of the largest length it can hold.
SIZES = (1, 2, 4, 8)
#: Bound of the broadcast filter, in bits.
MAX_CELLS = 1 << 26
#: Bytes of texts that are worked on at once; a longer text is worked on alone.
CHUNK_CHARS = 1 << 20
LABELS = "array<struct<etype:string,score:string>>"
GRAMS = "array<struct<gram:bigint,pos:int>>"
FOUND = "array<struct<etype:string,value:string,start:int,end:int,score:string>>"


class _Folded(dict):
    def __missing__(self, code: int) -> str:
        upper = chr(code).upper()
        # The one letter with a longer lower case is the dotted capital I, which folds to its base.
        self[code] = (upper if len(upper) == 1 else chr(code)).lower()[0]
        return self[code]


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Case folding letter by letter, as in the ``(?iu)`` patterns, so positions stay."""
    return text.lower() if text.isascii() else text.translate(_FOLDED)


def codes(folded: str) -> np.ndarray:
    return np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(letters: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all grams of *size* characters, one per place."""
    n = len(letters) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ letters[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_size(length: int) -> int:
    return max(s for s in SIZES if s <= length)


def joined(folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in a row, and where each begins and how long it is."""
    lengths = np.array([len(t) for t in folded], np.int64)
    return codes("".join(folded)), np.cumsum(lengths) - lengths, lengths


def places(first: np.ndarray, lengths: np.ndarray, size: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams of *size* characters of the (*wanted*) joined texts begin, and the text of each."""
    n = np.maximum(lengths - size + 1, 0)
    if wanted is not None:
        n = np.where(wanted, n, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[row], row


def _chunks(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Stretches of *batch* of about :data:`CHUNK_CHARS` folded characters, with the folded texts of *columns*.

    What is worked out per character is bounded by this, and not by the rows of a batch.
    """
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + CHUNK_CHARS, side="right")))
        part = batch.slice(start, end - start)
        yield part, [[fold(t) for t in part.column(c).to_pylist()] for c in columns]
        start = end


# -- the terms ---------------------------------------------------------------------------------------


def index(terms: DataFrame) -> DataFrame:
    """``term, labels, size, off, gram``: folded terms with the place of their rarest gram.

    *terms* has ``term, etype, score``; terms that differ in case only are one.
    """

    def folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            low = pa.array([fold(t) for t in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([low, batch.column(1), batch.column(2)], names=["term", "etype", "score"])

    def all_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for rows, (terms,) in _chunks(batch, 1):
                numbers = np.asarray(rows.column(0))
                letters, first, lengths = joined(terms)
                wanted = np.array([gram_size(n) for n in lengths.tolist()], np.int32)
                for size in np.unique(wanted).tolist():
                    at, row = places(first, lengths, size, wanted == size)
                    gram, off = gram_hashes(letters, size)[at], at - first[row]
                    # Of a gram that repeats in a term the first place counts.
                    order = np.lexsort((off, gram, row))
                    gram, off, row = gram[order], off[order], row[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[row[new]]), pa.array(np.full(int(new.sum()), size), pa.int32()),
                         pa.array(off[new].astype(np.int32)), pa.array(gram[new].view(np.int64))],
                        names=["row", "size", "off", "gram"],
                    )

    listed = terms.select("term", "etype", F.col("score").cast("string")).mapInArrow(folded, "term string, etype string, score string")
    one = stage(listed.groupBy("term").agg(F.collect_set(F.struct("etype", "score")).cast(LABELS).alias("labels")))
    known = one.withColumn("row", F.monotonically_increasing_id())
    grams = stage(known.select("row", "term").mapInArrow(all_grams, "row bigint, size int, off int, gram bigint"))
    shared = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    total = shared.agg(F.sum("n")).first()[0] or 0
    # Grams of a thousandth of the rows, of which there can be a thousand, would crowd a task.
    hot = shared.filter(F.col("n") * HOT_SHARE >= max(total, 1))
    counted = grams.join(F.broadcast(hot), "gram").unionByName(
        grams.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(shared, "gram")
    )
    rarest = counted.groupBy("row").agg(F.min(F.struct("n", "off", "size", "gram")).alias("best"))
    return stage(known.join(rarest, "row").select("term", "labels", "best.size", "best.off", "best.gram"))


def cells_of(n_terms: int) -> int:
    """Bits of the filter: sixteen per term, rounded up to a power of two, :data:`MAX_CELLS` at the most."""
    return min(MAX_CELLS, 1 << max(10, (16 * n_terms - 1).bit_length()))


def _probes(gram: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return gram & np.uint64(cells - 1), (gram >> np.uint64(33)) & np.uint64(cells - 1)


def _filter(terms: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """Cells and bits of the filter; at most ``MAX_CELLS / 64`` words come to the driver."""
    cells = cells_of(n_terms)
    low, high = f"gram & {cells - 1}L", f"shiftrightunsigned(gram, 33) & {cells - 1}L"
    hit = terms.select(F.expr(f"explode(array({low}, {high}))").alias("cell"))
    words = hit.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("bits")
    )
    bits = np.zeros(cells // 64, np.int64)
    for w in words.toLocalIterator():
        bits[w["word"]] = w["bits"]
    return cells, bits.view(np.uint64)


def _maybe(bits: np.ndarray, cells: int, gram: np.ndarray) -> np.ndarray:
    hit = np.ones(len(gram), bool)
    for cell in _probes(gram, cells):
        hit &= (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


# -- the texts ---------------------------------------------------------------------------------------


def search(df: DataFrame, keep: list[str], text_col: str, terms: DataFrame, n_terms: int) -> DataFrame:
    """Rows ``keep + spans`` of the texts that hold a term of the :func:`index` *terms*."""
    shared = df.sparkSession.sparkContext.broadcast(_filter(terms, n_terms))
    sizes = [r["size"] for r in terms.select("size").distinct().collect()]

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, bits = shared.value
        for batch in parts:
            for rows, (texts,) in _chunks(batch, 1):
                letters, first, lengths = joined(texts)
                row, gram, pos = [], [], []
                for size in sizes:
                    hashes = gram_hashes(letters, size)
                    hit = np.flatnonzero(_maybe(bits, cells, hashes))
                    text = np.searchsorted(first, hit, side="right") - 1
                    # A gram may not reach into the next text.
                    inside = hit + size <= first[text] + lengths[text]
                    hit, text = hit[inside], text[inside]
                    row.append(text)
                    gram.append(hashes[hit])
                    pos.append(hit - first[text])
                row, gram, pos = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (row, gram, pos))
                order = np.argsort(row, kind="stable")
                counts = np.bincount(row, minlength=len(texts))
                values = pa.StructArray.from_arrays(
                    [pa.array(gram[order].view(np.int64), pa.int64()), pa.array(pos[order].astype(np.int32))], ["gram", "pos"]
                )
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
                with_grams = pa.RecordBatch.from_arrays([*rows.columns, lists], names=["_keep", "_text", "_grams"])
                yield with_grams.filter(pa.array(counts > 0))

    rows = df.filter(F.col(text_col).isNotNull()).select(F.struct(*keep).alias("_keep"), F.col(text_col).alias("_text"))
    kept_type = rows.schema["_keep"].dataType.simpleString()
    shape = f"_keep {kept_type}, _text string"
    held = stage(rows.mapInArrow(look_up, f"{shape}, _grams {GRAMS}")).withColumn("_row", F.monotonically_increasing_id())
    met = held.select("_row", F.inline("_grams")).join(terms, "gram")
    start = F.col("pos") - F.col("off")
    place = F.struct(start.alias("start"), "term", "labels")
    together = met.filter(start >= 0).groupBy("_row").agg(F.collect_list(place).alias("_places"))
    return (
        held.select("_row", "_keep", "_text").join(together, "_row").select("_keep", "_text", "_places")
        .mapInArrow(_verify, f"_keep {kept_type}, spans {FOUND}")
        .filter(F.size("spans") > 0)
        .select("_keep.*", F.col("spans").cast(SPANS_TYPE).alias("spans"))
    )


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the places with the text; a term never overlaps itself."""
    for batch in parts:
        for rows, (folded,) in _chunks(batch, 1):
            texts, listed = rows.column(1).to_pylist(), rows.column(2)
            counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            begins, names, labels = listed.flatten().flatten()
            row, start = np.repeat(np.arange(len(texts)), counts), np.asarray(begins)
            order = np.lexsort((start, row)).tolist()
            rows_of, starts, terms = row.tolist(), start.tolist(), names.to_pylist()
            good, values, last, taken = [], [], -1, {}
            for i in order:
                r, at, term = rows_of[i], starts[i], terms[i]
                if r != last:
                    last, taken = r, {}
                if at >= taken.get(term, 0) and folded[r].startswith(term, at):
                    taken[term] = end = at + len(term)
                    good.append(i)
                    values.append(texts[r][at:end])
            at = np.array(good, np.int64)
            held = labels.take(pa.array(at))
            each = np.repeat(np.arange(len(at)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            etype, score = held.flatten().flatten()
            value = pa.array(values, pa.string()).take(pa.array(each))
            first = start[at][each].astype(np.int32)
            end = first + np.array([len(v) for v in values], np.int32)[each]
            spans = pa.StructArray.from_arrays(
                [etype, value, pa.array(first), pa.array(end), score], ["etype", "value", "start", "end", "score"]
            )
            per = np.bincount(row[at][each], minlength=len(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["_keep", "spans"])
