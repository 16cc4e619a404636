"""SentencePiece-style encoding as a relational lattice, and decoding.

Spaces become U+2581 and every word starts with one.  Texts are cut into units wherever no piece of the
vocabulary reaches over the place, so the best path of a text is that of its units one after another, and
units of any length are whole.  Distinct units are taken apart into their substrings of at most the longest
piece's length; an equi-join with the piece table leaves the edges of the lattice, a character no piece
covers gets an edge of its own with byte pieces.  The edges of a unit are listed by the place they end at and
a higher-order ``aggregate`` folds Viterbi over the places: the best path to each place, ties going to the
edge that starts first.  Ids come back to the texts by a join with the units: the most frequent ones, a fixed
number, are broadcast, the others are joined once for all texts of a bucket, and meet their texts there.

Scores are those of the table.  A BPE file's scores are the ranks of its merges, which do not add
up, so :func:`fit` estimates the log-probabilities of a unigram model over the same pieces from the
units and their counts, all of them, by expected counts on the same lattice; ``fitted`` asks for it.
Ids may differ from a BPE library's, decoding gives the same text.  The piece table is one vocabulary, which bounds its
broadcast (``MAX_PIECES``).

Defined cases: a null or empty text has no words and no ids; words may have any length; ids of texts may be
null or repeat; columns of any name, ``_row`` and ``_d`` included, stay as they are; U+2581 in a text reads as
a space, so it decodes to one; bytes that are no UTF-8 read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm.common import bound_batches
from veilmark.operators.common import cut, stage

SPACE = "▁"
MAX_PIECES = 1_000_000
#: What a character without a piece costs more than the worst piece.
UNKNOWN = -10.0
#: Rounds of expected counts.
ROUNDS = 2
#: What a piece that is never expected counts for.
LEAST_COUNT = 1e-3
#: Scores are rounded, as sums over partitions differ in their last digits.
DIGITS = 6
#: Places of a lattice that are folded at a time; only what long units cost depends on it.
BLOCK = 128
#: Units that are broadcast, at most.
HOT_UNITS = 300_000
#: Units of the texts of one bucket, about.
BUCKET_UNITS = 100_000
#: Edges that Python works on at a time, about.
EDGES = 1 << 17
#: Bytes of a batch of texts.
BATCH_BYTES = 2 << 20
#: Units whose ids are put together at a time, about.
FILL_UNITS = 1 << 18
#: Bits of the hashes of neighbouring characters and of pieces.
PAIR_BITS = 22


def pieces(spark: SparkSession, model_path: str) -> DataFrame:
    """``piece, id, score`` of the normal pieces and ``<0xNN>`` of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if model.get_piece_size() > MAX_PIECES:
        raise ValueError(f"at most {MAX_PIECES} pieces")
    rows = [
        (model.id_to_piece(i), i, float(model.get_score(i)), model.is_byte(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    return spark.createDataFrame(rows, "piece string, id int, score double, is_byte boolean")


def numbered(docs: DataFrame) -> DataFrame:
    """``_row, _d``: the rows of *docs* under a number that stays theirs.

    The numbers are written down once: a plan that is evaluated again behind a shuffle may deal
    rows out in another order, and texts would get the ids of others.
    """
    return stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_d")))


# -- units -----------------------------------------------------------------------------------------


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - PAIR_BITS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _characters(data: pa.Buffer) -> np.ndarray:
    """Where the characters of UTF-8 begin."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def joints(table: DataFrame) -> np.ndarray:
    """Whether a piece may hold two characters side by side, by the hash of both; where none does, texts are cut.

    Pairs that share a hash only leave a unit longer.
    """
    held = np.zeros(1 << PAIR_BITS, bool)
    for r in table.filter("NOT is_byte").select("piece").collect():
        points = _points(r["piece"])
        held[_pair(points[:-1], points[1:])] = True
    return held


def units_of(texts: pa.Array, held: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of all *texts* in order, their number and the number of words of each text."""
    texts = texts.cast(pa.large_string())
    spaced = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), pc.replace_substring(texts, " ", SPACE), pa.scalar("", pa.large_string()))
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), spaced)
    words = pc.count_substring(marked, SPACE).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    size = int(ends[-1] - ends[0])
    if not size:
        return pa.array([], pa.large_string()), np.zeros(len(marked), np.int64), words
    data = marked.buffers()[2].slice(int(ends[0]), size)
    points = _points(data.to_pybytes().decode())
    at = _characters(data)
    starts = np.searchsorted(at, ends - ends[0])
    begins = np.ones(len(points), bool)
    np.logical_not(held[_pair(points[:-1], points[1:])], out=begins[1:])
    begins[starts[starts < len(points)]] = True
    places = np.flatnonzero(begins)
    offsets = np.append(at[places], size)
    found = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), data)
    return found, np.diff(np.searchsorted(places, starts)), words


def unit_counts(texts: DataFrame, held) -> DataFrame:
    """``word, n``: distinct units of the column ``_text`` with their counts; *held*: broadcast :func:`joints`."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = pc.value_counts(units_of(batch.column(0), held.value)[0])
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    return texts.select("_text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# -- lattice ---------------------------------------------------------------------------------------


def _longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    return h * np.uint32(0x01000193) + points


def edges_of(distinct: DataFrame, table: DataFrame) -> DataFrame:
    """``unit, word, length, n, end, size, id, score`` of every edge of the lattices of ``word, n``.

    Substrings are made in Python, without those whose hash no piece has; the join with the pieces decides.  Edges
    of a unit follow one another, by their end and then by their size, as a broadcast join leaves rows where they
    are; ``unit`` is their number in a task, ``word`` stands with the first.  A character without a piece has the
    id ``-1 - code point``.
    """
    known = table.filter("NOT is_byte").select("piece", "id", "score")
    by_size: dict[int, list[str]] = {1: []}
    for r in known.select("piece").collect():
        by_size.setdefault(len(r["piece"]), []).append(r["piece"])
    by_size.pop(0, None)
    possible = np.zeros(1 << PAIR_BITS, bool)
    for size, some in by_size.items():
        points, h = _points("".join(some)).reshape(-1, size), np.zeros(len(some), np.uint32)
        for k in range(size - 1, -1, -1):
            h = _longer(h, points[:, k])
        possible[_pair(h, np.array([size], np.uint32))] = True
    sizes = sorted(by_size)
    shared = distinct.sparkSession.sparkContext.broadcast(possible)

    def spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = 0
        for batch in parts:
            words = batch.column("word").cast(pa.large_string())
            if not len(words):
                continue
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            data = words.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))
            points, at = _points(data.to_pybytes().decode()), np.append(_characters(data), len(data))
            length = np.diff(np.searchsorted(at, ends - ends[0]))
            unit = np.repeat(np.arange(len(words)), length)
            local = np.arange(len(points)) - (np.cumsum(length) - length)[unit] + 1
            # Substrings by the place they end at, which grow to the left.
            found, h = np.zeros((len(points), len(sizes)), bool), np.zeros(len(points), np.uint32)
            found[:, 0] = True
            for size in range(1, min(sizes[-1], len(points)) + 1):
                h[size - 1 :] = _longer(h[size - 1 :], points[: len(points) - size + 1])
                if size > 1 and size in by_size:
                    found[size - 1 :, sizes.index(size)] = shared.value[_pair(h[size - 1 :], np.array([size], np.uint32))] & (local[size - 1 :] >= size)
            end, size = np.nonzero(found)
            size = np.array(sizes)[size]
            low = at[end + 1 - size]
            n_bytes = at[end + 1] - low
            upto = np.append(0, np.cumsum(n_bytes))
            held = np.frombuffer(data, np.uint8)[np.repeat(low - upto[:-1], n_bytes) + np.arange(upto[-1])]
            pieces_ = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(upto), pa.py_buffer(held)).cast(pa.string())
            of, place = unit[end], local[end]
            firsts = pa.array(of, mask=~((place == 1) & (size == 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(of + past), batch.column("word").take(firsts), pa.array(length[of].astype(np.int32)),
                 pa.array(batch.column("n").to_numpy()[of]), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pieces_],
                names=["unit", "word", "length", "n", "end", "size", "piece"])
            past += len(words)

    cut_up = distinct.filter("length(word) > 0").select("word", F.col("n").cast("double").alias("n")).mapInArrow(
        spans, "unit bigint, word string, length int, n double, end int, size int, piece string")
    met = cut_up.join(F.broadcast(known), "piece", "left").filter("id IS NOT NULL OR size = 1")
    return met.select("unit", "word", "length", "n", "end", "size", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), "score")


def whole_units(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``EDGES`` rows of :func:`edges_of` that hold all edges of each of their units."""
    held, rows = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in parts:
        if not batch.num_rows:
            continue
        unit = batch.column("unit").to_numpy()
        last = int(np.flatnonzero(unit == unit[-1])[0])
        if rows + last >= EDGES and last:
            held.append(batch.slice(0, last))
            yield joined()
            held, rows, batch = [], 0, batch.slice(last)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield joined()


def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of whole units: the first row of each unit, its number of places, the unit of each row."""
    unit = batch.column("unit").to_numpy()
    new = np.append(True, unit[1:] != unit[:-1])
    first = np.flatnonzero(new)
    size, end = batch.column("length").to_numpy()[first].astype(np.int64), batch.column("end").to_numpy()
    # Every place has an edge of one character, and ends rise; else rows of a unit were not together.
    if np.count_nonzero(np.append(True, new[1:] | (end[1:] != end[:-1]))) != size.sum():
        raise RuntimeError("the edges of a unit do not follow one another")
    return first, size, np.cumsum(new) - 1


def fit(distinct: DataFrame, table: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """*table* with log-probabilities of its pieces as scores, fitted to words or units ``word, n`` and their counts.

    Merge ranks are no additive scores, so the unigram model is estimated as SentencePiece does: forward and
    backward sums over each lattice give the expected count of every edge, their sum over all words the
    probability of its piece.  At first a piece weighs what its merge rank says, by Zipf's law.  A piece that is
    never expected keeps the probability of a small part of a count.
    """
    known = table.filter("NOT is_byte")
    n_pieces = known.count()
    # The rank of a merge is its negative score; pieces that were put in by hand and have no rank come last.
    rank = F.least(F.greatest(-F.col("score"), F.lit(0.0)), F.lit(float(n_pieces))) + 1
    total = known.agg(F.sum(1 / rank)).first()[0]
    if total is None:
        return table
    scored = known.select("piece", "id", F.log(1 / rank / total).alias("score"))
    edges = edges_of(distinct, table).select("unit", "length", "n", "end", "size", "id")
    for _ in range(rounds):
        rows = scored.select("id", "score").collect()
        # The last place, that of id -1, belongs to characters without a piece.
        scores = np.full(max(r["id"] for r in rows) + 2, min(r["score"] for r in rows) + UNKNOWN)
        for r in rows:
            scores[r["id"]] = r["score"]
        shared = distinct.sparkSession.sparkContext.broadcast(scores)

        def expected(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scores = shared.value
            sums = np.zeros(len(scores))
            for batch in whole_units(parts):
                first, length, unit = places(batch)
                end, size, ids = (batch.column(c).to_numpy().astype(np.int64) for c in ("end", "size", "id"))
                ids = np.maximum(ids, -1)
                counts = expected_counts(length, unit, end - size, end, scores[ids])
                sums += np.bincount(ids + 1, counts * batch.column("n").to_numpy()[first][unit], len(scores))
            some = np.flatnonzero(sums[1:])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[1:][some])], names=["id", "count"])

        counts = edges.mapInArrow(expected, "id int, count double").groupBy("id").agg(F.sum("count").alias("count"))
        held = F.greatest(F.coalesce("count", F.lit(0.0)), F.lit(LEAST_COUNT)).alias("count")
        # One vocabulary; its sum comes from the same rows as its parts.
        new = cut(known.select("piece", "id").join(F.broadcast(counts), "id", "left").select("piece", "id", held))
        scored = new.select("piece", "id", F.round(F.log("count") - F.log(F.lit(new.agg(F.sum("count")).first()[0])), DIGITS).alias("score"))
    worst = scored.agg(F.min("score")).first()[0]
    fitted = scored.select("piece", "id", "score", F.lit(False).alias("is_byte"))
    rest = table.filter("is_byte").select("piece", "id", F.lit(worst + UNKNOWN).alias("score"), "is_byte")
    return cut(fitted.unionByName(rest))


def expected_counts(size: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> np.ndarray:
    """How often each edge is expected, of all words of a batch at once; ``size``: characters of each word.

    Sums run forward and backward over the places of all lattices, in logarithms.
    """
    if not len(word):
        return np.empty(0)
    first = np.cumsum(size + 1) - size - 1
    begin, finish = first[word] + start, first[word] + end
    ahead, back = np.zeros(int((size + 1).sum())), np.zeros(int((size + 1).sum()))
    _sums(end, finish, begin, score, ahead)
    _sums(size[word] - start, begin, finish, score, back)
    return np.exp(ahead[begin] + score + back[finish] - ahead[first + size][word])


def _sums(step: np.ndarray, to: np.ndarray, since: np.ndarray, score: np.ndarray, total: np.ndarray) -> None:
    """Fill *total* place by place: the logarithm of the sum over edges *since* one place *to* another, in the order of *step*."""
    order = np.lexsort((to, step))
    step, to, since, score = step[order], to[order], since[order], score[order]
    groups = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    many = np.diff(np.append(groups, len(to)))
    steps = np.append(np.flatnonzero(np.append(True, np.diff(step[groups]) != 0)), len(groups))
    for a, b in zip(steps[:-1], steps[1:]):
        low, high = groups[a], groups[b] if b < len(groups) else len(to)
        value = total[since[low:high]] + score[low:high]
        top = np.maximum.reduceat(value, groups[a:b] - low)
        total[to[groups[a:b]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, many[a:b])), groups[a:b] - low))


def listed(edges: DataFrame) -> DataFrame:
    """``word, ends``: per unit of :func:`edges_of` its edges, by the place they end at, in blocks of places."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(parts):
            first, length, unit = places(batch)
            end, size, ids, score = (batch.column(c) for c in ("end", "size", "id", "score"))
            place, base = end.to_numpy(), np.cumsum(length) - length
            at = np.append(np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (unit[1:] != unit[:-1]))), len(place))
            edge = pa.StructArray.from_arrays([score, size, ids], names=["score", "size", "id"])
            per_place = pa.ListArray.from_arrays(pa.array(at, pa.int32()), edge)
            blocks = -(-length // BLOCK)
            firsts = np.append(0, np.cumsum(blocks))
            of = np.repeat(np.arange(len(blocks)), blocks)
            cuts = np.append(base[of] + BLOCK * (np.arange(len(of)) - firsts[of]), len(at) - 1)
            per_block = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), per_place)
            ends = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), per_block)
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(first)), ends], names=["word", "ends"])

    ends = "array<array<array<struct<score: double, size: int, id: int>>>>"
    return edges.select("unit", "word", "length", "end", "size", "id", "score").mapInArrow(run, f"word string, ends {ends}")


def lattice(distinct: DataFrame, table: DataFrame) -> DataFrame:
    """``word, ids`` of the best path of every word or unit in column ``word``, which does not repeat."""
    known = table.filter("NOT is_byte")
    worst, longest = known.agg(F.min("score"), F.max(F.length("piece"))).first()
    byte_ids = {r["piece"]: r["id"] for r in table.filter("is_byte").collect()}
    in_order = F.array(*[F.lit(byte_ids.get(f"<0x{b:02X}>", 0)) for b in range(256)])
    unknown = F.lit((worst or 0.0) + UNKNOWN)
    edges = edges_of(distinct.select("word", F.lit(1).alias("n")), table).withColumn("score", F.coalesce("score", unknown))

    # A path to a place is its last edge and its score; an edge of size s follows the path s places before its end.
    def step(paths: Column, ending: Column) -> Column:
        ways = F.transform(ending, lambda e: F.struct(
            (F.element_at(paths, -e["size"])["score"] + e["score"]).alias("score"), e["size"].alias("size"), e["id"].alias("id")))
        return F.concat(paths, F.array(F.array_max(ways)))

    def block(done: Column, ends: Column) -> Column:
        before = F.element_at(done, -1)
        recent = F.least(F.lit(longest or 1), F.size(before))
        return F.concat(done, F.array(F.aggregate(ends, F.slice(before, -recent, recent), step)))

    begin = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("size"), F.lit(0).alias("id"))
    folded = F.aggregate("ends", F.array(F.array(begin)), block)
    # Every block but the first list begins with places of the block before.
    own = F.transform(F.col("ends"), lambda ends, i: F.slice(F.element_at(F.col("done"), i + 2), -F.size(ends), F.size(ends)))

    # Backwards: places inside the edge that was taken last are skipped.
    def walk(state: Column, path: Column) -> Column:
        inside = state["skip"] > 0
        return F.when(inside, F.struct((state["skip"] - 1).alias("skip"), state["ids"].alias("ids"))).otherwise(
            F.struct((path["size"] - 1).alias("skip"), F.concat(state["ids"], F.array(path["id"])).alias("ids")))

    def walk_block(state: Column, paths: Column) -> Column:
        none = F.array().cast("array<int>")
        last = F.element_at(state, -1)["skip"]
        return F.concat(state, F.array(F.aggregate(F.reverse(paths), F.struct(last.alias("skip"), none.alias("ids")), walk)))

    start = F.array(F.struct(F.lit(0).alias("skip"), F.array().cast("array<int>").alias("ids")))
    back = F.aggregate(F.reverse(F.col("own")), start, walk_block, lambda s: F.reverse(F.flatten(F.transform(s, lambda x: x["ids"]))))

    def as_bytes(i: Column) -> Column:
        point = -1 - i
        tail = [F.lit(0x80) + F.shiftright(point, 6 * k).bitwiseAND(F.lit(0x3F)) for k in range(3)]
        utf8 = (
            F.when(point < 0x80, F.array(point))
            .when(point < 0x800, F.array(F.lit(0xC0) + F.shiftright(point, 6), tail[0]))
            .when(point < 0x10000, F.array(F.lit(0xE0) + F.shiftright(point, 12), tail[1], tail[0]))
            .otherwise(F.array(F.lit(0xF0) + F.shiftright(point, 18), tail[2], tail[1], tail[0]))
        )
        return F.transform(utf8, lambda b: F.element_at(in_order, b + 1))

    spelled = F.flatten(F.transform("back", lambda i: F.when(i < 0, as_bytes(i)).otherwise(F.array(i))))
    ids = F.when(F.exists("back", lambda i: i < 0), spelled).otherwise(F.col("back"))
    paths = listed(edges).select("word", "ends", folded.alias("done")).select("word", own.alias("own")).select("word", back.alias("back"))
    return paths.select("word", ids.alias("ids"))


# -- texts -----------------------------------------------------------------------------------------


def _packed(codes: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def hot_units(known: DataFrame) -> pa.Table:
    """``word, ids, n`` of the most frequent units, ``HOT_UNITS`` at most."""
    level = F.floor(F.log2("n") * 16)
    many, least = 0, None
    for r in known.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect():
        many += r["k"]
        if many > HOT_UNITS:
            break
        least = r["level"]
    return known.filter(level >= least if least is not None else F.lit(False)).select("word", "ids", "n").toArrow()


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of texts that are not empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data, begins = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(begins, np.diff(ends))
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], begins)


def encoded(rows: DataFrame, table: DataFrame, fitted: bool = False) -> DataFrame:
    """``_row, n_words, ids`` of *rows* ``_row, _text``; *fitted*: with scores of :func:`fit`.

    ``_row`` is whatever belongs to a text.  The rows are evaluated three times, and each time the bucket of a text
    follows from its row alone, so it does not matter how they are dealt out.  A bucket gets the ids of the units
    in it that are not broadcast, then its texts, which are the numbers of broadcast units and the other units as they are.
    """
    spark = rows.sparkSession
    bound_batches(spark, BATCH_BYTES)
    rows = rows.select("_row", F.make_valid_utf8(F.coalesce("_text", F.lit(""))).alias("_text"))
    held = spark.sparkContext.broadcast(joints(table))
    counts = stage(unit_counts(rows, held))
    if fitted:
        table = fit(counts, table)
    known = stage(lattice(counts.select("word"), table).join(counts, "word"))
    hot = hot_units(known)
    # Frequent units have small numbers, which pack well.
    hot = hot.take(pc.sort_indices(hot, [("n", "descending"), ("word", "ascending")]))
    words, hot_ids = (pa.concat_arrays([*hot.column(c).chunks, pa.array([], hot.schema.field(c).type)]) for c in ("word", "ids"))
    words = words.cast(pa.large_string())
    order = np.argsort(_hashes(words), kind="stable")
    shared = spark.sparkContext.broadcast((
        words, (_hashes(words)[order], order), hot_ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(hot_ids).to_numpy(zero_copy_only=False),
    ))
    n_buckets = (known.agg(F.sum("n")).first()[0] or 0) // BUCKET_UNITS + 1
    dealt = rows.select(F.pmod(F.xxhash64("_row", "_text"), F.lit(n_buckets)).alias("bucket"), "_row", "_text")

    def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Numbers of all units of *texts*, units and words of each text, and the units that are not broadcast."""
        found, n_units, n_words = units_of(texts, held.value)
        words, (hashes, order) = shared.value[:2]
        one = found.dictionary_encode()
        number = np.append(order, 0)[np.searchsorted(hashes, _hashes(one.dictionary))]
        near = words.take(pa.array(number)) if len(words) else pa.nulls(len(number), pa.large_string())
        # Another unit of the same hash counts as not broadcast.
        number[~pc.fill_null(pc.equal(near, one.dictionary), False).to_numpy(zero_copy_only=False)] = len(words)
        codes = number[one.indices.to_numpy(zero_copy_only=False)]
        return codes, n_units, n_words, found.filter(pa.array(codes == len(words)))

    def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            codes, n_units, _, cold = coded(batch.column(1))
            at = np.repeat(batch.column(0).to_numpy(), n_units)[codes == len(shared.value[0])]
            pairs = pa.table({"bucket": at, "word": cold.cast(pa.string())})
            yield from pairs.group_by(["bucket", "word"]).aggregate([]).to_batches()

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            codes, n_units, n_words, cold = coded(batch.column(2))
            last = np.append(0, np.cumsum(n_units))
            colds = np.append(0, np.cumsum(codes == len(shared.value[0])))[last]
            packed = pa.array([_packed(codes[a:b]) for a, b in zip(last[:-1], last[1:])], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(colds, pa.int32()), cold.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_units, pa.int64()), packed, lists],
                names=["bucket", "_row", "n_words", "n_units", "codes", "cold"])

    kind = T.StructType([rows.schema["_row"]])
    named = T.StructType([T.StructField("bucket", T.LongType()), *kind.fields, T.StructField("n_words", T.LongType()),
                          T.StructField("n_units", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("cold", T.ArrayType(T.StringType()))])
    looked_up = (
        dealt.select("bucket", "_text").mapInArrow(rare, "bucket bigint, word string").repartition("word").distinct()
        .join(known.select("word", "ids"), "word").select("bucket", F.lit(True).alias("entry"), "word", "ids")
    )
    whole = dealt.mapInArrow(texts, named).withColumn("entry", F.lit(False))
    met = looked_up.unionByName(whole, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.desc("entry"))

    def fill(some: pa.RecordBatch, entries: dict[str, list[int]], begins: np.ndarray) -> pa.RecordBatch:
        words, _, flat, sizes = shared.value
        per = some.column("n_units").to_numpy()
        codes = np.concatenate([_unpacked(x) for x in some.column("codes").to_pylist()]).astype(np.int64)
        cold = [entries[w] for w in some.column("cold").flatten().to_pylist()]
        # The others come in the order of the texts, behind the ids of broadcast units.
        rest = codes == len(words)
        begin, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        begin[~rest], size[~rest] = begins[codes[~rest]], sizes[codes[~rest]]
        size[rest] = own = np.array([len(x) for x in cold], np.int64)
        begin[rest] = np.cumsum(own) - own
        upto = np.cumsum(size)
        at, cold_at = np.repeat(begin - upto + size, size) + np.arange(size.sum()), np.repeat(rest, size)
        ids = np.empty(len(at), np.int32)
        ids[~cold_at] = flat[at[~cold_at]]
        ids[cold_at] = [i for x in cold for i in x]
        ends = np.append(0, upto)[np.append(0, np.cumsum(per))]
        return pa.RecordBatch.from_arrays(
            [some.column("_row"), some.column("n_words"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["_row", "n_words", "ids"])

    def filled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = shared.value[3]
        begins = np.cumsum(sizes, dtype=np.int64) - sizes
        bucket, entries = None, {}
        for batch in parts:
            at, entry = batch.column("bucket").to_numpy(), batch.column("entry").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (entry[1:] != entry[:-1])))
            for low, high in zip(new, np.append(new[1:], len(at))):
                some = batch.slice(low, high - low)
                if at[low] != bucket:
                    bucket, entries = at[low], {}
                if entry[low]:
                    entries.update(zip(some.column("word").to_pylist(), some.column("ids").to_pylist()))
                    continue
                many = np.cumsum(some.column("n_units").to_numpy()) // FILL_UNITS
                starts = np.append(0, np.flatnonzero(np.diff(many)) + 1)
                for start, end in zip(starts, np.append(starts[1:], len(many))):
                    yield fill(some.slice(start, end - start), entries, begins)

    result = T.StructType([*kind.fields, T.StructField("n_words", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return met.mapInArrow(filled, result)


def encode(docs: DataFrame, table: DataFrame, text_col: str = "text", fitted: bool = False) -> DataFrame:
    """*docs* with their ids in the array column ``ids``."""
    packed = numbered(docs)
    per = encoded(packed.select("_row", F.col("_d")[text_col].alias("_text")), table, fitted)
    return packed.join(per.select("_row", F.col("ids").alias("_ids")), "_row").select("_d.*", F.col("_ids").alias("ids"))


def digests(docs: DataFrame, table: DataFrame, keys: list[str], text_col: str = "text", fitted: bool = False) -> DataFrame:
    """*keys* of every row with ``n_words, n_tokens, ids_hash, ids, restored``; the hash depends on order and ids.

    All ids are decoded again; ``restored`` says whether that gives the text, which only U+2581 in a text prevents.
    """
    row = F.struct(F.struct(*[F.col(k) for k in keys]).alias("k"), F.xxhash64(_valid(text_col)).alias("h"))
    per = encoded(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), table, fitted)
    back = decode(per, table)
    n = F.size("ids").cast("bigint")
    return back.select(
        *[F.col("_row")["k"][k].alias(k) for k in keys], "n_words", n.alias("n_tokens"),
        F.when(n > 0, F.xxhash64("ids")).otherwise(F.lit(0).cast("bigint")).alias("ids_hash"),
        "ids", (F.xxhash64("decoded") == F.col("_row")["h"]).alias("restored"),
    )


def _valid(text_col: str) -> Column:
    return F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))


def decode(coded: DataFrame, table: DataFrame) -> DataFrame:
    """*coded* with the text of the array column ``ids`` in ``decoded``; byte pieces become their bytes."""
    plain = F.encode(F.replace(F.col("piece"), F.lit(SPACE), F.lit(" ")), "UTF-8")
    body = F.when(F.col("is_byte"), F.unhex(F.substring("piece", 4, 2))).otherwise(plain)
    rows = table.select("id", body.alias("body")).collect()
    # An id that the table does not have stands for nothing.
    bodies = [b""] * (max((r["id"] for r in rows), default=-1) + 2)
    for r in rows:
        bodies[r["id"]] = bytes(r["body"])
    shared = coded.sparkSession.sparkContext.broadcast(pa.array(bodies, pa.large_binary()))

    @F.arrow_udf("binary")
    def text(ids: pa.Array) -> pa.Array:
        bodies = shared.value
        lists = pc.fill_null(ids, pa.scalar([], ids.type))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        flat = np.where((flat >= 0) & (flat < len(bodies)), flat, len(bodies) - 1).astype(np.int64)
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        taken = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), bodies.take(pa.array(flat)))
        return pc.binary_join(taken, pa.scalar(b"", pa.large_binary())).cast(pa.binary())

    return coded.withColumn("decoded", F.substr(F.decode(text("ids"), "UTF-8"), F.lit(2)))
