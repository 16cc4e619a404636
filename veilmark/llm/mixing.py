"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

* *Targets*: sources share the words of all documents by weight; a target stops at ``most`` times
  its source's words and the excess is shared again, until none is above.
* *Schedule*: the mix is a row of slots of ``block_words`` words.  Slot k has the golden-ratio point
  ``k * c mod 2^31``; the source whose stretch of the cumulative targets holds the point owns the
  slot.  Any stretch of slots is close to the target shares.
* *Ranks*: a source's slots are numbered in order; the slot of rank r takes words
  ``r * block_words ..`` of the source's stream, which is its documents laid end to end in the order
  of a hash, again and again.  A rank beyond the target is dropped, a missing one is added behind the
  last slot, and the last block ends at the target, so a source gives its target to the word.
* *Join*: documents are cut where blocks begin; pieces and slots meet on (source, rank).

Nothing is collected but sums over sources.  Source numbers, running words and ranks are running
totals in levels: rows are dealt over chunks of a few hundred by the leading bits of their place,
chunk totals are summed up in the same way, so a source with a third of all rows is no hot group.
No text is shuffled.  Everything follows from ids and texts, so a rerun gives the same mix.

Defined cases: a null text has no words, is never taken and stays in the result; a null source is a
source of its own, the last one; ids may be null or repeat, rows stand for themselves (rows that agree
in id and text share a chunk); further columns are not looked at; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import cut, join_groups

BLOCK_WORDS = 256
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its words.
MOST = 3
#: 2^31 over the golden ratio; odd, so its multiples visit every point.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Rows of a chunk are summed up by one task: 2^CHUNK_BITS, about.
CHUNK_BITS = 8
HASH_BITS = 60
SPACE = r"\x20\x09-\x0D"


def count_words(text: str) -> str:
    """Expression: number of words of *text*; makes no array of them."""
    each = f"length(regexp_replace({text}, '[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+', 'x'))"
    return f"CASE WHEN {text} RLIKE '[^{SPACE}]' THEN cast({each} AS bigint) ELSE 0L END".replace("\\", "\\\\")


def running(
    df: DataFrame, group: str, at: str, width: str, bits: str, most_bits: int, value: str, order: list[str], depth: int = 0
) -> DataFrame:
    """Add ``before``: the sum of *value* over the rows of the same *group* before this one.

    *at* is a place of *width* bits, whose leading *bits* (at most *most_bits*) choose the chunk;
    *order* refines it.  Rows agree on both within a group.
    """
    place = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if most_bits <= 0:
        return df.withColumn("before", F.coalesce(F.sum(value).over(place.partitionBy(group)), F.lit(0)))
    chunk, total, less = f"_chunk{depth}", f"_total{depth}", f"_bits{depth + 1}"
    chunked = df.withColumn(chunk, F.expr(f"shiftright({at}, cast({width} - {bits} AS int))"))
    totals = chunked.groupBy(group, chunk).agg(F.sum(value).alias(total), F.first(bits).alias(bits))
    totals = totals.withColumn(less, F.greatest(F.col(bits) - CHUNK_BITS, F.lit(0)))
    base = running(totals, group, chunk, bits, less, most_bits - CHUNK_BITS, total, [chunk], depth + 1)
    base = base.select(group, chunk, F.col("before").alias("_base"))
    local = F.coalesce(F.sum(value).over(place.partitionBy(group, chunk)), F.lit(0))
    joined = chunked.join(base, [group, chunk])
    return joined.withColumn("before", F.col("_base") + local).drop("_base", chunk)


def prefix(df: DataFrame, order: list, **values: str) -> DataFrame:
    """Add, for each name, the sum of an expression over all rows that come before in *order*."""
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range of a row must not change between the two uses below.
    ranged = cut(df.repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(*[F.sum(F.expr(v)).alias(f"_{k}") for k, v in values.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    base = sums.select("_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values])
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(base), "_part")
    for k, v in values.items():
        placed = placed.withColumn(k, F.col(f"_{k}") + F.coalesce(F.sum(F.expr(v)).over(here), F.lit(0)))
    return placed.drop("_part", *[f"_{k}" for k in values])


def level(sources: DataFrame, most: int = MOST) -> float:
    """Words a source gets per unit of weight, unless it stops at *most* times its own.

    Stopped sources leave the rest to the others, which raises the level and may stop more of
    them; the level only rises, and each round is a sum over the sources.
    """
    stopped, reached = -1, 0.0
    while True:
        full = F.col("words") * most <= F.lit(reached) * F.col("weight") if stopped >= 0 else F.lit(False)
        row = sources.agg(
            F.count_if(full).alias("stopped"), F.sum("words").alias("words"),
            F.sum(F.when(full, F.col("words") * most).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["stopped"] == stopped or not row["weight"]:
            return reached
        stopped = row["stopped"]
        reached = (row["words"] - row["given"]) / row["weight"]


def targets(sized: DataFrame, weights: Iterable[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: ``key, source, docs, words, weight, target, quota, first, src``.

    Sources are ordered by code point, null last, and take *weights* in turn.  ``quota`` is the target
    in whole words, ``first`` the quotas before it, ``src`` its number.
    """
    grouped = sized.groupBy("key", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"))
    by_name = [F.col("source").isNull(), F.col("source")]
    numbered = prefix(grouped, by_name, src="1L")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    numbered = cut(numbered.withColumn("weight", F.get(turn, (F.col("src") % F.size(turn)).cast("int"))))
    reached = level(numbered, most)
    target = F.least(F.col("words") * float(most), F.col("weight") * F.lit(reached))
    aimed = numbered.withColumn("target", target).withColumn("quota", F.floor("target").cast("bigint"))
    return cut(prefix(aimed, ["src"], first="quota"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, src, rank)``: the owner of every slot; together the ranks below every source's need."""
    spark = sources.sparkSession
    row = sources.agg(F.sum("quota").alias("quota"), F.count_if(F.col("quota") > 0).alias("n")).first()
    total = row["quota"] or 0
    n_slots = -(-total // block_words)
    need = F.expr(f"(quota + {block_words - 1}L) div {block_words}L")
    own = sources.filter("quota > 0").withColumn("need", need)
    # Stretches of the cumulative quotas, cut at cells so that an equi-join finds a point's stretch.
    cell = max(1, -(-total // (4 * (row["n"] or 0) + 64)))
    parts = own.select("src", "first", "quota", F.expr(f"explode(sequence(first div {cell}L, (first + quota - 1) div {cell}L))").alias("cell"))
    step = f"((id & {POINTS - 1}L) * {GOLDEN}L) & {POINTS - 1}L"
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.expr(f"least(cast(floor(({step}) / {float(POINTS)}D * {total}D) AS bigint), {max(total - 1, 0)}L)").alias("x")
    ).withColumn("cell", F.expr(f"x div {cell}L"))
    inside = (F.col("x") >= F.col("first")) & (F.col("x") < F.col("first") + F.col("quota"))
    owned = points.join(parts, "cell").filter(inside).select("slot", "src")
    width = max(1, n_slots.bit_length())
    most_bits = max(0, width - 12)
    ranked = running(
        owned.withColumns({"one": F.lit(1).cast("bigint"), "bits": F.lit(most_bits)}),
        "src", "slot", str(width), "bits", most_bits, "one", ["slot"],
    ).select("slot", "src", F.col("before").alias("rank"))
    counts = owned.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    short = own.join(counts, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < need")
    late = short.select("src", "n", F.expr("explode(sequence(n, need - 1))").alias("rank")).select(
        (F.lit(n_slots) + F.col("rank") - F.col("n")).alias("slot"), "src", "rank"
    )
    return ranked.join(own.select("src", "need"), "src").filter("rank < need").drop("need").unionByName(late)


def measured(
    docs: DataFrame, weights: Iterable[int] = WEIGHTS, most: int = MOST, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Documents and their sources: ``doc_id, size, src, start, words, target, quota`` and :func:`targets`.

    ``start`` is a document's place in its source's stream.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")
    )
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    sized = cut(
        rows.select(
            "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"),
            F.expr(count_words("coalesce(text, '')")).alias("size"), F.md5(name.cast("binary")).alias("turn"),
        )
    )
    sources = targets(sized, weights, most)
    bits = F.greatest(F.ceil(F.log2(F.col("docs") / F.lit(1 << CHUNK_BITS))), F.lit(0)).cast("int")
    known = sources.select("key", "src", "docs", "words", "target", "quota", bits.alias("bits"))
    placed = join_groups(sized.drop("source"), known, "key", "docs").drop("key", "docs")
    placed = placed.withColumn("at", F.conv(F.substring("turn", 1, HASH_BITS // 4), 16, 10).cast("bigint"))
    most_bits = sources.agg(F.max(bits)).first()[0] or 0
    laid = running(placed, "src", "at", str(HASH_BITS), "bits", most_bits, "size", ["turn"])
    return cut(laid.select("doc_id", "size", "src", F.col("before").alias("start"), "words", "target", "quota")), sources


def pieces(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(src, rank, start, doc_id, begin, n_words)``: what each block has of each document.

    ``begin`` counts words of the document.  Only the part of the stream below the target is made.
    """
    turns = laid.filter("size > 0 AND quota > start").select(
        "doc_id", "src", "start", "size", "quota",
        F.expr("explode(transform(sequence(0L, (quota - 1 - start) div words), e -> start + e * words))").alias("lo"),
    )
    ends = turns.withColumn("hi", F.expr("least(lo + size, quota)"))
    b = f"{block_words}L"
    cuts = ends.select("*", F.expr(f"explode(sequence(lo div {b}, (hi - 1) div {b}))").alias("rank"))
    at = F.expr(f"greatest(lo, rank * {b})")
    return cuts.select(
        "src", "rank", "start", "doc_id", (at - F.col("lo")).alias("begin"),
        (F.expr(f"least(hi, (rank + 1) * {b})") - at).alias("n_words"),
    )


def mix(
    docs: DataFrame, weights: Iterable[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, **columns: str
) -> DataFrame:
    """The mix: ``slot, src, rank, doc_id, begin, n_words``; read by slot, source, rank and begin."""
    laid, sources = measured(docs, weights, most, **columns)
    return _mix(laid, sources, block_words).drop("start")


def _mix(laid: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    return schedule(sources, block_words).join(pieces(laid, block_words), ["src", "rank"])


def taken(
    docs: DataFrame, weights: Iterable[int] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, **columns: str
) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``: the words of the mix added up."""
    laid, sources = measured(docs, weights, most, **columns)
    sums = _mix(laid, sources, block_words).groupBy("src", "start").agg(F.sum("n_words").alias("taken"))
    # Places are unique among documents that have words.
    found = laid.withColumn("place", F.when(F.col("size") > 0, F.col("start"))).join(
        sums.withColumnRenamed("start", "place"), ["src", "place"], "left"
    )
    return found.select(
        "doc_id", "size", F.col("words").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint").alias("taken"),
    )
