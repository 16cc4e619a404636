"""Hard negatives: rows of another label that score close below an anchor's positives.

A row's score is its inner product with the anchor.  An anchor's positives are its best rows of the
same label; a positive's hard negatives are the best rows of other labels whose score lies in a
window, given as shares of the positive's score.

* Rows and anchors are packed into blocks.  Anchors near to the same pivot share a block; pivots are
  a bounded sample, on which speed depends but no result.
* Every anchor block has a *spanning tree*: a minimum spanning tree over the distances of its anchors.
* *Bounds*: with ``p`` the parent of anchor ``a`` and any row ``x``, the scores ``a.x`` and ``p.x`` are at
  most ``|a - p| * |x|`` apart.  Going down the tree, a row's interval at the parent, widened by that,
  is its interval at the child; rows whose interval meets no window of the child are out, and only
  the others are scored again, which makes their interval a point.  (For positives, the window is
  open above and starts at the n-th largest lower bound.)
* Row blocks meet anchor blocks in a grid of cells with a bounded number of blocks each; a cell
  gives at most n rows per anchor and window, and the best of all cells are kept.

Every anchor block must meet every row block, so the work is that of a query set against all rows, in
blocks; each row block moves once per anchor block.  Where the tree's edges are as long as the
vectors, as with vectors in random directions, no row is ruled out and all are scored.

Vectors are whole numbers; scores are exact and must fit in 64 bits, else the job ends with an
OverflowError.  Shorter vectors count as padded with zeros.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part; a
row without an id is never an anchor, may be found, and loses ties; rows with the same id stand
for themselves, so a second row with an anchor's id may be its positive; an anchor without
positives, or a positive without negatives, has no rows; further columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import cut
from veilmark.llm.mixing import prefix

N_POSITIVES, N_NEGATIVES = 5, 5
#: Percent of the positive's score between which a negative's score must lie.
WINDOW = (80, 100)
BLOCK_ROWS, BLOCK_ANCHORS, BLOCK_BYTES = 2048, 512, 8 << 20
#: Row blocks per cell of the grid, at most.
CELL_BLOCKS = 32
#: Anchors that others are grouped around.
PIVOTS = 64
NO_ID = (1 << 63) - 1

BLOCK = "block bigint, spread bigint, n int, rows binary, ids binary, labels binary, vectors binary"
POSITIVE = "block bigint, i int, anchor_id bigint, row bigint, id bigint, score bigint"
NEGATIVE = "block bigint, i int, k int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


# -- blocks --------------------------------------------------------------------------------------


def packed(rows: DataFrame, width: int, most_rows: int, tree: bool = False) -> DataFrame:
    """Blocks of *rows* ``(row, id, label, vector)`` in the order of each partition."""
    most = max(1, min(most_rows, BLOCK_BYTES // (8 * max(width, 1))))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        for batch in parts:
            row, ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            matrix = dense(batch.column(3), width)
            for a in range(0, len(row), most):
                held.append((row[a : a + most], ids[a : a + most], label[a : a + most], matrix[a : a + most]))
                while sum(len(h[0]) for h in held) >= most:
                    whole = [np.concatenate(c) for c in zip(*held)]
                    yield block([c[:most] for c in whole], part, count)
                    held, count = [tuple(c[most:] for c in whole)], count + 1
        if sum(len(h[0]) for h in held):
            yield block([np.concatenate(c) for c in zip(*held)], part, count)

    def block(columns: list[np.ndarray], part: int, count: int) -> pa.RecordBatch:
        row, ids, label, matrix = columns
        out = {
            "block": pa.array([part << 32 | count], pa.int64()), "spread": pa.array([part + count], pa.int64()),
            "n": pa.array([len(row)], pa.int32()), "rows": [row.astype("<i8").tobytes()], "ids": [ids.astype("<i8").tobytes()],
            "labels": [label.astype("<i8").tobytes()], "vectors": [matrix.tobytes()],
        }
        if tree:
            order, parent, edge = spanning_tree(matrix)
            out |= {"tree": [order.astype("<i8").tobytes()], "parents": [parent.astype("<i8").tobytes()], "edges": [edge.tobytes()]}
        return pa.RecordBatch.from_pydict(out)

    known = F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id")
    shape = BLOCK + (", tree binary, parents binary, edges binary" if tree else "")
    return rows.select("row", known, F.col("label").cast("bigint"), "vector").mapInArrow(run, shape)


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists of *column* as rows of a matrix, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def spanning_tree(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, edge)``: parents come first in *order*; the root's parent is -1.

    Prim's algorithm from the vector nearest to the mean; an edge is an upper bound of the distance.
    """
    n = len(matrix)
    root = int(np.argmin(((matrix - matrix.mean(0)) ** 2).sum(1)))
    order, parent, edge = np.empty(n, np.int64), np.full(n, -1), np.full(n, np.inf)
    open_, at = np.ones(n, bool), root
    edge[root] = 0.0
    for k in range(n):
        order[k], open_[at] = at, False
        away = np.sqrt(((matrix - matrix[at]) ** 2).sum(1))
        nearer = open_ & (away < edge)
        edge[nearer], parent[nearer] = away[nearer], at
        if k + 1 < n:
            left = np.flatnonzero(open_)
            at = int(left[np.argmin(edge[left])])
    return order, parent, edge * (1 + 1e-9)


class Block:
    """One block unpacked."""

    def __init__(self, row: dict, width: int):
        whole = lambda name: np.frombuffer(row[name], "<i8")
        self.n, self.rows, self.ids, self.labels = row["n"], whole("rows"), whole("ids"), whole("labels")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(self.n, width)
        self.norms = np.sqrt((self.vectors**2).sum(1)) * (1 + 1e-9)
        if "tree" in row:
            self.tree, self.parents, self.edges = whole("tree"), whole("parents"), np.frombuffer(row["edges"], "<f8")


class Scores:
    """Exact scores and intervals of the rows of a block at the anchors of another, down its tree."""

    def __init__(self, anchors: Block, rows: Block):
        self.anchors, self.rows = anchors, rows
        # Products of whole numbers are exact in doubles below 2^53.
        self.exact = float(anchors.norms.max(initial=0)) * float(rows.norms.max(initial=0)) < 2.0**52
        self.low = np.empty((anchors.n, rows.n))
        self.high = np.empty((anchors.n, rows.n))
        self.scored = 0

    def bound(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals at anchor *i*, from its parent's, or from the norms at the root."""
        p, most = int(self.anchors.parents[i]), self.anchors.norms[i] * self.rows.norms + 1
        if p < 0:
            self.low[i], self.high[i] = -most, most
        else:
            apart = self.anchors.edges[i] * self.rows.norms + 1
            np.maximum(self.low[p] - apart, -most, out=self.low[i])
            np.minimum(self.high[p] + apart, most, out=self.high[i])
        return self.low[i], self.high[i]

    def score(self, i: int, some: np.ndarray) -> np.ndarray:
        """Scores of the rows *some* at anchor *i*, which become their intervals."""
        self.scored += len(some)
        vector = self.anchors.vectors[i]
        if self.exact:
            found = self.rows.vectors[some] @ vector
        else:
            whole = [int(v) for v in vector.tolist()]
            found = np.array(
                [sum(int(a) * b for a, b in zip(x, whole)) for x in self.rows.vectors[some].tolist()], object
            )
            if len(found) and max(abs(v) for v in found.tolist()) > NO_ID:
                raise OverflowError("a score does not fit in 64 bits")
        self.low[i, some] = self.high[i, some] = found.astype(np.float64)
        if not self.exact:
            # The intervals of later anchors start from the rounded value.
            slack = np.abs(self.low[i, some]) * 1e-15 + 1
            self.low[i, some] -= slack
            self.high[i, some] += slack
        return found.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the *n* largest scores, ties by smaller id."""
    if len(scores) > 8 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def find_positives(anchors: Block, rows: Block, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, places, scores)`` of the best *n* rows of the block with the anchor's label."""
    scores = Scores(anchors, rows)
    alike = {int(v): np.flatnonzero(rows.labels == v) for v in np.unique(anchors.labels)}
    for i in anchors.tree.tolist():
        low, high = scores.bound(i)
        same = alike[int(anchors.labels[i])]
        same = same[rows.rows[same] != anchors.rows[i]]
        if len(same) > n:
            least = np.partition(low[same], len(same) - n)[len(same) - n]
            same = same[high[same] >= least]
        found = scores.score(i, same)
        top = best(found, rows.ids[same], n)
        yield i, same[top], found[top]


def find_negatives(
    anchors: Block, rows: Block, windows: dict[int, list[tuple[int, int, int]]], n: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(anchor, window, places, scores)``; *windows* has ``(k, least, most)`` of each anchor."""
    scores = Scores(anchors, rows)
    for i in anchors.tree.tolist():
        low, high = scores.bound(i)
        own = windows.get(i)
        if not own:
            continue
        least, most = min(w[1] for w in own), max(w[2] for w in own)
        some = np.flatnonzero((rows.labels != anchors.labels[i]) & (high >= least) & (low <= most))
        found = scores.score(i, some)
        inside = (found >= least) & (found <= most)
        some, found = some[inside], found[inside]
        order = np.lexsort((rows.ids[some], -found))
        some, found = some[order], found[order]
        for k, from_, to in own:
            a = int(np.searchsorted(-found, -to, "left"))
            b = int(np.searchsorted(-found, -from_, "right"))
            if a < b:
                yield i, k, some[a : min(b, a + n)], found[a : min(b, a + n)]


# -- the job -------------------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """Whether the array column *vector* and all its components are there and finite."""
    return F.expr(f"{vector} IS NOT NULL AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")


def _anchor_blocks(anchors: DataFrame, width: int, n: int) -> DataFrame:
    """Blocks with trees, numbered from 0."""
    if n > BLOCK_ANCHORS:
        some = anchors.orderBy(F.xxhash64("row")).limit(PIVOTS).select("vector").collect()
        pivots = np.zeros((len(some), width))
        for k, r in enumerate(some):
            pivots[k, : len(r["vector"])] = r["vector"]
        shared = anchors.sparkSession.sparkContext.broadcast(pivots)
        columns = anchors.columns

        def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in parts:
                x = dense(batch.column(columns.index("vector")), width)
                away = (centres**2).sum(1) - 2 * x @ centres.T
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(away.argmin(1) if len(x) else [], pa.int32())], names=[*columns, "pivot"]
                )

        shape = ", ".join(f"`{c}` {t}" for c, t in anchors.dtypes) + ", pivot int"
        order = ["pivot", "row"]
        n_parts = -(-n // (8 * BLOCK_ANCHORS))
        anchors = anchors.mapInArrow(near, shape).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    else:
        anchors = anchors.repartition(1)
    blocks = cut(packed(anchors, width, BLOCK_ANCHORS, tree=True))
    return cut(prefix(blocks, ["block"], at="1L").withColumn("block", F.col("at")).drop("at", "spread"))


def mine(
    vectors: DataFrame, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, window: tuple[int, int] = WINDOW
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    *vectors* has ``id bigint, label, vector array<double>`` of whole numbers, and ``anchor boolean``.
    """
    spark = vectors.sparkSession
    chosen = vectors.filter(F.col("label").isNotNull() & usable("vector")).select(
        F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "vector",
        (F.coalesce("anchor", F.lit(False)) & F.col("id").isNotNull()).alias("anchor"),
    )
    rows = cut(chosen).withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.max(F.size("vector")).alias("width"), F.count_if("anchor").alias("n")).first()
    width, n_anchors = size["width"] or 0, size["n"] or 0
    final = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors:
        return spark.createDataFrame([], final)

    anchors = _anchor_blocks(rows.filter("anchor"), width, n_anchors)
    blocks = cut(packed(rows, width, BLOCK_ROWS))
    n_blocks, n_sets = blocks.count(), anchors.count()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = max(-(-n_blocks // CELL_BLOCKS), min(n_blocks, -(-4 * n_parts // n_sets)))
    copies = blocks.withColumns(
        {"cell": F.col("spread") % wide, "block": F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)).cast("array<bigint>"))}
    )

    def grid(sets: DataFrame):
        spread = sets.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(wide - 1)).cast("array<bigint>")))
        return copies.groupBy("block", "cell").cogroup(spread.groupBy("block", "cell"))

    def cells(left: pa.Table, right: pa.Table):
        """The anchor block of a cell with each of its row blocks."""
        for one in right.to_pylist():
            held = Block(one, width)
            for k in range(left.num_rows):
                yield one, held, Block(left.slice(k, 1).to_pylist()[0], width)

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        for one, a, x in cells(left, right):
            for i, at, score in find_positives(a, x, n_positives):
                n = len(at)
                for c, v in zip(out, (np.full(n, one["block"]), np.full(n, i), np.full(n, a.ids[i]), x.rows[at], x.ids[at], score)):
                    c.append(v)
        return _table(out, POSITIVE)

    first = F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("score"), "id", "row"))
    found = grid(anchors).applyInArrow(positives, POSITIVE).withColumn("k", first).filter(F.col("k") <= n_positives)
    # At most n_positives per anchor of the block.
    given = found.groupBy("block").agg(F.collect_list(F.struct("i", "k", "id", "score")).alias("given"))
    low, high = window

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(8)]
        for one, a, x in cells(left, right):
            windows: dict[int, list[tuple[int, int, int]]] = {}
            known = {}
            for g in one["given"]:
                known[g["i"], g["k"]] = g
                # Whole scores between the two shares of the positive's score.
                from_, to = -(-low * g["score"] // 100), high * g["score"] // 100
                if from_ <= to:
                    windows.setdefault(g["i"], []).append((g["k"], from_, to))
            for i, k, at, score in find_negatives(a, x, windows, n_negatives):
                n, g = len(at), known[i, k]
                fixed = (one["block"], i, k, a.ids[i], g["id"], g["score"])
                for c, v in zip(out, [*(np.full(n, f) for f in fixed), x.ids[at], score]):
                    c.append(v)
        return _table(out, NEGATIVE)

    met = grid(cut(anchors.join(given, "block"))).applyInArrow(negatives, NEGATIVE)
    rank = F.row_number().over(Window.partitionBy("block", "i", "k").orderBy(F.desc("score"), "id"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return met.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", named("positive_id").alias("positive_id"), "rank", named("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _table(columns: list[list[np.ndarray]], shape: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    names, types = zip(*(c.split() for c in shape.split(", ")))
    arrays = [pa.array(np.concatenate(c) if c else [], kinds[t]) for c, t in zip(columns, types)]
    return pa.Table.from_arrays(arrays, names=list(names))
