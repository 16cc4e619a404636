"""Hard negatives against brute force: bounds, blocks, ties and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import hard_negatives as H


def block(rows, width, tree=False):
    """A block of ``(row, id, label, vector)``."""
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, : len(r[3])] = r[3]
    out = {"n": len(rows), "vectors": x.tobytes()}
    for name, at in (("rows", 0), ("ids", 1), ("labels", 2)):
        out[name] = np.array([r[at] for r in rows], "<i8").tobytes()
    if tree:
        order, parent, edge = H.spanning_tree(x)
        out |= {"tree": order.astype("<i8").tobytes(), "parents": parent.astype("<i8").tobytes(), "edges": edge.tobytes()}
    return H.Block(out, width)


def brute(rows, n=5, m=5, low=80, high=100):
    """*rows* are ``(id, label, vector, anchor)``; None as in the tables."""
    def fine(r):
        return r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[2])

    def dot(a, b):
        return sum(int(x) * int(y) for x, y in zip(a, b))

    rows = [(k, *r) for k, r in enumerate(rows) if fine(r)]
    rank = lambda s, i: (-s, H.NO_ID if i is None else i)
    out = []
    for a in rows:
        if not a[4] or a[1] is None:
            continue
        scored = sorted(((dot(a[3], r[3]), r) for r in rows if r[0] != a[0]), key=lambda v: rank(v[0], v[1][1]))
        for ps, p in [v for v in scored if v[1][2] == a[2]][:n]:
            window = [v for v in scored if v[1][2] != a[2] and low * ps <= 100 * v[0] <= high * ps][:m]
            out += [(a[1], p[1], k, r[1], ps, s) for k, (s, r) in enumerate(window, 1)]
    return sorted(out, key=str)


def clustered(seed, n, width, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, width))
    return [
        (int(i), int(rng.integers(labels)), [float(v) for v in centres[i % 6] + rng.integers(-3, 4, width)], i % 10 == 0)
        for i in range(n)
    ]


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id bigint, label int, vector array<double>, anchor boolean").selectExpr(
        "*", "1 AS row", "2 AS block", "3 AS score", "4 AS k"
    ).repartition(3)
    return sorted((tuple(r) for r in H.mine(frame, **options).collect()), key=str)


def test_blocks_are_exact_and_bounds_rule_rows_out():
    rows = clustered(1, 600, 12)
    full = [(k, i, label, x) for k, (i, label, x, _) in enumerate(rows)]
    anchors = block([r for r, (*_, chosen) in zip(full, rows) if chosen], 12, tree=True)
    assert sorted(anchors.tree.tolist()) == list(range(anchors.n))
    others = block(full, 12)
    products = anchors.vectors @ others.vectors.T
    for i, at, score in H.find_positives(anchors, others, 5):
        same = np.flatnonzero((others.labels == anchors.labels[i]) & (others.rows != anchors.rows[i]))
        order = same[np.lexsort((others.ids[same], -products[i, same]))[:5]]
        assert at.tolist() == order.tolist() and score.tolist() == products[i, order].tolist()
    # Windows that hold one cluster: the tree leaves out most of the others.
    scores = H.Scores(anchors, others)
    windows = {i: [(1, int(products[i].max() * 0.9), int(products[i].max()))] for i in range(anchors.n)}
    for i in anchors.tree.tolist():
        low, high = scores.bound(i)
        some = np.flatnonzero((high >= windows[i][0][1]) & (low <= windows[i][0][2]))
        scores.score(i, some)
        assert (scores.low[i] <= products[i] + 1e-6).all() and (products[i] <= scores.high[i] + 1e-6).all()
        assert set(np.flatnonzero((products[i] >= windows[i][0][1]) & (products[i] <= windows[i][0][2]))) <= set(some)
    assert scores.scored < 0.6 * products.size


def test_mine(spark, monkeypatch):
    rows = clustered(2, 400, 8)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, n_positives=2, n_negatives=9, window=(50, 90)) == brute(rows, 2, 9, 50, 90)
    # Many small blocks give the same rows.
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 5)
    monkeypatch.setattr(H, "BLOCK_ROWS", 17)
    monkeypatch.setattr(H, "CELL_BLOCKS", 2)
    assert mined(spark, rows) == brute(rows)


NAN, INF = float("nan"), float("inf")
CASES = {
    "ties and repeats": [(i % 7, i % 3, [float(i % 4), 2.0, 1.0], i % 7 == 0) for i in range(60)],
    "nulls": [
        (0, 1, [3.0, 4.0], True), (None, 1, [3.0, 4.0], True), (1, None, [3.0, 4.0], True), (2, 1, None, True),
        (3, 1, [None, 1.0], False), (4, 2, [3.0, 4.0], None), (None, 2, [2.0, 4.0], False), (5, 1, [3.0, 4.0], False),
        (6, 2, [NAN, 4.0], False), (7, 2, [INF, 1.0], True), (8, 2, [3.0, 3.0], False),
    ],
    "lengths": [(0, 1, [], True), (1, 1, [1.0], True), (2, 2, [1.0, 5.0, 2.0], True), (3, 1, [1.0, 1.0], False), (4, 2, [1.0], False)],
    "negative and zero scores": [(0, 1, [-5.0, 1.0], True), (1, 1, [5.0, 0.0], False), (2, 2, [4.0, 0.0], False), (3, 1, [1.0, 5.0], False), (4, 2, [2.0, 10.0], False)],
    "one label": [(i, 1, [float(i)], True) for i in range(9)],
    "large": [(i, i % 2, [float(1 << 30), float((1 << 30) + i)], i < 2) for i in range(20)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert mined(spark, CASES[name]) == brute(CASES[name])


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], False)]) == []


def test_scores_must_fit(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, i % 2, [2.0**52, 2.0**40], True) for i in range(6)])


def test_usable(spark):
    frame = spark.createDataFrame([([1.0],), ([NAN],), ([None],), (None,), ([],), ([-INF],)], "v array<double>")
    assert [r.ok for r in frame.select(H.usable("v").alias("ok")).collect()] == [True, False, False, False, True, False]
    assert frame.filter(F.col("v").isNull()).count() == 1
