"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.operators.common import stage


def _relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(parent.select(F.col("node").alias(end), F.col("parent").alias(f"_{end}")), end)
    ends = F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
    return edges.select(*ends).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of *edges* ``(a, b)``; ``comp`` is the smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are followed in threes until
    they reach a root, and roots become the nodes of the next, smaller graph.  Paths and stars of
    any length take a logarithmic number of rounds.  Every round starts from a written table, so the
    plans of later rounds are no larger than those of the first.
    """
    cur = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    total = None
    while not cur.isEmpty():
        ways = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b"))
        parent = stage(ways.groupBy("a").agg(least.alias("parent")).withColumnRenamed("a", "node"))
        while True:
            one = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            two = one.toDF("up", "top")
            jumped = stage(parent.join(one, "parent").join(two, "up").select("node", "parent", "up", "top"))
            settled = jumped.filter("parent <> up").isEmpty()
            parent = jumped.select("node", F.col("top").alias("parent"))
            if settled:
                break
        if total is None:
            total = parent.withColumnRenamed("parent", "comp")
        else:
            again = parent.withColumnRenamed("node", "comp")
            total = total.join(again, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp"))
        total = stage(total)
        cur = stage(_relabel(cur, parent))
    if total is None:
        return edges.sparkSession.createDataFrame([], "node bigint, comp bigint")
    return total


def refine(comps: DataFrame, more: DataFrame) -> DataFrame:
    """*comps* with the links *more* ``(a, b)`` added; only the ends of those links are worked on."""
    for end in ("a", "b"):
        side = comps.select(F.col("node").alias(end), F.col("comp").alias("_c"))
        more = more.join(side, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    found = components(more)
    outer = found.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    inner = comps.join(outer, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = found.join(comps.select("node"), "node", "left_anti")
    return stage(inner.unionByName(new))
