"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial sums where rows are read) and an equi-join on
the node, so a star centre with very many neighbours is split like any skewed join.
Each round is written to the shared folder, which keeps the lineage short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.scratch import discard, written


def _minima(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v: long): root is the least node reachable.

    Nodes without an edge to another node are absent. The rounds end when the edges no
    longer change; they are stars then.
    """
    now = written(edges.filter("u != v").distinct(), "cc")
    state = None
    while True:
        then = written(_small_star(_large_star(now)).filter("u != v").distinct(), "cc")
        discard(now)
        now = then
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == state:
            break
        state = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
