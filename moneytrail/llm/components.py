"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds to (u, v) the least of u and all its v. A join on the aggregate instead of a window, so that AQE can split
    the rows of a node with very many neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs["u"] == least["w"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    own = near.select("u", F.col("m").alias("v")).distinct()
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (u, v; of one ordered type): root is the least node it can reach.

    Every round is a constant number of shuffles of at most the edges there are, and ends in a table in the shared
    folder; rounds go on until the stars no longer change. Self loops and repeated edges do no harm, rows with a null
    end are not edges.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
