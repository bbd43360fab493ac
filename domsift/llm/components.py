"""Connected components of an edge table, without any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domsift.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the smallest node it is linked to.

    Large-star and small-star steps in turn (Kiveris et al. 2014): each links a
    node's larger, then its smaller neighbours to the smallest one, until every
    node points at its component's smallest. The number of rounds grows with the
    logarithm of the number of nodes. Minima are partial aggregates; the minima
    table is written before the join, so that a hub's edges are an ordinary
    skewed join side that Spark splits.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = _star(_star(both, larger=True), larger=False)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node either has one edge down or only edges up."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    return ends.groupBy("n").agg(F.sum("down").alias("d"), F.max("up").alias("u")).where("d > 1 or (d = 1 and u = 1)").isEmpty()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the larger (else: all smaller) neighbours of each node ``a`` to its smallest one."""
    least = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least")), "least")
    met = edges.join(least, "a")
    if larger:
        linked = met.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        linked = met.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionByName(
            least.select("a", F.col("_least").alias("b"))
        )
    return written(linked.where("a <> b").distinct(), "star")
