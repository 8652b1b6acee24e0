"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.tables import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node u hangs its neighbours under the least node it knows: those above u (large), or those below (small).

    The least neighbour is an aggregate that combines before the shuffle; no node ever gathers its neighbours."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = around.join(low, "a")
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for the nodes of (a, b) edges that are not roots.

    Each round halves paths and is stored, so lineage stays short; the rounds end when nothing changes.
    """
    now = tables.store(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        nxt = tables.store(_star(_star(now, True).distinct(), False).where("a <> b").distinct())
        # the same set of edges twice is a set of stars
        seen = nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        tables.drop(now)
        now = nxt
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
