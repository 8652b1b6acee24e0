"""Set-like upkeep of a vector table: union, size, clear, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vectors import Metric
from vecspark.operators.search import distinct_vectors, within
from vecspark.plans.rank import with_rank


def add_all(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Union by column name; a missing weight counts as 1."""
    if "weight" in rows.columns and "weight" not in more.columns:
        more = more.withColumn("weight", F.lit(1.0))
    return rows.unionByName(more.select(*rows.columns))


def size(rows: DataFrame) -> int:
    return rows.count()


def clear(rows: DataFrame) -> DataFrame:
    """An empty table of the same schema."""
    return rows.filter(F.lit(False))


#: A first stretch of more rows than this is told by ranks; a shorter one by each task's own first rows.
TAKEN_AT_ONCE = 1 << 14


def take_first(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows by id; a long stretch does not pass through one task."""
    if n <= TAKEN_AT_ONCE:
        return rows.orderBy("id").limit(n)
    return with_rank(rows, ["id"], "_pos").filter(F.col("_pos") < n).drop("_pos")


def skip_first(rows: DataFrame, n: int) -> DataFrame:
    """All but the first ``n`` rows by id, without sorting into one task."""
    return with_rank(rows, ["id"], "_pos").filter(F.col("_pos") >= n).drop("_pos")


def remove_within(rows: DataFrame, probes: DataFrame, eps: float,
                  metric: str | Metric = "euclidean", *, layout: str = "auto") -> DataFrame:
    """Drop, for each probe, its nearest row if that is closer than ``eps``."""
    hits = within(probes, rows, eps, metric, layout=layout)
    return rows.join(hits.select(F.col("neighbor_id").alias("id")).distinct(), "id",
                     "left_anti").select(*rows.columns)


def remove_equal(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Drop every row whose vector equals a probe's vector."""
    return rows.join(probes.select("vec").distinct(), "vec", "left_anti").select(*rows.columns)


__all__ = ["add_all", "size", "clear", "take_first", "skip_first", "remove_within",
           "remove_equal", "distinct_vectors"]
