"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.session import materialize


def with_rank(df: DataFrame, order: list, name: str = "pos", by: list[str] = ()) -> DataFrame:
    """Add the 0-based position of each row in ``order``, counted within ``by``.

    Rows are range-partitioned on (by, order), numbered inside each partition,
    and shifted by the sizes of the partitions before it. ``order`` should end
    in a unique column: then equal values also spread over partitions, so no
    hot value can fill one task. The only window runs over one row per
    partition and ``by`` value.
    """
    by = list(by)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    numbered = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__rank_part", F.spark_partition_id())
        .withColumn("__rank_row", F.monotonically_increasing_id()))
    sizes = numbered.groupBy(*by, "__rank_part").agg(F.count("*").alias("__rank_n"), F.min("__rank_row").alias("__rank_first"))
    before = (Window.partitionBy(*(by or [F.lit(0)])).orderBy("__rank_part")
              .rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(*by, "__rank_part", "__rank_first",
                          F.coalesce(F.sum("__rank_n").over(before), F.lit(0)).alias("__rank_shift"))
    # without `by` this table has one row per partition; with it, as many rows as
    # (group, partition) pairs, which nothing bounds: then the planner decides
    return (numbered.join(shifts if by else F.broadcast(shifts), [*by, "__rank_part"])
            .withColumn(name, F.col("__rank_shift") + F.col("__rank_row") - F.col("__rank_first"))
            .drop("__rank_part", "__rank_row", "__rank_first", "__rank_shift"))
