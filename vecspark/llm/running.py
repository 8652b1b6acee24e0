"""Sums over all rows before a row, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.tables import Tables


def running_sum(tables: Tables, df: DataFrame, order: list, value: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each row in ``order``, within ``by``. Of ones, the rank from 0.

    Rows are dealt by ranges of (by, order), summed within their partition, and shifted by the partitions before it, so
    a group may be as large as the table: one window holds a partition's rows, the other a row for each partition.
    ``order`` should tell rows apart; equal rows stand in the order in which the stored table holds them.
    """
    by = list(by)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = tables.store(df.withColumn("__value", value.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    inside = Window.partitionBy(*by, "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (dealt.groupBy(*by, "__part").agg(F.sum("__value").alias("__sum"))
             .select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift")))
    return (dealt.withColumn(name, F.coalesce(F.sum("__value").over(inside), F.lit(0)))
            .join(parts, [*by, "__part"]).withColumn(name, F.col(name) + F.col("__shift"))
            .drop("__value", "__part", "__row", "__shift"))
