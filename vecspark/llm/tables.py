"""Intermediate tables in the shared folder, removed once nothing needs them."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from vecspark.session import work_dir


class Tables:
    """The intermediate tables of one run of an operator.

    ``store`` cuts lineage: the table lies in ``spark.checkpoint.dir``, so a lost executor costs a reread, not a
    recomputation. ``drop`` deletes tables whose readers have finished, and lets Spark's cleaner take the shuffle
    files of finished jobs, so that the peak of a loop is one round and not the sum of all.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{work_dir(spark).rstrip('/')}/vecspark-llm/{uuid.uuid4().hex}"
        self.n = 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.sweep()

    def sweep(self) -> None:
        for _ in range(2):  # what the first pass finds unused, the second lets go
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
