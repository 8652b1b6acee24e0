"""Session helpers: shared work folder, materialised tables, size limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side may be collected and broadcast only while it stays below this size.
BROADCAST_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()  # SparkContext.setCheckpointDir
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="vecspark-")
    return _local_dirs[app]


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage, survives lost executors, and hands Catalyst real sizes
    and prunable columns for whatever follows. ``by`` names a column of few
    values, one folder each, so that a filter on it leaves the others unread.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/vecspark/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that suit this package on any master."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
