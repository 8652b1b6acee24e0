"""Structured Streaming over the driver tables, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.clusters import by_corner
from vecspark.catalog.registry import E, LINE_COLUMNS, MEANS, NEAR, ORACLE, embeddings, lines, query, r6, s6, scratch, table
from vecspark.operators.generate import hypercube_at
from vecspark.operators.kmeans import ball_kmeans
from vecspark.operators.stats import label_means
from vecspark.schema import points
from vecspark.streaming import clusters as C


#: input of one micro-batch
TRIGGER_BYTES = 1 << 30


def stream_of(spark, sf, name):
    """The table as a file stream, a bounded part of it in each micro-batch."""
    return (spark.readStream.schema(table(spark, sf, name).schema).option("maxBytesPerTrigger", str(TRIGGER_BYTES))
            .parquet(f"{sf}/{name}.parquet*"))


def drain(df, path, mode="append"):
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


@query("stream_assign", f"WITH {E}, {MEANS}, {NEAR} SELECT id, centroid_id, {s6('distance')} AS distance FROM near")
def stream_assign(spark, sf):
    centers = label_means(embeddings(spark, sf), "label")
    s = points(stream_of(spark, sf, "embeddings"), "vec_id", "embedding")
    out = C.assign_stream(s, centers).select("id", "centroid_id", r6("distance").alias("distance"))
    path = scratch(spark)
    drain(out, path)
    return spark.read.schema(out.schema).parquet(path)


def _cluster_lines(spark, sf):
    s = points(stream_of(spark, sf, "lineitem"), "l_orderkey", columns=LINE_COLUMNS)
    path = scratch(spark)
    q = C.write_latest(C.cluster_stream(s, 50, 0.01), path, path + "-log", available_now=True)
    q.awaitTermination()
    return path


@query("stream_cluster")
def stream_cluster(spark, sf):
    return C.read_latest(spark, _cluster_lines(spark, sf))


@query("stream_cluster_weight_kept", "SELECT CAST(count(*) AS DOUBLE) AS weight FROM lineitem")
def stream_weight(spark, sf):
    return C.read_latest(spark, _cluster_lines(spark, sf)).agg(F.sum("weight").alias("weight"))


@query("stream_cluster_cube", ORACLE["sketch_cube"])
def stream_cluster_cube(spark, sf):
    """A stream of points around the corners of a cube: each corner's centroids hold the weight of its points."""
    ids = stream_of(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    path = scratch(spark)
    C.write_latest(C.cluster_stream(hypercube_at(ids, 3), 300, 0.01, shards=8), path, path + "-log", available_now=True).awaitTermination()
    return by_corner(C.read_latest(spark, path), spark)


@query("stream_then_ball")
def stream_then_ball(spark, sf):
    return ball_kmeans(C.read_latest(spark, _cluster_lines(spark, sf)), 8, 10)
