"""Seeded test data, generated in parallel and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.uniform import gaussian
from vecspark.functions.vectors import UNROLL


def _noise(d: int, seed: int, spread: float) -> Column:
    """Array of d normal draws keyed by (id, coordinate)."""
    if d <= UNROLL:
        return F.array(*[gaussian(seed, "id", F.lit(j)) * F.lit(float(spread)) for j in range(d)])
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                       lambda j: gaussian(seed, F.col("id"), j) * F.lit(float(spread)))


def hypercube_at(ids: DataFrame, d: int, radius: float = 0.01, seed: int = 0) -> DataFrame:
    """For every id, a normal point around corner ``id mod 2^d`` of the unit cube.

    The first coordinate takes the corner number's highest bit.
    """
    if not 1 <= d <= 30:
        raise ValueError("d must be between 1 and 30")
    corner = F.pmod(F.col("id"), F.lit(1 << d))
    bits = [F.shiftright(corner, d - 1 - j).bitwiseAND(F.lit(1)).cast("double") for j in range(d)]
    vec = F.zip_with(F.array(*bits), _noise(d, seed, radius), lambda b, z: b + z)
    return ids.select("id", vec.alias("vec"), F.lit(1.0).alias("weight"), corner.alias("corner"))


def hypercube_points(spark: SparkSession, d: int, n: int, radius: float = 0.01, seed: int = 0) -> DataFrame:
    return hypercube_at(spark.range(n), d, radius, seed)


def hypercube_corners(spark: SparkSession, d: int) -> DataFrame:
    """The 2^d corners as centroids."""
    bits = [F.shiftright(F.col("id"), d - 1 - j).bitwiseAND(F.lit(1)).cast("double") for j in range(d)]
    return spark.range(1 << d).select(F.col("id").cast("int").alias("centroid_id"),
                                      F.lit(1.0).alias("weight"), F.array(*bits).alias("vec"))


def normal_at(ids: DataFrame, d: int, seed: int = 0) -> DataFrame:
    """For every id, a standard normal vector."""
    return ids.select("id", _noise(d, seed, 1.0).alias("vec"), F.lit(1.0).alias("weight"))


def normal_points(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    return normal_at(spark.range(n), d, seed)


def blobs_at(ids: DataFrame, blobs: list[tuple[list[float], int]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """For every id, a normal point around the centre whose stretch of ids holds it: ``[(centre, members), ...]``, from 0 on.
    The last centre also takes all ids beyond."""
    d = len(blobs[0][0])
    ends, total = [], 0
    for _, n in blobs:
        total += n
        ends.append(total)
    blob = F.lit(len(blobs) - 1)
    for i in range(len(blobs) - 2, -1, -1):
        blob = F.when(F.col("id") < ends[i], F.lit(i)).otherwise(blob)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c, _ in blobs])
    rows = ids.withColumn("blob", blob.cast("int")).withColumn("_c", centres[F.col("blob")])
    vec = F.zip_with("_c", _noise(d, seed, spread), lambda c, z: c + z)
    return rows.select("id", vec.alias("vec"), F.lit(1.0).alias("weight"), "blob")


def blob_points(spark: SparkSession, blobs: list[tuple[list[float], int]], spread: float = 1.0,
                seed: int = 0) -> DataFrame:
    """Normal points around given centres: ``[(centre, members), ...]``."""
    return blobs_at(spark.range(sum(n for _, n in blobs)), blobs, spread, seed)


def axis_blobs(spark: SparkSession, d: int = 10, members: int = 1000, origin: int = 100,
               axes: int = 5, at: float = 6.0, spread: float = 1.0, seed: int = 0) -> DataFrame:
    """A blob at the origin and one on each of the first ``axes`` axes."""
    blobs = [([0.0] * d, origin)]
    blobs += [([at if j == a else 0.0 for j in range(d)], members) for a in range(axes)]
    return blob_points(spark, blobs, spread, seed)
