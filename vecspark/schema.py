"""Explicit schemas and the one validating projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())

POINTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("vec", VECTOR),
    T.StructField("weight", T.DoubleType()),
])
KEYED_VECTORS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("vec", VECTOR),
])
CENTROIDS = T.StructType([
    T.StructField("centroid_id", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("vec", VECTOR),
])
NEIGHBORS = "query_id bigint, neighbor_id bigint, distance double, rank int"


def is_valid(vec: Column, dim: int) -> Column:
    """True for a vector of the right length without null, NaN or infinity."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & ~F.coalesce(bad, F.lit(True))


def points(df: DataFrame, id_col: str, vec_col: str | None = None, *,
           columns: list[str] | None = None, weight: str | None = None,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Shape any table as ``(id, vec, weight, *keep)`` with double vectors.

    The vector is one array column, or an array built from numeric columns.
    """
    if columns:
        vec = F.array(*[F.col(c).cast("double") for c in columns])
    else:
        vec = F.col(vec_col).cast("array<double>")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"),
                     w.alias("weight"), *keep)


def validate_vectors(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Keep the valid rows only."""
    return df.filter(is_valid(F.col(vec), dim))


def validation_report(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """One row: how many vectors were kept and how many dropped."""
    ok = F.coalesce(is_valid(F.col(vec), dim), F.lit(False))
    return df.agg(F.count(F.when(ok, 1)).alias("kept"),
                  F.count(F.when(~ok, 1)).alias("dropped"))


def dimension(df: DataFrame, vec: str = "vec") -> int:
    """Dimension of the first vector, 0 when there is none."""
    row = df.select(F.size(vec).alias("d")).first()
    return max(row["d"], 0) if row else 0
