"""Registry, shared inputs and SQL snippets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.basis import hash_basis, make_basis
from vecspark.schema import points
from vecspark.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIM = 64


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def r6(c: Column | str) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def table(spark: SparkSession, sf: str, name: str, busy: bool = False) -> DataFrame:
    """A driver table. ``busy`` marks heavy work per row: a table that comes in fewer
    splits than there are cores is then dealt out to all of them."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    lanes = spark.sparkContext.defaultParallelism
    if busy and df.rdd.getNumPartitions() < lanes:  # a bare scan: counts splits, runs no job
        df = df.repartition(lanes)
    return df


def embeddings(spark, sf) -> DataFrame:
    return points(table(spark, sf, "embeddings"), "vec_id", "embedding", keep=("label",))


#: low-dimensional points at volume
LINE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def lines(spark, sf) -> DataFrame:
    return points(table(spark, sf, "lineitem", busy=True), "l_orderkey", columns=LINE_COLUMNS,
                  keep=("l_returnflag", "l_linestatus"))


def parts(spark, sf) -> DataFrame:
    """Weighted 2-d points with unique ids."""
    return points(table(spark, sf, "part"), "p_partkey", columns=["p_size", "p_retailprice"], weight="p_size")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents", busy=True)


def scratch(spark) -> str:
    """A new folder in the shared work folder."""
    return f"{work_dir(spark).rstrip('/')}/vecspark/{uuid.uuid4().hex}"


def long_vector(df: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """One row per coordinate, rounded, so that values compare as scalars."""
    return (df.select(*keys, F.posexplode(vec).alias("dim", "val"))
            .select(*keys, "dim", r6("val").alias("val")))


E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
#: label means as centroids, ids from 1 by first appearance
MEANS = """firsts AS (SELECT label, min(id) AS first_id FROM e GROUP BY label),
ids AS (SELECT label, CAST(row_number() OVER (ORDER BY first_id, label) AS INTEGER) AS centroid_id FROM firsts),
cells AS (SELECT e.label, t.i, avg(e.vec[t.i]) AS x FROM e, range(1, 65) t(i) GROUP BY ALL),
means AS (SELECT label, list(x ORDER BY i) AS vec FROM cells GROUP BY label),
c AS (SELECT ids.centroid_id, ids.label, means.vec FROM ids JOIN means USING (label))"""
NEAR = """near AS (SELECT e.id, e.label, e.vec, arg_min(c.centroid_id, (list_distance(e.vec, c.vec), c.centroid_id)) AS centroid_id,
  min(list_distance(e.vec, c.vec)) AS distance FROM e, c GROUP BY ALL)"""


def coords(source: str, keys: str = "id", vec: str = "vec") -> str:
    """SQL: one row per coordinate of a vector column."""
    return (f"SELECT {keys}, CAST(t.i - 1 AS INTEGER) AS dim, {s6(f'{vec}[t.i]')} AS val "
            f"FROM {source}, range(1, 1 + (SELECT max(len({vec})) FROM {source})) t(i)")


def sql_basis(basis: np.ndarray, name: str = "b") -> str:
    rows = ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in basis)
    return f"{name} AS (SELECT unnest(range({len(basis)})) AS i, unnest([{rows}]) AS row)"


def sql_uniform(*keys: str) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) + 0.5) / 4294967296.0)"


def sql_gaussian(*keys: str) -> str:
    u, v = sql_uniform(*keys, "'a'"), sql_uniform(*keys, "'b'")
    return f"(sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * {v}))"


BASIS = make_basis(8, DIM, seed=1)
UNIFORM_BASIS = make_basis(8, DIM, seed=2, kind="uniform")
HASH_BASIS = hash_basis(DIM, seed=3)
HASH_BASIS32 = hash_basis(DIM, seed=4, bits=32)
