"""Exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions import kernels
from vecspark.functions.vectors import Metric, get_metric, norm, normalize
from vecspark.plans.blocks import PairJob, Space, fetch, pair_blocks, unique_ids
from vecspark.schema import NEIGHBORS, dimension

#: Spread of one query's partial answers before the last merge.
MERGE_LANES = 64


@dataclass
class TopK(PairJob):
    """k nearest references of each query in the block."""

    k: int = 1
    metric: Metric | None = None

    def prepare(self, refs):
        return kernels.RefBlock(refs["id"], refs["vec"])

    def run(self, queries, block):
        qi, ids, d, rank = kernels.top_k(queries["vec"], block, self.k, self.metric)
        return {"query_id": queries["id"][qi], "neighbor_id": ids, "distance": d, "rank": rank + 1}

    def merge(self, outputs):
        o = super().merge(outputs)
        order = np.lexsort((o["neighbor_id"], o["distance"], o["query_id"]))
        o = {c: v[order] for c, v in o.items()}
        first = np.searchsorted(o["query_id"], o["query_id"], side="left")
        o["rank"] = np.arange(len(first)) - first + 1
        return {c: v[o["rank"] <= self.k] for c, v in o.items()}


def top_k_per_query(scored: DataFrame, k: int, lanes: int = 1) -> DataFrame:
    """Keep each query's k best rows, ties to the lower id.

    With ``lanes`` > 1 a query with very many partial answers is first cut
    down in several tasks; the rank filter then also prunes on the map side.
    """
    order = [F.col("distance"), F.col("neighbor_id")]
    base = scored.select("query_id", "neighbor_id", "distance")
    if lanes > 1:
        w = Window.partitionBy("query_id", "_lane").orderBy(*order)
        base = (base.withColumn("_lane", F.pmod(F.xxhash64("neighbor_id"), F.lit(lanes)))
                .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
                .drop("_r", "_lane"))
    w = Window.partitionBy("query_id").orderBy(*order)
    return base.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _space(metric: Metric, k: int) -> Space | None:
    if metric.name in ("euclidean", "sqeuclidean"):
        return Space("vec", kernels.pairwise_euclidean, kernels.slack_euclidean,
                     hyperplane=True, depth=k)
    if metric.name == "cosine":  # orders references as the Euclidean distance between unit vectors does
        return Space("_unit", kernels.pairwise_euclidean, kernels.slack_euclidean, hyperplane=True, depth=k, derive=_with_unit)
    if metric.triangle:
        return Space("vec", metric.pairwise, lambda q, r: 1e-9, depth=k)
    return None


def _with_unit(rows: DataFrame) -> DataFrame | None:
    """Rows with their unit vectors; none if some vector has no direction."""
    if not rows.filter((norm("vec") == 0) | F.isnan(norm("vec")) | (norm("vec") == float("inf"))).isEmpty():
        return None
    return rows.withColumn("_unit", normalize("vec"))


def knn(queries: DataFrame, refs: DataFrame, k: int, metric: str | Metric = "euclidean",
        *, layout: str = "auto") -> DataFrame:
    """The k nearest references of every query, by exact distance.

    Both inputs are ``(id, vec)``; the result is
    ``(query_id, neighbor_id, distance, rank)`` with ties broken by
    ``neighbor_id``. A query that is also a reference finds itself at 0. With
    fewer than k references all of them are returned. Query ids must be unique:
    the result could not tell two queries of one id apart.
    """
    if k < 1:
        raise ValueError("k must be positive")
    unique_ids(queries)
    metric = get_metric(metric)
    job = TopK(["id", "vec"], ["id", "vec"], NEIGHBORS, k=k, metric=metric)
    dim = dimension(refs)
    out, final = pair_blocks(queries, refs, job, dim, layout=layout, space=_space(metric, k))
    if final:
        return out
    lanes = MERGE_LANES if layout != "cells" else 1
    return top_k_per_query(out, k, lanes)


def rerank(candidates: DataFrame, queries: DataFrame, refs: DataFrame, k: int,
           metric: str | Metric = "euclidean", dim: int | None = None) -> DataFrame:
    """Exact distances for ``(query_id, neighbor_id)`` candidates, then the k best."""
    m = get_metric(metric)
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("_q"))
    r = refs.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("_r"))
    scored = (candidates.join(r, "neighbor_id").join(q, "query_id")
              .select("query_id", "neighbor_id", m.column("_q", "_r", dim).alias("distance")))
    return top_k_per_query(scored, k)


def within(queries: DataFrame, refs: DataFrame, eps: float, metric: str | Metric = "euclidean",
           *, layout: str = "auto") -> DataFrame:
    """Queries whose nearest reference is closer than ``eps`` (strict)."""
    return knn(queries, refs, 1, metric, layout=layout).filter(F.col("distance") < eps)


_searchers: dict[str, Callable[..., DataFrame]] = {}


def register_searcher(name: str, fn: Callable[..., DataFrame]) -> None:
    """Makes ``fn(queries, refs, k, **options)`` known to :func:`search` under a name; the built-in names are taken."""
    if name in ("exact", "projection", "lsh", "banded"):
        raise ValueError(f"{name!r} is built in")
    _searchers[name] = fn


def search(queries: DataFrame, refs: DataFrame, k: int, method: str = "exact", **options) -> DataFrame:
    """Search by method name: ``exact``, ``projection``, ``lsh``, ``banded``, or one that was registered."""
    from vecspark.operators.hash_search import build_band_index, knn_banded, knn_lsh
    from vecspark.operators.projection_search import knn_projection

    def banded(queries, refs, k, search_size=100, metric="euclidean", **index):
        return knn_banded(queries, build_band_index(refs, **index), k, search_size, metric)

    methods = {"exact": knn, "projection": knn_projection, "lsh": knn_lsh, "banded": banded, **_searchers}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; known: {sorted(methods)}")
    return methods[method](queries, refs, k, **options)


def bounded_centroids(centroids: DataFrame | tuple) -> tuple[np.ndarray, np.ndarray] | None:
    """Centroid ids and matrix on the driver, in id order; None when they
    exceed the broadcast bound."""
    if isinstance(centroids, tuple):
        return centroids
    rows = centroids.select("centroid_id", "vec")
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not head["n"]:
        raise ValueError("no centroids given")
    if head["n"] * head["d"] * 8 > session.BROADCAST_BYTES:
        return None
    cols = fetch(rows)
    order = np.argsort(cols["centroid_id"], kind="stable")
    return cols["centroid_id"][order], cols["vec"][order]


def centroid_arrays(centroids: DataFrame | tuple) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`bounded_centroids`, but too many centroids are an error."""
    arrays = bounded_centroids(centroids)
    if arrays is None:
        raise ValueError("the centroids exceed the broadcast bound; use knn(points, centroids, 1)")
    return arrays


def nearest_column(vec: str | Column, ids: np.ndarray, centers: np.ndarray,
                   metric: str | Metric = "euclidean") -> Column:
    """Struct column ``(centroid_id, distance)`` for a bounded set of centroids."""
    m = get_metric(metric)

    @F.arrow_udf("struct<centroid_id:int,distance:double>")
    def closest(col: pa.Array) -> pa.Array:
        x = kernels.to_matrix(col)
        pos, d = kernels.nearest(x, centers, m) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
        return pa.StructArray.from_arrays(
            [pa.array(ids[pos].astype(np.int32)), pa.array(d)], names=["centroid_id", "distance"])

    return closest(vec)


def assign_nearest(points: DataFrame, centroids: DataFrame | tuple,
                   metric: str | Metric = "euclidean") -> DataFrame:
    """Each point with its nearest centroid; ties go to the lowest id.

    A bounded centroid table rides along with the function, so points keep
    all their columns and nothing is shuffled. A larger table goes through
    the k = 1 search.
    """
    arrays = bounded_centroids(centroids)
    if arrays is None:
        refs = centroids.select(F.col("centroid_id").cast("bigint").alias("id"), "vec")
        # rows, not ids, are assigned: ids may repeat. The stored key is the same in both reads.
        keyed = session.materialize(points.withColumn("_row", F.monotonically_increasing_id()))
        hits = knn(keyed.select(F.col("_row").alias("id"), "vec"), refs, 1, metric).select(
            F.col("query_id").alias("_row"), F.col("neighbor_id").cast("int").alias("centroid_id"),
            "distance")
        return keyed.join(hits, "_row").drop("_row")
    ids, mat = arrays
    return (points.withColumn("_near", nearest_column("vec", ids, mat, metric))
            .select(*points.columns, "_near.centroid_id", "_near.distance"))


def nearest_other(rows: DataFrame, metric: str | Metric = "euclidean", *,
                  layout: str = "auto") -> DataFrame:
    """Distance from each row to the closest different row: ``(id, distance)``."""
    pairs = knn(rows, rows, 2, metric, layout=layout)
    return (pairs.filter(F.col("query_id") != F.col("neighbor_id"))
            .groupBy(F.col("query_id").alias("id")).agg(F.min("distance").alias("distance")))


def min_pair_distance(rows: DataFrame, n: int | None = None,
                      metric: str | Metric = "euclidean", *, positive: bool = False) -> DataFrame:
    """Least distance between two rows; with ``n``, between two of the first ``n`` rows by id.

    With ``positive`` copies are left out first, so the answer can serve as a
    distance cutoff.
    """
    if n is not None:
        rows = rows.orderBy("id").limit(n)
    if positive:
        rows = distinct_vectors(rows)
    return nearest_other(rows, metric).agg(F.min("distance").alias("distance"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per distinct vector, the one with the lowest id."""
    return rows.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")


def distance_predicate(a, b, eps: float, metric: str | Metric = "euclidean", dim=None) -> Column:
    """True when the two vectors are closer than ``eps``."""
    return get_metric(metric).column(a, b, dim) < eps
