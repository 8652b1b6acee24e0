"""Compositions: create centroids, evaluate a clustering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from vecspark.functions.basis import make_basis, project
from vecspark.operators import stats
from vecspark.operators.kmeans import ball_kmeans
from vecspark.operators.search import assign_nearest
from vecspark.operators.sketch import cluster_at_scale, sketch, sketch_size
from vecspark.schema import dimension
from vecspark.sources import io


def reduce_dense(points: DataFrame, d: int, basis: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """Random projection of dense vectors to ``d`` dimensions."""
    basis = basis if basis is not None else make_basis(d, dimension(points), seed)
    return points.withColumn("vec", project("vec", basis))


def create_centroids(points: DataFrame, k: int, *, label: str | None = None, actual: bool = False,
                     ball: bool = False, streaming: bool = False, path: str | None = None,
                     seed: int = 0) -> dict[str, DataFrame]:
    """Any of: label means, ball k-means of 20 rounds, streaming sketch. With
    ``path`` each is also written under its name."""
    out: dict[str, DataFrame] = {}
    if actual:
        if label is None:
            raise ValueError("label means need a label column")
        out["actual"] = stats.label_means(points, label).select("centroid_id", "weight", "vec")
    if ball:
        out["ball"] = ball_kmeans(points, k, 20, seed=seed)
    if streaming:
        sk = sketch(points, sketch_size(k, points.count()), seed=seed)
        out["streaming"] = io.renumber(sk.centroids.withColumnRenamed("id", "centroid_id"))
    if path:
        for name, df in out.items():
            io.write_centroids(df, f"{path}/{name}")
    return out


def two_stage(points: DataFrame, k: int, *, max_iter: int = 20, seed: int = 0) -> DataFrame:
    """Sketch with k x floor(ln n) clusters, then ball k-means on the sketch."""
    n = points.count()
    kappa = max(k, k * math.floor(math.log(max(n, 2))))
    return cluster_at_scale(points, k, kappa=kappa, max_iter=max_iter, seed=seed, n=n)


def evaluate_clustering(points: DataFrame, label: str, k: int, *, dims: int | None = None,
                        max_iter: int = 20, seed: int = 0, ball: DataFrame | None = None,
                        streaming: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both clusterings of (optionally projected) points, and their reports."""
    pts = points if dims is None else reduce_dense(points, dims, seed=seed)
    ball = ball if ball is not None else ball_kmeans(pts, k, max_iter, seed=seed)
    streaming = streaming if streaming is not None else two_stage(pts, k, max_iter=max_iter, seed=seed)
    out = {"label_spread": stats.cluster_spread(pts, label), "ball": ball, "streaming": streaming,
           "comparison": stats.compare_centroids(streaming, ball)}
    means = stats.label_means(pts, label)
    for name, c in (("ball", ball), ("streaming", streaming)):
        hit = assign_nearest(pts, c)
        out[f"{name}_counts"] = stats.cluster_counts(pts, c)
        out[f"{name}_spread"] = stats.cluster_spread(hit, "centroid_id")
        out[f"{name}_labels"] = stats.label_distribution(hit, label)
        out[f"{name}_closest"] = stats.closest_label(c, means)
    out["mean_label_spread"] = stats.mean_spread(out["label_spread"])
    return out
