"""Parallel seeding: the law of its draws, its reduction, and how many passes it takes."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, vectors
from vecspark.functions.sketcher import Sketcher
from vecspark.functions.uniform import local_uniform
from vecspark.functions.vectors import get_metric
from vecspark.operators import generate as G
from vecspark.operators import kmeans as K
from vecspark.operators import sketch as Z


def weighted(spark, mat, w):
    return spark.createDataFrame([(i, [float(x) for x in v], float(w[i])) for i, v in enumerate(mat)], "id bigint, vec array<double>, weight double")


def test_a_round_is_a_race(spark):
    rng = np.random.default_rng(3)
    mat, w = rng.normal(size=(400, 3)), rng.integers(0, 4, 400)
    centers = mat[:5]
    near = ((mat[:, None] - centers[None]) ** 2).sum(-1).min(1)
    t = {i: -np.log(local_uniform(7, 2, i)) / (w[i] * near[i]) for i in range(400) if w[i] * near[i] > 0}
    want = sorted(t, key=lambda i: (t[i], i))[:30]
    for parts in (1, 6):
        got = K.draw_candidates(weighted(spark, mat, w).repartition(parts), centers, 30, 7, 2)
        assert got.column("id").to_pylist() == want and np.allclose(got.column("t").to_numpy(), [t[i] for i in want])
    assert K.draw_candidates(weighted(spark, mat, w), mat, 30, 7, 2).num_rows == 0  # every point is a centre


def test_draws_follow_the_rates(spark):
    """Of points in two places, the share drawn from each is that of weight times squared distance."""
    mat = np.array([[1.0, 0.0]] * 900 + [[0.0, 3.0]] * 300)
    w = np.array([2.0] * 900 + [1.0] * 300)  # rates 1800 and 2700 in all
    drawn = [K.draw_candidates(weighted(spark, mat, w), np.zeros((1, 2)), 40, s, 1).column("id").to_numpy() for s in range(12)]
    share = np.mean(np.concatenate(drawn) >= 900)
    assert abs(share - 0.6) < 0.08


def test_reduction_takes_far_weights():
    vecs = np.array([[0.0, 0], [0.1, 0], [9, 0], [9.1, 0], [0, 9], [5, 5]])
    got = [K.weighted_seeds(vecs, np.array([50.0, 50, 40, 40, 60, 0]), 3, s) for s in range(40)]
    apart = [len({0 if j < 2 else 1 if j < 4 else j for j in g}) == 3 for g in got]
    assert np.mean(apart) > 0.9 and all(5 not in g for g in got)
    assert sorted(K.weighted_seeds(vecs, np.ones(6), 9, 1)) == [0, 1, 2, 3, 4, 5]


def test_seeds_find_every_corner(spark):
    pts = G.hypercube_points(spark, 4, 6000)
    got = rows(K.ball_kmeans(pts, 16, 20, seeding="parallel", seed=2), "centroid_id")
    corners = np.array(np.meshgrid(*[[0, 1]] * 4)).reshape(4, -1).T
    far = ((np.stack(got["vec"])[:, None] - corners[None]) ** 2).sum(-1).min(0)
    assert np.sqrt(far).max() < 0.05 and got["weight"].sum() == 6000
    a = rows(K.seed_parallel(pts, 10, 1), "centroid_id")
    assert a["id"].tolist() == rows(K.seed_parallel(pts.repartition(9), 10, 1), "centroid_id")["id"].tolist()


def test_few_points_and_bad_arguments(spark):
    dup = vectors(spark, [[0.0, 0], [0, 0], [5, 5], [5, 5]])
    assert K.seed_parallel(dup, 4).count() == 2
    with pytest.raises(ValueError):
        K.seed_parallel(vectors(spark, [[1.0]]), 2)
    with pytest.raises(ValueError):
        K.ball_kmeans(dup, 2, seeding="none")
    with pytest.raises(ValueError):
        K.seed_parallel(dup, 0)


def test_sketch_does_not_depend_on_partitions(spark, monkeypatch):
    """Nor on the Arrow batches in which rows come; a shard larger than a batch is never held."""
    pts = G.hypercube_points(spark, 3, 3000)
    monkeypatch.setattr(Z, "SHARD_ROWS", 500)
    want = rows(Z.sketch(pts, 7, seed=5).centroids, "id")
    assert Z.sketch(pts, 7).state.count() == 6 and want["weight"].sum() == 3000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = rows(Z.sketch(pts.repartition(11), 7, seed=5).centroids, "id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["id"].tolist() == want["id"].tolist() and np.allclose(np.stack(got["vec"]), np.stack(want["vec"]), atol=0)
    assert Z.shard_count(0, 5) == 1 and Z.shard_count(10**6, 10**5) == 1 and Z.shard_count(5001, 5) == 11


def test_hot_id_is_spread(spark):
    """Rows of one id go to many shards, as they differ in what they hold."""
    pts = spark.createDataFrame([(7, [float(k), 1.0], 1.0) for k in range(400)], "id bigint, vec array<double>, weight double")
    seen = Z.sketch(pts, 5, shards=8).state.toPandas()
    assert len(seen) == 8 and seen["n_seen"].max() < 100


def test_cutoff_from_the_data(spark):
    mat = np.array([[0.0, 0], [0, 0], [3, 4], [3, 4.5], [9, 9]])
    pts = vectors(spark, mat, [1, 1, 1, 2, 2])  # ids may repeat, copies do not count
    assert Z.estimate_cutoff(pts) == 0.5
    assert Z.estimate_cutoff(pts.limit(0)) == Z.estimate_cutoff(vectors(spark, mat[:2])) == 1e-5
    big = np.random.default_rng(8).normal(size=(300, 4))
    far = np.sqrt(((big[:, None] - big[None]) ** 2).sum(-1))[np.triu_indices(300, 1)].min()
    assert np.isclose(Z.estimate_cutoff(vectors(spark, big)), far)
    got = Z.sketch(vectors(spark, big), 20, None).state.first()
    assert got["n_seen"] == 300 and got["cutoff"] >= far


def test_sketch_tasks_take_few_shards(spark, monkeypatch):
    """More rows make more tasks, dealt evenly, and a sketch of its own counting passes over its input once."""
    monkeypatch.setattr(Z, "TASK_SHARDS", 2)
    pts = G.hypercube_points(spark, 3, 600).select("id", "vec", F.lit(1.0).alias("weight"))
    keyed = pts.withColumn("u", Z.row_uniform(0)).withColumn("shard", F.pmod("id", F.lit(101)))
    opts = {"beta": 1.3, "log_factor": 10.0, "overshoot": 0.5, "seed": 0}
    got = Z._streamed(keyed, 101, 5, 1e-5, get_metric("euclidean"), opts).filter("kind = 'state'")
    per_task = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).toPandas()["n"]
    assert len(per_task) == 51 and per_task.max() == 2 and per_task.sum() == 101
    counted = []
    monkeypatch.setattr(Z, "shard_count", lambda n, kappa: counted.append((n, kappa)) or 3)
    monkeypatch.setattr(Z, "sketch", lambda p, kappa, *a, **o: pytest.fail("counts again") if o["shards"] is None else Z.Sketch(
        spark.createDataFrame([], Z._SCHEMA)))
    assert Z.cluster_at_scale(pts, 2, merge="union").count() == 0 and counted == [(600, Z.sketch_size(2, 600))]


@pytest.mark.parametrize(("name", "dim", "cutoff"), [("euclidean", 3, 0.7), ("sqeuclidean", 12, 20), ("manhattan", 2, 0.7), ("cosine", 4, 0.7)])
def test_sketch_step_founds_one_by_one(name, dim, cutoff):
    """A step takes distances between rows that may found at once, and does what one row after the other would do."""
    m, calls = get_metric(name), []
    counting = dataclasses.replace(m, paired=lambda a, b: calls.append(len(a)) or m.paired(a, b))
    rng = np.random.default_rng(4)
    first, x = rng.normal(size=(5, dim)), np.round(rng.normal(size=(100, dim)), 1) + 0.01
    u, w = rng.random(100), rng.uniform(0.5, 2, 100)
    for metric in (m, counting):
        sk = Sketcher(1000, cutoff, metric)
        sk.vecs, sk.weights = first.copy(), np.ones(5)
        del calls[:]
        sk._step(x, w, u)
        centers = list(first)
        for k in range(100):
            if u[k] < min(m.paired(np.array([x[k]]), np.array([c]))[0] for c in centers) / cutoff:
                centers.append(x[k])
        at = np.array([np.argmin([m.paired(np.array([p]), np.array([c]))[0] for c in centers]) for p in x])
        want = np.bincount(at, w, len(centers)) + (np.arange(len(centers)) < 5)
        assert 15 < len(centers) < 105 and np.allclose(sk.weights, want)
    assert len(calls) < 10
