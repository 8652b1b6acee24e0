import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, vectors
from vecspark.functions import kernels
from vecspark.operators import stats as A
from vecspark.functions import sketcher
from vecspark.functions.vectors import get_metric
from vecspark.operators import generate as G
from vecspark.operators import kmeans as K
from vecspark.operators import search as S
from vecspark.operators import sketch as Z
from vecspark.operators.stats import total_weight
from vecspark.plans import pipelines as P


@pytest.fixture(scope="module")
def cube4(spark):
    return G.hypercube_points(spark, 4, 10000, seed=1).drop("corner").persist()


def covers(spark, centroids, d):
    """Distance of the corner that is farthest from all centroids."""
    corners = G.hypercube_corners(spark, d).select(F.col("centroid_id").cast("bigint").alias("id"), "vec")
    return S.knn(corners, centroids, 1).agg(F.max("distance")).first()[0]


def as_rows(c):
    return c.select(F.col("centroid_id").cast("bigint").alias("id"), "vec", "weight")


def test_generator_rules(spark):
    got = rows(G.hypercube_points(spark, 3, 16, 0.0), "id")
    assert got["vec"][6].tolist() == [1, 1, 0] and got["vec"][9].tolist() == [0, 0, 1]
    a = rows(G.hypercube_points(spark, 3, 64), "id")
    b = rows(G.hypercube_at(spark.range(64).repartition(7), 3), "id")
    assert all(np.array_equal(x, y) for x, y in zip(a["vec"], b["vec"]))
    n = np.stack(rows(G.normal_points(spark, 2000, 20), "id")["vec"])
    assert abs(n.mean()) < 0.02 and abs(n.std() - 1) < 0.02
    blobs = rows(G.axis_blobs(spark, 4, 10, 3, 2, 6.0, 0.01).groupBy("blob").count(), "blob")
    assert blobs["count"].tolist() == [3, 10, 10]


def test_ball_kmeans_on_cube(spark, cube4):
    c = K.ball_kmeans(cube4, 16, 20, seed=3).persist()
    assert abs(total_weight(c).first()[0] - 10000) < 1e-9
    assert covers(spark, as_rows(c), 4) < 0.05
    assert sorted(rows(c)["weight"]) == [625.0] * 16
    assert rows(c, "centroid_id")["centroid_id"].tolist() == list(range(16))


def test_ball_kmeans_on_blobs(spark):
    pts = G.axis_blobs(spark, 10, 200, 40, 5, 6.0, 0.01, seed=2)
    c = rows(K.ball_kmeans(pts, 6, 20, seed=1))
    got = sorted((round(w), tuple(np.round(v).astype(int).tolist())) for w, v in zip(c["weight"], c["vec"]))
    want = [(40, (0,) * 10)] + [(200, tuple(6 if j == a else 0 for j in range(10))) for a in range(5)]
    assert got == sorted(want)


def test_ball_kmeans_weights_and_trim(spark):
    pts = spark.createDataFrame([(0, [0.0], 1.0), (1, [1.0], 3.0), (2, [10.0], 1.0), (3, [5.4], 9.0)],
                                "id bigint, vec array<double>, weight double")
    seeds = K.centroid_frame(spark, [0, 1], [[0.0], [10.0]], [0, 0])
    step = rows(K.ball_kmeans_step(pts, seeds, 0.4), "centroid_id")  # 5.4 is out of reach
    assert [v.tolist() for v in step["vec"]] == [[0.75], [10.0]] and step["weight"].tolist() == [4, 1]
    final = rows(K.ball_kmeans(pts, 2, 10, 0.4, seeds=seeds), "centroid_id")
    assert final["weight"].tolist() == [4, 10]
    loose = rows(K.ball_kmeans(pts, 2, 10, 0.4, False, seeds=seeds), "centroid_id")
    assert loose["weight"].tolist() == [4, 1]


def test_centroid_without_points_stays(spark):
    pts = vectors(spark, [[0.0], [0.2]])
    seeds = K.centroid_frame(spark, [0, 1], [[0.1], [99.0]], [0, 0])
    got = rows(K.ball_kmeans_step(pts, seeds), "centroid_id")
    assert got["vec"][1].tolist() == [99.0] and got["weight"].tolist() == [2, 0]


def test_one_cluster_is_the_mean(spark):
    got = K.ball_kmeans(vectors(spark, [[0.0, 0.0], [2.0, 4.0]]), 1, 5).first()
    assert list(got["vec"]) == [1.0, 2.0] and got["weight"] == 2


def test_seeding(spark, cube4):
    a = rows(K.seed_kmeanspp(cube4, 16, 3), "centroid_id")
    b = rows(K.seed_kmeanspp(cube4.repartition(9), 16, 3), "centroid_id")
    assert a["id"].tolist() == b["id"].tolist() and a["id"].nunique() == 16
    assert len({tuple(np.round(v)) for v in a["vec"]}) == 16
    dup = vectors(spark, [[1.0]] * 5 + [[2.0]])
    assert K.seed_kmeanspp(dup, 4).count() == 2  # no more than the distinct points
    with pytest.raises(ValueError):
        K.seed_kmeanspp(vectors(spark, [[1.0]]), 2)
    with pytest.raises(ValueError):
        K.ball_kmeans(dup, 0)


def test_seeding_keeps_state_between_rounds(spark, cube4, monkeypatch):
    want = rows(K.seed_kmeanspp(cube4, 9, 4), "centroid_id")["id"].tolist()
    monkeypatch.setattr(K, "SEED_ROUNDS_KEPT", 3)
    assert rows(K.seed_kmeanspp(cube4, 9, 4), "centroid_id")["id"].tolist() == want


def test_draws_follow_weights(spark):
    pts = spark.createDataFrame([(i, [float(i)], w) for i, w in enumerate((1.0, 0.0, 8.0))],
                                "id bigint, vec array<double>, weight double")
    hits = [K.seed_kmeanspp(pts, 1, s).first()["id"] for s in range(6)]
    assert 1 not in hits and 2 in hits


def test_lloyd_nine_points(spark):
    data = [[1, 1], [2, 1], [1, 2], [2, 2], [3, 3], [8, 8], [9, 8], [8, 9], [9, 9]]
    pts = vectors(spark, data)
    start = K.centroid_frame(spark, [0, 1], data[:2], [0, 0])
    centroids, assigned = K.lloyd_kmeans(pts, start)
    got = rows(centroids, "centroid_id")
    means = sorted(v.tolist() for v in got["vec"])
    assert np.allclose(means, [[1.8, 1.8], [8.5, 8.5]]) and sorted(got["weight"]) == [4, 5]
    assert assigned.groupBy("centroid_id").count().count() == 2 and assigned.count() == 9


@pytest.mark.parametrize("sharding", ["split", "content"])
def test_sketch_on_cube(spark, sharding):
    pts = G.hypercube_points(spark, 6, 16384, seed=2).drop("corner").repartition(3)
    sk = Z.sketch(pts, 704, sharding=sharding, shards=2)
    assert abs(total_weight(sk.centroids).first()[0] - 16384) < 1e-9
    assert sk.state.agg(F.sum("n_seen")).first()[0] == 16384
    assert covers(spark, sk.centroids, 6) < 0.05
    near = S.assign_nearest(sk.centroids, G.hypercube_corners(spark, 6).select("centroid_id", "vec"))
    per_corner = rows(near.groupBy("centroid_id").agg(F.sum("weight").alias("w")))
    assert per_corner["w"].tolist() == [256.0] * 64
    top = sk.state.agg(F.max("n_centroids"), F.max("kappa")).first()
    assert top[0] <= max(704, top[1])
    t = rows(sk.trace, "shard", "no")
    assert len(t) and (t.groupby("shard")["cutoff"].diff().fillna(0) >= 0).all()


def test_hash_sketch_ignores_partitioning(spark, cube4):
    a = rows(Z.sketch(cube4, 60, sharding="content", shards=3, seed=5).centroids, "id")
    b = rows(Z.sketch(cube4.repartition(7), 60, sharding="content", shards=3, seed=5).centroids, "id")
    assert a["weight"].tolist() == b["weight"].tolist()
    assert all(np.array_equal(x, y) for x, y in zip(a["vec"], b["vec"]))


def test_sketch_edges(spark):
    same = vectors(spark, [[1.0, 1.0]] * 200)
    for cutoff in (0.0, 1e-5):
        got = rows(Z.sketch(same.coalesce(1), 5, cutoff).centroids)
        assert got["weight"].tolist() == [200.0]
    assert Z.sketch(same.filter("id < 0"), 5).centroids.count() == 0
    with pytest.raises(ValueError):
        Z.sketch(same, 5, sharding="odd")


def test_hash_sketch_ignores_order_and_partitions(spark):
    """Also when ids repeat: the draws follow the rows' content."""
    rng = np.random.default_rng(2)
    df = vectors(spark, rng.integers(0, 9, (400, 3)), ids=[i // 4 for i in range(400)])
    key = lambda d: sorted((r["weight"], *r["vec"]) for r in
                           Z.sketch(d, 20, 0.5, sharding="content", shards=3, seed=1).centroids.collect())
    assert key(df.coalesce(1)) == key(df.orderBy(F.desc("id"), "vec").repartition(5))


def test_sketcher_is_bounded_and_keeps_weight():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(5000, 3)), rng.uniform(0.5, 2, 5000)
    sk = sketcher.Sketcher(50, 1e-5, get_metric("euclidean"), log_factor=1)
    for s in range(0, 5000, 700):
        sk.add(x[s:s + 700], w[s:s + 700], rng.random(len(x[s:s + 700])))
        assert len(sk.weights) <= sk.kappa
    assert abs(sk.weights.sum() - w.sum()) < 1e-8
    assert np.allclose((sk.vecs * sk.weights[:, None]).sum(0), (x * w[:, None]).sum(0))


@pytest.mark.parametrize("merge", ["ball", "streaming", "union"])
def test_cluster_at_scale(spark, cube4, merge):
    c = Z.cluster_at_scale(cube4.repartition(4), 16, merge=merge, seed=2).persist()
    assert abs(total_weight(c).first()[0] - 10000) < 1e-6
    ids = rows(c, "centroid_id")["centroid_id"].tolist()
    assert ids == list(range(len(ids)))
    assert covers(spark, as_rows(c), 4) < 0.05
    if merge == "ball":
        assert sorted(rows(c)["weight"]) == [625.0] * 16


def test_tree_merge(spark, cube4, monkeypatch):
    monkeypatch.setattr(Z, "SHARD_BYTES", 4096)
    sk = Z.sketch(cube4, 40, sharding="content", shards=9, seed=1)
    merged = Z.merge_sketches(sk, 60, limit=100)
    assert merged.centroids.count() <= max(100, 60)
    assert abs(total_weight(merged.centroids).first()[0] - 10000) < 1e-6
    c = Z.cluster_at_scale(cube4, 16, kappa=100, seed=3)
    assert c.count() == 16 and abs(total_weight(c).first()[0] - 10000) < 1e-6


def test_pipelines(spark, cube4, tmp_path):
    pts = cube4.withColumn("label", F.pmod("id", F.lit(16)).cast("string"))
    out = P.create_centroids(pts, 16, label="label", actual=True, ball=True, streaming=True, path=str(tmp_path / "c"))
    assert set(out) == {"actual", "ball", "streaming"}
    for name in out:
        assert abs(spark.read.parquet(str(tmp_path / "c" / name)).agg(F.sum("weight")).first()[0] - 10000) < 1e-6
    with pytest.raises(ValueError):
        P.create_centroids(pts, 16, actual=True)
    two = P.two_stage(pts, 16, seed=1)
    report = P.evaluate_clustering(pts, "label", 16, ball=out["ball"], streaming=two)
    assert report["ball_counts"].agg(F.sum("n")).first()[0] == 10000
    assert rows(report["ball_labels"])["share"].tolist() == [1.0] * 16
    assert report["comparison"].agg(F.sum("n")).first()[0] == two.count()
    assert report["mean_label_spread"].first()[0] < 0.011
    assert report["streaming_closest"].count() == two.count()


def test_moved_points_are_counted_in_one_pass(spark, monkeypatch):
    """Few points look at the centroids of the round before, and the count is that of all."""
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(500, 3)) + rng.integers(0, 4, (500, 1)) * 4
    now, before = mat[:8] + 0.05, mat[:8]
    near = lambda c: ((mat[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    pts = K.with_weight(vectors(spark, mat)).repartition(3)
    sums, weights, moved = K.ball_sums(pts, now, before=before)
    assert moved == (near(now) != near(before)).sum() > 0
    assert np.array_equal(weights, np.bincount(near(now), minlength=8))
    at, d, other = kernels.nearest_and_next(mat, now, get_metric("euclidean"))
    exact = np.sort(np.sqrt(((mat[:, None] - now[None]) ** 2).sum(-1)), axis=1)
    assert (other <= exact[:, 1]).all() and np.allclose(other, exact[:, 1], atol=1e-5) and np.allclose(d, exact[:, 0])
    assert np.isinf(kernels.nearest_and_next(mat, now[:1], get_metric("euclidean"))[2]).all()


def test_wide_group_sums(spark, monkeypatch):
    """Groups of two columns, null among their values, in blocks of few rows."""
    monkeypatch.setattr(A, "SUM_ROWS", 16)
    rng = np.random.default_rng(6)
    rows_ = [(k, rng.normal(size=20).tolist(), float(k % 3 + 1), [None, "a", "b"][k % 3], k % 2) for k in range(150)]
    df = spark.createDataFrame(rows_, "id bigint, vec array<double>, weight double, g string, h int").repartition(4)
    got = {(r.g, r.h): r for r in A.weighted_centroid(df, ["g", "h"], first="id").collect()}
    assert len(got) == 6
    for (g, h), r in got.items():
        mine = [x for x in rows_ if (x[3], x[4]) == (g, h)]
        w = np.array([x[2] for x in mine])
        assert np.allclose(r.vec, (np.array([x[1] for x in mine]) * w[:, None]).sum(0) / w.sum()) and r["_first"] == mine[0][0]
        assert np.isclose(r.weight, w.sum())
    assert A.weighted_centroid(df.limit(0), ["g"], dim=20).collect() == []
