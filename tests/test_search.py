import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, vectors
from vecspark import session
from vecspark.functions.basis import make_basis
from vecspark.operators import generate as G
from vecspark.operators import hash_search as H
from vecspark.operators import maintain as M
from vecspark.operators import projection_search as P
from vecspark.operators import recall as R
from vecspark.operators import search as S
from vecspark.plans import blocks
from vecspark.plans.rank import with_rank

LAYOUTS = ["auto", "refs", "queries", "cells"]
METHODS = {
    "exact": lambda q, r, k: S.knn(q, r, k),
    "projection": lambda q, r, k: P.knn_projection(q, r, k, max(k, 200), projections=5),
    "lsh": lambda q, r, k: H.knn_lsh(q, r, k, max(k, 200)),
}


@pytest.fixture(scope="module")
def normals(spark):
    return G.normal_points(spark, 1000, 20, seed=4).drop("weight").persist()


def brute(q, r, k):
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(np.arange(len(r)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("method", METHODS)
def test_stored_query_finds_itself_first(normals, method):
    q = normals.filter("id < 100")
    got = rows(METHODS[method](q, normals, 2), "query_id", "rank")
    first, second = got[got["rank"] == 1], got[got["rank"] == 2]
    assert (first["neighbor_id"] == first["query_id"]).all() and (first["distance"] < 1e-6).all()
    assert (second["distance"].to_numpy() > 0.1).all() and len(second) == 100


@pytest.mark.parametrize("method", METHODS)
def test_noisy_query_is_found_at_its_noise(spark, normals, method):
    noise = G.normal_at(normals.filter("id < 50").select("id"), 20, 77)
    q = normals.join(noise.select("id", F.col("vec").alias("n")), "id").select(
        "id", F.zip_with("vec", "n", lambda a, b: a + 0.01 * b).alias("vec"), "n")
    size = {r["id"]: 0.01 * float(np.linalg.norm(r["n"])) for r in q.select("id", "n").collect()}
    got = rows(METHODS[method](q.drop("n"), normals, 1))
    assert (got["neighbor_id"] == got["query_id"]).all()
    assert max(abs(d - size[i]) for i, d in zip(got["query_id"], got["distance"])) < 1e-5


@pytest.mark.parametrize("method", METHODS)
def test_distances_increase(normals, method):
    got = rows(METHODS[method](normals.filter("id < 5"), normals, 200), "query_id", "rank")
    for _, part in got.groupby("query_id"):
        assert (np.diff(part["distance"]) > 0).all() and len(part) == 200


@pytest.mark.parametrize("layout", LAYOUTS)
def test_grid(spark, layout):
    """Three by four points, 3 apart in a row and 4 between rows: a corner sees 0, 3, 4, 5."""
    df = vectors(spark, [[3.0 * col, 4.0 * line] for line in range(3) for col in range(4)])
    got = rows(S.knn(df, df, 4, layout=layout), "query_id", "rank")
    distance = {q: part["distance"].tolist() for q, part in got.groupby("query_id")}
    assert distance[0] == distance[11] == [0.0, 3.0, 4.0, 5.0]
    assert distance[1] == distance[2] == [0.0, 3.0, 3.0, 4.0]
    assert distance[5] == [0.0, 3.0, 3.0, 4.0]


def test_a_far_row_does_not_blur_the_others(monkeypatch):
    from vecspark.functions import kernels
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    far = x.copy()
    far[7, 3] = 1e9
    m, asked = S.get_metric("euclidean"), []
    monkeypatch.setattr(kernels, "paired_in_parts", lambda m, q, r, qi, ri: asked.append(len(qi)) or m.paired(q[qi], r[ri]))
    pos, d = kernels.nearest(x, far, m)
    assert sum(asked) < 2 * len(x)
    want = np.sqrt(((x[:, None] - far[None]) ** 2).sum(-1))
    assert (pos == want.argmin(1)).all() and np.allclose(d, want.min(1))


def test_rows_that_are_no_vectors_are_refused(spark):
    for bad in ([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0, 8.0]], [[1.0, 2.0], None], [[1.0, None], [2.0, 3.0]]):
        df = spark.createDataFrame(list(enumerate(bad)), "id bigint, vec array<double>").coalesce(1)
        with pytest.raises(Exception, match="different lengths|is null"):
            S.knn(df, df, 1, layout="queries").collect()


@pytest.mark.parametrize("bound", [64 << 20, 8])
def test_assignment_is_by_row_when_ids_repeat(spark, monkeypatch, bound):
    monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
    points = spark.createDataFrame([(1, [0.0, 0.0]), (1, [10.0, 10.0])], "id bigint, vec array<double>")
    centroids = spark.createDataFrame([(0, [0.0, 1.0]), (1, [10.0, 9.0])], "centroid_id int, vec array<double>")
    got = S.assign_nearest(points, centroids).collect()
    assert sorted((r["vec"][0], r["centroid_id"]) for r in got) == [(0.0, 0), (10.0, 1)]
    for layout in LAYOUTS:
        with pytest.raises(ValueError, match="not unique"):
            S.knn(points, points, 1, layout=layout)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan", "cosine"])
def test_layouts_agree_with_a_third_of_copies(spark, monkeypatch, layout, metric):
    monkeypatch.setattr(blocks, "block_rows", lambda dim: 64)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(200, 3)), np.tile(rng.normal(size=3), (100, 1)),
                   rng.normal(size=(60, 3)) * 0.01 + 5])
    df = vectors(spark, x).repartition(3)
    m = S.get_metric(metric)
    got = rows(S.knn(df, df, 4, metric, layout=layout), "query_id", "rank")
    ids = np.arange(len(x))
    for q, part in got.groupby("query_id"):
        d = m.paired(np.broadcast_to(x[q], x.shape), x)
        order = np.lexsort((ids, d))[:4]
        assert part["neighbor_id"].tolist() == order.tolist()
        assert np.array_equal(part["distance"], d[order])
    assert len(got) == 4 * len(x)


def test_cells_skip_far_data(spark, monkeypatch):
    """Far groups are ruled out, so a query visits few cells."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 4)) + 100 * g for g in range(4)])
    df = vectors(spark, x)
    space = S._space(S.get_metric("euclidean"), 2)
    _, visits, plan = blocks._prune(df, df, space, 4)
    assert visits.count() < 0.5 * len(x) * len(plan)
    assert visits.select("id").distinct().count() == len(x)


def test_cells_only_where_they_spare_work(spark, monkeypatch):
    """where no cell is ruled out a query must not travel to each of them."""
    monkeypatch.setattr(blocks, "block_rows", lambda dim: 64)
    rng = np.random.default_rng(3)
    even = vectors(spark, rng.normal(size=(1200, 12)))
    lumps = vectors(spark, np.vstack([rng.normal(size=(300, 4)) + 100 * g for g in range(4)]))
    space = S._space(S.get_metric("euclidean"), 2)
    assert blocks._prune(even, even, space, 12, 64) is None
    assert blocks._prune(lumps, lumps, space, 4, 64) is not None


@pytest.mark.parametrize("layout", LAYOUTS)
def test_edges(spark, layout):
    df = vectors(spark, [[0.0, 1.0], [2.0, 3.0]])
    none = df.filter("id < 0")
    assert S.knn(df, df, 9, layout=layout).count() == 4
    assert S.knn(none, df, 1, layout=layout).count() == 0
    if layout != "cells":
        assert S.knn(df, none, 1, layout=layout).count() == 0
    with pytest.raises(ValueError):
        S.knn(df, df, 0, layout=layout)


def test_partitioning_does_not_matter(normals):
    want = rows(S.knn(normals, normals, 3))
    near = rows(P.knn_projection(normals, normals, 3, 10))
    for n in (1, 9):
        df = normals.repartition(n)
        assert rows(S.knn(df, df, 3, layout="queries")).equals(want)
        assert rows(P.knn_projection(df, df, 3, 10)).equals(near)


def lumpy(spark, d):
    """Groups of unequal size and radius 0.05."""
    n_groups = 90
    sizes = [max(1, int(3000 / (i + 1) / 5)) for i in range(n_groups)]
    rng = np.random.default_rng(d)
    blobs = [(rng.normal(size=d).tolist(), s) for s in sizes]
    return G.blob_points(spark, blobs, 0.05, seed=d).select("id", "vec").persist()


@pytest.mark.parametrize("d", [20])
def test_projection_recall_on_lumpy_data(spark, d):
    df = lumpy(spark, d)
    q = df.filter("id % 101 = 0")
    got = R.search_overlap(P.knn_projection(q, df, 20, 20, projections=d), S.knn(q, df, 20))
    assert got.agg(F.avg("overlap")).first()[0] > 7


@pytest.mark.parametrize("window,more", [("half_open", 0), ("closed", 1)])
def test_projection_windows_by_hand(spark, window, more):
    """One projection of 1-d data: windows are plain rank intervals; ties and outside queries included."""
    values = [0.0, 1.0, 1.0, 1.0, 2.0, 5.0, 7.0, 7.0, 9.0, 12.0]
    asks = [-3.0, 0.0, 1.0, 1.5, 7.0, 12.0, 50.0]
    df, q = vectors(spark, [[v] for v in values]), vectors(spark, [[v] for v in asks], range(100, 107))
    got = rows(P.projection_candidates(q, df, np.array([[1.0]]), 2, window))
    want = []
    for i, a in enumerate(asks):
        at = sum(v < a for v in values)
        want += [(100 + i, j) for j in range(max(0, at - 2), min(len(values), at + 2 + more))]
    assert list(zip(got["query_id"], got["neighbor_id"])) == want


def test_projection_index_is_reusable_and_spread(spark):
    """A third of all rows equal: positions are still a permutation, over several slices."""
    x = np.vstack([np.zeros((400, 2)), np.random.default_rng(1).normal(size=(800, 2))])
    df = vectors(spark, x).repartition(4)
    basis = make_basis(3, 2, 1)
    ix = P.build_index(df, basis)
    pos = ix.table.filter("p = 0").select("pos").toPandas()["pos"]
    assert sorted(pos) == list(range(1200))
    a = rows(P.knn_projection(df, df, 3, 10, index=ix))
    assert a.equals(rows(P.knn_projection(df, df, 3, 10, basis=basis)))
    with pytest.raises(ValueError):
        P.build_index(df, np.ones((100, 2)))


def test_projection_lanes(spark, monkeypatch, normals):
    want = rows(P.knn_projection(normals, normals, 3, 10))
    monkeypatch.setattr(P, "SLICE_QUERIES", 16)
    assert rows(P.knn_projection(normals, normals, 3, 10)).equals(want)


def test_delta(spark, normals):
    basis = make_basis(4, 20, 1)
    old, new = normals.filter("id < 900"), normals.filter("id >= 900")
    gone = normals.filter("id % 50 = 7")
    q = normals.filter("id % 9 = 0")
    for rebuild in ("no", "auto"):
        got = rows(P.knn_with_delta(q, old, new, gone, 3, 900, basis=basis, rebuild=rebuild), "query_id", "rank")
        want = rows(S.knn(q, normals.join(gone.select("id"), "id", "left_anti"), 3), "query_id", "rank")
        assert got[want.columns].equals(want), rebuild
    assert P.needs_reindex(100, 6, 0) and P.needs_reindex(100, 0, 3) and not P.needs_reindex(100, 5, 2)


@pytest.mark.parametrize("raise_limit", [None, 0.9])
def test_hash_search_recall_and_layouts(spark, normals, raise_limit):
    df = G.normal_points(spark, 3000, 10, seed=2).drop("weight")
    q = df.filter("id < 60")
    args = dict(search_size=300, raise_limit=raise_limit, seed=5)
    want = rows(H.knn_lsh(q, df, 100, **args))
    overlap = R.search_overlap(H.knn_lsh(q, df, 100, **args), S.knn(q, df, 100))
    assert overlap.agg(F.percentile_approx("recall", 0.5)).first()[0] > 0.45
    if raise_limit == 0.9:
        for layout in ("cells",):
            assert rows(H.knn_lsh(q, df, 100, layout=layout, **args)).equals(want)
    work = H.distance_evaluations(q, df, 300, raise_limit=raise_limit, seed=5).agg(F.sum("evaluations")).first()[0]
    assert 60 * 300 <= work < 60 * 3000


def test_hash_search_with_few_rows(spark):
    df = vectors(spark, np.random.default_rng(1).normal(size=(7, 4)))
    assert H.knn_lsh(df, df, 3, 50).count() == 21
    with pytest.raises(ValueError):
        H.knn_lsh(df, df, 10, 5)


def test_hash_raise_never_lowers(spark, normals):
    base = rows(H.distance_evaluations(normals, normals, 50, seed=1, raise_limit=None))
    more = rows(H.distance_evaluations(normals, normals, 50, seed=1, raise_limit=0.5))
    assert (more["cutoff"] >= base["cutoff"]).all() and (more["cutoff"] > base["cutoff"]).any()


def test_hash_correlation_falls_with_bits(spark):
    df = G.normal_points(spark, 1500, 10, seed=8)
    got = rows(R.hash_correlation(df, df)).query("pairs > 500")
    assert np.corrcoef(got["hamming"], got["mean_cosine"])[0, 1] < -0.95


def test_remove_promotes_second(spark, normals):
    q = normals.filter("id = 12")
    before = rows(S.knn(q, normals, 2), "rank")
    left = M.remove_within(normals, q, 1e-7)
    assert M.size(left) == 999
    after = rows(S.knn(q, left, 1))
    assert after["neighbor_id"][0] == before["neighbor_id"][1]
    assert M.size(M.remove_within(normals, vectors(spark, [[50.0] * 20]), 0.1)) == 1000
    assert M.size(M.remove_equal(normals, q)) == 999


def test_batched_adds(normals):
    x = normals.filter("id < 300")
    assert M.size(x) == 300
    x = M.add_all(x, normals.filter("id >= 300 and id < 310"))
    assert M.size(x) == 310
    x = M.add_all(x, normals.filter("id >= 310"))
    assert M.size(x) == 1000 and rows(S.knn(x, x, 1))["distance"].max() == 0
    assert M.size(M.clear(x)) == 0 and M.clear(x).schema == x.schema
    assert M.skip_first(x, 990).count() == 10 and M.take_first(x, 7).count() == 7


def test_distinct_and_pair_distance(spark):
    df = vectors(spark, [[0, 0], [0, 0], [3, 4], [0, 0]])
    assert [r["id"] for r in M.distinct_vectors(df).orderBy("id").collect()] == [0, 2]
    assert S.min_pair_distance(df).first()[0] == 0
    assert S.min_pair_distance(df, positive=True).first()[0] == 5
    assert rows(S.nearest_other(df))["distance"].tolist() == [0, 0, 5, 0]


def test_assign_ties_and_large_centroid_tables(spark, monkeypatch):
    pts = vectors(spark, [[0.0], [1.0], [0.5]])
    c = spark.createDataFrame([(2, [1.0]), (1, [0.0])], "centroid_id int, vec array<double>")
    want = rows(S.assign_nearest(pts, c))
    assert want["centroid_id"].tolist() == [1, 2, 1]
    from vecspark import session
    monkeypatch.setattr(session, "BROADCAST_BYTES", 8)
    got = rows(S.assign_nearest(pts, c))
    assert got["centroid_id"].tolist() == [1, 2, 1]


def test_methods_by_name(normals):
    q = normals.filter("id < 3")
    for name in ("exact", "projection", "lsh"):
        assert S.search(q, normals, 1, method=name).count() == 3
    with pytest.raises(ValueError):
        S.search(q, normals, 1, method="tree")


def test_global_rank(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.lit(1).alias("same"))
    got = rows(with_rank(df.repartition(5), ["same", "id"], "pos"), "id")
    assert (got["pos"] == got["id"]).all()
    by = rows(with_rank(df.repartition(5), [F.col("id").desc()], "pos", ["g"]), "g", "pos")
    assert by.query("g == 1")["id"].tolist() == list(range(997, 0, -3))


def test_cosine_cells(spark):
    """Unit vectors rule cells out; a vector without direction makes all blocks meet."""
    rng = np.random.default_rng(12)
    lumps = (rng.normal(size=(9, 5))[rng.integers(0, 9, 400)] + rng.normal(size=(400, 5)) * 0.05) * rng.uniform(0.1, 9, (400, 1))
    df = vectors(spark, lumps)
    want = rows(S.knn(df, df, 4, "cosine", layout="refs"))
    assert rows(S.knn(df, df, 4, "cosine", layout="cells")).equals(want)
    zero = df.union(vectors(spark, np.zeros((1, 5)), [900]))
    assert S._with_unit(zero) is None
    got = rows(S.knn(df, zero, 4, "cosine", layout="cells"))
    assert got.equals(want)
