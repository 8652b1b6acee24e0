import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import vectors
from vecspark.functions import basis as B
from vecspark.functions import kernels as K
from vecspark.functions import vectors as V
from vecspark.functions.uniform import gaussian, local_gaussian, local_uniform, uniform
from vecspark.schema import validate_vectors, validation_report

finite = st.floats(-100, 100, allow_nan=False)


def test_unrolled_and_folded_sums_are_the_same_bits(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(rng.normal(size=7).tolist(), rng.normal(size=7).tolist())
                                for _ in range(20)], "a array<double>, b array<double>")
    for f in (V.euclidean, V.sq_euclidean, V.dot, V.manhattan, V.cosine):
        got = df.select(f("a", "b").alias("x"), f("a", "b", 7).alias("y")).collect()
        assert all(r["x"] == r["y"] for r in got)


def test_numpy_and_column_forms_agree(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 20)), rng.normal(size=(30, 20))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))],
                               "i int, a array<double>, b array<double>")
    for name, m in V.METRICS.items():
        got = [r[0] for r in df.orderBy("i").select(m.column("a", "b")).collect()]
        assert np.array_equal(got, m.paired(a, b)), name
        assert np.allclose(m.pairwise(a, b).diagonal(), got, atol=1e-7)


def test_normalize_keeps_zero(spark):
    got = vectors(spark, [[0, 0], [3, 4]]).orderBy("id").select(V.normalize("vec")).collect()
    assert [list(r[0]) for r in got] == [[0.0, 0.0], [0.6, 0.8]]


def test_metric_registry(spark):
    with pytest.raises(ValueError):
        V.get_metric("nope")
    V.register_metric("chebyshev", lambda a, b, dim=None: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
                      lambda a, b: np.abs(a - b).max(axis=1), triangle=True)
    try:
        from vecspark.operators.search import knn
        rng = np.random.default_rng(3)
        x = rng.normal(size=(60, 4))
        df = vectors(spark, x)
        want = np.abs(x[:, None] - x[None]).max(2)
        for layout in ("refs", "queries", "cells"):
            got = knn(df, df, 3, "chebyshev", layout=layout).toPandas()
            for q, part in got.groupby("query_id"):
                assert np.allclose(part.sort_values("rank")["distance"], np.sort(want[q])[:3])
    finally:
        del V.METRICS["chebyshev"]


def test_random_numbers_match_plain_python(spark):
    got = spark.range(5).select("id", uniform(7, "id").alias("u"), gaussian(7, "id", F.lit(2)).alias("g")).collect()
    for r in got:
        assert r["u"] == local_uniform(7, r["id"])
        assert abs(r["g"] - local_gaussian(7, r["id"], 2)) < 1e-12


def test_basis_kinds():
    g = B.make_basis(5, 12, 1)
    assert np.allclose((g ** 2).sum(1), 1) and (g < 0).any()
    assert (B.make_basis(5, 12, 1, kind="uniform") > 0).all()
    assert not np.allclose((B.make_basis(5, 12, 1, unit=False) ** 2).sum(1), 1)
    with pytest.raises(ValueError):
        B.make_basis(0, 3)
    with pytest.raises(ValueError):
        B.make_basis(2, 3, kind="odd")


@pytest.mark.parametrize("m,d", [(3, 4), (20, 30)])
def test_projection_both_forms(spark, m, d):
    rng = np.random.default_rng(4)
    x, basis = rng.normal(size=(10, d)), B.make_basis(m, d, 2)
    got = np.array([r[0] for r in vectors(spark, x).orderBy("id").select(B.project("vec", basis)).collect()])
    assert np.allclose(got, x @ basis.T)
    assert np.array_equal(got, K.project(x, basis))


def test_sign_hash_and_hamming(spark):
    rng = np.random.default_rng(5)
    x, basis = rng.normal(size=(12, 3)), B.hash_basis(3, 1)
    for d, bits in ((3, 32), (3, 64), (9, 64)):
        x, basis = rng.normal(size=(12, d)), B.hash_basis(d, 1, bits)
        f = B.sign_hash32 if bits == 32 else B.sign_hash64
        got = [r[0] for r in vectors(spark, x).orderBy("id").select(f("vec", basis)).collect()]
        want = [sum(1 << i for i in range(bits) if x[j] @ basis[i] > 0) for j in range(12)]
        assert [g % (1 << 64) for g in got] == want
    df = spark.createDataFrame([(0, -1), (5, 6)], "a bigint, b bigint")
    assert [r[0] for r in df.select(B.hamming("a", "b")).collect()] == [64, 2]
    with pytest.raises(ValueError):
        B.hash_basis(3, bits=16)


def test_validation(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")]),
                                (5, [None, 1.0]), (6, [float("inf"), 0.0])], "id bigint, vec array<double>")
    assert [r["id"] for r in validate_vectors(df, 2).collect()] == [1]
    assert validation_report(df, 2).first().asDict() == {"kept": 1, "dropped": 5}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(finite, finite), min_size=1, max_size=30), st.integers(1, 8))
def test_block_top_k_is_brute_force(points, k):
    x = np.array(points)
    ids = np.arange(len(x))[::-1].copy()
    m = V.get_metric("euclidean")
    qi, got, d, rank = K.top_k(x, K.RefBlock(ids, x), k, m)
    for q in range(len(x)):
        dist = m.paired(np.broadcast_to(x[q], x.shape), x)
        want = sorted(zip(dist, ids))[:k]
        mine = list(zip(d[qi == q], got[qi == q]))
        assert mine == want


def test_block_of_copies_expands_lowest_ids():
    x = np.zeros((1000, 3))
    qi, ids, d, rank = K.top_k(np.ones((2, 3)), K.RefBlock(np.arange(1000) + 5, x), 4, V.get_metric("euclidean"))
    assert ids.tolist() == [5, 6, 7, 8] * 2 and len(K.RefBlock(np.arange(1000), x).vecs) == 1


@pytest.mark.parametrize("k", [1, 7, 300])
def test_single_precision_shortlist_is_exact(monkeypatch, k):
    """Single precision only chooses; distances, ties and ranks are those of doubles. It must be taken
    for usual data, and not where it tells nothing apart."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(K, "SQUARE_COLS", 500)
    usual = np.round(rng.normal(size=(2000, 5)) * 3, 1) + 1e7
    for x, taken in ((usual, True), (np.vstack([usual, np.full((1, 5), np.inf)]), False), (usual * 1e-200, False)):
        doubles = []
        metric = V.Metric("x", None, K.paired_euclidean, K.pairwise_euclidean, K.slack_euclidean)
        real = K.pair_slack
        monkeypatch.setattr(K, "pair_slack", lambda *a: doubles.append(1) or real(*a))
        ids = rng.permutation(len(x))
        with np.errstate(all="ignore"):
            got = K.top_k(x[:600], K.RefBlock(ids, x), k, metric)
            monkeypatch.setattr(K, "SINGLE_ROWS", 1 << 60)
            want = K.top_k(x[:600], K.RefBlock(ids, x), k, metric) if taken else got
        monkeypatch.setattr(K, "SINGLE_ROWS", 256)
        monkeypatch.setattr(K, "pair_slack", real)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
        if taken:
            assert K._shortlist(_taken(x, x[:600]), 0, 512, k) is not None
        else:
            assert doubles and not K.Squares(x).of(x[:600])


def _taken(refs, queries):
    sq = K.Squares(refs)
    assert sq.of(queries)
    return sq


@pytest.mark.parametrize("k", [1, 4, 300])
def test_cosine_is_shortlisted_too(monkeypatch, k):
    """single precision chooses for the cosine as well, and decides nothing: rows along one line, rows without a direction
    and lengths that squares cannot hold give what doubles give."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(2000, 5)) * 3, 1)
    odd = np.vstack([x, x[:40] * 4, np.zeros((3, 5)), np.full((1, 5), np.nan)])
    metric, real = V.get_metric("cosine"), K.pair_slack
    for refs, queries, taken in ((x[x.any(axis=1)], x[:600] + 0.05, True), (odd, x[:600] + 0.05, True), (odd, odd[-600:], None),
                                 (np.vstack([x, np.full((1, 5), 1e-170)]), x[:600] + 0.05, False)):
        doubles = []
        monkeypatch.setattr(K, "pair_slack", lambda *a: doubles.append(1) or real(*a))
        ids = rng.permutation(len(refs))
        with np.errstate(all="ignore"):
            got = K.top_k(queries, K.RefBlock(ids, refs), k, metric)
            assert taken is None or taken != bool(doubles)
            monkeypatch.setattr(K, "SINGLE_ROWS", 1 << 60)
            want = K.top_k(queries, K.RefBlock(ids, refs), k, metric)
        monkeypatch.setattr(K, "SINGLE_ROWS", 256)
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))


def test_paired_sums_go_in_index_order():
    """Whatever the shape, sums are those of one coordinate after the other, bit by bit."""
    rng = np.random.default_rng(6)
    for n, d in ((1, 64), (2, 9), (513, 9), (1200, 70), (7, 3), (4, 0)):
        a, b = rng.normal(size=(2, n, d)) * 10.0 ** rng.integers(-6, 6, (2, n, 1))
        squares, dots = np.zeros(n), np.zeros(n)
        for j in range(d):
            squares += (a[:, j] - b[:, j]) * (a[:, j] - b[:, j])
            dots += a[:, j] * b[:, j]
        assert np.array_equal(K.paired_sqeuclidean(a, b), squares) and np.array_equal(K.paired_dot(a, b), dots)


def test_normalize_takes_the_length_once(spark):
    """the norm is not taken anew for each coordinate."""
    got = vectors(spark, [[0, 0], [3, 4], [-0.5, 0]]).orderBy("id").select(V.normalize("vec").alias("u"))
    assert [r["u"] for r in got.collect()] == [[0, 0], [0.6, 0.8], [-1, 0]]
    assert spark.range(1).select(V.normalize(F.lit(None).cast("array<double>")).alias("u")).first()["u"] is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt(") == 1
