"""Hash search: one look, raising, and the tables of bands, against brute force on the hashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import vectors
from vecspark.functions import kernels
from vecspark.functions.basis import hash_basis
from vecspark.operators import hash_search as H

BASIS = hash_basis(4, 9)


@pytest.fixture(scope="module")
def data():
    """Lumps, so that some queries meet many references in few bits; exact copies; a few far rows; any long as id."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 4)) * 3
    refs = np.round(centre[rng.integers(0, 12, 600)] + rng.normal(size=(600, 4)) * 0.4, 2)
    refs[300:340] = refs[300]
    ids = rng.permutation(600) * 10**15 - 3 * 10**17
    q = np.vstack([refs[::20], rng.normal(size=(10, 4)) * 5])
    return (ids, refs), (np.arange(len(q)) - 5, q)


def frames(spark, data):
    (ids, refs), (qid, q) = data
    return vectors(spark, refs, ids).repartition(5), vectors(spark, q, qid)


def brute(data, k, size, raise_limit=None, flips=None):
    (ids, refs), (qid, q) = data
    level = kernels.hamming_matrix(kernels.sign_hash(q, BASIS), kernels.sign_hash(refs, BASIS)).astype(int)
    dist = np.sqrt(((q[:, None] - refs[None]) ** 2).sum(-1))
    out, limits = [], {}
    for i, name in enumerate(qid.tolist()):
        may = np.ones(len(refs), bool)
        if flips is not None:
            x = kernels.sign_hash(q[i:i + 1], BASIS).view(np.uint64) ^ kernels.sign_hash(refs, BASIS).view(np.uint64)
            may = np.any([np.bitwise_count(x >> np.uint64(16 * b) & np.uint64(0xFFFF)) <= flips for b in range(4)], axis=0)
        some = np.sort(level[i][may])
        cutoff = int(some[size - 1]) if len(some) >= size else 64
        if raise_limit is not None and len(some) >= size:
            reach = np.sort(dist[i][level[i] <= cutoff])[size - 1]
            while cutoff < H.RAISE_BELOW - 1:
                d = dist[i][level[i] == cutoff + 1]
                if len(d) <= H.RAISE_MEMBERS or not reach:
                    break
                step = np.sort(np.minimum(np.floor(d / (2 * reach) * H.QUARTILE_STEPS), H.QUARTILE_STEPS))
                q1 = step[int(np.ceil(0.25 * len(d))) - 1] * 2 * reach / H.QUARTILE_STEPS
                if not raise_limit * q1 + (1 - raise_limit) * d.min() < reach:
                    break
                cutoff += 1
        limits[name] = (cutoff, int((level[i][may] <= cutoff).sum()))
        near = sorted((round(float(d), 9), r) for d, r in zip(dist[i][may & (level[i] <= cutoff)], ids[may & (level[i] <= cutoff)].tolist()))
        out += [(name, r, d, n) for n, (d, r) in enumerate(near[:k], 1)]
    return sorted(out), limits


def said(df):
    return sorted((r.query_id, r.neighbor_id, round(r.distance, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("layout,raise_limit", [("refs", None), ("queries", None), ("blocks", None), ("queries", 0.9), ("cells", 0.9)])
def test_hash_search(spark, data, layout, raise_limit, monkeypatch):
    monkeypatch.setattr(H, "RAISE_AT_ONCE", 2)
    refs, q = frames(spark, data)
    want, limits = brute(data, 7, 30, raise_limit)
    assert said(H.knn_lsh(q, refs, 7, 30, basis=BASIS, raise_limit=raise_limit, layout=layout)) == want
    if layout == "queries":
        got = H.distance_evaluations(q, refs, 30, basis=BASIS, raise_limit=raise_limit, layout=layout).collect()
        assert {r.query_id: (r.cutoff, r.evaluations) for r in got} == limits


def test_steps_without_a_distance_for_each_pair(monkeypatch):
    """A raising look counts as before, but takes exact distances of few pairs only."""
    rng = np.random.default_rng(6)
    basis, x, q = hash_basis(16, 3), rng.normal(size=(6000, 16)), rng.normal(size=(300, 16))
    refs = {"id": rng.permutation(6000), "vec": x, "hash": kernels.sign_hash(x, basis)}
    queries = {"id": np.arange(300), "vec": q, "hash": kernels.sign_hash(q, basis), "low": rng.integers(18, 22, 300),
               "reach": rng.uniform(1.5, 3.5, 300), "bar": rng.uniform(1, 3, 300)}
    queries["high"] = queries["low"] + rng.integers(0, 4, 300)
    job, pairs, real = H.Levels([], [], H.ROWS, k=4, metric=H.get_metric("euclidean")), [], kernels.paired_in_parts
    monkeypatch.setattr(kernels, "paired_in_parts", lambda m, a, b, qi, ri: pairs.append(len(qi)) or real(m, a, b, qi, ri))
    got = job.run(queries, dict(refs))
    few = sum(pairs)
    monkeypatch.setattr(kernels.Squares, "of", lambda self, x: False)
    pairs.clear()
    want = job.run(queries, dict(refs))
    assert few < 0.2 * sum(pairs)

    def told(o):
        c = {(a, b, s): n for a, b, s, n in zip(*(o[x].tolist() for x in ("query_id", "hamming", "step", "n"))) if n}
        least = {}
        for a, b, n, d in zip(*(o[x].tolist() for x in ("query_id", "hamming", "n", "least"))):
            if n:
                least[a, b] = min(d, least.get((a, b), np.inf))
        near = {(a, b, r, d) for a, b, n, r, d in zip(*(o[x].tolist() for x in ("query_id", "hamming", "n", "neighbor_id", "distance")))
                if not n and d <= queries["bar"][a]}
        return c, least, near
    assert told(got) == told(want) and len(told(got)[2]) > 50


@pytest.mark.parametrize("flips,rows", [(1, 9), (2, 4096)])
def test_bands(spark, data, flips, rows, monkeypatch):
    """With buckets of few rows: crowded ones are split by further bits, the 40 copies by ids; buckets with many queries in lanes."""
    refs, q = frames(spark, data)
    index = H.build_band_index(refs, BASIS, flips=flips, bucket_rows=rows)
    assert index.table.count() == 4 * 600 and index.table.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= max(rows, 30)
    if rows == 9:
        assert max(map(max, index.parts)) > 1 and sum(map(len, index.lows)) > 50
        monkeypatch.setattr(H, "block_rows", lambda dim: 3)
    assert said(H.knn_banded(q, index, 5, 20)) == brute(data, 5, 20, flips=flips)[0]
    assert said(H.knn_lsh(q, None, 5, 20, index=index, layout="cells", raise_limit=None)) == brute(data, 5, 20)[0]


def test_bucket_bounds():
    rng = np.random.default_rng(1)
    values, counts = np.unique(rng.integers(0, 1 << 10, 400) ** 2 >> 10, return_counts=True)
    counts[3] = 500
    lows, parts = H.bucket_bounds(values, counts, 10, 20)
    assert lows[0] == 0 and (np.diff(lows) > 0).all()
    for low, high, n in zip(lows, [*lows[1:], 1 << 10], parts):
        held = counts[(values >= low) & (values < high)].sum()
        assert held <= 20 or (high - low == 1 and n == -(-held // 20))


def test_masks():
    masks = H.flip_masks(16, 2)
    assert len(masks) == 1 + 16 + 120 == len(set(masks.tolist())) and max(np.bitwise_count(masks)) == 2


def test_no_rows(spark, data):
    refs, q = frames(spark, data)
    index = H.build_band_index(refs.limit(0), BASIS)
    assert H.knn_banded(q, index, 3, 5).collect() == [] and H.knn_lsh(q, refs.limit(0), 3, 5, basis=BASIS).collect() == []
    assert H.knn_lsh(q.limit(0), refs, 3, 5, basis=BASIS).collect() == []
    for bad in (lambda: H.knn_banded(q, index, 6, 5), lambda: H.build_band_index(refs, BASIS, bands=5), lambda: H.knn_lsh(q.union(q), refs, 3, 5)):
        with pytest.raises(ValueError):
            bad()


def test_one_look_raises(spark, data, monkeypatch):
    """All bits a limit may grow by are told in one look at squares, not four bits in each; other metrics take few bits at once."""
    refs, q = frames(spark, data)
    looks, real = [], H._looked
    monkeypatch.setattr(H, "_looked", lambda x, *a, **b: looks.append(x.agg(F.max(F.col("high") - F.col("low"))).first()[0]) or real(x, *a, **b))
    want, limits = brute(data, 7, 30, 0.9)
    assert said(H.knn_lsh(q, refs, 7, 30, basis=BASIS, layout="refs")) == want
    assert len(looks) == 2 and looks[1] > 10 and max(c for c, _ in limits.values()) > 10
    looks.clear()
    H.knn_lsh(q, refs, 7, 30, basis=BASIS, layout="refs", metric="manhattan")
    assert len(looks) > 1 and max(looks[1:]) < 4


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_what_covers_falls(monkeypatch, held):
    """Which references are up to the covering bit distance, without an order of all of a block; also where very many are."""
    rng = np.random.default_rng(7)
    code = rng.integers(-2**62, 2**62, 3000)
    code[:900] = code[0]
    refs, queries = {"id": np.arange(3000), "hash": code}, {"id": np.arange(40), "hash": np.append(code[:4], code[-36:])}
    queries |= {"low": np.zeros(40, int), "high": np.full(40, H.BITS)}
    monkeypatch.setattr(H, "STEP_COLS", 128)
    sorts, real = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **b: sorts.append(x.size) or real(x, *a, **b))
    found = H.Levels([], [], H.ROWS, depth=25).covering(queries, refs, held)
    assert sum(sorts) <= 40 * 128
    if held == 300:
        assert found is None
        return
    level = kernels.hamming_matrix(queries["hash"], code)
    want = np.nonzero(level <= np.sort(level, axis=1)[:, 24:25])
    assert sorted(zip(*(x.tolist() for x in found[:2]))) == sorted(zip(*(x.tolist() for x in want)))
    assert (found[2] == level[found[0], found[1]]).all()


@pytest.mark.parametrize("strategy", [0.0, 0.3, 0.9, 1.0])
def test_steps_not_told_apart_decide_alike(strategy):
    """A quartile's step and the one told for it raise a limit alike, whatever the least distance is."""
    rng, told = np.random.default_rng(8), H.told_steps(strategy)
    for reach in rng.uniform(1e-3, 1e3, 50):
        for step, least in zip(rng.integers(0, 33, 300), rng.uniform(0, 1, 300)):
            least *= (step + 1) * 2 * reach / 32
            real, short = (strategy * (s * 2 * reach / 32) + (1 - strategy) * least < reach for s in (step, told[step]))
            assert real == short
    assert len(set(told.tolist())) < 12 or not strategy >= 0.9
    assert H.told_steps(1.2) is None
