"""The projection index that carries its vectors, and the index kept in a folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, vectors
from vecspark import session
from vecspark.functions.basis import make_basis
from vecspark.operators import projection_search as P
from vecspark.operators.stored_index import StoredIndex


def by_hand(q, refs, basis, k, size, window, gone=()):
    """(query, neighbour, distance, rank): windows along each projection, then exact distances; refs and q as {id: vector}."""
    out, ids = [], sorted(refs)
    for i, x in q.items():
        found = set()
        for b in basis:
            line = sorted((sum(u * w for u, w in zip(refs[r], b)), r) for r in ids)
            place = sum(v < sum(u * w for u, w in zip(x, b)) for v, _ in line)
            end = place + size + (window == "closed")
            found |= {r for _, r in line[max(0, place - size):end]}
        near = sorted((float(np.sqrt(((np.array(refs[r]) - x) ** 2).sum())), r) for r in found if r not in gone)
        out += [(i, r, round(d, 9), n) for n, (d, r) in enumerate(near[:k], 1)]
    return sorted(out)


def said(df):
    return sorted((r.query_id, r.neighbor_id, round(r.distance, 9), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    mat = np.round(rng.normal(size=(300, 3)), 1)  # ties and copies
    return {k: mat[k] for k in range(300)}, {1000 + k: v for k, v in enumerate(np.vstack([mat[:20], rng.normal(size=(10, 3)) * 5]))}


def frames(spark, data):
    return [vectors(spark, np.array(list(d.values())), d.keys()) for d in data]


@pytest.mark.parametrize("window", ["half_open", "closed"])
@pytest.mark.parametrize("few", [True, False])
def test_search_by_hand(spark, data, window, few, monkeypatch):
    """Few queries travel to the slices, many meet them; slices and lanes are small here."""
    monkeypatch.setattr(P, "SLICE_ROWS", 64)
    monkeypatch.setattr(P, "SLICE_QUERIES", 4)
    basis = np.round(make_basis(3, 3, seed=8), 2)
    refs, q = frames(spark, data)
    index = P.build_index(refs, basis)
    assert sum(len(x[2]) for x in index.slices.values()) > 12
    if not few:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 200)
    got = P.search_index(index, q, 4, 7, window, without=vectors(spark, [[0.0]], [5]) if few else None)
    assert said(got) == by_hand(data[1], data[0], basis, 4, 7, window, {5} if few else ())
    pairs = P.projection_candidates(q, None, basis, 7, window, index=index)
    assert pairs.count() == len(by_hand(data[1], data[0], basis, 300, 7, window))


def test_no_pair_table(spark, data, monkeypatch):
    """One join of queries and slices, nothing joined back: only the place of a query joins, and the answers are few."""
    refs, q = frames(spark, data)
    index = P.build_index(refs, make_basis(3, 3))
    plan = P.search_index(index, q, 4, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and plan.count("MapInArrow") == 1


def test_empty_and_bad(spark, data):
    refs, q = frames(spark, data)
    index = P.build_index(refs, make_basis(2, 3))
    assert P.search_index(index, q.limit(0), 3, 5).collect() == []
    assert P.search_index(P.build_index(refs.limit(0), make_basis(2, 3)), q, 3, 5).collect() == []
    with pytest.raises(ValueError, match="not unique"):
        P.search_index(index, q.union(q), 3, 5)
    with pytest.raises(ValueError):
        P.search_index(index, q, 0, 5)


def test_versions(spark, data, tmp_path):
    refs, q = frames(spark, data)
    every, asked = data
    basis = np.round(make_basis(3, 3, seed=8), 2)
    some = {i: v for i, v in every.items() if i < 280}
    path = str(tmp_path / "index")
    one = StoredIndex.create(refs.where("id < 280"), path, basis)
    assert one.manifest.version == 1 and said(one.search(q, 3, 6)) == by_hand(asked, some, basis, 3, 6, "closed")
    two = one.add(refs.where("id >= 280 AND id < 290"))           # 10 of 280: within 5 %
    three = two.remove(refs.where("id IN (3, 4, 285, 9999)"))     # 3 that are there: within 2 %
    assert (three.manifest.pending, three.manifest.gone, three.manifest.base) == (10, 3, one.manifest.base)
    for index in (three, StoredIndex.open(spark, path)):
        for part in (q.where("id < 1010"), q.where("id >= 1010")):
            got, ids = said(index.search(part, 3, 6)), {r.id for r in part.collect()}
            near = by_hand({i: asked[i] for i in ids}, some, basis, 300, 6, "closed", {3, 4})
            fresh = [(i, r, round(float(np.sqrt(((every[r] - asked[i]) ** 2).sum())), 9), 0) for i in ids for r in range(280, 290) if r != 285]
            want = []
            for i in ids:
                best = sorted((d, r) for j, r, d, _ in near + fresh if j == i)[:3]
                want += [(i, r, d, n) for n, (d, r) in enumerate(best, 1)]
            assert got == sorted(want)
    four = three.add(refs.where("id IN (3, 285)"), "no")          # there again
    assert sorted(r.id for r in four.rows().collect()) == sorted(set(range(290)) - {4})
    five = four.add(refs.where("id >= 290"))                      # 22 of 280: a new base
    assert five.manifest.base != one.manifest.base and (five.manifest.pending, five.manifest.gone) == (0, 0)
    now = {i: v for i, v in every.items() if i != 4}
    assert five.manifest.indexed == len(now) and said(five.search(q, 3, 6)) == by_hand(asked, now, basis, 3, 6, "closed")
    with pytest.raises(RuntimeError, match="exists already"):     # a second writer from the same version
        four.remove(refs.where("id = 7"), "no")
    assert said(three.search(q, 3, 6)) != said(five.search(q, 3, 6))  # older versions stay readable
    five.vacuum()
    again = StoredIndex.open(spark, path)
    assert again.manifest == five.manifest and again.rows().count() == len(now)
    assert again.rebuild().manifest.version == 6
    with pytest.raises(RuntimeError, match="already"):
        StoredIndex.create(refs, path, basis)
    assert rows(again.rows().select("id")).id.tolist() == sorted(now)


def test_ragged_vectors_are_refused(spark, tmp_path):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors of different lengths"):
        StoredIndex.create(bad, str(tmp_path / "x"), np.ones((60, 5)))
