"""Nearest-neighbour search and upkeep of vector sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.registry import (
    BASIS, E, HASH_BASIS, MEANS, NEAR, ORACLE, embeddings, parts, query, r6, s6, scratch, sql_basis, table)
from vecspark.functions.uniform import random_order
from vecspark.operators import hash_search as H
from vecspark.operators import maintain as M
from vecspark.operators import projection_search as P
from vecspark.operators import recall as R
from vecspark.operators import search as S
from vecspark.operators.stats import label_means, outlier_trim
from vecspark.operators.stored_index import StoredIndex
from vecspark.plans.rank import with_rank

PAIR_DIST = """d AS (SELECT q.id AS query_id, r.id AS neighbor_id, {dist} AS distance FROM e q, e r)"""
TOP = """SELECT query_id, neighbor_id, {d6} AS distance, rank FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM {src})
WHERE rank <= {k}"""


def top_sql(k, src="d"):
    return TOP.format(d6=s6("distance"), k=k, src=src)


def rounded(hits):
    return hits.select("query_id", "neighbor_id", r6("distance").alias("distance"), "rank")


EXACT = f"WITH {E}, {PAIR_DIST.format(dist='list_distance(q.vec, r.vec)')} "


@query("knn_exact", EXACT + top_sql(5))
def knn_exact(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.knn(e, e, 5))


@query("knn_exact_partitioned", EXACT + top_sql(5))
def knn_cells(spark, sf):
    """The layout for two large sides."""
    e = embeddings(spark, sf)
    return rounded(S.knn(e, e, 5, layout="cells"))


@query("knn_exact_small_queries", EXACT + top_sql(3))
def knn_queries(spark, sf):
    """The layout for few queries against many references."""
    e = embeddings(spark, sf)
    return rounded(S.knn(e, e, 3, layout="queries"))


@query("knn_sqeuclidean", f"WITH {E}, {PAIR_DIST.format(dist='list_distance(q.vec, r.vec) ** 2')} " + top_sql(4))
def knn_sq(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.knn(e, e, 4, "sqeuclidean"))


@query("knn_cosine", f"WITH {E}, {PAIR_DIST.format(dist='1 - list_cosine_similarity(q.vec, r.vec)')}, "
                     "t AS (" + top_sql(4) + ") SELECT * FROM t WHERE rank > 1")
def knn_cosine(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.knn(e, e, 4, "cosine")).filter("rank > 1")


@query("knn_cosine_partitioned", f"WITH {E}, {PAIR_DIST.format(dist='1 - list_cosine_similarity(q.vec, r.vec)')} " + top_sql(4))
def knn_cosine_cells(spark, sf):
    """Cells of unit vectors; rank 1 is the query itself."""
    e = embeddings(spark, sf)
    return rounded(S.knn(e, e, 4, "cosine", layout="cells"))


@query("order_by_distance", EXACT + "SELECT query_id, neighbor_id, CAST(row_number() OVER (PARTITION BY query_id "
       "ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 20")
def order_by_distance(spark, sf):
    e = embeddings(spark, sf)
    return S.knn(e, e, 20).select("query_id", "neighbor_id", "rank")


@query("top_k_per_query", """SELECT query_id, neighbor_id, distance, rank FROM (
SELECT l_suppkey AS query_id, l_partkey AS neighbor_id, min(l_extendedprice) AS distance,
CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_extendedprice), l_partkey) AS INTEGER) AS rank
FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE rank <= 3""")
def top_k_per_query(spark, sf):
    scored = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("neighbor_id")).agg(
        F.min("l_extendedprice").alias("distance"))
    return S.top_k_per_query(scored, 3, lanes=8)


@query("assign_nearest", f"WITH {E}, {MEANS}, {NEAR} SELECT id, centroid_id, {s6('distance')} AS distance FROM near")
def assign_nearest(spark, sf):
    e = embeddings(spark, sf)
    return S.assign_nearest(e, label_means(e, "label")).select("id", "centroid_id", r6("distance").alias("distance"))


GAPS = ("gaps AS (SELECT a.centroid_id, min(list_distance(a.vec, b.vec)) AS gap FROM c a, c b "
        "WHERE a.centroid_id <> b.centroid_id GROUP BY ALL)")


@query("outlier_trim", f"WITH {E}, {MEANS}, {NEAR}, {GAPS} SELECT near.id, near.centroid_id, {s6('distance')} AS distance "
                       "FROM near JOIN gaps USING (centroid_id) WHERE distance < 5.35 * gap")
def trim(spark, sf):
    e = embeddings(spark, sf)
    c = label_means(e, "label")
    return outlier_trim(S.assign_nearest(e, c), c, 5.35).select("id", "centroid_id", r6("distance").alias("distance"))


def _window_sql(high: str) -> str:
    return f"""v AS (SELECT b.i AS p, e.id, list_dot_product(e.vec, b.row) AS v FROM e, b),
pos AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY v, id) - 1 AS pos,
  rank() OVER (PARTITION BY p ORDER BY v) - 1 AS qpos FROM v),
cand AS (SELECT DISTINCT q.id AS query_id, r.id AS neighbor_id FROM pos q JOIN pos r ON q.p = r.p
  AND r.pos >= q.qpos - 10 AND r.pos <= q.qpos + {high})"""


RERANK = """s AS (SELECT query_id, neighbor_id, list_distance(q.vec, r.vec) AS distance FROM {cand}
JOIN e q ON q.id = query_id JOIN e r ON r.id = neighbor_id)"""


@query("knn_projection", f"WITH {E}, {sql_basis(BASIS)}, {_window_sql('9')}, {RERANK.format(cand='cand')} " + top_sql(5, "s"))
def knn_projection(spark, sf):
    e = embeddings(spark, sf)
    return rounded(P.knn_projection(e, e, 5, 10, basis=BASIS))


@query("knn_projection_closed", f"WITH {E}, {sql_basis(BASIS)}, {_window_sql('10')}, {RERANK.format(cand='cand')} " + top_sql(5, "s"))
def knn_projection_closed(spark, sf):
    e = embeddings(spark, sf)
    return rounded(P.knn_projection(e, e, 5, 10, basis=BASIS, window="closed"))


@query("projection_candidates", f"WITH {E}, {sql_basis(BASIS)}, {_window_sql('9')} "
                                "SELECT query_id, count(*) AS candidates FROM cand GROUP BY query_id")
def projection_candidates(spark, sf):
    e = embeddings(spark, sf)
    return P.projection_candidates(e, e, BASIS, 10).groupBy("query_id").agg(F.count("*").alias("candidates"))


@query("knn_with_delta", f"""WITH {E}, {sql_basis(BASIS)},
ix AS (SELECT * FROM e WHERE label <> 0), pend AS (SELECT * FROM e WHERE label = 0),
gone AS (SELECT id FROM e WHERE label = 1),
v AS (SELECT b.i AS p, ix.id, list_dot_product(ix.vec, b.row) AS v FROM ix, b),
qv AS (SELECT b.i AS p, e.id, list_dot_product(e.vec, b.row) AS v FROM e, b),
pos AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY v, id) - 1 AS pos FROM v),
qpos AS (SELECT qv.p, qv.id, count(v.id) AS qpos FROM qv LEFT JOIN v ON v.p = qv.p AND v.v < qv.v GROUP BY ALL),
cand AS (SELECT DISTINCT q.id AS query_id, r.id AS neighbor_id FROM qpos q JOIN pos r ON q.p = r.p
  AND r.pos BETWEEN q.qpos - 10 AND q.qpos + 10
  UNION SELECT e.id, pend.id FROM e, pend),
kept AS (SELECT * FROM cand WHERE neighbor_id NOT IN (SELECT id FROM gone)),
{RERANK.format(cand='kept')} """ + top_sql(5, "s"))
def knn_with_delta(spark, sf):
    """Label 0 not indexed yet, label 1 removed since."""
    e = embeddings(spark, sf)
    return rounded(P.knn_with_delta(e, e.filter("label <> 0"), e.filter("label = 0"), e.filter("label = 1"),
                                    5, 10, basis=BASIS, rebuild="no"))


FOLDED = f"""ix AS (SELECT * FROM e WHERE label <> 1),
v AS (SELECT b.i AS p, ix.id, list_dot_product(ix.vec, b.row) AS v FROM ix, b),
qv AS (SELECT b.i AS p, e.id, list_dot_product(e.vec, b.row) AS v FROM e, b),
pos AS (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY v, id) - 1 AS pos FROM v),
qpos AS (SELECT qv.p, qv.id, count(v.id) AS qpos FROM qv LEFT JOIN v ON v.p = qv.p AND v.v < qv.v GROUP BY ALL),
cand AS (SELECT DISTINCT q.id AS query_id, r.id AS neighbor_id FROM qpos q JOIN pos r ON q.p = r.p
  AND r.pos BETWEEN q.qpos - 10 AND q.qpos + 10)"""


@query("knn_with_delta_rebuilt", f"WITH {E}, {sql_basis(BASIS)}, {FOLDED}, {RERANK.format(cand='cand')} " + top_sql(5, "s"))
def knn_with_delta_rebuilt(spark, sf):
    """The changes of ``knn_with_delta`` exceed their shares, so the index is built anew."""
    e = embeddings(spark, sf)
    return rounded(P.knn_with_delta(e, e.filter("label <> 0"), e.filter("label = 0"), e.filter("label = 1"), 5, 10, basis=BASIS))


def _three_batches(index, e):
    """All queries in three batches, answered by one index."""
    parts = [index.search(e.filter(f"pmod(label, 3) = {k}"), 5, 10) for k in range(3)]
    return rounded(parts[0].union(parts[1]).union(parts[2]))


@query("stored_index_kept", ORACLE["knn_with_delta"])
def stored_index_kept(spark, sf):
    """The same changes made in a stored index that is not rebuilt, opened again and searched three times."""
    e, path = embeddings(spark, sf), scratch(spark)
    StoredIndex.create(e.filter("label <> 0"), path, BASIS).add(e.filter("label = 0"), "no").remove(e.filter("label = 1"), "no")
    return _three_batches(StoredIndex.open(spark, path), e)


@query("stored_index_rebuilt", ORACLE["knn_with_delta_rebuilt"])
def stored_index_rebuilt(spark, sf):
    """The same changes where the rule for rebuilding applies to each."""
    e, path = embeddings(spark, sf), scratch(spark)
    StoredIndex.create(e.filter("label <> 0"), path, BASIS).add(e.filter("label = 0")).remove(e.filter("label = 1"))
    return _three_batches(StoredIndex.open(spark, path), e)


HASHES = f"""{sql_basis(HASH_BASIS)}, h AS (SELECT e.id, bit_or(CASE WHEN list_dot_product(e.vec, b.row) > 0
  THEN CAST(1 AS UBIGINT) << CAST(b.i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS hash FROM e, b GROUP BY e.id),
hp AS (SELECT q.id AS query_id, r.id AS neighbor_id, CAST(bit_count(xor(q.hash, r.hash)) AS INTEGER) AS hamming FROM h q, h r),
cnt AS (SELECT query_id, hamming, count(*) AS n FROM hp GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY hamming) AS upto FROM cnt),
lim AS (SELECT query_id, coalesce(min(hamming) FILTER (upto >= 40), 64) AS cutoff FROM cum GROUP BY query_id)"""


@query("knn_lsh", f"WITH {E}, {HASHES}, cand AS (SELECT hp.* FROM hp JOIN lim USING (query_id) WHERE hamming <= cutoff), "
                  f"{RERANK.format(cand='cand')} " + top_sql(5, "s"))
def knn_lsh(spark, sf):
    e = embeddings(spark, sf)
    return rounded(H.knn_lsh(e, e, 5, 40, basis=HASH_BASIS, raise_limit=None))


@query("knn_lsh_partitioned", f"WITH {E}, {HASHES}, cand AS (SELECT hp.* FROM hp JOIN lim USING (query_id) WHERE hamming <= cutoff), "
                              f"{RERANK.format(cand='cand')} " + top_sql(5, "s"))
def knn_lsh_cells(spark, sf):
    e = embeddings(spark, sf)
    return rounded(H.knn_lsh(e, e, 5, 40, basis=HASH_BASIS, layout="cells", raise_limit=None))


@query("hash_bit_counts", f"WITH {E}, {HASHES} SELECT query_id, hamming, n FROM cnt")
def bit_counts(spark, sf):
    h = H.hashed(embeddings(spark, sf), HASH_BASIS)
    return H.bit_counts(h, h)


@query("distance_evaluations", f"WITH {E}, {HASHES} SELECT query_id, CAST(cutoff AS INTEGER) AS cutoff, "
                               "CAST(sum(n) AS BIGINT) AS evaluations FROM cnt JOIN lim USING (query_id) "
                               "WHERE hamming <= cutoff GROUP BY ALL")
def distance_evaluations(spark, sf):
    e = embeddings(spark, sf)
    return H.distance_evaluations(e, e, 40, basis=HASH_BASIS, raise_limit=None)


RAISED = f"""{HASHES},
hd AS (SELECT hp.*, list_distance(q.vec, r.vec) AS distance FROM hp JOIN e q ON q.id = query_id JOIN e r ON r.id = neighbor_id),
best AS (SELECT query_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rk
  FROM hd JOIN lim USING (query_id) WHERE hamming <= cutoff),
reach AS (SELECT query_id, max(distance) AS reach FROM best WHERE rk <= 40 GROUP BY query_id HAVING count(*) >= 40),
st AS (SELECT query_id, hamming, distance, least(floor(distance / (2 * reach) * 32), 32) AS step, reach
  FROM hd JOIN reach USING (query_id) JOIN lim USING (query_id) WHERE hamming > cutoff AND hamming < 32),
sc AS (SELECT query_id, hamming, step, reach, count(*) AS n FROM st GROUP BY ALL),
su AS (SELECT *, sum(n) OVER (PARTITION BY query_id, hamming ORDER BY step) AS upto,
  sum(n) OVER (PARTITION BY query_id, hamming) AS total FROM sc),
q1 AS (SELECT query_id, hamming, reach, total, min(step) FILTER (upto >= 0.25 * total) * 2 * reach / 32 AS q1 FROM su GROUP BY query_id, hamming, reach, total),
ok AS (SELECT q1.query_id, q1.hamming FROM q1 JOIN (SELECT query_id, hamming, min(distance) AS least FROM st GROUP BY ALL) m
  USING (query_id, hamming) WHERE total > 10 AND 0.9 * q1 + 0.1 * least < reach),
run AS (SELECT ok.query_id, ok.hamming, ok.hamming - lim.cutoff - row_number() OVER (PARTITION BY ok.query_id ORDER BY ok.hamming) AS gap
  FROM ok JOIN lim USING (query_id)),
up AS (SELECT lim.query_id, lim.cutoff + count(run.hamming) AS cutoff FROM lim LEFT JOIN run
  ON run.query_id = lim.query_id AND run.gap = 0 GROUP BY lim.query_id, lim.cutoff)"""


@query("hash_limit_raise", f"WITH {E}, {RAISED} SELECT query_id, CAST(cutoff AS INTEGER) AS cutoff, "
                           "CAST(sum(n) AS BIGINT) AS evaluations FROM cnt JOIN up USING (query_id) "
                           "WHERE hamming <= cutoff GROUP BY ALL")
def hash_limit_raise(spark, sf):
    e = embeddings(spark, sf)
    return H.distance_evaluations(e, e, 40, basis=HASH_BASIS)


@query("knn_lsh_raised", f"WITH {E}, {RAISED}, cand AS (SELECT hp.* FROM hp JOIN up USING (query_id) WHERE hamming <= cutoff), "
       f"{RERANK.format(cand='cand')} " + top_sql(5, "s"))
def knn_lsh_raised(spark, sf):
    """The limit raised as by default."""
    e = embeddings(spark, sf)
    return rounded(H.knn_lsh(e, e, 5, 40, basis=HASH_BASIS))


IN_A_BAND = " OR ".join(f"bit_count((xor(q.hash, r.hash) >> {16 * b}) & 65535) <= 2" for b in range(4))


@query("knn_lsh_banded", f"""WITH {E}, {HASHES[:HASHES.index('hp AS')]}
hp AS (SELECT q.id AS query_id, r.id AS neighbor_id, CAST(bit_count(xor(q.hash, r.hash)) AS INTEGER) AS hamming FROM h q JOIN h r ON {IN_A_BAND}),
cum AS (SELECT query_id, hamming, sum(count(*)) OVER (PARTITION BY query_id ORDER BY hamming) AS upto FROM hp GROUP BY query_id, hamming),
lim AS (SELECT query_id, coalesce(min(hamming) FILTER (upto >= 10), 64) AS cutoff FROM cum GROUP BY query_id),
cand AS (SELECT hp.* FROM hp JOIN lim USING (query_id) WHERE hamming <= cutoff), {RERANK.format(cand='cand')} """ + top_sql(5, "s"))
def knn_lsh_banded(spark, sf):
    """Candidates from the bands of the hashes: at most two differing bits in some band of 16."""
    e = embeddings(spark, sf)
    return rounded(H.knn_banded(e, H.build_band_index(e, HASH_BASIS), 5, 10))


@query("hash_correlation", f"WITH {E}, {HASHES} SELECT hamming, count(*) AS pairs, "
                           f"{s6('avg(list_cosine_similarity(q.vec, r.vec))')} AS mean_cosine FROM hp "
                           "JOIN e q ON q.id = query_id JOIN e r ON r.id = neighbor_id GROUP BY hamming")
def hash_correlation(spark, sf):
    e = embeddings(spark, sf)
    return R.hash_correlation(e, e, HASH_BASIS).select("hamming", "pairs", r6("mean_cosine").alias("mean_cosine"))


@query("search_overlap", f"""WITH {E}, {sql_basis(BASIS)}, {_window_sql('9')}, {RERANK.format(cand='cand')},
a AS ({TOP.format(d6='distance', k=10, src='s')}), {PAIR_DIST.format(dist='list_distance(q.vec, r.vec)')},
x AS ({TOP.format(d6='distance', k=10, src='d')})
SELECT x.query_id, count(a.neighbor_id) AS overlap, {s6('count(a.neighbor_id) / count(*)')} AS recall,
{s6('(SELECT max(distance) FROM a WHERE a.query_id = x.query_id) / max(x.distance)')} AS farthest_ratio
FROM x LEFT JOIN a USING (query_id, neighbor_id) GROUP BY x.query_id""")
def search_overlap(spark, sf):
    e = embeddings(spark, sf)
    out = R.search_overlap(P.knn_projection(e, e, 10, 10, basis=BASIS), S.knn(e, e, 10))
    return out.select("query_id", "overlap", r6("recall").alias("recall"), r6("farthest_ratio").alias("farthest_ratio"))


@query("candidate_union", f"WITH {E}, {sql_basis(BASIS)}, {_window_sql('9')}, {PAIR_DIST.format(dist='list_distance(q.vec, r.vec)')}, "
       f"x AS ({top_sql(5)}) SELECT query_id, neighbor_id FROM cand UNION SELECT query_id, neighbor_id FROM x")
def candidate_union(spark, sf):
    e = embeddings(spark, sf)
    pairs = P.projection_candidates(e, e, BASIS, 10)
    return pairs.union(S.knn(e, e, 5).select("query_id", "neighbor_id")).distinct()


@query("result_intersection", f"WITH {E}, {sql_basis(BASIS)}, {_window_sql('9')}, {PAIR_DIST.format(dist='list_distance(q.vec, r.vec)')}, "
       f"x AS ({top_sql(5)}) SELECT query_id, neighbor_id FROM cand INTERSECT SELECT query_id, neighbor_id FROM x")
def result_intersection(spark, sf):
    e = embeddings(spark, sf)
    pairs = P.projection_candidates(e, e, BASIS, 10)
    return pairs.intersect(S.knn(e, e, 5).select("query_id", "neighbor_id"))


NEAREST_OTHER = "o AS (SELECT query_id AS id, min(distance) AS distance FROM d WHERE query_id <> neighbor_id GROUP BY query_id)"


@query("nearest_other", EXACT + f", {NEAREST_OTHER} SELECT id, {s6('distance')} AS distance FROM o")
def nearest_other(spark, sf):
    return S.nearest_other(embeddings(spark, sf)).select("id", r6("distance").alias("distance"))


@query("min_pair_distance", EXACT + f", {NEAREST_OTHER} SELECT {s6('min(distance)')} AS distance FROM o")
def min_pair_distance(spark, sf):
    return S.min_pair_distance(embeddings(spark, sf), None).select(r6("distance").alias("distance"))


@query("remove_within", f"WITH {E}, {MEANS}, hit AS (SELECT c.centroid_id, arg_min(e.id, (list_distance(c.vec, e.vec), e.id)) AS id, "
       "min(list_distance(c.vec, e.vec)) AS distance FROM c, e GROUP BY c.centroid_id) "
       "SELECT id, label FROM e WHERE id NOT IN (SELECT id FROM hit WHERE distance < 0.95)")
def remove_within(spark, sf):
    e = embeddings(spark, sf)
    probes = label_means(e, "label").select(F.col("centroid_id").cast("bigint").alias("id"), "vec")
    return M.remove_within(e, probes, 0.95).select("id", "label")


@query("remove_equal", f"WITH {E} SELECT id, label FROM e WHERE label <> 3")
def remove_equal(spark, sf):
    e = embeddings(spark, sf)
    return M.remove_equal(e, e.filter("label = 3")).select("id", "label")


@query("add_all", f"WITH {E} SELECT id, label FROM e UNION ALL SELECT id + 1000000, label FROM e")
def add_all(spark, sf):
    e = embeddings(spark, sf)
    return M.add_all(e, e.withColumn("id", F.col("id") + 1000000).drop("weight")).select("id", "label")


@query("distinct_vectors", """SELECT min(p_partkey) AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y
FROM part GROUP BY p_size, p_retailprice""")
def distinct_vectors(spark, sf):
    return M.distinct_vectors(parts(spark, sf)).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query("set_size", "SELECT count(*) AS n FROM embeddings")
def set_size(spark, sf):
    return embeddings(spark, sf).agg(F.count("*").alias("n"))


@query("set_clear", f"WITH {E} SELECT id, label FROM e WHERE false")
def set_clear(spark, sf):
    return M.clear(embeddings(spark, sf)).select("id", "label")


@query("take_first", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderkey LIMIT 100")
def take_first(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return M.take_first(o, 100)


@query("skip_first", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderkey OFFSET 100")
def skip_first(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return M.skip_first(o, 100)


@query("random_order", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5('5:' || o_orderkey), o_orderkey) - 1 AS pos FROM orders")
def shuffled(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return with_rank(o, [random_order(5), "id"], "pos").select("id", "pos")


@query("search_by_method", EXACT + top_sql(2))
def search_by_method(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.search(e, e, 2, method="exact"))


@query("search_by_method_projection", ORACLE["knn_projection"])
def search_by_method_projection(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.search(e, e, 5, "projection", search_size=10, basis=BASIS))


@query("search_by_method_lsh", ORACLE["knn_lsh_raised"])
def search_by_method_lsh(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.search(e, e, 5, "lsh", search_size=40, basis=HASH_BASIS))


@query("search_by_method_banded", ORACLE["knn_lsh_banded"])
def search_by_method_banded(spark, sf):
    e = embeddings(spark, sf)
    return rounded(S.search(e, e, 5, "banded", search_size=10, basis=HASH_BASIS))


@query("search_by_method_registered", EXACT + top_sql(2))
def search_by_method_registered(spark, sf):
    """A searcher of the user's own: exact search, its result cut to the two nearest."""
    S.register_searcher("two_nearest", lambda q, r, k, **o: S.knn(q, r, k, **o).filter("rank <= 2"))
    e = embeddings(spark, sf)
    return rounded(S.search(e, e, 3, "two_nearest"))
