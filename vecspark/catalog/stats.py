"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.registry import (
    E, LINE_COLUMNS, MEANS, NEAR, coords, embeddings, lines, long_vector, parts, query, r6, s6, table)
from vecspark.operators import stats as A
from vecspark.operators.kmeans import ball_kmeans_step
from vecspark.operators.search import assign_nearest

_LINE_MEANS = ", ".join(
    f"{s6(f'sum(l_quantity * {c}) / sum(l_quantity)')} AS v{i}" for i, c in enumerate(LINE_COLUMNS))


@query("weighted_centroid", f"SELECT l_returnflag, {_LINE_MEANS}, {s6('sum(l_quantity)')} AS weight FROM lineitem GROUP BY l_returnflag")
def weighted_centroid(spark, sf):
    p = lines(spark, sf).withColumn("weight", F.col("vec")[0])
    return A.weighted_centroid(p, "l_returnflag", 4).select(
        "l_returnflag", *[r6(F.col("vec")[i]).alias(f"v{i}") for i in range(4)], r6("weight").alias("weight"))


@query("label_means", f"WITH {E}, {MEANS} {coords('c', 'centroid_id, label')}")
def label_means(spark, sf):
    return long_vector(A.label_means(embeddings(spark, sf), "label"), "centroid_id", "label")


@query("label_ids", """SELECT l_shipmode AS label, CAST(row_number() OVER (ORDER BY f, l_shipmode) - 1 AS INTEGER) AS label_id
FROM (SELECT o_orderpriority AS l_shipmode, min(o_orderkey) AS f FROM orders GROUP BY 1)""")
def label_ids(spark, sf):
    return A.label_ids(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query("total_sq_radius", f"WITH {E}, m AS (SELECT t.i, avg(vec[t.i]) AS x FROM e, range(1, 65) t(i) GROUP BY t.i) "
       f"SELECT {s6('sum((e.vec[m.i] - m.x) ** 2)')} AS sq_radius FROM e, m")
def total_sq_radius(spark, sf):
    return A.total_sq_radius(embeddings(spark, sf)).select(r6("sq_radius").alias("sq_radius"))


@query("cluster_counts", f"WITH {E}, {MEANS}, {NEAR} SELECT c.centroid_id, count(near.id) AS n FROM c LEFT JOIN near USING (centroid_id) GROUP BY ALL")
def cluster_counts(spark, sf):
    e = embeddings(spark, sf)
    return A.cluster_counts(e, A.label_means(e, "label"))


@query("corrected_weights", f"WITH {E}, {MEANS}, {NEAR} SELECT c.centroid_id, coalesce(sum(near.id % 5 + 1), 0) + 0.0 AS weight "
       "FROM c LEFT JOIN near USING (centroid_id) GROUP BY ALL")
def corrected_weights(spark, sf):
    e = embeddings(spark, sf)
    w = e.withColumn("weight", (F.col("id") % 5 + 1).cast("double"))
    return A.corrected_weights(w, A.label_means(e, "label")).select("centroid_id", "weight")


@query("cluster_spread_by_label", f"WITH {E}, s AS (SELECT label, t.i, stddev_pop(vec[t.i]) AS sd FROM e, range(1, 65) t(i) GROUP BY ALL) "
       f"SELECT label, {s6('avg(sd)')} AS spread FROM s GROUP BY label")
def spread_by_label(spark, sf):
    return A.cluster_spread(embeddings(spark, sf), "label").select("label", r6("spread").alias("spread"))


@query("cluster_spread_computed", f"WITH {E}, {MEANS}, {NEAR}, s AS (SELECT centroid_id, t.i, stddev_pop(vec[t.i]) AS sd "
       f"FROM near, range(1, 65) t(i) GROUP BY ALL) SELECT centroid_id, {s6('avg(sd)')} AS spread FROM s GROUP BY centroid_id")
def spread_computed(spark, sf):
    e = embeddings(spark, sf)
    hit = assign_nearest(e, A.label_means(e, "label"))
    return A.cluster_spread(hit, "centroid_id").select("centroid_id", r6("spread").alias("spread"))


@query("mean_spread", f"WITH {E}, s AS (SELECT label, t.i, stddev_pop(vec[t.i]) AS sd FROM e, range(1, 65) t(i) GROUP BY ALL), "
       f"g AS (SELECT label, avg(sd) AS spread FROM s GROUP BY label) SELECT {s6('avg(spread)')} AS mean_spread FROM g")
def mean_spread(spark, sf):
    return A.mean_spread(A.cluster_spread(embeddings(spark, sf), "label")).select(r6("mean_spread").alias("mean_spread"))


@query("label_distribution", f"WITH {E}, {MEANS}, {NEAR}, k AS (SELECT centroid_id, label, count(*) AS n FROM near GROUP BY ALL) "
       "SELECT centroid_id, label, n, CAST(sum(n) OVER w AS BIGINT) AS cluster_size, count(*) OVER w AS labels, "
       f"{s6('n / sum(n) OVER w')} AS share FROM k WINDOW w AS (PARTITION BY centroid_id)")
def label_distribution(spark, sf):
    e = embeddings(spark, sf)
    d = A.label_distribution(assign_nearest(e, A.label_means(e, "label")), "label")
    return d.withColumn("share", r6("share"))


@query("compare_centroids", f"WITH {E}, {MEANS}, {NEAR}, m2 AS (SELECT centroid_id, t.i, avg(vec[t.i]) AS x FROM near, range(1, 65) t(i) GROUP BY ALL), "
       "d AS (SELECT centroid_id, list(x ORDER BY i) AS vec FROM m2 GROUP BY centroid_id), "
       "h AS (SELECT d.centroid_id AS a, arg_min(c.centroid_id, (list_distance(d.vec, c.vec), c.centroid_id)) AS centroid_id FROM d, c GROUP BY d.centroid_id) "
       "SELECT c.centroid_id, count(h.a) AS n FROM c LEFT JOIN h USING (centroid_id) GROUP BY c.centroid_id")
def compare_centroids(spark, sf):
    e = embeddings(spark, sf)
    c = A.label_means(e, "label")
    return A.compare_centroids(ball_kmeans_step(e, c, None), c)


@query("closest_label", f"WITH {E}, {MEANS}, {NEAR}, m2 AS (SELECT centroid_id, t.i, avg(vec[t.i]) AS x FROM near, range(1, 65) t(i) GROUP BY ALL), "
       "d AS (SELECT centroid_id, list(x ORDER BY i) AS vec FROM m2 GROUP BY centroid_id) "
       "SELECT d.centroid_id, arg_min(c.label, (list_distance(d.vec, c.vec), c.centroid_id)) AS label, "
       f"{s6('min(list_distance(d.vec, c.vec))')} AS distance FROM d, c GROUP BY d.centroid_id")
def closest_label(spark, sf):
    e = embeddings(spark, sf)
    c = A.label_means(e, "label")
    return A.closest_label(ball_kmeans_step(e, c, None), c).withColumn("distance", r6("distance"))


@query("summarize_centroids", f"WITH w AS (SELECT l_suppkey, sum(l_extendedprice) AS weight FROM lineitem GROUP BY l_suppkey) "
       f"SELECT count(*) AS clusters, CAST(sum(CAST(floor(weight) AS BIGINT)) AS BIGINT) AS points, "
       "round(avg(weight), 4) AS mean_weight, round(stddev_samp(weight), 4) AS sd_weight FROM w")
def summarize_centroids(spark, sf):
    w = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("weight"))
    s = A.summarize_centroids(w)
    return s.select("clusters", "points", F.round("mean_weight", 4).alias("mean_weight"),
                    F.round("sd_weight", 4).alias("sd_weight"))


@query("matrix_shape", "SELECT count(*) AS n_rows, 4 AS n_cols, CAST(sum((l_quantity <> 0)::INT + (l_discount <> 0)::INT "
       "+ (l_tax <> 0)::INT + (l_linenumber <> 0)::INT) AS BIGINT) AS nnz FROM lineitem")
def matrix_shape(spark, sf):
    return A.matrix_shape(lines(spark, sf))


@query("nonzero_cells", "SELECT p_partkey AS id, 0 AS dim, CAST(p_size AS DOUBLE) AS val FROM part WHERE p_size <> 0 "
       "UNION ALL SELECT p_partkey, 1, p_retailprice FROM part WHERE p_retailprice <> 0")
def nonzero_cells(spark, sf):
    return A.nonzero(parts(spark, sf))


_Q = ", ".join(f"{s6(f'quantile_cont(value, {q})')} AS q{i}" for i, q in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))


@query("summary_quartiles", f"SELECT event_type, count(value) AS n, {s6('avg(value)')} AS mean, {s6('stddev_samp(value)')} AS sd, {_Q} "
       "FROM events GROUP BY event_type")
def summary_quartiles(spark, sf):
    s = A.summary_quartiles(table(spark, sf, "events"), "value", "event_type")
    return s.select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "sd", "q0", "q1", "q2", "q3", "q4")])


@query("summary_quartiles_global", f"SELECT count(value) AS n, {s6('avg(value)')} AS mean, {s6('stddev_samp(value)')} AS sd, {_Q} FROM events")
def summary_quartiles_global(spark, sf):
    s = A.summary_quartiles(table(spark, sf, "events"), "value")
    return s.select("n", *[r6(c).alias(c) for c in ("mean", "sd", "q0", "q1", "q2", "q3", "q4")])


@query("summary_quartiles_mergeable")
def summary_quartiles_mergeable(spark, sf):
    return A.summary_quartiles(table(spark, sf, "events"), "value", "event_type", accuracy=1000)


@query("total_weight", "SELECT sum(l_quantity) AS weight FROM lineitem")
def total_weight(spark, sf):
    return A.total_weight(lines(spark, sf).withColumn("weight", F.col("vec")[0]))
