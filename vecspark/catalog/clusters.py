"""Clustering, classification and generated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.registry import (
    BASIS, E, MEANS, NEAR, coords, embeddings, lines, long_vector, parts, query, r6, s6, scratch,
    sql_basis, sql_gaussian, sql_uniform, table)
from vecspark.operators import classify as C
from vecspark.operators import generate as G
from vecspark.operators import kmeans as K
from vecspark.operators import sketch as S
from vecspark.operators.search import assign_nearest, centroid_arrays
from vecspark.operators.stats import cluster_counts, label_distribution, label_means, summarize_centroids
from vecspark.plans import pipelines as P
from vecspark.session import materialize
from vecspark.sources import io


def round_sql(src: str, to: str, trim: float | None, step: int) -> str:
    """CTEs of one clustering round from centroid table ``src`` to ``to``."""
    near = f"n{step}"
    keep = "" if trim is None else f"WHERE distance < {trim} * gap"
    gaps = "" if trim is None else (
        f"g{step} AS (SELECT a.centroid_id, min(list_distance(a.vec, b.vec)) AS gap FROM {src} a, {src} b "
        f"WHERE a.centroid_id <> b.centroid_id GROUP BY ALL),")
    join = "" if trim is None else f"JOIN g{step} USING (centroid_id)"
    return f"""{gaps} {near} AS (SELECT e.id, e.vec, arg_min(c.centroid_id, (list_distance(e.vec, c.vec), c.centroid_id)) AS centroid_id,
  min(list_distance(e.vec, c.vec)) AS distance FROM e, {src} c GROUP BY e.id, e.vec),
k{step} AS (SELECT {near}.* FROM {near} {join} {keep}),
m{step} AS (SELECT centroid_id, t.i, avg(vec[t.i]) AS x FROM k{step}, range(1, 65) t(i) GROUP BY ALL),
v{step} AS (SELECT centroid_id, list(x ORDER BY i) AS vec FROM m{step} GROUP BY centroid_id),
{to} AS (SELECT s.centroid_id, coalesce(v.vec, s.vec) AS vec, (SELECT count(*) FROM k{step} WHERE k{step}.centroid_id = s.centroid_id) AS n
  FROM {src} s LEFT JOIN v{step} v USING (centroid_id))"""


def rounds_sql(n: int, trim: float | None) -> str:
    return ", ".join(round_sql("c" if i == 0 else f"r{i}", f"r{i + 1}", trim, i + 1) for i in range(n))


#: of the label means' gaps, so that some points count and some do not
TRIM = 5.35


@query("ball_kmeans_step", f"WITH {E}, {MEANS}, {rounds_sql(1, TRIM)} {coords('r1', 'centroid_id, CAST(n AS DOUBLE) AS weight')}")
def ball_step(spark, sf):
    e = embeddings(spark, sf)
    return long_vector(K.ball_kmeans_step(e, label_means(e, "label"), TRIM), "centroid_id", "weight")


@query("ball_kmeans_step_untrimmed", f"WITH {E}, {MEANS}, {rounds_sql(1, None)} {coords('r1', 'centroid_id, CAST(n AS DOUBLE) AS weight')}")
def ball_step_untrimmed(spark, sf):
    e = embeddings(spark, sf)
    return long_vector(K.ball_kmeans_step(e, label_means(e, "label"), None), "centroid_id", "weight")


FINAL = """f AS (SELECT r3.centroid_id, r3.vec, CAST(count(x.id) AS DOUBLE) AS weight FROM r3 LEFT JOIN (
SELECT e.id, arg_min(c.centroid_id, (list_distance(e.vec, c.vec), c.centroid_id)) AS centroid_id FROM e, r3 c GROUP BY e.id) x
USING (centroid_id) GROUP BY r3.centroid_id, r3.vec)"""


@query("ball_kmeans", f"WITH {E}, {MEANS}, {rounds_sql(3, TRIM)}, {FINAL} {coords('f', 'centroid_id, weight')}")
def ball_kmeans(spark, sf):
    e = embeddings(spark, sf)
    return long_vector(K.ball_kmeans(e, 10, 3, TRIM, seeds=label_means(e, "label")), "centroid_id", "weight")


@query("ball_kmeans_untrimmed", f"WITH {E}, {MEANS}, {rounds_sql(3, None)}, {FINAL} {coords('f', 'centroid_id, weight')}")
def ball_kmeans_untrimmed(spark, sf):
    e = embeddings(spark, sf)
    return long_vector(K.ball_kmeans(e, 10, 3, None, seeds=label_means(e, "label")), "centroid_id", "weight")


@query("ball_kmeans_seeded")
def ball_kmeans_seeded(spark, sf):
    return K.ball_kmeans(lines(spark, sf).withColumn("id", F.xxhash64("id", "vec")), 8, 5, seed=3)


@query("lloyd_kmeans", f"WITH {E}, {MEANS}, {rounds_sql(3, None)} {coords('r3', 'centroid_id, CAST(n AS DOUBLE) AS weight')}")
def lloyd(spark, sf):
    e = embeddings(spark, sf)
    return long_vector(K.lloyd_kmeans(e, label_means(e, "label"), 3, 0.0)[0], "centroid_id", "weight")


@query("lloyd_assignments", f"WITH {E}, {MEANS}, {rounds_sql(2, None)} SELECT e.id, "
       "arg_min(c.centroid_id, (list_distance(e.vec, c.vec), c.centroid_id)) AS centroid_id FROM e, r2 c GROUP BY e.id")
def lloyd_assignments(spark, sf):
    e = embeddings(spark, sf)
    return K.lloyd_kmeans(e, label_means(e, "label"), 2, 0.0)[1].select("id", "centroid_id")


def _seeding_sql(k: int, seed: int) -> str:
    """Weighted draws on the part table, one CTE per round."""
    d2 = "((p.x - s.x) ** 2 + (p.y - s.y) ** 2)"
    out = f"""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_size AS DOUBLE) AS w FROM part),
s AS (SELECT sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w) AS t FROM p),
r AS (SELECT sum(p.w * {d2}) AS radius FROM p, s),
q0 AS (SELECT arg_min(p.id, -ln({sql_uniform(str(seed), '0', 'p.id')}) / (p.w * (r.radius + s.t * {d2}))) AS id FROM p, s, r)"""
    for i in range(1, k):
        seen = " UNION ALL ".join(f"SELECT id FROM q{j}" for j in range(i))
        out += f""", c{i} AS (SELECT * FROM p WHERE id IN ({seen})),
d{i} AS (SELECT p.id, p.w, min((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS near FROM p, c{i} c GROUP BY p.id, p.w),
q{i} AS (SELECT arg_min(id, -ln({sql_uniform(str(seed), str(i), 'id')}) / (w * near)) AS id FROM d{i} WHERE near > 0 AND w > 0)"""
    return out + " " + " UNION ALL ".join(
        f"SELECT {i} AS centroid_id, p.id, p.w AS weight, p.x, p.y FROM p JOIN q{i} USING (id)" for i in range(k))


@query("seed_kmeanspp", _seeding_sql(6, 11))
def seed_kmeanspp(spark, sf):
    return K.seed_kmeanspp(parts(spark, sf), 6, 11).select(
        "centroid_id", "id", "weight", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


@query("streaming_sketch")
def streaming_sketch(spark, sf):
    return S.sketch(lines(spark, sf), 100, 0.01).centroids


@query("streaming_sketch_weight_kept", "SELECT CAST(count(*) AS DOUBLE) AS weight, count(*) AS n_seen FROM lineitem")
def sketch_weight(spark, sf):
    """The sketch's weights add up to the number of points."""
    sk = S.sketch(lines(spark, sf), 100, 0.01)
    one = F.lit(0).alias("_k")
    return (sk.centroids.agg(F.sum("weight").alias("weight")).select("*", one)
            .join(sk.state.agg(F.sum("n_seen").alias("n_seen")).select("*", one), "_k").drop("_k"))


@query("sketch_state")
def sketch_state(spark, sf):
    return S.sketch(lines(spark, sf), 100, 0.01).state


@query("sketch_state_summary", f"SELECT CAST(ceil(count(*) / {S.SHARD_ROWS}.0) AS BIGINT) AS shards, CAST(count(*) AS BIGINT) AS n_seen FROM lineitem")
def sketch_state_summary(spark, sf):
    """Shards follow from the number of rows, and every row is seen once."""
    return S.sketch(lines(spark, sf), 100, 0.01).state.agg(F.count("*").alias("shards"), F.sum("n_seen").alias("n_seen"))


def _round_sql(n, seed):
    """The candidates of one round, far from the label means."""
    draw = sql_uniform(str(seed), "1", "id")
    return (f"WITH {E}, {MEANS}, near AS (SELECT e.id, min(list_distance(e.vec, c.vec)) ** 2 AS d2 FROM e, c GROUP BY e.id) "
            f"SELECT id, {s6(f'-ln({draw}) / d2')} AS t FROM near ORDER BY -ln({draw}) / d2, id LIMIT {n}")


@query("seed_candidates", _round_sql(20, 5))
def seed_candidates(spark, sf):
    """One round of parallel seeding from given centres."""
    e = embeddings(spark, sf)
    _, centers = centroid_arrays(label_means(e, "label"))
    drawn = K.draw_candidates(K.with_weight(e), centers, 20, 5, 1)
    return spark.createDataFrame(drawn.select(["id", "t"])).select("id", r6("t").alias("t"))


@query("seed_parallel")
def seed_parallel(spark, sf):
    return K.seed_parallel(embeddings(spark, sf), 20, 3).select("centroid_id", "id", "weight")


@query("sketch_trace")
def sketch_trace(spark, sf):
    return S.sketch(lines(spark, sf), 100, 0.01).trace


@query("cluster_at_scale")
def cluster_at_scale(spark, sf):
    return S.cluster_at_scale(lines(spark, sf), 8)


@query("cluster_at_scale_summary", "SELECT 8 AS clusters, count(*) AS points FROM lineitem")
def cluster_at_scale_summary(spark, sf):
    """Whatever the sketch did, k clusters hold all points."""
    s = summarize_centroids(S.cluster_at_scale(lines(spark, sf), 8))
    return s.select(F.col("clusters").cast("int").alias("clusters"), "points")


@query("cluster_merge_streaming")
def cluster_merge_streaming(spark, sf):
    return S.cluster_at_scale(lines(spark, sf), 8, merge="streaming")


@query("cluster_merge_union", "SELECT CAST(count(*) AS DOUBLE) AS weight FROM lineitem")
def cluster_merge_union(spark, sf):
    return S.cluster_at_scale(lines(spark, sf), 8, merge="union").agg(
        F.sum("weight").alias("weight"))


@query("two_stage_clustering")
def two_stage(spark, sf):
    return P.two_stage(embeddings(spark, sf), 10)


@query("create_centroids_actual", f"WITH {E}, {MEANS} {coords('c', 'centroid_id')}")
def create_actual(spark, sf):
    out = P.create_centroids(embeddings(spark, sf), 10, label="label", actual=True)
    return long_vector(out["actual"], "centroid_id")


@query("create_centroids_computed")
def create_computed(spark, sf):
    out = P.create_centroids(embeddings(spark, sf), 10, ball=True, streaming=True)
    return out["ball"].withColumn("kind", F.lit("ball")).unionByName(
        out["streaming"].withColumn("kind", F.lit("streaming")))


@query("evaluate_clustering_label_spread", f"WITH {E}, {sql_basis(BASIS)}, pr AS (SELECT e.label, b.i, list_dot_product(e.vec, b.row) AS x FROM e, b), "
       f"s AS (SELECT label, i, stddev_pop(x) AS sd FROM pr GROUP BY ALL) SELECT label, {s6('avg(sd)')} AS spread FROM s GROUP BY label")
def evaluate_spread(spark, sf):
    e = P.reduce_dense(embeddings(spark, sf), 8, BASIS)
    centers = label_means(e, "label")
    out = P.evaluate_clustering(e, "label", 10, ball=centers, streaming=centers)
    return out["label_spread"].select("label", r6("spread").alias("spread"))


@query("evaluate_clustering_labels")
def evaluate_labels(spark, sf):
    return P.evaluate_clustering(embeddings(spark, sf), "label", 10, dims=8, max_iter=5)["ball_labels"]


@query("reduce_dimension_dense", f"WITH {E}, {sql_basis(BASIS)} SELECT e.id, CAST(b.i AS INTEGER) AS dim, "
       f"{s6('list_dot_product(e.vec, b.row)')} AS val FROM e, b")
def reduce_dense(spark, sf):
    return long_vector(P.reduce_dense(embeddings(spark, sf), 8, BASIS), "id")


@query("centroid_distance_features", f"WITH {E}, {MEANS} SELECT e.id, c.centroid_id - 1 AS dim, "
       f"{s6('list_distance(e.vec, c.vec) ** 2')} AS val FROM e, c")
def centroid_distance_features(spark, sf):
    e = embeddings(spark, sf)
    f = e.select("id", C.centroid_distance_features("vec", label_means(e, "label")).alias("vec"))
    return long_vector(f, "id")


def _held_out_sql(seed):
    return f"{sql_uniform(str(seed), chr(39) + 'held out' + chr(39), 'id')} < 0.25"


def _trained(spark, sf, max_iter):
    """A model trained on three quarters of the rows, and what it says of the others."""
    e, held = embeddings(spark, sf), C.held_out(4)
    train = e.filter(~held)
    centers = label_means(train, "label")
    model, labels = C.train_on_distances(train, "label", centers, max_iter=max_iter)
    return model, lambda m: C.score(m, e.filter(held), "label", labels, centers)


@query("train_and_score")
def train_and_score(spark, sf):
    model, said = _trained(spark, sf, 20)
    return said(model)


@query("train_and_score_rows", f"WITH {E} SELECT id, true AS scored FROM e WHERE {_held_out_sql(4)}")
def train_and_score_rows(spark, sf):
    """Each row that was held out is scored once: probabilities of one in all, the greatest at the prediction."""
    model, said = _trained(spark, sf, 5)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return said(model).select("id", ((F.abs(total - 1) < 1e-9) & (F.element_at("scores", F.col("predicted") + 1) == F.col("max_score"))
                                     & (F.col("log_likelihood") <= 0)).alias("scored"))


@query("model_save_load")
def model_save_load(spark, sf):
    model, said = _trained(spark, sf, 5)
    path = scratch(spark)
    C.save_model(model, path)
    return said(C.load_model(path)).select("id", "predicted")


@query("model_save_load_same", f"WITH {E} SELECT id, true AS same FROM e WHERE {_held_out_sql(4)}")
def model_save_load_same(spark, sf):
    """A model that was saved and read again says of every row what it said before."""
    model, said = _trained(spark, sf, 5)
    path = scratch(spark)
    C.save_model(model, path)
    before = said(model).select("id", F.col("predicted").alias("p"), F.col("scores").alias("s"))
    return (said(C.load_model(path)).join(before, "id")
            .select("id", ((F.col("predicted") == F.col("p")) & (F.col("scores") == F.col("s"))).alias("same")))


@query("confusion_report", f"WITH {E}, {MEANS}, {NEAR} SELECT ids.centroid_id AS actual, near.centroid_id AS predicted, count(*) AS n "
       "FROM near JOIN ids USING (label) GROUP BY ALL")
def confusion(spark, sf):
    return C.confusion(_nearest_mean(spark, sf), "actual_id", "centroid_id")


def _nearest_mean(spark, sf):
    """Prediction by nearest label mean."""
    from vecspark.operators.search import assign_nearest
    e = embeddings(spark, sf)
    centers = label_means(e, "label")
    return assign_nearest(e, centers).join(
        centers.select("label", F.col("centroid_id").alias("actual_id")), "label")


@query("confusion_matrix", f"WITH {E}, {MEANS}, {NEAR} SELECT ids.centroid_id AS actual, "
       + ", ".join(f"count(*) FILTER (near.centroid_id = {i}) AS p_{i}" for i in range(1, 11))
       + " FROM near JOIN ids USING (label) GROUP BY ids.centroid_id")
def confusion_matrix(spark, sf):
    return C.confusion_matrix(_nearest_mean(spark, sf), list(range(1, 11)), "actual_id", "centroid_id")


@query("accuracy_report", f"WITH {E}, {MEANS}, {NEAR} SELECT count(*) AS n, count(*) FILTER (ids.centroid_id = near.centroid_id) AS correct, "
       f"{s6('avg(CAST(ids.centroid_id = near.centroid_id AS INTEGER))')} AS accuracy FROM near JOIN ids USING (label)")
def accuracy(spark, sf):
    return C.accuracy_report(_nearest_mean(spark, sf), "actual_id", "centroid_id").withColumn("accuracy", r6("accuracy"))


def _gen(expr_of):
    return ", ".join(f"{s6(expr_of(j))} AS v{j}" for j in range(3))


@query("hypercube_points", "SELECT o_orderkey AS id, o_orderkey % 8 AS corner, "
       + _gen(lambda j: f"((o_orderkey % 8) >> {2 - j}) % 2 + 0.01 * " + sql_gaussian("9", "o_orderkey", str(j)))
       + " FROM orders")
def hypercube_points(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    g = G.hypercube_at(ids, 3, 0.01, 9)
    return g.select("id", "corner", *[r6(F.col("vec")[j]).alias(f"v{j}") for j in range(3)])


@query("normal_points", "SELECT o_orderkey AS id, " + _gen(lambda j: sql_gaussian("9", "o_orderkey", str(j))) + " FROM orders")
def normal_points(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.normal_at(ids, 3, 9).select("id", *[r6(F.col("vec")[j]).alias(f"v{j}") for j in range(3)])


@query("cluster_generated_cube")
def cluster_generated(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return cluster_counts(G.hypercube_at(ids, 3), K.ball_kmeans(G.hypercube_at(ids, 3), 8, 10, seed=5))


BLOBS = [([0.0, 0.0, 0.0], 100), ([6.0, 0.0, 0.0], 1000), ([0.0, 6.0, 0.0], 1000), ([0.0, 0.0, 6.0], 1)]
_BLOB = "CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 1100 THEN 1 WHEN o_orderkey < 2100 THEN 2 ELSE 3 END"


@query("blob_points", f"SELECT o_orderkey AS id, {_BLOB} AS blob, "
       + _gen(lambda j: f"(CASE WHEN {_BLOB} = {j + 1} THEN 6.0 ELSE 0.0 END) + 0.5 * " + sql_gaussian("9", "o_orderkey", str(j)))
       + " FROM orders")
def blob_points(spark, sf):
    """A small blob at the origin and one on each axis."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.blobs_at(ids, BLOBS, 0.5, 9).select("id", "blob", *[r6(F.col("vec")[j]).alias(f"v{j}") for j in range(3)])


_CORNERS = "SELECT CAST(o_orderkey % 8 AS INTEGER) AS corner, CAST(count(*) AS DOUBLE) AS weight, true AS close FROM orders GROUP BY 1"


def by_corner(centroids, spark):
    """Weight of the centroids nearest to each corner of the cube, and whether each of them is within 0.05 of it."""
    rows = centroids.select(F.monotonically_increasing_id().alias("id"), "vec", "weight")
    near = assign_nearest(materialize(rows), G.hypercube_corners(spark, 3))
    return near.groupBy(F.col("centroid_id").alias("corner")).agg(
        F.sum("weight").alias("weight"), F.max(F.col("distance")).alias("far")).select("corner", "weight", (F.col("far") < 0.05).alias("close"))


def cube(spark, sf):
    return G.hypercube_at(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), 3)


@query("estimate_cutoff", f"WITH {E}, s AS (SELECT id, vec FROM e ORDER BY md5('0:' || id), id LIMIT {S.CUTOFF_SAMPLE}) "
       f"SELECT {s6('min(list_distance(a.vec, b.vec))')} AS cutoff FROM s a JOIN s b ON a.id < b.id AND a.vec <> b.vec")
def estimate_cutoff(spark, sf):
    return spark.createDataFrame([(S.estimate_cutoff(embeddings(spark, sf)),)], "cutoff double").select(r6("cutoff").alias("cutoff"))


@query("sketch_cube_estimated", _CORNERS)
def sketch_cube_estimated(spark, sf):
    """The cutoff is taken from the data."""
    return by_corner(S.sketch(cube(spark, sf), 300, None).centroids, spark)


@query("cluster_at_scale_cube", _CORNERS)
def cluster_at_scale_cube(spark, sf):
    """Sketch, merge and ball k-means find each corner with the weight of its points."""
    return by_corner(S.cluster_at_scale(cube(spark, sf), 8, kappa=60, cutoff=0.01, trim=None, max_iter=30), spark)


@query("sketch_cube", _CORNERS)
def sketch_cube(spark, sf):
    """Every centroid of the sketch stands for points of one corner, as the cutoff is far below its side."""
    return by_corner(S.sketch(cube(spark, sf), 300, 0.01).centroids, spark)


@query("cluster_merge_streaming_cube", _CORNERS)
def merge_streaming_cube(spark, sf):
    return by_corner(S.cluster_at_scale(cube(spark, sf), 8, kappa=300, cutoff=0.01, merge="streaming"), spark)


_D = ("m2 AS (SELECT centroid_id, t.i, avg(vec[t.i]) AS x FROM near, range(1, 65) t(i) GROUP BY ALL), "
      "d AS (SELECT centroid_id, list(x ORDER BY i) AS vec FROM m2 GROUP BY centroid_id), "
      "near2 AS (SELECT e.id, e.label, e.vec, arg_min(d.centroid_id, (list_distance(e.vec, d.vec), d.centroid_id)) AS centroid_id FROM e, d GROUP BY ALL)")
_GIVEN = f"WITH {E}, {MEANS}, {NEAR}, {_D}"


def _reports(near: str, c: str) -> dict[str, str]:
    return {
        "counts": f"SELECT {c}.centroid_id, count({near}.id) AS n FROM {c} LEFT JOIN {near} USING (centroid_id) GROUP BY ALL",
        "spread": f", s AS (SELECT centroid_id, t.i, stddev_pop(vec[t.i]) AS sd FROM {near}, range(1, 65) t(i) GROUP BY ALL) "
                  f"SELECT centroid_id, {s6('avg(sd)')} AS spread FROM s GROUP BY centroid_id",
        "labels": f", k AS (SELECT centroid_id, label, count(*) AS n FROM {near} GROUP BY ALL) "
                  "SELECT centroid_id, label, n, CAST(sum(n) OVER w AS BIGINT) AS cluster_size, count(*) OVER w AS labels, "
                  f"{s6('n / sum(n) OVER w')} AS share FROM k WINDOW w AS (PARTITION BY centroid_id)",
        "closest": f"SELECT x.centroid_id, arg_min(c.label, (list_distance(x.vec, c.vec), c.centroid_id)) AS label, "
                   f"{s6('min(list_distance(x.vec, c.vec))')} AS distance FROM {c} x, c GROUP BY x.centroid_id"}


def _report(name: str, sql: str) -> None:
    @query(f"evaluate_{name}", f"{_GIVEN}{'' if sql.startswith(',') else ' '}{sql}")
    def run(spark, sf):
        """The report on two given clusterings: the label means, and those moved by one round."""
        e = embeddings(spark, sf)
        means = label_means(e, "label")
        out = P.evaluate_clustering(e, "label", 10, ball=means, streaming=K.ball_kmeans_step(e, means, None))[name]
        return out.withColumns({c: r6(c) for c in ("spread", "share", "distance", "mean_spread") if c in out.columns})


for _kind, _near, _c in (("ball", "near", "c"), ("streaming", "near2", "d")):
    for _part, _sql in _reports(_near, _c).items():
        _report(f"{_kind}_{_part}", _sql)
_report("comparison", "SELECT c.centroid_id, count(h.a) AS n FROM c LEFT JOIN (SELECT d.centroid_id AS a, arg_min(c.centroid_id, "
        "(list_distance(d.vec, c.vec), c.centroid_id)) AS centroid_id FROM d, c GROUP BY d.centroid_id) h USING (centroid_id) GROUP BY c.centroid_id")
_report("mean_label_spread", ", sl AS (SELECT label, t.i, stddev_pop(vec[t.i]) AS sd FROM e, range(1, 65) t(i) GROUP BY ALL), "
        f"g AS (SELECT label, avg(sd) AS spread FROM sl GROUP BY label) SELECT {s6('avg(spread)')} AS mean_spread FROM g")
