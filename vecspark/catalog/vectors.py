"""Vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.registry import (
    BASIS, E, HASH_BASIS, HASH_BASIS32, UNIFORM_BASIS, coords, embeddings, long_vector, query, r6,
    s6, sql_basis)
from vecspark.functions import basis as B
from vecspark.functions import vectors as V
from vecspark.schema import validate_vectors, validation_report

PAIRS = f"WITH {E}, p AS (SELECT a.id, a.vec AS a, b.vec AS b FROM e a JOIN e b ON b.id = a.id + 1)"


def neighbours_in_order(spark, sf):
    """Every vector with the one of the next id."""
    e = embeddings(spark, sf)
    return e.select("id", F.col("vec").alias("a")).join(
        e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b")), "id")


def _scalar(name, column, expr):
    @query(name, f"{PAIRS} SELECT id, {s6(expr)} AS val FROM p")
    def run(spark, sf):
        return neighbours_in_order(spark, sf).select("id", r6(column()).alias("val"))


def _fold(expr):
    return f"list_sum(list_transform(range(1, 65), lambda i: {expr}))"


_scalar("euclidean", lambda: V.euclidean("a", "b"), "list_distance(a, b)")
_scalar("sq_euclidean", lambda: V.sq_euclidean("a", "b"), _fold("(a[i] - b[i]) * (a[i] - b[i])"))
_scalar("dot", lambda: V.dot("a", "b"), "list_dot_product(a, b)")
_scalar("norm_l1", lambda: V.norm("a", 1), _fold("abs(a[i])"))
_scalar("norm_l2", lambda: V.norm("a", 2), f"sqrt({_fold('a[i] * a[i]')})")
_scalar("norm_squared", lambda: V.norm("a", 0), _fold("a[i] * a[i]"))
_scalar("metric_manhattan", lambda: V.get_metric("manhattan").column("a", "b"), _fold("abs(a[i] - b[i])"))
_scalar("metric_cosine", lambda: V.get_metric("cosine").column("a", "b"), "1 - list_cosine_similarity(a, b)")


def _vector(name, column, expr):
    @query(name, f"{PAIRS}, o AS (SELECT id, list_transform(range(1, 65), lambda i: {expr}) AS vec FROM p) {coords('o')}")
    def run(spark, sf):
        return long_vector(neighbours_in_order(spark, sf).select("id", column().alias("vec")), "id")


_vector("normalize", lambda: V.normalize(V.add("a", "b")),
        "(a[i] + b[i]) / sqrt(list_sum(list_transform(range(1, 65), lambda j: (a[j] + b[j]) * (a[j] + b[j]))))")
_vector("vector_add", lambda: V.add("a", "b"), "a[i] + b[i]")
_vector("vector_sub", lambda: V.sub("a", "b"), "a[i] - b[i]")
_vector("vector_scale", lambda: V.scale("a", 2.5), "a[i] * 2.5")


@query("vectors_equal", f"{PAIRS} SELECT id, a = b AS same_next, a = a AS same_self FROM p")
def vectors_equal(spark, sf):
    return neighbours_in_order(spark, sf).select(
        "id", V.vectors_equal("a", "b").alias("same_next"), V.vectors_equal("a", "a").alias("same_self"))


@query("distance_predicate", f"{PAIRS} SELECT id, list_distance(a, b) < 1.4 AS near FROM p")
def distance_predicate(spark, sf):
    return neighbours_in_order(spark, sf).select("id", (V.euclidean("a", "b") < 1.4).alias("near"))


def _projected(name, basis):
    @query(name, f"WITH {E}, {sql_basis(basis)} SELECT e.id, CAST(b.i AS INTEGER) AS dim, "
                 f"{s6('list_dot_product(e.vec, b.row)')} AS val FROM e, b")
    def run(spark, sf):
        return long_vector(embeddings(spark, sf).select("id", B.project("vec", basis).alias("vec")), "id")


_projected("project_gaussian_basis", BASIS)
_projected("project_uniform_basis", UNIFORM_BASIS)



@query("sign_hash64", f"WITH {E}, {sql_basis(HASH_BASIS)} SELECT e.id, to_hex(bit_or(CASE WHEN "
                      "list_dot_product(e.vec, b.row) > 0 THEN CAST(1 AS UBIGINT) << CAST(b.i AS UBIGINT) "
                      "ELSE CAST(0 AS UBIGINT) END)) AS hash FROM e, b GROUP BY e.id")
def sign_hash64(spark, sf):
    return embeddings(spark, sf).select("id", F.hex(B.sign_hash64("vec", HASH_BASIS)).alias("hash"))


@query("sign_hash32", f"WITH {E}, {sql_basis(HASH_BASIS32)} SELECT e.id, CAST(sum(CASE WHEN "
                      "list_dot_product(e.vec, b.row) > 0 THEN CAST(1 AS BIGINT) << CAST(b.i AS BIGINT) "
                      "ELSE 0 END) AS BIGINT) AS hash FROM e, b GROUP BY e.id")
def sign_hash32(spark, sf):
    return embeddings(spark, sf).select("id", B.sign_hash32("vec", HASH_BASIS32).alias("hash"))


@query("hamming", f"WITH {E}, {sql_basis(HASH_BASIS)}, h AS (SELECT e.id, bit_or(CASE WHEN "
                  "list_dot_product(e.vec, b.row) > 0 THEN CAST(1 AS UBIGINT) << CAST(b.i AS UBIGINT) "
                  "ELSE CAST(0 AS UBIGINT) END) AS hash FROM e, b GROUP BY e.id) "
                  "SELECT a.id, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS hamming "
                  "FROM h a JOIN h b ON b.id = a.id + 1")
def hamming(spark, sf):
    h = embeddings(spark, sf).select("id", B.sign_hash64("vec", HASH_BASIS).alias("hash"))
    nxt = h.select((F.col("id") - 1).alias("id"), F.col("hash").alias("other"))
    return h.join(nxt, "id").select("id", B.hamming("hash", "other").alias("hamming"))


def _spoilt(spark, sf):
    """Every tenth vector is null, another tenth too short, another has a coordinate that is no number."""
    tenth, cut = F.pmod("id", F.lit(10)), F.slice("vec", 1, 63)
    vec = (F.when(tenth == 3, None).when(tenth == 4, cut)
           .when(tenth == 5, F.concat(cut, F.array(F.lit(float("nan"))))).otherwise(F.col("vec")))
    return embeddings(spark, sf).withColumn("vec", vec)


SPOILT = f"""{E}, x AS (SELECT id, CASE id % 10 WHEN 3 THEN NULL WHEN 4 THEN vec[1:63]
  WHEN 5 THEN list_append(vec[1:63], 'nan'::DOUBLE) ELSE vec END AS vec FROM e)"""


@query("validate_vectors", f"WITH {SPOILT} SELECT id, len(vec) AS len FROM x WHERE len(vec) = 64 "
                           "AND NOT list_bool_or(list_transform(vec, lambda x: isnan(x) OR isinf(x)))")
def valid(spark, sf):
    return validate_vectors(_spoilt(spark, sf), 64).select("id", F.size("vec").cast("bigint").alias("len"))


@query("validation_report", f"WITH {SPOILT}, ok AS (SELECT coalesce(len(vec) = 64 AND NOT list_bool_or(list_transform("
                            "vec, lambda x: isnan(x) OR isinf(x))), false) AS ok FROM x) "
                            "SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM ok")
def report(spark, sf):
    return validation_report(_spoilt(spark, sf), 64)
