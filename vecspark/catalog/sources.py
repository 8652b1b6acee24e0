"""Sources and sinks: every sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.registry import (
    E, MEANS, coords, documents, embeddings, lines, long_vector, parts, query, r6, s6, scratch, sql_basis, table)
from vecspark.functions.basis import make_basis
from vecspark.functions.text import label_from_path
from vecspark.operators.stats import label_means, weighted_centroid
from vecspark.sources import io

BASIS3 = make_basis(3, 64, seed=6)


@query("read_text_tree", "SELECT 'source=' || source AS label, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY source")
def read_text_tree(spark, sf):
    path = scratch(spark)
    documents(spark, sf).select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return (io.read_text_tree(spark, path).groupBy(label_from_path("path").alias("label"))
            .agg(F.sum(F.length("text")).alias("chars")))


@query("vectors_round_trip", "WITH k AS (SELECT row_number() OVER (ORDER BY encode(p_name), CAST(p_size AS DOUBLE), p_retailprice) - 1 AS id, p_name AS key, "
       "CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) SELECT id, key, x, y, CAST(1 AS DOUBLE) AS weight FROM k")
def vectors_round_trip(spark, sf):
    path = scratch(spark)
    p = table(spark, sf, "part")
    io.write_vectors(p.select(F.col("p_name").alias("key"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("vec")), path)
    return io.read_vectors(spark, path).select("id", "key", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), "weight")


@query("centroids_round_trip", f"WITH {E}, {MEANS}, z AS (SELECT centroid_id - 1 AS centroid_id, vec FROM c) {coords('z', 'centroid_id')}")
def centroids_round_trip(spark, sf):
    path = scratch(spark)
    io.write_centroids(label_means(embeddings(spark, sf), "label"), path)
    return long_vector(io.read_centroids(spark, path), "centroid_id")


@query("dense_csv", "SELECT CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part")
def dense_csv(spark, sf):
    path = scratch(spark)
    io.write_dense_csv(parts(spark, sf), path)
    return spark.read.schema("x0 double, x1 double").csv(path, header=True)


@query("labelled_csv", "SELECT CAST(l_returnflag AS VARCHAR) AS label, CAST(l_orderkey AS VARCHAR) AS name, printf('%.5f', l_quantity) AS v0, "
       "printf('%.5f', l_discount) AS v1, printf('%.5f', l_tax) AS v2, printf('%.5f', CAST(l_linenumber AS DOUBLE)) AS v3 FROM lineitem")
def labelled_csv(spark, sf):
    path = scratch(spark)
    rows = lines(spark, sf).withColumn("name", F.col("id").cast("string"))
    io.write_labelled_csv(rows, path, "l_returnflag", "name")
    return spark.read.schema("label string, name string, v0 string, v1 string, v2 string, v3 string").csv(path)


@query("matrix_market_entries", "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, * FROM part) "
       "SELECT r AS row, 1 AS col, CAST(p_size AS DOUBLE) AS val FROM p WHERE p_size <> 0 UNION ALL SELECT r, 2, p_retailprice FROM p WHERE p_retailprice <> 0")
def matrix_market_entries(spark, sf):
    path = scratch(spark)
    io.to_matrix_market(parts(spark, sf), path)
    f = F.split("value", " ")
    return spark.read.text(f"{path}/entries").select(
        f[0].cast("bigint").alias("row"), f[1].cast("int").alias("col"), f[2].cast("double").alias("val"))


@query("matrix_market_header", "SELECT count(*) || ' 2 ' || CAST(sum((p_size <> 0)::INT + (p_retailprice <> 0)::INT) AS BIGINT) AS sizes FROM part")
def matrix_market_header(spark, sf):
    path = scratch(spark)
    io.to_matrix_market(parts(spark, sf), path)
    return spark.read.text(f"{path}/header").filter(~F.col("value").startswith("%")).select(F.col("value").alias("sizes"))


@query("label_ids_round_trip", """SELECT label, CAST(row_number() OVER (ORDER BY f, label) - 1 AS INTEGER) AS label_id
FROM (SELECT o_orderpriority AS label, min(o_orderkey) AS f FROM orders GROUP BY 1)""")
def label_ids_round_trip(spark, sf):
    path = scratch(spark)
    io.write_label_ids(table(spark, sf, "orders"), "o_orderpriority", path, "o_orderkey")
    return io.read_label_ids(spark, path)


@query("sample_text_round_trip", """WITH m AS (SELECT p_brand, min(p_partkey) AS f, avg(p_size) AS x, avg(p_retailprice) AS y FROM part GROUP BY p_brand)
SELECT 'point' AS kind, row_number() OVER (ORDER BY p_partkey) - 1 AS id, round(CAST(p_size AS DOUBLE), 6) + 0.0 AS x, round(p_retailprice, 6) + 0.0 AS y FROM part
UNION ALL SELECT 'centre', row_number() OVER (ORDER BY f, p_brand) - 1, round(x, 6) + 0.0, round(y, 6) + 0.0 FROM m""")
def sample_text_round_trip(spark, sf):
    path = scratch(spark)
    p = parts(spark, sf)
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    means = label_means(p.drop("weight").join(brands, "id"), "p_brand")
    io.write_sample_text(p, means, 2, path)
    return io.read_sample_text(spark, path).select(
        "kind", "id", r6(F.col("vec")[0]).alias("x"), r6(F.col("vec")[1]).alias("y"))


@query("export_points", f"WITH {E}, {MEANS}, {sql_basis(BASIS3)}, a AS (SELECT 'point' AS kind, id, vec FROM e "
       "UNION ALL SELECT 'centre', CAST(centroid_id AS BIGINT), vec FROM c) "
       f"SELECT kind, id, CAST(b.i AS INTEGER) AS dim, {s6('list_dot_product(vec, b.row)')} AS val FROM a, b")
def export_points(spark, sf):
    e = embeddings(spark, sf)
    return long_vector(io.export_points(e, label_means(e, "label"), 64, basis=BASIS3), "kind", "id")
