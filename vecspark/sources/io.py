"""Sources and sinks. All writers write many files in parallel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions.basis import make_basis, project
from vecspark.operators.stats import label_ids, nonzero
from vecspark.plans.rank import with_rank
from vecspark.schema import CENTROIDS, KEYED_VECTORS, dimension


def read_text_tree(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``: ``(path, text)``, empty files included.

    Spark's sources pass over empty files. They are the listed files that a scan
    of file names alone does not report; no content is read to find them.
    """
    def plain(c):
        return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")

    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    full = texts.select(plain(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    listed = spark.createDataFrame([(f,) for f in texts.inputFiles()], "path string").select(
        plain(F.col("path")).alias("path"))
    named = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(plain(F.col("_metadata.file_path")).alias("path")))
    return full.unionByName(listed.join(named, "path", "left_anti").withColumn("text", F.lit("")))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Keyed vectors with a running id in key order and weight 1."""
    rows = spark.read.schema(KEYED_VECTORS).parquet(path)
    return number_vectors(rows)


def number_vectors(keyed: DataFrame) -> DataFrame:
    """``(id, key, vec, weight)``; equal keys are ordered by their vectors."""
    return (with_rank(keyed, ["key", "vec"], "id")
            .select("id", "key", "vec", F.lit(1.0).alias("weight")))


def write_vectors(df: DataFrame, path: str, key: str = "key", mode: str = "errorifexists") -> None:
    df.select(F.col(key).cast("string").alias("key"), "vec").write.mode(mode).parquet(path)


def renumber(centroids: DataFrame) -> DataFrame:
    """Centroids with ids 0 .. k-1 in id order."""
    return (with_rank(centroids, ["centroid_id"], "_pos")
            .select(F.col("_pos").cast("int").alias("centroid_id"), "weight", "vec"))


def write_centroids(centroids: DataFrame, path: str, mode: str = "errorifexists") -> None:
    renumber(centroids).write.mode(mode).parquet(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CENTROIDS).parquet(path)


def dense_columns(df: DataFrame, dim: int | None = None) -> DataFrame:
    """One column per coordinate: x0, x1, ..."""
    dim = dim or dimension(df)
    return df.select(*[F.element_at("vec", i + 1).alias(f"x{i}") for i in range(dim)])


def write_dense_csv(df: DataFrame, path: str, dim: int | None = None, mode: str = "errorifexists") -> None:
    dense_columns(df, dim).write.mode(mode).csv(path, header=True)


def fixed5(x: Column) -> Column:
    """Five decimals, as text."""
    return F.format_string("%.5f", x)


def labelled_columns(df: DataFrame, label: str = "label", name: str = "name",
                     dim: int | None = None) -> DataFrame:
    dim = dim or dimension(df)
    return df.select(F.col(label).alias("label"), F.col(name).alias("name"),
                     *[fixed5(F.element_at("vec", i + 1)).alias(f"v{i}") for i in range(dim)])


def write_labelled_csv(df: DataFrame, path: str, label: str = "label", name: str = "name",
                       dim: int | None = None, mode: str = "errorifexists") -> None:
    labelled_columns(df, label, name, dim).write.mode(mode).csv(path, header=False)


def matrix_entries(df: DataFrame) -> DataFrame:
    """1-based coordinates of the non-zero cells: ``(row, col, val)``; rows in id order."""
    placed = with_rank(df.select("id", "vec"), ["id"], "_pos").select(F.col("_pos").alias("id"), "vec")
    return nonzero(placed).select((F.col("id") + 1).alias("row"), (F.col("dim") + 1).alias("col"), "val")


def matrix_header(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols, nnz)``."""
    from vecspark.operators.stats import matrix_shape
    return matrix_shape(df)


def to_matrix_market(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Coordinate text: ``<path>/header`` holds the format line and the sizes,
    ``<path>/entries`` the triples in row order over any number of part files."""
    head = matrix_header(df).select(F.concat(
        F.lit("%%MatrixMarket matrix coordinate real general\n"),
        F.concat_ws(" ", "n_rows", "n_cols", "nnz")).alias("value"))
    head.write.mode(mode).text(f"{path}/header")
    (matrix_entries(df).repartitionByRange("row", "col").sortWithinPartitions("row", "col")
     .select(F.concat_ws(" ", "row", "col", "val").alias("value")).write.mode(mode).text(f"{path}/entries"))


_LABEL_IDS = T.StructType([T.StructField("clusterName", T.StringType()),
                           T.StructField("clusterId", T.IntegerType())])


def write_label_ids(df: DataFrame, label: str, path: str, id_col: str = "id",
                    mode: str = "errorifexists") -> None:
    (label_ids(df, label, id_col)
     .select(F.col("label").cast("string").alias("clusterName"), F.col("label_id").alias("clusterId"))
     .write.mode(mode).csv(path, header=True))


def read_label_ids(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(_LABEL_IDS).csv(path, header=True)
            .select(F.col("clusterName").alias("label"), F.col("clusterId").alias("label_id")))


def read_sample_text(spark: SparkSession, path: str) -> DataFrame:
    """Points and centres from a text file: ``(kind, id, vec)``.

    Lines starting with ``#`` are comments, the first other line holds
    ``dims count``, then come ``count`` points and after them the centres.
    """
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
             .filter(~F.col("value").startswith("#") & (F.trim("value") != "")))
    placed = with_rank(lines, ["file", "block", "line"], "pos")
    head = placed.filter("pos = 0").first()
    if head is None:
        raise ValueError("the file holds no data")
    n = int(head["value"].split()[1])
    vec = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda x: x.cast("double"))
    return placed.filter("pos > 0").select(
        F.when(F.col("pos") <= n, "point").otherwise("centre").alias("kind"),
        F.when(F.col("pos") <= n, F.col("pos") - 1).otherwise(F.col("pos") - 1 - n).alias("id"),
        vec.alias("vec"))


def export_points(points: DataFrame, centres: DataFrame, dims: int, *, basis: np.ndarray | None = None,
                  seed: int = 0) -> DataFrame:
    """Points and centres for plotting: ``(kind, id, vec)``; above three dimensions
    both are projected to 3-D with the same basis."""
    both = (points.select(F.lit("point").alias("kind"), F.col("id").cast("bigint").alias("id"), "vec")
            .unionByName(centres.select(F.lit("centre").alias("kind"),
                                        F.col("centroid_id").cast("bigint").alias("id"), "vec")))
    if dims > 3:
        basis = basis if basis is not None else make_basis(3, dims, seed)
        both = both.withColumn("vec", project("vec", basis))
    return both


def write_sample_text(points: DataFrame, centres: DataFrame, dims: int, path: str, *,
                      comment: str = "points, then centres", mode: str = "errorifexists") -> None:
    """The text format of :func:`read_sample_text`, as ordered part files."""
    def line(vec):
        return F.array_join(F.transform(vec, lambda x: x.cast("string")), " ")

    head = points.agg(F.count("*").alias("n")).select(
        F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(f"# {comment}").alias("value")),
                          F.struct(F.lit(1).alias("at"),
                                   F.concat_ws(" ", F.lit(str(dims)), "n").alias("value")))).alias("h")
    ).select(F.col("h.at").alias("at"), F.lit(0).cast("bigint").alias("id"), F.col("h.value").alias("value"))
    rows = head.unionByName(points.select(F.lit(2).alias("at"), F.col("id").cast("bigint").alias("id"),
                                          line("vec").alias("value")))
    rows = rows.unionByName(centres.select(F.lit(3).alias("at"), F.col("centroid_id").cast("bigint").alias("id"),
                                           line("vec").alias("value")))
    (rows.repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("value")
     .write.mode(mode).text(path))
