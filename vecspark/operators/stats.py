"""Aggregates over vectors, clusters and labels."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions import kernels
from vecspark.functions.basis import literal
from vecspark.functions.vectors import sq_euclidean
from vecspark.operators.search import assign_nearest
from vecspark.plans.blocks import regroup
from vecspark.plans.rank import with_rank
from vecspark.schema import dimension
from vecspark.session import materialize

#: Up to this dimension one aggregate column per coordinate beats exploding rows
#: (at 64 dimensions exploding was measured a third faster).
WIDE = 16
#: Buckets of a histogram, rows of a bucket that are put in order, and bytes that a group's wanted ranks may take.
BINS, SMALL_CELL, GROUP_BYTES = 1024, 1 << 14, 2048
#: Rows of a block whose groups are summed together.
SUM_ROWS = 1 << 15


def per_dimension(df: DataFrame, by: list[str], agg: Callable[[Column, Column], Column],
                  dim: int, vec: str = "vec") -> DataFrame:
    """``(*by, v)`` with one aggregate per coordinate, combined before the shuffle."""
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    if dim <= WIDE:
        return df.groupBy(*by).agg(F.array(*[
            agg(F.element_at(vec, i + 1), weight) for i in range(dim)]).alias("v"))
    long = df.select(*by, weight.alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    cells = long.groupBy(*by, "_i").agg(agg(F.col("_x"), F.col("_w")).alias("_a"))
    return cells.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "_a"))), lambda s: s["_a"]).alias("v"))


def weighted_centroid(df: DataFrame, by: list[str] | str = (), dim: int | None = None, *,
                      first: str | None = None) -> DataFrame:
    """Weighted mean vector and total weight per group: ``(*by, vec, weight)``.

    ``first`` names a column whose least value is added as ``_first``.
    """
    by = [by] if isinstance(by, str) else list(by)
    dim = dim or dimension(df)
    w = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    if dim <= WIDE:
        total = F.sum(w)
        mean = F.array(*[F.sum(w * F.element_at("vec", i + 1)) / total for i in range(dim)])
        least = [F.min(first).alias("_first")] if first else []
        out = df.groupBy(*by).agg(mean.alias("vec"), total.alias("weight"), *least)
        return out if by else out.filter(F.col("weight").isNotNull())
    named = {c: f"_by{n}" for n, c in enumerate(by)}
    flat = df.select(*[F.col(c).alias(n) for c, n in named.items()], *([F.col(first).alias("_first")] if first else []),
                     w.cast("double").alias("_w"), F.col("vec").alias("_v"))
    part = _partial_sums(flat, list(named.values()), bool(first)).withColumnsRenamed({n: c for c, n in named.items()})
    long = part.select(*by, *(["_first"] if first else []), "_w", F.posexplode("_v").alias("_i", "_x"))
    cells = long.groupBy(*by, "_i").agg(
        (F.sum("_x") / F.sum("_w")).alias("_a"), F.sum("_w").alias("_t"), *([F.min("_first").alias("_first")] if first else []))
    return cells.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_a"))), lambda s: s["_a"]).alias("vec"),
        F.max("_t").alias("weight"), *([F.min("_first").alias("_first")] if first else []))


def _partial_sums(flat: DataFrame, by: list[str], first: bool) -> DataFrame:
    """Weighted vector sums of the groups that a block of rows holds: a few rows instead of one for each coordinate."""
    def add_up(batches):
        for table in regroup(batches, SUM_ROWS):
            if not table.num_rows:
                continue
            code = np.zeros(table.num_rows, np.int64)
            for c in by:
                d = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
                _, code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(), return_inverse=True)
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            x, w = kernels.to_matrix(table.column("_v"))[order], table.column("_w").to_numpy()[order]
            out = {c: table.column(c).take(pa.array(order[start])) for c in by}
            if first:
                ends = np.append(start[1:], len(order))
                out["_first"] = pa.chunked_array([pa.array([pc.min(table.column("_first").take(pa.array(order[s:e]))).as_py()
                                                            for s, e in zip(start, ends)], table.column("_first").type)])
            out |= {"_w": pa.array(np.add.reduceat(w, start)), "_v": kernels.to_lists(np.add.reduceat(x * w[:, None], start, axis=0))}
            yield from pa.table(out).to_batches()

    names = [*by, *(["_first"] if first else []), "_w", "_v"]
    rows = flat.select(*names)
    return rows.mapInArrow(add_up, rows.schema)


def label_ids(df: DataFrame, label: str, id_col: str = "id", start: int = 0) -> DataFrame:
    """``(label, label_id)``, numbered by first appearance in id order."""
    firsts = df.groupBy(F.col(label).alias("label")).agg(F.min(id_col).alias("_first"))
    return (with_rank(firsts, ["_first", "label"], "_pos")
            .select("label", (F.col("_pos") + start).cast("int").alias("label_id")))


def label_means(df: DataFrame, label: str, dim: int | None = None) -> DataFrame:
    """Mean vector of each true label, ids from 1 by first appearance:
    ``(centroid_id, label, vec, weight)``."""
    df = df.withColumn("label", F.col(label))
    keep = ["label", "id", "vec"] + (["weight"] if "weight" in df.columns else [])
    means = weighted_centroid(df.select(*keep), "label", dim, first="id")
    placed = with_rank(means, ["_first", "label"], "_pos")
    return placed.select((F.col("_pos") + 1).cast("int").alias("centroid_id"), "label", "vec", "weight")


def total_sq_radius(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Sum of squared distances to the plain mean of all rows."""
    mean = weighted_centroid(df.select("vec"), dim=dim).first()
    if mean is None:
        return df.agg(F.lit(0.0).alias("sq_radius"))
    return df.agg(F.sum(sq_euclidean("vec", literal(mean["vec"]))).alias("sq_radius"))


def cluster_counts(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Points per centroid, centroids without points included."""
    hits = assign_nearest(points, centroids).groupBy("centroid_id").agg(F.count("*").alias("n"))
    return (centroids.select("centroid_id").join(hits, "centroid_id", "left")
            .select("centroid_id", F.coalesce("n", F.lit(0)).alias("n")))


def compare_centroids(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many of ``a``'s centroids fall to each of ``b``'s."""
    rows = a.select(F.col("centroid_id").cast("bigint").alias("id"), "vec")
    return cluster_counts(rows, b)


def corrected_weights(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Centroids with their weight set to the total weight of the assigned points."""
    w = F.col("weight") if "weight" in points.columns else F.lit(1.0)
    sums = (assign_nearest(points, centroids).groupBy("centroid_id").agg(F.sum(w).alias("_w")))
    return (centroids.drop("weight").join(sums, "centroid_id", "left")
            .select("centroid_id", F.coalesce("_w", F.lit(0.0)).alias("weight"), "vec"))


def cluster_spread(points: DataFrame, by: str, dim: int | None = None) -> DataFrame:
    """Per cluster, the mean over dimensions of the population standard deviation."""
    dim = dim or dimension(points)
    sd = per_dimension(points, [by], lambda x, w: F.stddev_pop(x), dim)
    return sd.select(by, (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"))
                     .alias("spread"))


def mean_spread(spread: DataFrame) -> DataFrame:
    """Unweighted mean of the clusters' spreads."""
    return spread.agg(F.avg("spread").alias("mean_spread"))


def label_distribution(assigned: DataFrame, label: str) -> DataFrame:
    """Per cluster and label: members, share of the cluster, and the cluster's size and label count."""
    cells = assigned.groupBy("centroid_id", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("centroid_id").agg(F.sum("n").alias("cluster_size"),
                                             F.count("*").alias("labels"))
    return (cells.join(sizes, "centroid_id")
            .select("centroid_id", "label", "n", "cluster_size", "labels",
                    (F.col("n") / F.col("cluster_size")).alias("share")))


def closest_label(centroids: DataFrame, means: DataFrame) -> DataFrame:
    """The label mean nearest to each centroid: ``(centroid_id, label, distance)``."""
    rows = centroids.select(F.col("centroid_id").alias("_cid"), "vec")
    hit = assign_nearest(rows, means.select("centroid_id", "vec"))
    return (hit.join(means.select("centroid_id", "label"), "centroid_id")
            .select(F.col("_cid").alias("centroid_id"), "label", "distance"))


def summarize_centroids(centroids: DataFrame) -> DataFrame:
    """Clusters, total of truncated weights, mean and sample deviation of weights."""
    return centroids.agg(F.count("*").alias("clusters"),
                         F.sum(F.col("weight").cast("bigint")).alias("points"),
                         F.avg("weight").alias("mean_weight"),
                         F.stddev_samp("weight").alias("sd_weight"))


def matrix_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and non-zero cells."""
    return df.agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).alias("n_cols"),
                  F.sum(F.size(F.filter("vec", lambda x: x != 0))).alias("nnz"))


def nonzero(df: DataFrame) -> DataFrame:
    """Long form of the non-zero cells: ``(id, dim, val)``, dims from 0."""
    return df.select("id", F.posexplode("vec").alias("dim", "val")).filter(F.col("val") != 0)


def summary_quartiles(df: DataFrame, col: str, by: list[str] | str = (), *,
                      accuracy: int | None = None) -> DataFrame:
    """Count, mean, deviation, least value, quartiles and greatest value of a column.

    Exact quartiles (interpolated) come from counting: a histogram between the least and the greatest value names the
    buckets that hold the wanted ranks, these are cut again, and once a bucket is small its rows are put in order. No
    pass sorts or gathers a group, whatever its size. Without finite values throughout, or with very many groups, they are
    read off global ranks instead. With ``accuracy`` they come from a mergeable summary, whose rank error is at
    most rows / accuracy.
    """
    by = [by] if isinstance(by, str) else list(by)
    shares = [0.0, 0.25, 0.5, 0.75, 1.0]
    rows = df.select(*by, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    base = [F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd")]
    if accuracy is not None:
        out = rows.groupBy(*by).agg(*base, F.percentile_approx("_x", shares, accuracy).alias("_q"))
        return out.select(*by, "n", "mean", "sd", *[F.col("_q")[i].alias(f"q{i}") for i in range(5)])
    moments = materialize(rows.groupBy(*by).agg(*base, F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    spot = F.transform(F.array(*map(F.lit, shares)), lambda p: p * (F.col("n") - 1))
    wanted = (moments.filter("n > 0").select(*by, F.posexplode(spot).alias("_i", "_at"))
              .select(*by, "_i", F.explode(F.array(
                  F.struct(F.floor("_at").alias("_pos"), (1 - (F.col("_at") - F.floor("_at"))).alias("_w")),
                  F.struct((F.floor("_at") + 1).alias("_pos"), (F.col("_at") - F.floor("_at")).alias("_w")),
              )).alias("_s")).select(*by, "_i", "_s._pos", "_s._w").filter("_w > 0"))
    size = moments.agg(F.count("*").alias("groups"), F.max(F.col("_hi") - F.col("_lo")).alias("span")).first()
    if size["groups"] * GROUP_BYTES > session.BROADCAST_BYTES or not np.isfinite(size["span"] or 0.0):
        ranked = with_rank(rows.withColumn("_tie", F.monotonically_increasing_id()), ["_x", "_tie"], "_pos", by)
        # matched on position, so a crowded group does not crowd a task
        found = _beside(ranked, wanted, by, lambda r: F.col("_pos") == r["_pos"], ["_i", "_w"])
    else:
        found = _selected(rows, moments, wanted, by)
    found = found.groupBy(*by).agg(
        *[F.sum(F.when(F.col("_i") == i, F.col("_x") * F.col("_w"))).alias(f"q{i}") for i in range(5)])
    return _beside(moments.drop("_lo", "_hi"), found, by, lambda r: F.lit(True), [f"q{i}" for i in range(5)], "left")


def _beside(rows: DataFrame, small: DataFrame, by: list[str], on, take: list[str], how: str = "inner") -> DataFrame:
    """Join on the groups, null being one of them, and on a condition; the columns of ``rows`` and those taken of ``small``."""
    other = small.select(*[F.col(c).alias(f"_r_{c}") for c in small.columns])
    right = {c: F.col(f"_r_{c}") for c in small.columns}
    rule = on(right)
    for c in by:
        rule = rule & F.col(c).eqNullSafe(right[c])
    return rows.join(F.broadcast(other), rule, how).select(*rows.columns, *[right[c].alias(c) for c in take])


def _selected(rows: DataFrame, moments: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, _i, _w, _x)``: the value at each wanted rank, by counting passes.

    A cell is a stretch of values (``_lo`` to ``_hi``, both among the values) with ``_below`` rows before it. A pass counts the
    buckets of the cells that hold a wanted rank and are still large; the bounds of a bucket are its own least and
    greatest value, so every pass parts at least these two.
    """
    cells, done, small = moments.filter("n > 0").select(*by, "_lo", "_hi", F.lit(0).cast("bigint").alias("_below")), [], []
    before = Window.partitionBy(*by, "_lo").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        inside = _beside(rows, cells, by, lambda r: F.col("_x").between(r["_lo"], r["_hi"]), ["_lo", "_hi", "_below"])
        width = F.col("_hi") - F.col("_lo")
        bucket = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width * BINS), F.lit(BINS - 1))).otherwise(0)
        counted = inside.groupBy(*by, "_lo", "_below", bucket.alias("_bucket")).agg(
            F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        counted = counted.select(*by, (F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_below"),
                                 "_n", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"))
        held = materialize(_beside(wanted, counted, by, lambda r: (F.col("_pos") >= r["_below"]) & (F.col("_pos") < r["_below"] + r["_n"]),
                                   ["_lo", "_hi", "_below", "_n"]))
        done.append(held.filter("_lo = _hi").select(*by, "_i", "_w", F.col("_lo").alias("_x")))
        small.append(held.filter(f"_lo < _hi AND _n <= {SMALL_CELL}"))
        left = held.filter(f"_lo < _hi AND _n > {SMALL_CELL}")
        if left.isEmpty():
            break
        wanted = left.select(*by, "_i", "_pos", "_w")
        cells = left.select(*by, "_lo", "_hi", "_below").distinct()
    out = functools.reduce(DataFrame.unionByName, done)
    rest = functools.reduce(DataFrame.unionByName, small)
    if not rest.isEmpty():  # at most SMALL_CELL rows of a cell are put in order
        inside = _beside(rows, rest.select(*by, "_lo", "_hi", "_below").distinct(), by,
                         lambda r: F.col("_x").between(r["_lo"], r["_hi"]), ["_lo", "_below"])
        order = Window.partitionBy(*by, "_lo").orderBy("_x")
        placed = inside.withColumn("_pos", F.col("_below") + F.row_number().over(order) - 1)
        out = out.unionByName(_beside(placed, rest, by, lambda r: F.col("_pos") == r["_pos"], ["_i", "_w"]).select(*by, "_i", "_w", "_x"))
    return out


def total_weight(df: DataFrame) -> DataFrame:
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    return df.agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"))


def outlier_trim(assigned: DataFrame, centroids: DataFrame, trim: float) -> DataFrame:
    """Assigned points closer to their centroid than ``trim`` x the gap to its nearest neighbour."""
    from vecspark.operators.search import nearest_other
    rows = centroids.select(F.col("centroid_id").cast("bigint").alias("id"), "vec")
    gaps = nearest_other(rows).select(F.col("id").cast("int").alias("centroid_id"),
                                      F.col("distance").alias("_gap"))
    return (assigned.join(gaps, "centroid_id", "left")
            .filter(F.col("_gap").isNull() | (F.col("distance") < trim * F.col("_gap")))
            .drop("_gap"))
