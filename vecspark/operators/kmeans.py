"""Weighted seeding, ball k-means and plain Lloyd iterations.

Only the k centroids live on the driver. A round is one pass over the points:
each task sums the points of every centroid it meets and emits at most
k x (dimension + 3) numbers, which are added up in one small shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions import kernels
from vecspark.functions.basis import literal
from vecspark.functions.uniform import local_uniform, uniform
from vecspark.functions.vectors import get_metric, sq_euclidean
from vecspark.operators.search import assign_nearest, centroid_arrays
from vecspark.operators.stats import weighted_centroid
from vecspark.schema import CENTROIDS, dimension

#: Seeding stores each point's distance to the seeds after this many rounds.
SEED_ROUNDS_KEPT = 16
#: Candidates that a round of parallel seeding draws, in multiples of k.
OVERSAMPLE = 2.0
#: Tasks in which the candidates of all tasks meet.
MERGE_TASKS = 8


def with_weight(points: DataFrame) -> DataFrame:
    w = F.col("weight") if "weight" in points.columns else F.lit(1.0)
    return points.select("id", "vec", w.alias("weight"))


def centroid_frame(spark: SparkSession, ids, vecs, weights) -> DataFrame:
    """The k centroids as a DataFrame."""
    table = pa.table({"centroid_id": pa.array(np.asarray(ids, np.int32)),
                      "weight": pa.array(np.asarray(weights, np.float64)),
                      "vec": kernels.to_lists(np.asarray(vecs, np.float64))})
    return spark.createDataFrame(table, CENTROIDS)


def _check_size(k: int, dim: int) -> None:
    if k * (dim + 3) * 8 > session.BROADCAST_BYTES:
        raise ValueError("too many centroids to hold on the driver; cluster a sketch instead")


def seed_kmeanspp(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Pick k starting points, far ones more often: ``(centroid_id, weight, vec, id)``.

    The first draw is proportional to weight x (total squared radius + total
    weight x squared distance to the mean), each later one to weight x squared
    distance to the nearest seed so far. A draw is a race: every row gets an
    exponential arrival time with its own rate and the earliest wins, which is
    one ``min`` per round. Fewer than k distinct points give fewer seeds.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = points.sparkSession
    pts = with_weight(points)
    dim = dimension(pts)
    _check_size(k, dim)
    if len(pts.take(2)) < 2:
        raise ValueError("seeding needs at least two points")
    head = weighted_centroid(pts, dim=dim).first()
    total = head["weight"]
    center = literal(head["vec"])
    to_center = sq_euclidean("vec", center)
    radius = pts.agg(F.sum(F.col("weight") * to_center)).first()[0]

    first = pts.withColumn("near", F.lit(radius) + F.lit(total) * to_center)
    chosen, kept = [], 0
    won = _draw(first, np.zeros((0, dim)), seed, 0)
    state = pts.withColumn("near", F.lit(float("inf")))
    while won is not None:
        chosen.append(won)
        if len(chosen) == k:
            break
        fresh = np.array([c["vec"] for c in chosen[kept:]], dtype=float)
        if len(fresh) > SEED_ROUNDS_KEPT:
            state = session.materialize(state.withColumn("near", _least_sq("vec", "near", fresh[:-1])))
            kept, fresh = len(chosen) - 1, fresh[-1:]
        won = _draw(state, fresh, seed, len(chosen))
    rows = [(i, float(c["weight"]), list(c["vec"]), c["id"]) for i, c in enumerate(chosen)]
    return spark.createDataFrame(rows, "centroid_id int, weight double, vec array<double>, id bigint")


def _nearest_sq(x: np.ndarray, near: np.ndarray, centers: np.ndarray) -> np.ndarray:
    for c in centers if len(x) else ():
        near = np.minimum(near, kernels.paired_sqeuclidean(x, np.broadcast_to(c, x.shape)))
    return near


def _least_sq(vec: str, near: str, centers: np.ndarray):
    """The lesser of ``near`` and the squared distance to the nearest of ``centers``."""
    @F.arrow_udf("double")
    def least(col: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array(_nearest_sq(kernels.to_matrix(col), known.to_numpy(), centers))
    return least(vec, near)


def _draw(state: DataFrame, fresh: np.ndarray, seed: int, round_: int):
    """Winner of one race at rates weight x squared distance: every task sends its
    earliest arrival, the earliest of those wins."""
    def race(batches):
        best = None
        for b in batches:
            ids, w, near, u = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            rate = w * _nearest_sq(kernels.to_matrix(b.column(1)), near, fresh)
            at = np.flatnonzero(rate > 0)
            if not len(at):
                continue
            t = -np.log(u[at]) / rate[at]
            i = np.lexsort((ids[at], t))[0]
            if best is None or (t[i], ids[at[i]]) < best[0]:
                best = (t[i], ids[at[i]]), b.slice(at[i], 1)
        if best is not None:
            (t, _), row = best
            yield pa.RecordBatch.from_arrays(
                [pa.array([t]), row.column(0), row.column(1), row.column(2)], names=["t", "id", "vec", "weight"])

    u = uniform(seed, F.lit(round_), "id")
    return (state.select("id", "vec", "weight", "near", u.alias("u"))
            .mapInArrow(race, "t double, id bigint, vec array<double>, weight double")
            .agg(F.min(F.struct("t", "id", "vec", "weight")).alias("w")).first()["w"])


def draw_candidates(points: DataFrame, centers: np.ndarray, n: int, seed: int, round_: int) -> pa.Table:
    """``n`` points at once, far from ``centers`` more often: ``(t, id, vec, weight)``, in the order of ``t``.

    The race of one draw with n winners: a point arrives at -ln(u) / (weight x squared distance to the nearest centre),
    which is a draw without replacement. A task sends its n earliest; points on a centre never arrive.
    """
    shared = points.sparkSession.sparkContext.broadcast(centers)
    schema = pa.schema([("t", pa.float64()), ("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("weight", pa.float64())])

    def earliest(table: pa.Table) -> pa.Table:
        return table.sort_by([("t", "ascending"), ("id", "ascending")]).slice(0, n).combine_chunks()

    def race(batches):
        held, far = schema.empty_table(), shared.value
        m = get_metric("euclidean")
        for b in batches:
            if not b.num_rows:
                continue
            _, d = kernels.nearest(kernels.to_matrix(b.column(1)), far, m)
            rate = b.column(2).to_numpy() * d * d
            at = np.flatnonzero(rate > 0)
            t = -np.log(b.column(3).to_numpy()[at]) / rate[at]
            best = at[np.argsort(t, kind="stable")[:n]] if len(at) <= n else at[np.argpartition(t, n - 1)[:n]]
            t = dict(zip(at.tolist(), t.tolist()))
            some = b.take(pa.array(best))
            held = earliest(pa.concat_tables([held, pa.table([pa.array([t[i] for i in best.tolist()], pa.float64()), some.column(0),
                                                              some.column(1), some.column(2)], schema=schema)]))
        yield from held.to_batches()

    def again(batches):
        held = schema.empty_table()
        for b in batches:
            held = earliest(pa.concat_tables([held, pa.Table.from_batches([b]).cast(schema)]))
        yield from held.to_batches()

    ddl = "t double, id bigint, vec array<double>, weight double"
    drawn = points.select("id", "vec", "weight", uniform(seed, F.lit(round_), "id").alias("u")).mapInArrow(race, ddl)
    # what all tasks send meets in a few before it comes to the driver
    return earliest(drawn.repartition(MERGE_TASKS).mapInArrow(again, ddl).toArrow().cast(schema))


def seed_parallel(points: DataFrame, k: int, seed: int = 0, *, oversample: float = OVERSAMPLE, rounds: int | None = None) -> DataFrame:
    """Pick k starting points in a few passes, however large k is: ``(centroid_id, weight, vec, id)``.

    The first point is drawn as in :func:`seed_kmeanspp`. Each of ``rounds`` rounds (by default the number of decimal digits of the
    number of points) draws ``oversample * k`` candidates at once at the rates of a later draw there. The candidates
    are then weighted by the points nearest to each, and k of them are drawn from these weights, one after the other, on the
    driver; ``weight`` is that of the chosen point itself. Fewer than k distinct points give fewer seeds.
    """
    if k < 1 or oversample <= 0 or (rounds is not None and rounds < 1):
        raise ValueError("k, oversample and rounds must be positive")
    spark = points.sparkSession
    pts = with_weight(points)
    dim = dimension(pts)
    head = weighted_centroid(pts, dim=dim).first()
    rounds = rounds or max(2, len(str(pts.count())))
    each = max(1, int(np.ceil(oversample * k)))
    _check_size(1 + rounds * each, dim)
    if len(pts.take(2)) < 2:
        raise ValueError("seeding needs at least two points")
    to_center = sq_euclidean("vec", literal(head["vec"]))
    radius = pts.agg(F.sum(F.col("weight") * to_center)).first()[0]
    first = _draw(pts.withColumn("near", F.lit(radius) + F.lit(head["weight"]) * to_center), np.zeros((0, dim)), seed, 0)
    ids, own, vecs = [first["id"]], [first["weight"]], np.array([first["vec"]], dtype=float)
    for r in range(1, rounds + 1):
        more = draw_candidates(pts, vecs, each, seed, r)
        if not more.num_rows:
            break
        ids += more.column("id").to_pylist()
        own += more.column("weight").to_pylist()
        vecs = np.vstack([vecs, kernels.to_matrix(more.column("vec"))])
    _, mass, _ = ball_sums(pts, vecs)
    at = weighted_seeds(vecs, mass, k, seed)
    rows = [(i, float(own[j]), vecs[j].tolist(), ids[j]) for i, j in enumerate(at)]
    return spark.createDataFrame(rows, "centroid_id int, weight double, vec array<double>, id bigint")


def weighted_seeds(vecs: np.ndarray, weights: np.ndarray, k: int, seed: int) -> list[int]:
    """Rows drawn one after the other by the law of :func:`seed_kmeanspp`, from a table on the driver."""
    u = np.array([[local_uniform(seed, "reduce", r, i) for i in range(len(vecs))] for r in range(min(k, len(vecs)))])
    center = (vecs * weights[:, None]).sum(0) / weights.sum()
    near = kernels.paired_sqeuclidean(vecs, np.broadcast_to(center, vecs.shape))
    rate = weights * ((weights * near).sum() + weights.sum() * near)
    near, chosen = np.full(len(vecs), np.inf), []
    for row in u:
        with np.errstate(divide="ignore"):
            t = np.where(rate > 0, -np.log(row) / rate, np.inf)
        j = int(t.argmin())
        if not np.isfinite(t[j]):
            break
        chosen.append(j)
        near = np.minimum(near, kernels.paired_sqeuclidean(vecs, np.broadcast_to(vecs[j], vecs.shape)))
        rate = weights * near
    return chosen


SEEDINGS = {"serial": seed_kmeanspp, "parallel": seed_parallel}


def _gaps(vecs: np.ndarray) -> np.ndarray:
    """Distance of each centroid to its nearest neighbour; infinite for a single one."""
    k = len(vecs)
    gaps = np.full(k, np.inf)
    for i in range(k):
        d = kernels.paired_euclidean(np.broadcast_to(vecs[i], vecs.shape), vecs)
        d[i] = np.inf
        gaps[i] = d.min()
    return gaps


def ball_sums(points: DataFrame, vecs: np.ndarray, *, before: np.ndarray | None = None,
              trim: float | None = None, metric: str = "euclidean"):
    """One pass: weighted sums and weights per centroid, and how many points
    chose another centroid than under ``before``.

    No centroid is nearer than the next one now less the furthest that any has moved, so a point whose lead
    exceeds what both could have moved chose the same one before; only the others are compared with ``before``.
    """
    k, dim = vecs.shape
    m = get_metric(metric)
    step = None if before is None or not m.triangle else m.paired(vecs, before)
    slack = 0.0 if step is None else 1e-9 * (1.0 + float(np.abs(vecs).max(initial=0.0)))
    reach = np.full(k, np.inf) if trim is None else _gaps(vecs) * trim
    shared = points.sparkSession.sparkContext.broadcast((vecs, before, reach))

    def add_up(batches):
        now, old, far = shared.value
        sums, weights, moved = np.zeros((k, dim)), np.zeros(k), 0
        for b in batches:
            if not b.num_rows:
                continue
            x, w = kernels.to_matrix(b.column(0)), b.column(1).to_numpy()
            if old is None:
                at, d = kernels.nearest(x, now, m)
                moved += len(at)
            else:
                at, d, other = kernels.nearest_and_next(x, now, m)
                close = np.ones(len(at), bool) if step is None else ~(d + step[at] + slack < other - step.max())
                if close.any():
                    moved += int((kernels.nearest(x[close], old, m)[0] != at[close]).sum())
            keep = d < far[at]
            at, x, w = at[keep], x[keep], w[keep]
            np.add.at(weights, at, w)
            order = np.argsort(at, kind="stable")
            at, wx = at[order], (x * w[:, None])[order]
            if len(at):
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                sums[at[first]] += np.add.reduceat(wx, first, axis=0)
        hit = np.flatnonzero(weights)
        cid = np.concatenate([np.repeat(hit, dim + 1), [-1]])
        pos = np.concatenate([np.tile(np.arange(dim + 1), len(hit)), [0]])
        val = np.concatenate([np.column_stack([sums[hit], weights[hit]]).ravel(), [float(moved)]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(val)],
            names=["cid", "pos", "val"])

    cells = (points.select("vec", "weight").mapInArrow(add_up, "cid int, pos int, val double")
             .groupBy("cid", "pos").agg(F.sum("val").alias("val")).toArrow())
    shared.unpersist()
    cid, pos, val = (cells.column(c).to_numpy() for c in ("cid", "pos", "val"))
    table = np.zeros((k, dim + 1))
    body = cid >= 0
    table[cid[body], pos[body]] = val[body]
    return table[:, :dim], table[:, dim], int(val[~body].sum())


def ball_kmeans_step(points: DataFrame, centroids: DataFrame, trim: float | None = 0.9) -> DataFrame:
    """One round: assign, drop outliers, average. A centroid that keeps no
    point stays where it is with weight 0."""
    ids, vecs = centroid_arrays(centroids)
    sums, weights, _ = ball_sums(with_weight(points), vecs, trim=trim)
    return centroid_frame(points.sparkSession, ids, _moved(vecs, sums, weights), weights)


def _moved(vecs, sums, weights):
    live = weights > 0
    out = vecs.copy()
    out[live] = sums[live] / weights[live, None]
    return out


def ball_kmeans(points: DataFrame, k: int, max_iter: int = 20, trim: float | None = 0.9,
                correct_weights: bool = True, *, seeds: DataFrame | None = None, seed: int = 0,
                seeding: str = "serial") -> DataFrame:
    """Trimmed k-means until no point changes its centroid: ``(centroid_id, weight, vec)``.

    Without ``seeds`` it starts from :func:`seed_kmeanspp` (``seeding="serial"``, k passes) or :func:`seed_parallel`.

    A point counts only while it is closer to its centroid than ``trim`` x the
    distance from there to the next centroid. ``correct_weights`` finally sets
    each weight to that of all points assigned, outliers included.
    """
    if k < 1 or max_iter < 1:
        raise ValueError("k and max_iter must be positive")
    if seeding not in SEEDINGS:
        raise ValueError(f"seeding must be one of {sorted(SEEDINGS)}")
    spark = points.sparkSession
    pts = session.materialize(with_weight(points))  # read in every round, computed once
    ids, vecs = centroid_arrays(seeds if seeds is not None else SEEDINGS[seeding](pts, k, seed))
    _check_size(*vecs.shape)
    before, weights = None, np.zeros(len(vecs))
    for _ in range(max_iter):
        sums, weights, moved = ball_sums(pts, vecs, before=before, trim=trim)
        if not moved:
            # the last pass repeats the round before it; its means stay valid
            vecs = _moved(vecs, sums, weights)
            break
        before, vecs = vecs, _moved(vecs, sums, weights)
    if correct_weights:
        _, weights, _ = ball_sums(pts, vecs)
    return centroid_frame(spark, ids, vecs, weights)


def lloyd_kmeans(points: DataFrame, initial: DataFrame, max_iter: int = 10,
                 tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Plain k-means from given centres until none moves further than ``tol``.

    Returns the centroids and each point with its final centroid.
    """
    pts = session.materialize(with_weight(points))
    ids, vecs = centroid_arrays(initial)
    _check_size(*vecs.shape)
    weights = np.zeros(len(vecs))
    for _ in range(max_iter):
        sums, weights, _ = ball_sums(pts, vecs)
        old, vecs = vecs, _moved(vecs, sums, weights)
        if kernels.paired_euclidean(old, vecs).max() <= tol:
            break
    return (centroid_frame(points.sparkSession, ids, vecs, weights),
            assign_nearest(points, (ids, vecs)))
