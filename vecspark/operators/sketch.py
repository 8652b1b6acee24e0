"""One-pass clustering at scale: a sketch per shard, merged as a tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions import kernels
from vecspark.functions.sketcher import Fed, Sketcher
from vecspark.functions.uniform import random_order, uniform
from vecspark.functions.vectors import get_metric
from vecspark.operators.kmeans import ball_kmeans, with_weight
from vecspark.plans.rank import with_rank
from vecspark.schema import dimension

#: Rows of one shard, about, when rows are sharded by content, and rows for each centroid there at least.
SHARD_ROWS, ROWS_A_CENTROID = 1 << 16, 64
#: Shards that one task sorts and sketches at most, unless there were more than 65,536 tasks.
TASK_SHARDS = 16
#: Rows whose distances tell a first cutoff.
CUTOFF_SAMPLE = 1000
#: Size of one group in a merge.
SHARD_BYTES = 64 << 20

_SCHEMA = ("kind string, shard bigint, no int, weight double, vec array<double>, "
           "n_seen bigint, kappa int, cutoff double, n_centroids int")
_ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("no", pa.int32()),
                    ("weight", pa.float64()), ("vec", pa.list_(pa.float64())),
                    ("n_seen", pa.int64()), ("kappa", pa.int32()), ("cutoff", pa.float64()),
                    ("n_centroids", pa.int32())])


@dataclass
class Sketch:
    """Result of a sketch, backed by one stored table."""

    table: DataFrame

    @property
    def centroids(self) -> DataFrame:
        """``(id, vec, weight)``: weighted points that stand for the input."""
        return self.table.filter("kind = 'centroid'").select(
            (F.col("shard") * F.lit(1 << 40) + F.col("no")).alias("id"), "vec", "weight")

    @property
    def state(self) -> DataFrame:
        """Per shard: rows seen, estimated number of clusters, final cutoff, centroids."""
        return self.table.filter("kind = 'state'").select(
            "shard", "n_seen", "kappa", "cutoff", "n_centroids")

    @property
    def trace(self) -> DataFrame:
        """One row per collapse: the state right after it."""
        return self.table.filter("kind = 'trace'").select(
            "shard", "no", "n_seen", "kappa", "cutoff", "n_centroids")


def _rows(sk: Sketcher, shard: int) -> pa.Table:
    if isinstance(sk, Fed):
        sk.finish()
    m = len(sk.weights)
    out = []
    if m:
        out.append({"kind": ["centroid"] * m, "shard": [shard] * m, "no": list(range(m)),
                    "weight": pa.array(sk.weights), "vec": kernels.to_lists(sk.vecs),
                    "n_seen": [None] * m, "kappa": [None] * m, "cutoff": [None] * m,
                    "n_centroids": [None] * m})
        out.append({"kind": ["state"], "shard": [shard], "no": [None], "weight": [None], "vec": [None],
                    "n_seen": [sk.n_seen], "kappa": [sk.kappa], "cutoff": [sk.cutoff],
                    "n_centroids": [m]})
    t = len(sk.trace)
    if t:
        n, k, c, s = zip(*sk.trace)
        out.append({"kind": ["trace"] * t, "shard": [shard] * t, "no": list(range(t)),
                    "weight": [None] * t, "vec": [None] * t, "n_seen": list(n), "kappa": list(k),
                    "cutoff": [float(x) for x in c], "n_centroids": list(s)})
    tables = [pa.table(o, schema=_ARROW) for o in out]
    return pa.concat_tables(tables) if tables else _ARROW.empty_table()


def row_uniform(seed: int):
    """A draw for each row that follows from its content: ids may repeat, and rows alike in all may be swapped."""
    return uniform(seed, F.xxhash64("id", "vec", "weight"))


def estimate_cutoff(points: DataFrame, sample: int = CUTOFF_SAMPLE, *, metric: str = "euclidean", seed: int = 0) -> float:
    """A first cutoff from the data: the least distance between two different vectors of ``sample`` rows, those first in a
    random order of ids. Without two different vectors the default of :func:`sketch`."""
    m = get_metric(metric)
    rows = points.select("id", "vec").orderBy(random_order(seed), "id").limit(sample)
    vecs = np.unique(kernels.to_matrix(rows.toArrow().column("vec")), axis=0)
    if len(vecs) < 2:
        return 1e-5
    i, j = np.triu_indices(len(vecs), 1)
    near = m.pairwise(vecs, vecs)[i, j]
    best = near <= near.min() + 2 * np.max(m.slack(vecs, vecs))
    d = kernels.paired_in_parts(m, vecs, vecs, i[best], j[best])
    return float(d[d > 0].min(initial=np.inf)) if (d > 0).any() else 1e-5


def sketch(points: DataFrame, kappa: int, cutoff: float | None = 1e-5, *, beta: float = 1.3,
           log_factor: float = 10.0, overshoot: float = 0.5, metric: str = "euclidean",
           sharding: str = "content", shards: int | None = None, seed: int = 0) -> Sketch:
    """Reduce points to about ``kappa`` weighted centroids per shard in one pass.

    ``content`` shards rows by a hash of all they hold, and each shard takes them in order: the result does not depend on how
    the input is partitioned, nor on the number of cores, at the price of moving it once. The number of shards follows from
    that of the rows, unless given. ``split`` sketches every input partition where it lies, with no shuffle. Either way rows
    stream through a task batch by batch; only the centroids are held. ``cutoff=None`` takes :func:`estimate_cutoff`.
    """
    m = get_metric(metric)
    cutoff = estimate_cutoff(points, metric=metric, seed=seed) if cutoff is None else cutoff
    opts = {"beta": beta, "log_factor": log_factor, "overshoot": overshoot, "seed": seed}
    pts = with_weight(points).withColumn("u", row_uniform(seed))
    if sharding == "split":
        def run(batches):
            shard = TaskContext.get().partitionId()
            sk = Sketcher(kappa, cutoff, m, key=shard, **opts)
            for b in batches:
                if b.num_rows:
                    sk.add(kernels.to_matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy())
            yield from _rows(sk, shard).to_batches()

        return Sketch(session.materialize(pts.select("vec", "weight", "u").mapInArrow(run, _SCHEMA)))
    if sharding != "content":
        raise ValueError("sharding must be 'content' or 'split'")
    if shards is None:
        shards = shard_count(points.count(), kappa)
    keyed = pts.withColumn("shard", F.pmod(F.xxhash64("id", "vec", "weight"), F.lit(shards)))
    return Sketch(session.materialize(_streamed(keyed, shards, kappa, cutoff, m, opts)))


def shard_count(n: int, kappa: int) -> int:
    """Shards for n rows: of 65,536 rows each, or as many more as make a sketch of kappa centroids worth it."""
    return max(1, -(-n // max(SHARD_ROWS, ROWS_A_CENTROID * kappa)))


def _streamed(keyed: DataFrame, shards: int, kappa: int, cutoff: float, metric, opts: dict) -> DataFrame:
    """Sketch every shard of ``(shard, id, vec, weight, u)`` in id order. A task sorts its shards, which may spill, and feeds
    them batch by batch to one sketch after the other, however large a shard is."""
    def run(batches):
        now, sk = None, None
        for b in batches:
            shard = b.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[:len(shard)])
            for s, e in zip(edges, np.append(edges[1:], len(shard))):
                if shard[s] != now:
                    if sk is not None:
                        yield from _rows(sk, now).to_batches()
                    now, sk = int(shard[s]), Fed(kappa, cutoff, metric, key=int(shard[s]), **opts)
                part = b.slice(s, e - s)
                sk.feed(kernels.to_matrix(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy())
        if sk is not None:
            yield from _rows(sk, now).to_batches()

    # shards are numbered and dealt by number: no pass over the rows to choose bounds, and tasks get equally many
    lanes = 4 * keyed.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(shards, max(lanes, -(-shards // TASK_SHARDS)), 1 << 16))
    return (keyed.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "id", "u")
            .select("shard", "vec", "weight", "u").mapInArrow(run, _SCHEMA))


def _grouped(keyed: DataFrame, kappa: int, cutoff: float, metric, opts: dict) -> DataFrame:
    """Sketch every group of ``(shard, id, vec, weight, u)`` in id order; groups are of bounded size."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("id", "ascending"), ("u", "ascending")])
        shard = rows.column("shard")[0].as_py()
        sk = Sketcher(kappa, cutoff, metric, key=shard, **opts)
        sk.add(kernels.to_matrix(rows.column("vec")), rows.column("weight").to_numpy(),
               rows.column("u").to_numpy())
        return _rows(sk, shard)

    return (keyed.select("shard", "id", "vec", "weight", "u")
            .groupBy("shard").applyInArrow(run, schema=_SCHEMA))


def merge_sketches(sk: Sketch, kappa: int, *, limit: int, metric: str = "euclidean",
                   seed: int = 0, **opts) -> Sketch:
    """Sketch the centroids of neighbouring shards together until at most ``limit`` remain.

    Every group holds a bounded number of rows and starts from the least
    cutoff reached below it. Weights carry over, so none is lost.
    """
    m = get_metric(metric)
    level = 0
    while True:
        head = sk.state.agg(F.sum("n_centroids").alias("n"), F.count("*").alias("shards"),
                            F.max("n_centroids").alias("most"), F.min("cutoff").alias("cut")).first()
        dim = dimension(sk.table.filter("kind = 'centroid'"))
        if not head["n"] or head["n"] <= limit or head["shards"] <= 1:
            return sk
        fan = max(2, SHARD_BYTES // (8 * max(1, dim) * head["most"]))
        level += 1
        packed = (with_rank(sk.state.select("shard"), ["shard"], "at")
                  .select("shard", F.floor(F.col("at") / fan).alias("group")))
        rows = (sk.table.filter("kind = 'centroid'").join(packed, "shard")
                .select((F.col("shard") * F.lit(1 << 40) + F.col("no")).alias("id"), "vec", "weight",
                        F.col("group").alias("shard"))
                .withColumn("u", uniform(seed, F.lit(f"level{level}"), "id")))
        sk = Sketch(session.materialize(_grouped(rows, kappa, head["cut"], m,
                                                 {"seed": seed + level, **opts})))


def sketch_size(k: int, n: int) -> int:
    """Default number of sketch centroids, ceil(k ln n)."""
    return max(k, math.ceil(k * math.log(max(n, 2))))


def cluster_at_scale(points: DataFrame, k: int, *, kappa: int | None = None, cutoff: float | None = 1e-5,
                     max_iter: int = 20, trim: float | None = 0.9, merge: str = "ball",
                     sharding: str = "content", shards: int | None = None, seed: int = 0,
                     metric: str = "euclidean", n: int | None = None, seeding: str = "parallel",
                     **opts) -> DataFrame:
    """Sketch every shard, then reduce the sketches: ``(centroid_id, weight, vec)``.

    ``ball`` ends with ball k-means on the whole distributed sketch, ``streaming`` sketches all
    shards into one, ``union`` returns the centroids of all shards as they are.
    """
    if merge not in ("ball", "streaming", "union"):
        raise ValueError("merge must be 'ball', 'streaming' or 'union'")
    if kappa is None or merge == "streaming":
        counted = n is None
        n = points.count() if counted else n
        kappa = kappa or sketch_size(k, n)
        if counted and sharding == "content" and shards is None:
            shards = shard_count(n, kappa)
    sk = sketch(points, kappa, cutoff, metric=metric, sharding=sharding, shards=shards, seed=seed, **opts)
    if merge == "ball":
        return ball_kmeans(sk.centroids, k, max_iter, trim, seed=seed, seeding=seeding)
    if merge == "streaming":
        sk = merge_sketches(sk, max(kappa, sketch_size(k, n)), limit=1, metric=metric, seed=seed, **opts)
    return (with_rank(sk.centroids, ["id"], "_pos")
            .select(F.col("_pos").cast("int").alias("centroid_id"), "weight", "vec"))
