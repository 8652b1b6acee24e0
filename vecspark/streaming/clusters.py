"""Clustering in Structured Streaming: a sketch per shard held as state."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecspark.functions import kernels
from vecspark.functions.sketcher import Fed
from vecspark.functions.uniform import uniform
from vecspark.functions.vectors import get_metric
from vecspark.operators.search import centroid_arrays, nearest_column

STATE = ("vecs array<double>, weights array<double>, n_seen bigint, kappa int, cutoff double, "
         "collapses int")
#: Shards of a stream: rows of one micro-batch and shard are sorted in one task, which holds a run of them and puts others on its
#: own disk.
SHARDS = 64
#: Bytes of one sorted run, and rows of a run that are read back at once.
RUN_BYTES, READ_ROWS = 32 << 20, 1 << 13
#: What a sorted run says of each row, besides its vector.
KEYS = ["id", "u", "no", "weight"]
#: Snapshots kept: the current one, and the one before it for whoever still reads it and for a batch that is replayed.
KEPT = 2
OUTPUT = ("shard int, version bigint, no int, weight double, vec array<double>, n_seen bigint, "
          "kappa int, cutoff double")


def cluster_stream(stream: DataFrame, kappa: int, cutoff: float = 1e-5, *, shards: int = SHARDS,
                   metric: str = "euclidean", seed: int = 0, beta: float = 1.3,
                   log_factor: float = 10.0, overshoot: float = 0.5) -> DataFrame:
    """Incremental clustering of a stream of ``(id, vec[, weight])``.

    Rows are sharded by id; a shard's state is its centroids and three numbers,
    so it is bounded by kappa whatever has been seen. Every micro-batch emits
    the current centroids of the shards it touched. The random number of a row
    depends on what the row holds and a batch is taken in the order of id and that
    number, so a replayed batch leads to the same state. Write with output mode ``update``.
    """
    m = get_metric(metric)
    weight = F.col("weight") if "weight" in stream.columns else F.lit(1.0)
    keyed = stream.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id",
                          "vec", weight.alias("weight"), uniform(seed, F.xxhash64("id", "vec", weight)).alias("u"))
    opts = {"beta": beta, "log_factor": log_factor, "overshoot": overshoot, "seed": seed}

    def absorb(key, frames, state: GroupState):
        (shard,) = key
        sk = Fed(kappa, cutoff, m, key=int(shard), **opts)
        if state.exists:
            vecs, weights, sk.n_seen, sk.kappa, sk.cutoff, sk.collapses = state.get
            sk.weights = np.array(weights, dtype=float)
            sk.vecs = np.array(vecs, dtype=float).reshape(len(sk.weights), -1)
        with tempfile.TemporaryDirectory() as folder:
            for vecs, weights, u in _in_order(frames, folder):
                sk.feed(vecs, weights, u)
        sk.finish()
        state.update((sk.vecs.ravel().tolist(), sk.weights.tolist(), int(sk.n_seen), int(sk.kappa),
                      float(sk.cutoff), int(sk.collapses)))
        yield pd.DataFrame({"shard": int(shard), "version": int(sk.n_seen), "no": range(len(sk.weights)),
                            "weight": sk.weights, "vec": list(sk.vecs), "n_seen": int(sk.n_seen),
                            "kappa": int(sk.kappa), "cutoff": float(sk.cutoff)})

    return keyed.groupBy("shard").applyInPandasWithState(
        absorb, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _sorted_run(parts: list[tuple]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows ``(id, u, no, weight)`` of some parts in the order of id, u and arrival, and their vectors."""
    keys = pd.concat([k for k, _ in parts], ignore_index=True)
    vecs = np.concatenate([v for _, v in parts])
    keys = keys.sort_values(["id", "u", "no"])
    return keys.reset_index(drop=True), vecs[keys.index.to_numpy()]


def _in_order(frames, folder: str):
    """Vectors, weights and draws of all rows in the order of id and draw, in pieces. What exceeds a run is sorted run by run,
    put on disk and merged from there, a few rows of each run at a time."""
    parts, size, runs, n = [], 0, [], 0

    def put():
        keys, vecs = _sorted_run(parts)
        columns = [pa.array(keys[c], from_pandas=True) for c in KEYS] + [kernels.to_lists(vecs)]
        rows = pa.Table.from_arrays(columns, names=[*KEYS, "vec"])
        name = f"{folder}/{len(runs)}"
        with pa.OSFile(name, "wb") as f, pa.ipc.new_file(f, rows.schema) as out:
            out.write_table(rows, max_chunksize=READ_ROWS)
        runs.append(name)
        parts.clear()

    for rows in frames:
        if not len(rows):
            continue
        vecs = np.stack(rows["vec"].to_numpy()).astype(float)
        if vecs.ndim != 2 or parts and vecs.shape[1] != parts[0][1].shape[1]:
            raise ValueError("a vector is null, or vectors are of different lengths")
        parts.append((rows.assign(no=np.arange(n, n + len(rows)))[KEYS], vecs))
        n += len(rows)
        size += vecs.nbytes + 32 * len(vecs)
        if size >= RUN_BYTES:
            put()
            size = 0
    if not runs:
        if parts:
            keys, vecs = _sorted_run(parts)
            yield vecs, keys["weight"].to_numpy(float), keys["u"].to_numpy(float)
        return
    if parts:
        put()
    yield from _merged(runs)


def _merged(runs: list[str]):
    """The rows of sorted runs in order. Rows up to the first one that is the last read of a run with more to come are sure."""
    files = [pa.ipc.open_file(pa.OSFile(name, "rb")) for name in runs]
    at, ask, held = [0] * len(files), range(len(files)), None
    while True:
        parts = [] if held is None else [held]
        for r in ask:
            rows = files[r].get_batch(at[r])
            at[r] += 1
            keys = pd.DataFrame({c: rows.column(c).to_pandas() for c in KEYS})
            keys["run"] = np.full(len(keys), -1)
            if at[r] < files[r].num_record_batches:
                keys.loc[len(keys) - 1, "run"] = r
            parts.append((keys, kernels.to_matrix(rows.column("vec"))))
        keys, vecs = _sorted_run(parts)
        last = np.flatnonzero(keys["run"].to_numpy() >= 0)
        sure = last[0] + 1 if len(last) else len(keys)
        if sure:
            yield vecs[:sure], keys["weight"].to_numpy(float)[:sure], keys["u"].to_numpy(float)[:sure]
        if not len(last):
            return
        ask, held = [int(keys["run"].iloc[last[0]])], (keys.iloc[sure:], vecs[sure:])


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots: those whose writer has left its mark."""
    sc = spark.sparkContext
    marks = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = marks.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(re.search(r"batch=(\d+)/_SUCCESS$", str(f.getPath()))[1]) for f in found)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    gone = sc._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)


def write_latest(clusters: DataFrame, path: str, checkpoint: str, *, available_now: bool = False):
    """Keep the current centroids of every shard readable under ``path``.

    Each micro-batch writes a snapshot: its own shards, and the others from the snapshot before it. A snapshot counts once the
    writer's mark stands in its folder; then all but the last ``KEPT`` go. So the folder holds two versions of each shard
    however long the stream runs, and a replayed batch writes the same snapshot again.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = f"{path}/.fresh-{number}"
        batch.write.mode("overwrite").parquet(fresh)  # the state is advanced once, whatever reads it
        now = spark.read.schema(OUTPUT).parquet(fresh)
        before = [n for n in _snapshots(spark, path) if n < number]
        if before:
            old = spark.read.schema(OUTPUT).parquet(f"{path}/batch={before[-1]}")
            now = now.unionByName(old.join(now.select("shard").distinct(), "shard", "left_anti").select(now.columns))
        now.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for n in before[:len(before) + 1 - KEPT]:
            _delete(spark, f"{path}/batch={n}")
        _delete(spark, fresh)

    writer = (clusters.writeStream.outputMode("update").foreachBatch(store)
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current clusters as weighted points ``(id, vec, weight)``, ready for ball k-means: the newest snapshot, nothing else."""
    found = _snapshots(spark, path)
    rows = spark.read.schema(OUTPUT).parquet(f"{path}/batch={found[-1]}") if found else spark.createDataFrame([], OUTPUT)
    return rows.select((F.col("shard").cast("bigint") * F.lit(1 << 40) + F.col("no")).alias("id"), "vec", "weight")


def assign_stream(stream: DataFrame, centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Nearest fixed centroid of each arriving point; stateless."""
    ids, vecs = centroid_arrays(centroids)
    return (stream.withColumn("_near", nearest_column("vec", ids, vecs, metric))
            .select(*stream.columns, "_near.centroid_id", "_near.distance"))
