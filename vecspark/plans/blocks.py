"""Distribution of query x reference work.

A search compares every query with references, but only a task ever sees the
pairs; what leaves a task is at most a few rows per query. Three layouts:

``refs``     references are small (size checked): they travel to the queries,
             nothing is shuffled and each task's answer is final.
``queries``  queries are small (size checked): they travel to the references,
             each task answers for its own part and the parts are merged.
``cells``    both are large: references are cut into cells around pivots, a
             query visits only the cells that the triangle inequality cannot
             rule out, and every cell is split into blocks of bounded size on
             both sides, so neither a crowded cell nor a popular one can
             outgrow a task. Nothing is dropped. Where a sample of the queries
             shows that cells would move more rows than they spare, it is ``blocks``.
``blocks``   the same without a space to rule cells out: all blocks meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions import kernels
from vecspark.functions.uniform import random_order

#: Size of one side of a task's pair of blocks.
BLOCK_BYTES = 32 << 20
MAX_PIVOTS = 1024
#: Multiplications that justify spreading a small input over more tasks.
HEAVY = 2e8
#: Moving a row costs about as much as this many pairs.
PAIRS_A_ROW = 500


def columns_of(batch) -> dict:
    """Arrow batch or table -> NumPy columns (list columns become matrices)."""
    out = {}
    for name in batch.schema.names:
        col = batch.column(name)
        if pa.types.is_list(col.type):
            out[name] = kernels.to_matrix(col)
        else:
            out[name] = np.asarray(col.to_numpy(zero_copy_only=False)
                                   if isinstance(col, pa.Array) else col.to_numpy())
    return out


@dataclass
class PairJob:
    """What to compute for a block of queries against a block of references."""

    q_cols: list[str]
    r_cols: list[str]
    schema: str
    #: queries of one block, where a query's output is large
    q_most = 1 << 16

    def prepare(self, refs: dict):
        return refs

    def run(self, queries: dict, prepared) -> dict:
        """Output columns, already reduced to few rows per query."""
        raise NotImplementedError

    def merge(self, outputs: list[dict]) -> dict:
        """Combine outputs of several reference blocks for the same queries."""
        return {c: np.concatenate([o[c] for o in outputs]) for c in outputs[0]}


@dataclass
class Space:
    """A metric space in which cells may be ruled out."""

    column: str
    pairwise: object
    slack: object
    hyperplane: bool = False
    #: how many nearest references a query needs
    depth: int = 1
    #: adds ``column`` to rows; None where it would not be a metric space for them
    derive: object = None


def batch_of(out: dict, names: list[str], types: list) -> pa.RecordBatch:
    arrays = []
    for n, t in zip(names, types):
        v = out[n]
        arrays.append(v if isinstance(v, pa.Array) else
                      kernels.to_lists(v) if getattr(v, "ndim", 1) == 2 else pa.array(v))
    return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types)], names=names)


def arrow_types(spark, schema: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    st = StructType.fromDDL(schema)
    return [f.name for f in st], [to_arrow_type(f.dataType) for f in st]


def regroup(batches, rows: int):
    """Join small Arrow batches into tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def block_rows(dim: int) -> int:
    """Rows of dimension ``dim`` that make one block."""
    return max(64, min(1 << 16, BLOCK_BYTES // (8 * max(1, dim))))


def fetch(df: DataFrame) -> dict:
    """Bring a side whose size was checked to the driver as NumPy columns."""
    return columns_of(df.toArrow())


def unique_ids(queries: DataFrame, ids: np.ndarray | None = None) -> None:
    """An error if an id is not unique. Ids that are few, or on the driver already, are looked at there; others are counted."""
    if ids is None and queries.count() * 8 <= session.BROADCAST_BYTES:
        ids = fetch(queries.select("id"))["id"]
    if ids is None:
        row = queries.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id").first()
        repeated = [] if row is None else [row["id"]]
    else:
        ids = np.sort(ids)
        repeated = ids[1:][ids[1:] == ids[:-1]].tolist()
    if repeated:
        raise ValueError(f"query id {repeated[0]} is not unique")


def spread(df: DataFrame, bytes_: float, work: float) -> DataFrame:
    """More tasks for a small table with heavy work; large tables keep their splits."""
    lanes = df.sparkSession.sparkContext.defaultParallelism
    if work > HEAVY and bytes_ < (128 << 20):
        return df.repartition(int(min(lanes, max(2, work // HEAVY))))
    return df


def pair_blocks(queries: DataFrame, refs: DataFrame, job: PairJob, dim: int, *,
                layout: str = "auto", space: Space | None = None) -> tuple[DataFrame, bool]:
    """Run ``job`` over all needed pairs.

    Returns the output rows and whether each query's rows are already final
    (True only when every task saw all references).
    """
    same = queries is refs
    queries, refs = queries.select(*job.q_cols), refs.select(*job.r_cols)
    nq = nr = None
    if layout == "auto":
        nr, width = refs.count(), 8.0 * (dim + 2)
        nq = nr if same else queries.count()
        small_refs, small_queries = (n * width <= session.BROADCAST_BYTES for n in (nr, nq))
        # both small: few queries against many references work better where the references lie
        if small_refs and not (small_queries and nq * 64 < nr):
            layout = "refs"
        else:
            layout = "queries" if small_queries else "cells"
    elif layout in ("refs", "queries"):
        side = refs if layout == "refs" else queries
        if side.count() * 8.0 * (dim + 2) > session.BROADCAST_BYTES:
            raise ValueError(f"layout {layout!r} needs a side below the broadcast bound")
    if layout == "refs":
        return _refs_to_queries(queries, refs, job, dim, nq, nr), True
    if layout == "queries":
        return _queries_to_refs(queries, refs, job, dim), False
    if layout in ("cells", "blocks"):
        return _cells(queries, refs, job, dim, space if layout == "cells" else None), False
    raise ValueError(f"unknown layout {layout!r}")


def _refs_to_queries(queries, refs, job, dim, nq, nr):
    sc = queries.sparkSession.sparkContext
    shared = sc.broadcast(fetch(refs))
    names, types = arrow_types(queries.sparkSession, job.schema)

    def search(batches):
        prepared = None
        for b in batches:
            if prepared is None:
                prepared = job.prepare(shared.value)
            yield batch_of(job.run(columns_of(b), prepared), names, types)

    if nq is not None:
        queries = spread(queries, 8.0 * nq * dim, float(nq) * (nr or 1) * dim)
    return queries.mapInArrow(search, job.schema)


def _queries_to_refs(queries, refs, job, dim):
    sc = queries.sparkSession.sparkContext
    shared = sc.broadcast(fetch(queries))
    names, types = arrow_types(queries.sparkSession, job.schema)
    rows = block_rows(dim)

    def search(batches):
        held = None
        for table in regroup(batches, rows):
            out = job.run(shared.value, job.prepare(columns_of(table)))
            held = out if held is None else job.merge([held, out])
        if held is not None:
            yield batch_of(held, names, types)

    return refs.mapInArrow(search, job.schema)


def _cells(queries, refs, job, dim, space):
    spark = queries.sparkSession
    names, types = arrow_types(spark, job.schema)
    if space is not None and space.derive is not None:
        derived = space.derive(queries), space.derive(refs)
        if None in derived:
            space = None
        else:
            queries, refs = derived
    size = block_rows(dim)
    q_size = min(size, job.q_most)
    pruned = None if space is None else _prune(queries, refs, space, dim, q_size)
    if pruned is None:
        celled = refs.withColumn("cell", F.lit(0))
        visiting = queries.withColumn("cell", F.lit(0))
        n, nq = refs.count(), queries.count()
        plan = [(0, n, nq)]
        # two tasks for each core at least, where there is work for them; more blocks of references would mean more partial answers
        tasks = min(2 * spark.sparkContext.defaultParallelism, float(n) * nq * dim / HEAVY) / max(1, -(-n // size))
        if tasks > 1:
            q_size = min(q_size, int(-(-nq // tasks)))
    else:
        celled, visiting, plan = pruned
    rows = [(int(c), -(-int(r) // size), -(-int(q) // q_size)) for c, r, q in plan if r and q]
    splits = F.broadcast(spark.createDataFrame(rows, "cell int, r_parts int, q_parts int"))
    keys = ["cell", "r_part", "q_part"]
    q_side = (visiting.join(splits, "cell")
              .withColumn("q_part", F.pmod(F.xxhash64("id", F.lit(17)), "q_parts").cast("int"))
              .withColumn("r_part", F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1)))
              # fresh column identities: both sides may stem from one DataFrame
              .select(*[F.col(c).alias(c) for c in (*keys, *job.q_cols)]))
    r_side = (celled.join(splits, "cell")
              .withColumn("r_part", F.pmod(F.xxhash64("id", F.lit(23)), "r_parts").cast("int"))
              .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
              .select(*keys, *job.r_cols))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        out = job.run(columns_of(left.drop_columns(keys)),
                      job.prepare(columns_of(right.drop_columns(keys))))
        return pa.Table.from_batches([batch_of(out, names, types)])

    return (q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys))
            .applyInArrow(meet, schema=job.schema))


def _prune(queries, refs, space: Space, dim: int, q_size: int | None = None):
    """Cells around sampled pivots, and the cells each query cannot skip. With ``q_size``, the queries of a block, None if
    blocks without cells are likely to be less work."""
    spark = refs.sparkSession
    n = refs.count()
    want = int(min(MAX_PIVOTS, max(4, space.depth, 4 * n // block_rows(dim), n ** 0.5)))
    drawn = fetch(refs.select("id", space.column)
                  .orderBy(random_order(7), "id").limit(want))[space.column]
    pivots = np.unique(drawn, axis=0)
    pairwise, slack = space.pairwise, space.slack

    def as_space(col):
        return kernels.to_matrix(col) if pa.types.is_list(col.type) else col.to_numpy()

    @F.arrow_udf("struct<cell:int,away:double>")
    def place(col: pa.Array) -> pa.Array:
        x = as_space(col)
        cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
        for s, e in kernels.chunks(len(x), len(pivots)):
            d = pairwise(x[s:e], pivots)
            cell[s:e] = d.argmin(axis=1)
            away[s:e] = d[np.arange(e - s), cell[s:e]]
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], names=["cell", "away"])

    celled = session.materialize(refs.withColumn("_p", place(space.column))
                                 .select(*refs.columns, "_p.cell", "_p.away"))
    stats = {r["cell"]: r for r in celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()}
    size = np.array([stats[c]["n"] if c in stats else 0 for c in range(len(pivots))])
    lo = np.array([stats[c]["lo"] if c in stats else np.inf for c in range(len(pivots))])
    hi = np.array([stats[c]["hi"] if c in stats else -np.inf for c in range(len(pivots))])
    apart = pairwise(pivots, pivots) if space.hyperplane else None
    depth, hyper = space.depth, space.hyperplane
    used = size > 0

    def visit(x):
        """Boolean (rows, cells): can the cell hold one of the row's answers?"""
        d = pairwise(x, pivots)
        err = 4 * slack(x, pivots)
        reach = np.full(len(x), np.inf)
        if len(drawn) >= depth:
            reach = np.partition(pairwise(x, drawn), depth - 1, axis=1)[:, depth - 1]
        bound = np.maximum(d - hi, lo - d)
        if hyper:
            own = d.argmin(axis=1)
            gap = apart[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - (d[np.arange(len(x)), own] ** 2)[:, None]) / (2 * gap)
            bound = np.maximum(bound, np.where(gap > 0, plane - err, -np.inf))
        return (bound <= (reach + err)[:, None]) & used

    if q_size is not None:
        some, nq, r_size = fetch(queries.select("id", space.column).orderBy(random_order(11), "id").limit(want))[space.column], queries.count(), block_rows(dim)
        asked = nq * visit(some).mean(axis=0) if len(some) else np.zeros(len(pivots))
        moved = (asked * -(-size // r_size) + size * np.ceil(asked / q_size)).sum()
        moved_by_blocks = nq * -(-n // r_size) + n * -(-nq // q_size)
        if (asked * size).sum() + PAIRS_A_ROW * moved >= float(nq) * n + PAIRS_A_ROW * moved_by_blocks:
            return None

    @F.arrow_udf("array<int>")
    def cells_for(col: pa.Array) -> pa.Array:
        x = as_space(col)
        rows, cells = [], []
        for s, e in kernels.chunks(len(x), 2 * len(pivots)):
            qi, ci = np.nonzero(visit(x[s:e]))
            rows.append(qi + s)
            cells.append(ci)
        if not rows:
            return pa.array([], pa.list_(pa.int32()))
        qi = np.concatenate(rows)
        starts = np.searchsorted(qi, np.arange(len(x) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts),
                                        pa.array(np.concatenate(cells).astype(np.int32)))

    visits = cells_for(space.column)

    visiting = session.materialize(queries.withColumn("cells", visits))
    asked = visiting.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
    plan = [(r["cell"], size[r["cell"]], r["count"]) for r in asked]
    flat = visiting.select(*queries.columns, F.explode("cells").alias("cell"))
    return celled.drop("away"), flat, plan
