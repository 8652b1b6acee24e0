"""Approximate search by ranks along random projections."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions import kernels
from vecspark.functions.basis import make_basis, project
from vecspark.functions.vectors import Metric, get_metric
from vecspark.operators.search import MERGE_LANES, knn, top_k_per_query
from vecspark.plans.blocks import columns_of, fetch, unique_ids
from vecspark.schema import NEIGHBORS, dimension
from vecspark.session import materialize

#: Shares of pending and removed rows beyond which an index is rebuilt.
PENDING_SHARE = 0.05
REMOVED_SHARE = 0.02
#: Rows of one slice of an index, about, and queries placed or scored within one slice by one task.
SLICE_ROWS = 1 << 15
SLICE_QUERIES = 1 << 16


@dataclass
class ProjectionIndex:
    """Rank index over a set of references, with the references' vectors.

    ``table`` holds ``(p, part, v, id, pos, vec)``: every row's place along every projection, stored in (p, v, id) order.
    ``slices`` describes its partitions on the driver: for each projection the least value, the first position, the
    number and the rows of each slice, in order; there is one entry per ``SLICE_ROWS`` rows of the table.
    """

    basis: np.ndarray
    table: DataFrame
    slices: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    dim: int = 0
    #: where ``laid`` rows are kept, for an index that is opened again
    laid: DataFrame | None = field(default=None, repr=False)


def _projected(rows: DataFrame, basis: np.ndarray, *more: str) -> DataFrame:
    return rows.select("id", *more, F.posexplode(project("vec", basis)).alias("p", "v"))


def lay_index(refs: DataFrame, basis: np.ndarray) -> DataFrame:
    """The rows of an index in order, as they are stored: ``(p, v, id, vec, part, row)``."""
    if not 1 <= len(basis) < 100:
        raise ValueError("use 1 to 99 projections")
    keys = ["p", "v", "id"]
    parts = max(refs.sparkSession.sparkContext.defaultParallelism, refs.count() * len(basis) // SLICE_ROWS + 1)
    return (_projected(refs, basis, "vec").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
            .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))


def index_of(laid: DataFrame, basis: np.ndarray) -> ProjectionIndex:
    """The index over stored rows of :func:`lay_index`: positions are row numbers inside a partition, shifted by the sizes of
    the partitions before it."""
    rows = (laid.groupBy("p", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"),
                                          F.min("v").alias("least"), F.first(F.size("vec")).alias("d")).collect())
    slices: dict[int, tuple] = {}
    shifts, seen = [], {}
    for r in sorted(rows, key=lambda r: (r["p"], r["part"])):
        start = seen.get(r["p"], 0)
        seen[r["p"]] = start + r["n"]
        shifts.append((r["p"], r["part"], start - r["first"]))
        slices.setdefault(r["p"], ([], [], [], []))
        for held, x in zip(slices[r["p"]], (r["least"], start, r["part"], r["n"])):
            held.append(x)
    slices = {p: tuple(np.array(x) for x in v) for p, v in slices.items()}
    shift = laid.sparkSession.createDataFrame(shifts, "p int, part int, shift bigint")
    table = (laid.join(F.broadcast(shift), ["p", "part"])
             .select("p", "part", "v", "id", (F.col("row") + F.col("shift")).alias("pos"), "vec"))
    return ProjectionIndex(basis, table, slices, max([0, *(r["d"] for r in rows)]), laid)


def build_index(refs: DataFrame, basis: np.ndarray) -> ProjectionIndex:
    """Project, order and number the references once, for any number of searches.

    Range partitions split on (p, v, id): a value shared by very many rows still
    spreads over tasks.
    """
    return index_of(materialize(lay_index(refs, basis), by="part"), basis)


def _slice_of(index: ProjectionIndex):
    """Arrow function (p, v) -> the slice that holds v's place: its first position and number, -1 before all slices."""
    slices = index.slices

    @F.arrow_udf("struct<start:bigint,part:int>")
    def locate(p: pa.Array, v: pa.Array) -> pa.Array:
        ps, vs = p.to_numpy(), v.to_numpy()
        start, part = np.zeros(len(ps), np.int64), np.full(len(ps), -1, np.int32)
        for i in np.unique(ps):
            least, starts, parts, _ = slices[int(i)]
            mine = ps == i
            at = np.searchsorted(least, vs[mine], side="left") - 1
            hit = at >= 0
            where = np.flatnonzero(mine)[hit]
            start[where], part[where] = starts[at[hit]], parts[at[hit]]
        return pa.StructArray.from_arrays([pa.array(start), pa.array(part)], names=["start", "part"])
    return locate


def _slices_within(index: ProjectionIndex):
    """Arrow function (p, low, high) -> numbers of the slices that hold positions from low to high."""
    slices = index.slices

    @F.arrow_udf("array<int>")
    def overlapped(p: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        ps, lo, hi = p.to_numpy(), low.to_numpy(), high.to_numpy()
        first, last = np.zeros(len(ps), np.int64), np.zeros(len(ps), np.int64)
        for i in np.unique(ps):
            _, starts, _, n = slices[int(i)]
            mine = ps == i
            first[mine] = np.searchsorted(starts + n, lo[mine], side="right")
            last[mine] = np.searchsorted(starts, hi[mine], side="right")
        count = np.maximum(last - first, 0)
        ends = np.cumsum(count)
        row = np.repeat(np.arange(len(ps)), count)
        at = first[row] + np.arange(len(row)) - (ends - count)[row]
        found = np.zeros(len(row), np.int32)
        for i in np.unique(ps):
            mine = ps[row] == i
            found[mine] = slices[int(i)][2][at[mine]]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found))
    return overlapped


def _answered(asked: DataFrame, index: ProjectionIndex, columns: list[str], small: bool, run, merge, schema: str,
              without: DataFrame | None = None, span: int | None = None) -> DataFrame:
    """Bring queries to the slices they ask, ``asked`` by ``(p, part)``, and answer them there.

    Few queries travel to the slices, which stay where they are stored. Many meet them in one cogroup; a slice
    asked by very many queries (copies of one query, say) is answered in several lanes. Slices nobody asks are not read,
    nor are, with ``span``, stretches of so many positions that lie in no query's window handed on.
    """
    spark = asked.sparkSession
    count = {(r["p"], r["part"]): r["count"] for r in asked.groupBy("p", "part").count().collect()}
    lanes = F.broadcast(spark.createDataFrame([(p, k, -(-n // SLICE_QUERIES)) for (p, k), n in count.items()], "p int, part int, lanes int"))
    held = index.table.select("p", "part", *columns).filter(F.col("part").isin(sorted({k for _, k in count}))).join(lanes, ["p", "part"])
    if small and span is not None:  # a query asks three or four stretches, so they are no more than the queries
        stretch = lambda x: F.floor(x / span).cast("long")
        near = asked.select("p", F.explode(F.sequence(stretch(F.col("low")), stretch(F.col("high")))).alias("stretch")).distinct()
        held = (held.withColumn("stretch", stretch(F.col("pos"))).join(F.broadcast(near), ["p", "stretch"], "left_semi").drop("stretch"))
    if without is not None:
        gone = without.select("id").distinct()
        held = held.join(F.broadcast(gone) if gone.count() * 64 < session.BROADCAST_BYTES else gone, "id", "left_anti")
    if small:
        shared = spark.sparkContext.broadcast(_by_slice(fetch(asked)))

        def scan(batches):
            out = []
            for b in batches:
                rows = columns_of(b)
                edge = np.flatnonzero(np.append(True, (np.diff(rows["p"]) != 0) | (np.diff(rows["part"]) != 0)))
                for s, e in zip(edge, np.append(edge[1:], len(rows["p"]))):
                    mine = shared.value.get((int(rows["p"][s]), int(rows["part"][s])))
                    if mine is not None and e > s:
                        out.append(run(mine, {c: x[s:e] for c, x in rows.items()}))
                out = [merge(out)] if len(out) > 16 else out
            if out:
                yield from merge(out).to_batches()
        return held.drop("lanes").mapInArrow(scan, schema)
    keys = ["p", "part", "lane"]
    ask = (asked.join(lanes, ["p", "part"]).withColumn("lane", F.pmod(F.xxhash64("query_id"), "lanes").cast("int")).drop("lanes")
           .select(*[F.col(c).alias(c) for c in (*keys, *[c for c in asked.columns if c not in keys])]))
    held = held.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).select(*keys, *columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return merge([])
        return run(columns_of(left), columns_of(right))
    return ask.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, schema=schema)


def _by_slice(rows: dict) -> dict[tuple[int, int], dict]:
    order = np.lexsort((rows["part"], rows["p"]))
    rows = {c: x[order] for c, x in rows.items()}
    n = len(order)
    edge = np.flatnonzero(np.append(True, (np.diff(rows["p"]) != 0) | (np.diff(rows["part"]) != 0))) if n else []
    return {(int(rows["p"][s]), int(rows["part"][s])): {c: x[s:e] for c, x in rows.items()} for s, e in zip(edge, np.append(edge[1:], n))}


def _small(queries: DataFrame, index: ProjectionIndex) -> bool:
    return queries.count() * len(index.basis) * 8.0 * (index.dim + 8) <= session.BROADCAST_BYTES


def _places(index: ProjectionIndex, queries: DataFrame, small: bool, *more: str) -> DataFrame:
    """``(p, query_id, qpos, *more)``, stored: how many references lie below the query on each projection."""
    names = {c: f"more_{c}" for c in more}
    placed = materialize(_projected(queries.select("id", *[F.col(c).alias(c) for c in {*more, "vec"}]), index.basis, *more)
                         .withColumn("_at", _slice_of(index)("p", "v"))
                         .select("p", F.col("id").alias("query_id"), F.col("v").alias("at"), "_at.start", "_at.part",
                                 *[F.col(c).alias(n) for c, n in names.items()]))

    def count_below(q: dict, rows: dict) -> pa.Table:
        n = np.searchsorted(np.sort(rows["v"]), q["at"], side="left")
        return pa.table({"p": pa.array(q["p"], pa.int32()), "query_id": pa.array(q["query_id"]), "n": pa.array(n, pa.int64())})

    def joined(tables: list[pa.Table]) -> pa.Table:
        none = pa.table({"p": pa.array([], pa.int32()), "query_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return pa.concat_tables([none, *tables])

    asked = placed.filter("part >= 0").select("p", "part", "query_id", "at")
    below = _answered(asked, index, ["v"], small, count_below, joined, "p int, query_id bigint, n bigint")
    below = below.groupBy("p", "query_id").agg(F.sum("n").alias("n"))
    if small:
        below = F.broadcast(below)
    return materialize(placed.join(below, ["p", "query_id"], "left")
                       .select("p", "query_id", (F.col("start") + F.coalesce("n", F.lit(0))).alias("qpos"),
                               *[F.col(n).alias(c) for c, n in names.items()]))


def query_positions(index: ProjectionIndex, queries: DataFrame) -> DataFrame:
    """``(p, query_id, qpos)``: how many references lie below the query on each projection.

    The slice that holds a query's place follows from the slices' least values;
    within it the smaller values are counted by binary search.
    """
    return _places(index, queries, _small(queries, index))


def _window(search_size: int, window: str) -> tuple[Column, Column]:
    """First and last position of a query's window."""
    if search_size < 1:
        raise ValueError("search_size must be positive")
    if window not in ("half_open", "closed"):
        raise ValueError("window must be 'half_open' or 'closed'")
    return F.col("qpos") - search_size, F.col("qpos") + search_size - (0 if window == "closed" else 1)


def _score(k: int, metric: Metric):
    """The k nearest rows of a slice that lie in each query's window. The queries are taken some at a time, by position,
    against the stretch of rows that their windows cover."""
    def run(q: dict, rows: dict) -> pa.Table:
        order = np.argsort(rows["pos"], kind="stable")
        pos, ids, vecs = rows["pos"][order], rows["id"][order], rows["vec"][order]
        order = np.argsort(q["low"], kind="stable")
        q = {c: x[order] for c, x in q.items()}
        first, last = np.searchsorted(pos, q["low"], side="left"), np.searchsorted(pos, q["high"], side="right")
        parts, s, n = [], 0, len(first)
        while s < n:
            room, e = kernels.MATRIX_CELLS, s + 1
            while e < n and (e + 1 - s) * (last[s:e + 1].max() - first[s]) <= room:
                e += 1
            a, b = first[s], last[s:e].max()
            if b > a:
                cells = np.arange(a, b)
                inside = (cells >= first[s:e, None]) & (cells < last[s:e, None])
                near = metric.pairwise(q["vec"][s:e], vecs[a:b])
                err = kernels.pair_slack(metric, q["vec"][s:e], vecs[a:b])
                far = np.where(inside, near + err, np.inf)
                bar = np.partition(far, k - 1, axis=1)[:, k - 1] if k < b - a else np.full(e - s, np.inf)
                qi, ri = np.nonzero(inside & ~(near - err > bar[:, None]))
                d = kernels.paired_in_parts(metric, q["vec"][s:e], vecs[a:b], qi, ri)
                order = np.lexsort((ids[a + ri], d, qi))
                qi, ri, d = qi[order], ri[order], d[order]
                best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
                parts.append((q["query_id"][s:e][qi[best]], ids[a + ri[best]], d[best]))
            s = e
        return _hits(parts)
    return run


def _hits(parts: list[tuple]) -> pa.Table:
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(x) for x in cols], names=["query_id", "neighbor_id", "distance"])


def _best_hits(k: int):
    """Partial answers of one task as one: each query's k nearest, a neighbour met on several projections once."""
    def merge(tables: list[pa.Table]) -> pa.Table:
        if not tables:
            return _hits([])
        t = pa.concat_tables(tables)
        q, r, d = (t.column(c).to_numpy() for c in ("query_id", "neighbor_id", "distance"))
        order = np.lexsort((r, d, q))
        q, r, d = q[order], r[order], d[order]
        new = np.append(True, (np.diff(q) != 0) | (np.diff(r) != 0) | (np.diff(d) != 0))[:len(q)]
        q, r, d = q[new], r[new], d[new]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return _hits([(q[keep], r[keep], d[keep])])
    return merge


def search_index(index: ProjectionIndex, queries: DataFrame, k: int, search_size: int, window: str = "half_open",
                 metric: str | Metric = "euclidean", *, without: DataFrame | None = None) -> DataFrame:
    """The k nearest references within each query's windows, scored where the index stores them: a task ships at most k
    rows for each query and slice. ``without`` names rows (id) that are no longer there; they keep their positions."""
    if k < 1:
        raise ValueError("k must be positive")
    low, high = _window(search_size, window)
    unique_ids(queries)
    if not index.slices:
        return queries.sparkSession.createDataFrame([], NEIGHBORS)
    small = _small(queries, index)
    placed = _places(index, queries, small, "vec").select("p", "query_id", low.alias("low"), high.alias("high"), "vec")
    asked = placed.withColumn("part", F.explode(_slices_within(index)("p", "low", "high")))
    if not small:
        asked = materialize(asked)
    hits = _answered(asked.select("p", "part", "query_id", "low", "high", "vec"), index, ["id", "pos", "vec"], small,
                     _score(k, get_metric(metric)), _best_hits(k), "query_id bigint, neighbor_id bigint, distance double", without, search_size)
    once = hits.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    return top_k_per_query(once, k, MERGE_LANES if small else 1)


def projection_candidates(queries: DataFrame, refs: DataFrame | None, basis: np.ndarray,
                          search_size: int, window: str = "half_open", *,
                          index: ProjectionIndex | None = None) -> DataFrame:
    """``(query_id, neighbor_id)`` pairs that share a rank window on some projection.

    ``half_open`` takes ``search_size`` references at or above the query's
    value and as many below it; ``closed`` takes one more above.
    """
    low, high = _window(search_size, window)
    index = index or build_index(refs, basis)
    if not index.slices:
        return queries.sparkSession.createDataFrame([], "query_id bigint, neighbor_id bigint")
    slot = lambda x: F.floor(x / search_size)
    r = index.table.select("p", F.col("id").alias("neighbor_id"), "pos", slot(F.col("pos")).alias("slot"))
    q = query_positions(index, queries).withColumn("slot", F.explode(F.sequence(slot(low), slot(high))))
    # a slot holds at most `search_size` references, so only the query side of this
    # join can be crowded; adaptive skew handling splits that side
    hits = r.join(q, ["p", "slot"]).filter((F.col("pos") >= low) & (F.col("pos") <= high))
    return hits.select("query_id", "neighbor_id").distinct()


def knn_projection(queries: DataFrame, refs: DataFrame | None, k: int, search_size: int = 20, *,
                   basis: np.ndarray | None = None, projections: int = 4, seed: int = 0,
                   window: str = "half_open", index: ProjectionIndex | None = None,
                   metric: str | Metric = "euclidean") -> DataFrame:
    """Nearest references among those close in rank along random projections.

    Pass an ``index`` from :func:`build_index` to search the same references again; ``refs`` is not read then.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if index is None:
        if basis is None:
            d = dimension(refs)
            if not d:
                return queries.sparkSession.createDataFrame([], NEIGHBORS)
            basis = make_basis(projections, d, seed)
        index = build_index(refs, basis)
    return search_index(index, queries, k, search_size, window, metric)


def needs_reindex(n_indexed: int, n_pending: int, n_removed: int) -> bool:
    return n_pending > PENDING_SHARE * n_indexed or n_removed > REMOVED_SHARE * n_indexed


def fold_delta(indexed: DataFrame, pending: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows to index after a rebuild: everything added and not removed."""
    return indexed.unionByName(pending.select(*indexed.columns)).join(
        removed.select("id"), "id", "left_anti").select(*indexed.columns)


def knn_with_delta(queries: DataFrame, indexed: DataFrame, pending: DataFrame, removed: DataFrame,
                   k: int, search_size: int = 20, *, basis: np.ndarray | None = None,
                   metric: str | Metric = "euclidean", rebuild: str = "auto",
                   index: ProjectionIndex | None = None) -> DataFrame:
    """Projection search over an index with recent changes.

    Rows not indexed yet are searched exactly and removed rows are left out.
    When the changes have outgrown their shares the index is rebuilt first.
    ``index`` is that of ``indexed``, built before; without it one is built for this call.
    :class:`vecspark.operators.stored_index.StoredIndex` keeps all of this in a folder.
    """
    basis = index.basis if index is not None else basis
    if rebuild == "auto":
        rebuild = "yes" if needs_reindex(indexed.count(), pending.count(), removed.count()) else "no"
    if rebuild == "yes":
        return knn_projection(queries, fold_delta(indexed, pending, removed), k, search_size,
                              basis=basis, window="closed", metric=metric)
    index = index or build_index(indexed, basis)
    near = search_index(index, queries, k, search_size, "closed", metric, without=removed)
    fresh = knn(queries, pending.join(removed.select("id"), "id", "left_anti"), k, metric)
    return top_k_per_query(near.unionByName(fresh), k)
