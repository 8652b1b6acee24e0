"""Approximate search by sign hashes: cheap bit distances choose which rows
get an exact distance."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.functions.basis import hash_basis, sign_hash64
from vecspark.functions.vectors import Metric, get_metric
from vecspark.operators.search import MERGE_LANES, top_k_per_query
from vecspark.plans.blocks import PairJob, arrow_types, batch_of, block_rows, columns_of, pair_blocks, unique_ids
from vecspark.schema import dimension
from vecspark.session import materialize

BITS = 64
#: A raised limit stays below this many differing bits.
RAISE_BELOW = 32
#: Only buckets with more members than this may raise the limit.
RAISE_MEMBERS = 10
#: How readily a limit is raised, and by how many bits in one look: a look at squares costs the same for any number of bits,
#: one that takes exact distances does not.
RAISE, RAISE_AT_ONCE, RAISE_EXACT = 0.9, RAISE_BELOW, 4
#: Steps of the distance scale on which a bucket's lower quartile is read.
QUARTILE_STEPS = 32
#: Queries of one block: each may bring a few rows of every bit distance.
ASK_ROWS = 1 << 14


def hashed(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    """``(id, vec, hash)``."""
    return rows.select("id", "vec", sign_hash64("vec", basis).alias("hash"))


@dataclass
class CountBits(PairJob):
    """For each query, how many references lie at each bit distance."""

    def run(self, queries, refs):
        rows = []
        codes, n = np.unique(refs["hash"], return_counts=True)
        for s, e in kernels.chunks(len(queries["id"]), len(codes)):
            ham = kernels.hamming_matrix(queries["hash"][s:e], codes).astype(np.int64)
            flat = (np.arange(e - s) * (BITS + 1))[:, None] + ham
            counts = np.bincount(flat.ravel(), weights=np.broadcast_to(n, ham.shape).ravel(),
                                 minlength=(e - s) * (BITS + 1)).reshape(e - s, BITS + 1)
            qi, h = np.nonzero(counts)
            rows.append((queries["id"][s:e][qi], h, counts[qi, h].astype(np.int64)))
        if not rows:
            z = np.zeros(0, np.int64)
            return {"query_id": z, "hamming": z, "n": z}
        q, h, c = (np.concatenate(x) for x in zip(*rows))
        return {"query_id": q, "hamming": h, "n": c}

    def merge(self, outputs):
        o = super().merge(outputs)
        key, inv = np.unique(np.stack([o["query_id"], o["hamming"]], 1), axis=0, return_inverse=True)
        n = np.bincount(inv.ravel(), weights=o["n"], minlength=len(key)).astype(np.int64)
        return {"query_id": key[:, 0], "hamming": key[:, 1], "n": n}


#: Queries and references of one matrix of bit distances, and pairs of such queries held beyond which fewer queries are taken at once.
STEP_ROWS, STEP_COLS, HELD = 64, 4096, 1 << 20
#: Parts of a step that single-precision squares tell apart: 2 to this.
PART_BITS = 8
PARTS = 1 << PART_BITS

ROWS = "query_id bigint, hamming int, step int, n bigint, least double, neighbor_id bigint, distance double"
_INTS = ("query_id", "hamming", "step", "n", "neighbor_id")


def _rows(**columns) -> dict:
    n = len(next(iter(columns.values()), ()))
    names = ("query_id", "hamming", "step", "n", "least", "neighbor_id", "distance")
    return {c: np.asarray(columns.get(c, np.zeros(n)), np.int64 if c in _INTS else np.float64) for c in names}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts; the keys are in order."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _first_of_each(starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of ``n`` ordered rows are among the first ``k`` of their run."""
    at = np.arange(n)
    return at - np.repeat(starts, np.diff(np.append(starts, n))) < k


@dataclass
class Levels(PairJob):
    """One look at the pairs: for each query and bit distance, how many references lie there and the ``k`` nearest of them.

    Only bit distances from the query's ``low`` to its ``high`` count; of these, those up to the one that covers
    ``depth`` references of the block. The limit of a query over all references lies no higher, so whatever is
    left out here is beyond it. With a ``reach`` counts are told by ``step``, the place of the distance on the scale
    0 .. 2 x reach, with the least distance there, and only neighbours no farther than the query's ``bar`` come out.
    ``told`` has the step to tell for each step, where several need not be told apart.
    Rows of two kinds come out: counts (``n`` > 0), and neighbours (``n`` = 0).
    """

    k: int = 1
    metric: Metric | None = None
    depth: int | None = None
    told: np.ndarray | None = None
    q_most = ASK_ROWS

    def prepare(self, refs):
        order = np.argsort(refs["id"], kind="stable")
        return {c: v[order] for c, v in refs.items()}

    def run(self, queries, refs):
        out, n = [_rows()], len(refs["id"])
        if "reach" in queries and n and takes_squares(self.metric) and (queries["reach"] > 0).all():
            if "_squares" not in refs:
                refs["_squares"] = kernels.Squares(refs["vec"])
            if refs["_squares"].of(queries["vec"]):
                return PairJob.merge(self, out + [self.stepped({c: v[s:s + STEP_ROWS] for c, v in queries.items()}, refs, s)
                                                  for s in range(0, len(queries["id"]), STEP_ROWS)])
        rows = STEP_ROWS if self.depth is not None and self.depth <= n else 1
        for s in range(0, len(queries["id"]), max(rows, kernels.MATRIX_CELLS // (4 * max(1, n)))):
            part = {c: v[s:s + max(rows, kernels.MATRIX_CELLS // (4 * max(1, n)))] for c, v in queries.items()}
            found = self.covering(part, refs)
            if found:
                out.append(self.scored(part, refs, *found))
                continue
            for a, b in kernels.chunks(len(part["id"]), 4 * max(1, n)):
                few = {c: v[a:b] for c, v in part.items()}
                out.append(self.scored(few, refs, *self.covering(few, refs, held=np.inf)))
        return PairJob.merge(self, out)

    def covering(self, queries, refs, held=HELD):
        """Pairs (query, reference) and their bit distances, those that count: up to the bit distance that covers ``depth``
        references. What covers them falls from one stretch of references to the next. None if more than ``held`` pairs come up."""
        n, m = len(queries["id"]), len(refs["id"])
        low, limit = queries["low"].astype(np.uint8)[:, None], queries["high"].astype(np.uint8)
        depth = self.depth if self.depth is not None and self.depth <= m else None
        seen, parts, total = np.zeros((n, BITS + 1), np.int64), [], 0
        for a in range(0, m, STEP_COLS):
            level = kernels.hamming_matrix(queries["hash"], refs["hash"][a:a + STEP_COLS])
            if low.any():
                level[level < low] = 255
            if depth is not None and not a and depth <= level.shape[1]:
                limit = np.minimum(limit, np.partition(level, depth - 1, axis=1)[:, depth - 1])
            qi, ri = np.divmod(np.flatnonzero(level <= limit[:, None]), level.shape[1])
            h = level[qi, ri]
            parts.append((qi, a + ri, h))
            total += len(qi)
            if total > held:
                return None
            if depth is not None:
                seen += np.bincount(qi * (BITS + 1) + h, minlength=seen.size).reshape(seen.shape)
                covers = np.cumsum(seen, axis=1) >= depth
                limit = np.where(covers[:, -1], np.minimum(limit, covers.argmax(axis=1)), limit).astype(np.uint8)
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        qi, ri, h = (np.concatenate(x) for x in zip(*parts))
        keep = h <= limit[qi]
        return qi[keep], ri[keep], h[keep].astype(np.int64)

    def stepped(self, queries, refs, s):
        """The rows of some queries, from ``s`` on, with a reach: single-precision squares tell most steps, exact distances those
        near an edge, the least of each bit distance and the neighbours. All pairs of a matrix are counted, by bit distance and
        step; a list is made only of those that need a closer look."""
        sq, n = refs["_squares"], len(queries["id"])
        low, span = queries["low"].astype(np.uint8)[:, None], (queries["high"] - queries["low"]).astype(np.uint8)[:, None]
        wide, steps = int(span.max()) + 2, QUARTILE_STEPS + 1  # bit distances from a query's low on, and one place for all others
        asked = np.arange(wide) <= span
        per_step = QUARTILE_STEPS / (2 * queries["reach"] * sq.scale)
        scale = np.minimum(per_step * PARTS, 1e37).astype(np.float32)[:, None]
        bar, q2 = (queries["bar"] * sq.scale) ** 2 * (1 + 1e-9), sq.q2[s:s + n]
        counts, most = np.zeros(n * wide * steps, np.int64), np.full(n * wide, np.inf)
        rows, others = (np.arange(n) * wide * steps)[:, None], np.full((1, STEP_COLS), wide - 1, np.uint8)
        # matrices that are used again
        places, bits, roots = (np.empty((n, STEP_COLS), t) for t in (np.int64, np.uint64, np.float32))
        asked_hash, hashes = queries["hash"].view(np.uint64)[:, None], refs["hash"].view(np.uint64)
        near, least = [], []
        exact = lambda qi, ri: kernels.paired_in_parts(self.metric, queries["vec"], refs["vec"], qi, ri)

        def bounds(some):
            """Some places of the matrix as pairs: query, reference, place among the bit distances, bounds of the square."""
            qi, ri = np.divmod(some, b - a)
            x, err = d2.ravel()[some].astype(np.float64), sq.err(s + qi, a + ri)
            return qi, a + ri, qi * wide + level.ravel()[some], np.maximum(x - err, 0.0), x + err

        for a in range(0, len(refs["id"]), STEP_COLS):
            b = min(len(refs["id"]), a + STEP_COLS)
            level = np.bitwise_count(np.bitwise_xor(asked_hash, hashes[a:b], out=bits[:, :b - a]))
            level -= low
            inside = level <= span
            np.minimum(level, others[:, :b - a], out=level)
            d2 = sq.block(s, s + n, a, b)
            part = np.maximum(d2, np.float32(0), out=roots[:, :b - a])
            np.sqrt(part, out=part)
            part *= scale
            if 2 * (q2.max() + sq.r2[a:b].max()) * per_step.max() ** 2 > QUARTILE_STEPS ** 2:
                np.minimum(part, np.float32(QUARTILE_STEPS * PARTS + PARTS // 2), out=part)
            part = part.astype(np.uint16)
            key = level.astype(np.uint16)
            key *= np.uint16(steps)
            key += part >> np.uint16(PART_BITS)
            key = np.add(rows, key, out=places[:, :b - a])
            counts += np.bincount(key.ravel(), minlength=len(counts))
            # a square that is off by e is off by no more than e as a root, in steps, wherever an edge lies; and what single precision rounds
            off = np.ceil(PARTS * (sq.c * (q2 + sq.r2[a:b].max()) + 1e-30) * per_step ** 2 + 0.05) + 1
            off = np.fmin(off, PARTS // 2).astype(np.uint16)[:, None]
            part += off
            part &= np.uint16(PARTS - 1)
            edge = np.flatnonzero((part <= 2 * off) & inside)
            if len(edge):
                qi, ri, at, lower, upper = bounds(edge)
                step, above = (np.minimum(np.sqrt(x) * per_step[qi] * y, QUARTILE_STEPS).astype(np.int64) for x, y in ((lower, 1 - 1e-9), (upper, 1 + 1e-9)))
                unsure = np.flatnonzero(step != above)
                d = exact(qi[unsure], ri[unsure])
                step[unsure] = np.minimum(np.floor(d / (2 * queries["reach"][qi[unsure]]) * QUARTILE_STEPS), QUARTILE_STEPS)
                was, now = key[qi, ri - a], at * steps + step
                moved = was != now
                np.subtract.at(counts, was[moved], 1)
                np.add.at(counts, now[moved], 1)
                key[qi, ri - a] = now
            # the least of a bit distance lies in the first step that has any
            first = (counts.reshape(n, wide, steps) > 0).argmax(axis=2)
            may = (np.arange(steps) <= first[:, :, None]) & asked[:, :, None]
            qi, ri, at, lower, upper = bounds(np.flatnonzero(np.take(may.ravel(), key)))
            np.minimum.at(most, at, upper)
            may = lower <= most[at]
            least.append((at[may], qi[may], ri[may], lower[may]))
            room = (bar + sq.c * (q2 + sq.r2[a:b].max()) + 1e-30).astype(np.float32)
            qi, ri, at, lower, _ = bounds(np.flatnonzero((d2 <= np.nextafter(room, np.float32(np.inf))[:, None]) & inside))
            may = lower <= bar[qi]
            near.append((at[may], qi[may], ri[may]))
        key, qi, ri, lower = (np.concatenate(x) for x in zip(*least))
        may = lower <= most[key]
        key, d = key[may], exact(qi[may], ri[may])
        most[:] = np.inf
        np.minimum.at(most, key, d)
        counts = np.where(asked[:, :, None], counts.reshape(n, wide, steps), 0).reshape(-1, steps)
        if self.told is not None:
            counts = np.stack([counts[:, self.told == t].sum(axis=1) for t in range(steps)], axis=1)
        key, step = np.nonzero(counts)
        first = np.append(True, np.diff(key) != 0)[:len(key)]  # the bucket's least lies in its first step
        bits = _rows(query_id=queries["id"][key // wide], hamming=queries["low"][key // wide] + key % wide, step=step, n=counts[key, step],
                     least=np.where(first, most[key], np.inf))
        key, qi, ri = (np.concatenate(x) for x in zip(*near))
        d = exact(qi, ri)
        may = d <= queries["bar"][qi]
        key, qi, ri, d = key[may], qi[may], ri[may], d[may]
        order = np.lexsort((refs["id"][ri], d, key))
        best = order[_first_of_each(_runs(key[order]), len(order), self.k)]
        hits = _rows(query_id=queries["id"][qi[best]], hamming=queries["low"][qi[best]] + key[best] % wide, neighbor_id=refs["id"][ri[best]], distance=d[best])
        return {c: np.concatenate([bits[c], hits[c]]) for c in bits}

    def scored(self, queries, refs, qi, ri, level):
        """Counts and nearest rows of the pairs (qi, ri)."""
        if not len(qi):
            return _rows()
        d = kernels.paired_in_parts(self.metric, queries["vec"], refs["vec"], qi, ri)
        step = np.zeros(len(d), np.int64)
        if "reach" in queries:
            reach = queries["reach"][qi]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.minimum(np.floor(d / (2 * reach) * QUARTILE_STEPS), QUARTILE_STEPS)
            step = np.where(reach > 0, step, QUARTILE_STEPS).astype(np.int64)
            step = step if self.told is None else np.where(step < 0, step, self.told[np.maximum(step, 0)])
        key = qi * (BITS + 1) + level
        # references are in the order of their ids, and a step grows with the distance
        order = np.lexsort((ri, d, key))
        starts = _runs(key[order], step[order])
        at = order[starts]
        counts = _rows(query_id=queries["id"][qi[at]], hamming=level[at], step=step[at], n=np.diff(np.append(starts, len(d))), least=d[at])
        best = order[_first_of_each(_runs(key[order]), len(order), self.k)]
        near = _rows(query_id=queries["id"][qi[best]], hamming=level[best], neighbor_id=refs["id"][ri[best]], distance=d[best])
        return {c: np.concatenate([counts[c], near[c]]) for c in near}

    def merge(self, outputs):
        """Of several blocks of a task: counts summed, again cut at the depth, and the nearest of each bit distance."""
        o = PairJob.merge(self, outputs)
        if not len(o["n"]):
            return o
        c, near = ({x: v[some] for x, v in o.items()} for some in (o["n"] > 0, o["n"] == 0))
        order = np.lexsort((c["step"], c["hamming"], c["query_id"]))
        c = {x: v[order] for x, v in c.items()}
        new = _runs(c["query_id"], c["hamming"], c["step"])
        counts = {x: v[new] for x, v in c.items()}
        counts |= {"n": np.add.reduceat(c["n"], new), "least": np.minimum.reduceat(c["least"], new)}
        q = counts["query_id"]
        starts = _runs(q)
        size = np.diff(np.append(starts, len(q)))
        limit = np.full(len(starts), BITS)
        if self.depth is not None:
            upto = np.cumsum(counts["n"])
            upto = upto - np.repeat(upto[starts] - counts["n"][starts], size)
            limit = np.minimum.reduceat(np.where(upto >= self.depth, counts["hamming"], BITS), starts)
        keep = counts["hamming"] <= np.repeat(limit, size)
        order = np.lexsort((near["neighbor_id"], near["distance"], near["hamming"], near["query_id"]))
        near = {x: v[order] for x, v in near.items()}
        some = near["hamming"] <= limit[np.searchsorted(q[starts], near["query_id"])]
        some &= _first_of_each(_runs(near["query_id"], near["hamming"]), len(some), self.k)
        return {x: np.concatenate([counts[x][keep], near[x][some]]) for x in o}


def takes_squares(metric: Metric | None) -> bool:
    """Whether a look with a reach tells steps from squares."""
    return metric.pairwise is kernels.pairwise_euclidean


def told_steps(strategy: float) -> np.ndarray | None:
    """For each step the one to tell. A lower quartile in a step so low, or so high, that ``_risen`` decides alike whatever the least
    distance of the bucket is, which lies no higher than that step, goes as the lowest or the highest."""
    if not 0 <= strategy <= 1:
        return None
    t, half = np.arange(QUARTILE_STEPS + 1), QUARTILE_STEPS / 2
    surely = strategy * t + (1 - strategy) * (t + 1) < half * (1 - 1e-9)
    never = strategy * t > half * (1 + 1e-9)
    return np.where(surely, 0, np.where(never, QUARTILE_STEPS, t))


def _looked(queries: DataFrame, refs: DataFrame, k: int, metric: Metric, dim: int, layout: str, depth: int | None = None,
            told: np.ndarray | None = None) -> DataFrame:
    """Rows of :class:`Levels`, stored; ``queries`` carry (id, vec, hash, low, high) and perhaps reach. Every block of references
    is looked at once."""
    columns = ["id", "vec", "hash", "low", "high"] + [c for c in ("reach", "bar") if c in queries.columns]
    job = Levels(columns, ["id", "vec", "hash"], ROWS, k=k, metric=metric, depth=depth, told=told)
    out, _ = pair_blocks(queries, refs, job, dim, layout=layout)
    return materialize(out)


def _counts(rows: DataFrame) -> DataFrame:
    return rows.filter("n > 0").groupBy("query_id", "hamming").agg(F.sum("n").alias("n"))


def _nearest_within(rows: DataFrame, limits: DataFrame, k: int, lanes: int) -> DataFrame:
    hits = (rows.filter("n = 0").select("query_id", "hamming", "neighbor_id", "distance")
            .join(limits.select("query_id", "cutoff"), "query_id").filter("hamming <= cutoff"))
    return top_k_per_query(hits, k, lanes)


def bit_counts(queries: DataFrame, refs: DataFrame, *, layout: str = "auto") -> DataFrame:
    """``(query_id, hamming, n)``: how many references lie at each bit distance. Both sides carry ``(id, hash)``."""
    job = CountBits(["id", "hash"], ["id", "hash"], "query_id bigint, hamming int, n bigint")
    out, final = pair_blocks(queries, refs, job, 2, layout=layout)
    return out if final else out.groupBy("query_id", "hamming").agg(F.sum("n").alias("n"))


def bit_limits(counts: DataFrame, search_size: int, otherwise: int | None = BITS) -> DataFrame:
    """``(query_id, cutoff)``: least bit distance that covers ``search_size`` rows, ``otherwise`` if there are fewer."""
    upto = (Window.partitionBy("query_id").orderBy("hamming")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = counts.withColumn("_upto", F.sum("n").over(upto))
    return reached.groupBy("query_id").agg(F.coalesce(
        F.min(F.when(F.col("_upto") >= search_size, F.col("hamming"))), F.lit(otherwise).cast("int")).alias("cutoff"))


@dataclass
class Looked:
    """What the looks of a hash search have found: ``rows`` of :class:`Levels` and each query's ``(query_id, cutoff)``."""

    rows: DataFrame
    limits: DataFrame


def _risen(sums: DataFrame, now: DataFrame, strategy: float) -> DataFrame:
    """``(id, cutoff, open)`` after a look at the bit distances from ``low`` to ``high`` of the open queries ``now``.

    With D the distance of the ``search_size``-th best row within the first limit, the limit grows by one bit while
    ``s * Q1 + (1 - s) * min`` of the next bucket stays below D. Q1 is the lower edge of the step that holds the lower quartile.
    """
    steps = (sums.filter("n > 0").groupBy(F.col("query_id").alias("id"), "hamming", "step")
             .agg(F.sum("n").alias("n"), F.min("least").alias("least")))
    sums = steps.groupBy("id", "hamming").agg(F.min("least").alias("least"), F.sum("n").alias("total"),
                                              F.sort_array(F.collect_list(F.struct("step", "n"))).alias("steps"))
    # first step at which a quarter of the bucket is reached
    seen = F.aggregate(
        "steps", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("int").alias("at")),
        lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.coalesce(
            a["at"], F.when(a["sum"] + x["n"] >= 0.25 * F.col("total"), x["step"])).alias("at")))
    q1 = seen["at"] * 2 * F.col("reach") / QUARTILE_STEPS
    s = float(strategy)
    ok = (sums.join(now.select("id", "reach"), "id")
          .filter((F.col("total") > RAISE_MEMBERS) & (s * q1 + (1 - s) * F.col("least") < F.col("reach")))
          .groupBy("id").agg(F.collect_set("hamming").alias("ok")))
    grown = F.aggregate(F.sequence(F.col("low"), F.col("high")), F.col("cutoff"),
                        lambda acc, h: F.when((h == acc + 1) & F.array_contains("ok", h), h).otherwise(acc))
    return (now.join(ok, "id", "left").withColumn("cutoff", F.when(F.col("ok").isNull(), F.col("cutoff")).otherwise(grown))
            .withColumn("open", (F.col("cutoff") == F.col("high")) & (F.col("high") < RAISE_BELOW - 1)))


def _raised(found: Looked, queries: DataFrame, search_size: int, k: int, strategy: float, at_once: int, look) -> Looked:
    """Widens the limits, ``at_once`` bits in one look, for as long as some query's limit still grows."""
    # a first look also brings rows beyond the limit, not all of them; later looks bring them whole
    held = found.rows.join(found.limits, "query_id").filter("hamming <= cutoff").select(found.rows.columns)
    reach = top_k_per_query(held.filter("n = 0"), search_size, MERGE_LANES).groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count("*") >= search_size, F.max("distance")).alias("reach"),
        F.max(F.when(F.col("rank") <= k, F.col("distance"))).alias("bar"))  # farther ones are no answers, however the limit grows
    now = materialize(queries.select("id", "vec", "hash").join(found.limits.withColumnRenamed("query_id", "id"), "id")
                      .join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
                      .withColumn("open", (F.col("reach") > 0) & (F.col("cutoff") < RAISE_BELOW - 1)))
    limits, rows = now.filter("NOT open").select(F.col("id").alias("query_id"), "cutoff"), held
    while True:
        rising = now.filter("open").drop("open")
        if rising.isEmpty():
            return Looked(rows, limits)
        rising = materialize(rising.withColumn("low", F.col("cutoff") + 1)
                             .withColumn("high", F.least(F.col("cutoff") + at_once, F.lit(RAISE_BELOW - 1))))
        more = look(rising)
        now = materialize(_risen(more, rising, strategy).select("id", "vec", "hash", "cutoff", "reach", "bar", "open"))
        limits = limits.unionByName(now.filter("NOT open").select(F.col("id").alias("query_id"), "cutoff"))
        rows = rows.unionByName(more)


def _search(queries: DataFrame, refs: DataFrame, k: int, search_size: int, basis: np.ndarray | None, seed: int,
            raise_limit: float | None, metric: Metric, layout: str, index: BandIndex | None) -> Looked:
    unique_ids(queries)
    raising = raise_limit is not None and raise_limit >= 0
    keep = max(k, search_size) if raising else k
    if index is None and layout == "cells":
        index = build_band_index(refs, basis, seed=seed)
    if index is not None:
        basis, dim, rows = index.basis, index.dim, index.rows
    else:
        dim = dimension(refs)
        basis = hash_basis(max(dim, 1), seed) if basis is None else basis
        rows = hashed(refs, basis)
        rows = materialize(rows) if raising else rows  # one look needs no stored hashes
    q = materialize(hashed(queries, basis).withColumns({"low": F.lit(0), "high": F.lit(BITS)}))
    if layout == "cells":
        found = _through_bands(q, index, keep, metric, search_size)
    else:
        looked = _looked(q, rows, keep, metric, dim, layout, search_size)
        found = Looked(looked, bit_limits(_counts(looked), search_size))
    if raising:
        at_once = RAISE_AT_ONCE if takes_squares(metric) else min(RAISE_AT_ONCE, RAISE_EXACT)
        found = _raised(found, q, search_size, k, raise_limit, at_once, lambda x: _looked(
            x, rows, k, metric, dim, "blocks" if layout == "cells" else layout, told=told_steps(raise_limit)))
    return found


def _through_bands(q: DataFrame, index: BandIndex, k: int, metric: Metric, search_size: int) -> Looked:
    """Few bits in some band first. A query whose limit lies beyond what that surely finds looks at all blocks."""
    near = band_rows(q, index, search_size, k, metric)
    sure = index.bands * (index.flips + 1) - 1
    limits = materialize(q.select(F.col("id").alias("query_id")).join(bit_limits(_counts(near), search_size, None), "query_id", "left"))
    far = limits.filter(F.col("cutoff").isNull() | (F.col("cutoff") > sure)).select(F.col("query_id").alias("id"))
    rest = _looked(q.join(far, "id", "left_semi"), index.rows, k, metric, index.dim, "blocks", search_size)
    limits = limits.filter(F.col("cutoff") <= sure).union(bit_limits(_counts(rest), search_size))
    return Looked(near.join(far.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest), limits)


def knn_lsh(queries: DataFrame, refs: DataFrame | None, k: int, search_size: int = 100, *,
            basis: np.ndarray | None = None, seed: int = 0, raise_limit: float | None = RAISE,
            metric: str | Metric = "euclidean", layout: str = "auto", index: BandIndex | None = None) -> DataFrame:
    """Nearest references among those whose sign hash is close to the query's.

    The bit limit of a query is the least one that covers ``search_size`` references; rows beyond it never count. One look at
    the references finds the limit and the rows within it: a block tells counts, and the nearest rows of each bit distance that
    may matter. ``raise_limit`` widens the limit while the next bucket still looks promising (see :func:`_risen`), in
    one more look; None or a negative value never does.

    ``index`` (see :func:`build_band_index`) keeps the references' hashes, and ``refs`` is not read then. ``layout="cells"`` goes
    through its bands, which suits many queries; results do not depend on the layout.
    """
    if not 1 <= k <= search_size:
        raise ValueError("need 1 <= k <= search_size")
    found = _search(queries, refs, k, search_size, basis, seed, raise_limit, get_metric(metric), layout, index)
    return _nearest_within(found.rows, found.limits, k, MERGE_LANES)


def distance_evaluations(queries: DataFrame, refs: DataFrame | None, search_size: int = 100, *,
                         basis: np.ndarray | None = None, seed: int = 0,
                         raise_limit: float | None = RAISE, metric: str | Metric = "euclidean",
                         layout: str = "auto", index: BandIndex | None = None) -> DataFrame:
    """Rows within each query's limit, whose exact distances decide: ``(query_id, cutoff, evaluations)``."""
    found = _search(queries, refs, 1, search_size, basis, seed, raise_limit, get_metric(metric), layout, index)
    return (_counts(found.rows).join(found.limits, "query_id").filter(F.col("hamming") <= F.col("cutoff"))
            .groupBy("query_id", "cutoff").agg(F.sum("n").alias("evaluations")))


# -- multi-index hashing: tables of the hash's bands

@dataclass
class BandIndex:
    """References by the bands of their hashes.

    A hash is cut into ``bands`` runs of bits. ``table`` holds each reference once for each band, with its vector, in buckets
    of neighbouring band values: ``(cell, part, band, id, vec, hash)``. A crowded bucket is split by further bits of the band, and
    one that consists of a single value by ids, so no bucket exceeds a block. ``lows[b]`` are the least values of
    band b's buckets, ``cells[b]`` and ``parts[b]`` their numbers and splits; there is one entry for each block of rows, 65,536
    a band at most. ``rows`` are the references with their hashes, (id, vec, hash).
    """

    basis: np.ndarray
    bands: int
    flips: int
    rows: DataFrame
    table: DataFrame
    lows: list[np.ndarray]
    cells: list[np.ndarray]
    parts: list[np.ndarray]
    dim: int

    @property
    def width(self) -> int:
        return BITS // self.bands


def _band(hash_: Column, band: int | Column, width: int) -> Column:
    shift = band * width if isinstance(band, int) else (band * F.lit(width)).cast("int")
    return F.call_function("shiftrightunsigned", hash_, F.lit(shift) if isinstance(shift, int) else shift).bitwiseAND(F.lit((1 << width) - 1))


def bucket_bounds(values: np.ndarray, counts: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each bucket and how many parts it has: halves of halves, by one more bit each, until a bucket holds at most
    ``most`` rows or a single value."""
    order = np.argsort(values)
    values, upto = values[order], np.append(0, np.cumsum(counts[order]))
    out, todo = [], [(0, 1 << width)]
    while todo:
        low, high = todo.pop()
        a, b = np.searchsorted(values, (low, high))
        n = int(upto[b] - upto[a])
        if n > most and high - low > 1:
            middle = (low + high) // 2
            todo += [(middle, high), (low, middle)]
        else:
            out.append((low, max(1, -(-n // most))))
    lows, parts = zip(*out)
    return np.array(lows, np.int64), np.array(parts, np.int64)


def build_band_index(refs: DataFrame, basis: np.ndarray | None = None, *, seed: int = 0, bands: int = 4, flips: int = 2,
                     bucket_rows: int | None = None) -> BandIndex:
    """Hash the references once and lay them out by the bands of their hashes, for any number of searches.

    References that differ from a query in fewer than ``bands * (flips + 1)`` bits differ in at most ``flips`` bits of
    some band, so a search that tries every such value of each band finds all of them.
    """
    if bands not in (4, 8, 16) or not 0 <= flips <= 3:
        raise ValueError("use 4, 8 or 16 bands and up to 3 flips")
    dim = dimension(refs)
    basis = hash_basis(max(dim, 1), seed) if basis is None else basis
    rows, width = materialize(hashed(refs, basis)), BITS // bands
    most = bucket_rows or block_rows(dim)
    each = rows.withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(bands)])))
    each = each.withColumn("value", _band(F.col("hash"), F.col("band"), width))
    # at most 2^16 values of each band, whatever the number of rows
    count = {b: ([], []) for b in range(bands)}
    for r in each.groupBy("band", "value").count().collect():
        count[r["band"]][0].append(r["value"])
        count[r["band"]][1].append(r["count"])
    bounds = [bucket_bounds(np.array(v, np.int64), np.array(n, np.int64), width, most) for v, n in (count[b] for b in range(bands))]
    first = np.cumsum([0] + [len(low) for low, _ in bounds])
    cells = [np.arange(first[b], first[b + 1]) for b in range(bands)]

    @F.arrow_udf("struct<cell:int,parts:int>")
    def place(band: pa.Array, value: pa.Array) -> pa.Array:
        b, v = band.to_numpy(), value.to_numpy()
        cell, n = np.zeros(len(b), np.int32), np.ones(len(b), np.int32)
        for k in np.unique(b):
            mine = b == k
            at = np.searchsorted(bounds[k][0], v[mine], side="right") - 1
            cell[mine], n[mine] = cells[k][at], bounds[k][1][at]
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "parts"])

    placed = each.withColumn("_at", place("band", "value")).select(
        "_at.cell", F.pmod(F.xxhash64("id"), F.col("_at.parts")).cast("int").alias("part"), "band", "id", "vec", "hash")
    return BandIndex(basis, bands, flips, rows, materialize(placed), [b[0] for b in bounds], cells, [b[1] for b in bounds], dim)


def flip_masks(width: int, flips: int) -> np.ndarray:
    """All masks of at most ``flips`` of ``width`` bits."""
    out = [0]
    for n in range(1, flips + 1):
        out += [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), n)]
    return np.array(out, np.int64)


def _covering(level: np.ndarray, qi: np.ndarray, n: int, depth: int) -> np.ndarray:
    """For each of ``n`` queries the bit distance that covers ``depth`` of its pairs, 64 if there are fewer."""
    counts = np.bincount(qi * (BITS + 1) + level, minlength=n * (BITS + 1)).reshape(n, BITS + 1)
    reached = counts.cumsum(axis=1) >= depth
    return np.where(reached[:, -1], reached.argmax(axis=1), BITS)


def band_rows(q: DataFrame, index: BandIndex, search_size: int, k: int, metric: Metric) -> DataFrame:
    """Rows of :class:`Levels`, stored, over the references that differ from a query in at most ``flips`` bits of some band.

    A query goes to the buckets that hold a value of at most so many flipped bits, and is compared there with the references
    at such values; a pair that meets in several bands counts in the first. A bucket asked by very many queries is answered
    in several blocks.
    """
    spark, width, flips, masks = q.sparkSession, index.width, index.flips, flip_masks(index.width, index.flips)
    lows, cells, parts = index.lows, index.cells, index.parts

    @F.arrow_udf("array<struct<cell:int,part:int>>")
    def asked(hash_: pa.Array) -> pa.Array:
        ends, found, split = [0], [], []
        for h in hash_.to_numpy().view(np.uint64):
            for b in range(len(lows)):
                value = int(h >> np.uint64(b * width)) & ((1 << width) - 1)
                at = np.unique(np.searchsorted(lows[b], value ^ masks, side="right") - 1)
                n = parts[b][at]
                found.append(np.repeat(cells[b][at], n))
                split.append(np.concatenate([np.arange(x) for x in n]))
            ends.append(ends[-1] + sum(map(len, found[-len(lows):])))
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32) for x in (found, split)]
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.StructArray.from_arrays(list(map(pa.array, flat)), names=["cell", "part"]))

    job = Levels([], [], ROWS, k=k, metric=metric, depth=search_size)
    names, types = arrow_types(spark, ROWS)
    asks = q.select("id", "vec", "hash", F.explode(asked("hash")).alias("_at"))
    asks = materialize(asks.select("_at.cell", "_at.part", F.col("id").alias("query_id"), F.col("vec").alias("q"), F.col("hash").alias("q_hash")))
    lanes = asks.groupBy("cell", "part").agg(F.ceil(F.count("*") / min(ASK_ROWS, block_rows(index.dim))).cast("int").alias("lanes"))
    lanes = F.broadcast(materialize(lanes))  # an entry for each block of references
    keys = ["cell", "part", "lane"]
    asks = (asks.join(lanes, ["cell", "part"]).withColumn("lane", F.pmod(F.xxhash64("query_id"), "lanes").cast("int"))
            .select(*keys, "query_id", "q", "q_hash"))
    held = (index.table.join(lanes, ["cell", "part"]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
            .select(*keys, "band", "id", "vec", "hash"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        x, r = columns_of(left), columns_of(right)
        band, bits = int(r["band"][0]), np.uint64((1 << width) - 1)
        part = lambda h, b: h.view(np.uint64) >> np.uint64(b * width) & bits
        order = np.lexsort((r["id"], part(r["hash"], band)))
        r = {c: v[order] for c, v in r.items()}
        values, start = np.unique(part(r["hash"], band), return_index=True)
        size = np.diff(np.append(start, len(r["id"])))
        queries = {"id": x["query_id"], "vec": x["q"], "hash": x["q_hash"]}
        out, wanted = [_rows()], part(x["q_hash"], band)
        for s, e in kernels.chunks(len(wanted), 32 * max(len(values), int(size.sum()) // 8)):
            qi, vi = np.nonzero(np.bitwise_count(wanted[s:e, None] ^ values[None, :]) <= flips)
            n = size[vi]
            qi = np.repeat(qi, n)
            ri = np.repeat(start[vi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = queries["hash"][s:e][qi] ^ r["hash"][ri]
            first = np.ones(len(qi), bool)
            for b in range(band):  # met in an earlier band already
                first &= np.bitwise_count(part(differ, b)) > flips
            qi, ri, level = qi[first], ri[first], np.bitwise_count(differ[first].view(np.uint64)).astype(np.int64)
            fits = level <= _covering(level, qi, e - s, search_size)[qi]
            out.append(job.scored({c: v[s:e] for c, v in queries.items()}, r, qi[fits], ri[fits], level[fits]))
        return pa.Table.from_batches([batch_of(PairJob.merge(job, out), names, types)])

    return materialize(asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, schema=ROWS))


def knn_banded(queries: DataFrame, index: BandIndex, k: int, search_size: int = 100,
               metric: str | Metric = "euclidean") -> DataFrame:
    """Nearest references among those that differ from the query in few bits of some band (``index.flips``).

    The bit limit is the least one that covers ``search_size`` of these candidates. No query looks at all references:
    the work is that of the buckets it asks. Where the limit is below ``bands * (flips + 1)`` the result is that
    of :func:`knn_lsh` without raising.
    """
    if not 1 <= k <= search_size:
        raise ValueError("need 1 <= k <= search_size")
    unique_ids(queries)
    rows = band_rows(materialize(hashed(queries, index.basis)), index, search_size, k, get_metric(metric))
    return _nearest_within(rows, bit_limits(_counts(rows), search_size), k, 1)
