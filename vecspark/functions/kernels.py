"""NumPy helpers that run on one Arrow batch inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of one distance matrix; larger inputs are worked off in row chunks.
MATRIX_CELLS = 1 << 22


def to_matrix(col) -> np.ndarray:
    """List column -> (rows, dim) double matrix. Null or ragged rows are an error: a reshape would cut them anew."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    flat = col.flatten()
    if col.null_count or flat.null_count:
        raise ValueError("a vector or one of its coordinates is null")
    if len(flat) % n or not pc.all(pc.equal(col.value_lengths(), len(flat) // n)).as_py():
        raise ValueError("vectors of different lengths")
    flat = flat.to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(n, -1)


def to_lists(mat: np.ndarray) -> pa.Array:
    """(rows, dim) double matrix -> list column."""
    n, d = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat).ravel()))


#: Rows whose coordinates are summed at once, so that they stay in a cache; fewer coordinates than this are summed one by one.
SUM_ROWS, SUM_COLS = 512, 9


def _summed(terms, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``terms(a, b)`` of each row, summed in index order."""
    out = np.zeros(len(a))
    for s in range(0, len(a), SUM_ROWS if a.shape[1] >= SUM_COLS else max(1, len(a))):
        x, y, to = (v[s:s + SUM_ROWS] if a.shape[1] >= SUM_COLS else v for v in (a, b, out))
        if a.shape[1] >= SUM_COLS and len(x) > 1:  # rows of a transposed matrix of more than one column are added one after the other
            np.add.reduce(np.ascontiguousarray(terms(x, y).T), axis=0, out=to)
        else:
            for j in range(a.shape[1]):
                to += terms(x[:, j], y[:, j])
    return out


def paired_sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(lambda x, y: np.square(x - y), a, b)


def paired_euclidean(a, b):
    return np.sqrt(paired_sqeuclidean(a, b))


def paired_manhattan(a, b):
    acc = np.zeros(len(a))
    for j in range(a.shape[1]):
        acc += np.abs(a[:, j] - b[:, j])
    return acc


def paired_dot(a, b):
    return _summed(np.multiply, a, b)


def paired_cosine(a, b):
    length = np.sqrt(paired_dot(a, a)) * np.sqrt(paired_dot(b, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - paired_dot(a, b) / length


def pairwise_by_rows(paired, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(r)))
    for i in range(len(q)):
        out[i] = paired(np.broadcast_to(q[i], r.shape), r)
    return out


def pairwise_sqeuclidean(q, r):
    d = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * (q @ r.T)
    return np.maximum(d, 0.0, out=d)


def slack_sqeuclidean(q, r) -> float:
    """Bound on the rounding error of the expanded form."""
    if not len(q) or not len(r):
        return 0.0
    scale = float((q * q).sum(1).max() + (r * r).sum(1).max())
    return 1e-14 * (q.shape[1] + 8) * scale


def pairwise_euclidean(q, r):
    return np.sqrt(pairwise_sqeuclidean(q, r))


def slack_euclidean(q, r) -> float:
    return float(np.sqrt(slack_sqeuclidean(q, r)))


def pair_slack(metric, q, r):
    """Rounding bound of each pair by its own two norms: one far row must not blur all others."""
    if metric.slack not in (slack_sqeuclidean, slack_euclidean):
        return metric.slack(q, r)
    err = 1e-14 * (q.shape[1] + 8) * ((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :])
    return err if metric.slack is slack_sqeuclidean else np.sqrt(err)


def paired_in_parts(metric, q, r, qi, ri, size: int = 1 << 11):
    """Exact distances of the pairs, a bounded number of gathered rows at a time."""
    return np.concatenate([np.zeros(0), *(metric.paired(q[qi[a:a + size]], r[ri[a:a + size]]) for a in range(0, len(qi), size))])


def pairwise_cosine(q, r):
    with np.errstate(invalid="ignore", divide="ignore"):
        qn = q / np.sqrt((q * q).sum(1))[:, None]
        rn = r / np.sqrt((r * r).sum(1))[:, None]
    return 1.0 - qn @ rn.T


def project(vecs: np.ndarray, basis: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Rows of ``vecs`` times ``basis``, summed in index order.

    A matrix product would be quicker but its rounding depends on the batch
    shape; equal vectors must get equal projections in every task.
    """
    out = np.zeros((len(vecs), len(basis)))
    for s in range(0, len(vecs), chunk):
        part = out[s:s + chunk]
        for j in range(basis.shape[1]):
            part += vecs[s:s + chunk, j:j + 1] * basis[:, j]
    return out


def sign_hash(vecs: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Bit i is set when the i-th projection is positive."""
    bits = project(vecs, basis) > 0
    powers = np.uint64(1) << np.arange(len(basis), dtype=np.uint64)
    return (bits * powers).sum(1, dtype=np.uint64).view(np.int64)


def hamming_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])


class RefBlock:
    """One block of reference rows, with exact copies folded together.

    Copies share every distance, and ties go to the lower id, so a top-k over
    distinct vectors followed by expansion to each vector's k lowest ids is
    the top-k over all rows. A block of nothing but copies costs one distance.
    """

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vecs = ids[order], vecs[order]
        n = len(ids)
        self.n, self.nearness = n, None
        if n and vecs.shape[1]:
            probe = vecs @ np.cos(np.arange(1, vecs.shape[1] + 1.0))
            # equal rows give nearly equal probes; only then is the exact fold worth it
            srt = np.sort(probe)
            close = np.diff(srt) <= 1e-9 * (1.0 + np.abs(srt[1:]))
            if close.any():
                self.vecs, inv = np.unique(vecs, axis=0, return_inverse=True)
                by_vec = np.argsort(inv.ravel(), kind="stable")
                self.ids = ids[by_vec]
                self.starts = np.searchsorted(inv.ravel()[by_vec], np.arange(len(self.vecs)))
                self.sizes = np.diff(np.append(self.starts, n))
                return
        self.vecs, self.ids = vecs, ids
        self.starts, self.sizes = np.arange(n), np.ones(n, dtype=np.int64)

    def expand(self, qi, ui, d, k):
        """(query, distinct vector, distance) -> k best rows per query."""
        take = np.minimum(self.sizes[ui], k)
        rep = np.repeat(np.arange(len(ui)), take)
        within = np.arange(len(rep)) - np.repeat(np.cumsum(take) - take, take)
        ids = self.ids[self.starts[ui[rep]] + within]
        qi, d = qi[rep], d[rep]
        order = np.lexsort((ids, d, qi))
        qi, ids, d = qi[order], ids[order], d[order]
        first = np.searchsorted(qi, qi, side="left")
        rank = np.arange(len(qi)) - first
        keep = rank < k
        return qi[keep], ids[keep], d[keep], rank[keep]


def chunks(n_rows: int, n_cols: int):
    step = max(1, MATRIX_CELLS // max(1, n_cols))
    for s in range(0, n_rows, step):
        yield s, min(n_rows, s + step)


class Squares:
    """Squared Euclidean distances in single precision, with a bound on their error, to choose pairs for exact distances.

    Both sides are taken about the references' mean and scaled by a power of two to at most 1; the differences keep
    their relative precision. ``of`` says whether the values allow that. Results are in scaled units. ``blur`` is how far
    the squares of the given values may lie from those that count.
    """

    def __init__(self, refs: np.ndarray, blur: float = 0.0):
        self.blur = blur
        self.refs, self.dim = refs, refs.shape[1]
        with np.errstate(all="ignore"):
            self.centre = refs.mean(axis=0) if len(refs) else np.zeros(self.dim)
            self.big = float(np.abs(refs - self.centre).max()) if refs.size else np.nan
        self.c = (2 * self.dim + 40) * 2.0 ** -24
        self.scale, self.least = 0.0, 1e-30

    def of(self, queries: np.ndarray) -> bool:
        """Takes these queries; False if some value is not finite or beyond what squares can hold."""
        with np.errstate(all="ignore"):
            x = queries - self.centre
            big = max(self.big, float(np.abs(x).max())) if x.size else np.nan
        if not 1e-140 < big < 1e140:
            return False
        scale = 2.0 ** -np.frexp(big)[1]
        if scale != self.scale:
            self.scale, self.least = scale, 1e-30 + self.blur * scale * scale
            r = (self.refs - self.centre) * scale
            self.r2 = (r * r).sum(1)
            self.right = np.column_stack([r, self.r2, np.ones(len(r))]).astype(np.float32)
        x *= scale
        self.q2 = (x * x).sum(1)
        self.left = np.column_stack([-2.0 * x, np.ones(len(x)), self.q2]).astype(np.float32)
        return True

    def block(self, s: int, e: int, a: int, b: int) -> np.ndarray:
        return self.left[s:e] @ self.right[a:b].T

    def err(self, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
        return self.c * (self.q2[qi] + self.r2[ri]) + self.least


#: Blocks of fewer references are not worth it.
SINGLE_ROWS = 256
#: Queries and references of one matrix of single-precision squares, and candidates of a query beyond which doubles choose.
SQUARE_ROWS, SQUARE_COLS, MANY = 512, 4096, 64


def _shortlist(sq: Squares, s: int, e: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (query, reference) among which the k nearest of the queries s to e surely are; None if they are too many.

    A bar, the k-th least upper bound so far, falls from one stretch of references to the next.
    """
    n, m = e - s, len(sq.refs)
    bar = np.full(n, np.inf)
    best = np.full((n, k), np.inf)
    held, total = [], 0
    for a in range(0, m, SQUARE_COLS):
        b = min(m, a + SQUARE_COLS)
        d = sq.block(s, e, a, b)
        if a == 0 and k < b:
            near = np.argpartition(d[:, :max(1024, 2 * k)], k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(n), k)
            upper = d[rows, near.ravel()] + sq.err(s + rows, near.ravel())
            bar = upper.reshape(n, k).max(axis=1)
        # the least a pair's own error bound can allow it, before that bound is known
        room = bar + sq.c * (sq.q2[s:e] + sq.r2[a:b].max()) + sq.least
        at = np.flatnonzero(d <= np.nextafter(room.astype(np.float32), np.float32(np.inf))[:, None])
        qi, ri = np.divmod(at, b - a)
        value = d.ravel()[at].astype(np.float64)
        err = sq.err(s + qi, a + ri)
        fits = value - err <= bar[qi]
        qi, ri, value, err = qi[fits], a + ri[fits], value[fits], err[fits]
        held.append((qi, ri, value - err))
        total += len(qi)
        if total > MANY * (k + 16) * n:
            return None
        if len(qi):
            rows = np.append(np.repeat(np.arange(n), k), qi)
            upper = np.append(best.ravel(), value + err)
            order = np.lexsort((upper, rows))
            first = np.searchsorted(rows[order], np.arange(n))
            best = upper[order][first[:, None] + np.arange(k)]
            bar = np.minimum(bar, best[:, -1])
    qi, ri, lower = (np.concatenate(x) for x in zip(*held))
    fits = lower <= bar[qi]
    qi, ri = qi[fits], ri[fits]
    order = np.argsort(qi, kind="stable")
    return qi[order], ri[order]


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and for each whether that is to be trusted."""
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(1))
        return x / length[:, None], (length > 1e-140) & (length < 1e140)


class _Nearness:
    """Which squares order the references of a block as a metric does, and those of them that may be among the k nearest.

    Cosine distances are half the squares between unit vectors. A row of zeros or with a value that is not a number has none:
    as a reference it comes after all others, as a query it has no shortlist.
    """

    def __init__(self, vecs: np.ndarray, metric):
        self.at, self.squares, self.unit = None, None, metric.pairwise is pairwise_cosine
        if self.unit:
            refs, fine = _units(vecs)
            if not (fine | (vecs == 0).all(axis=1) | np.isnan(vecs).any(axis=1)).all():
                return
            self.at = np.flatnonzero(fine)
            vecs = refs[self.at]
        elif metric.pairwise not in (pairwise_euclidean, pairwise_sqeuclidean):
            return
        if len(vecs) >= SINGLE_ROWS:
            self.squares = Squares(vecs, 1e-14 * (vecs.shape[1] + 8) if self.unit else 0.0)

    def of(self, queries: np.ndarray) -> np.ndarray:
        """Takes these queries; for which of them squares will do."""
        fine = np.full(len(queries), self.squares is not None)
        if self.unit and self.squares is not None:
            queries, fine = _units(queries)
            queries[~fine] = 0.0
        return fine & (self.squares is not None and self.squares.of(queries))

    def shortlist(self, s: int, e: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """As :func:`_shortlist`, for the queries taken."""
        found = _shortlist(self.squares, s, e, k)
        return found if found is None or self.at is None else (found[0], self.at[found[1]])


def top_k(queries: np.ndarray, block: RefBlock, k: int, metric):
    """k nearest rows of the block for each query row, ties to the lower id."""
    parts = []
    u = block.vecs
    if len(queries) and len(u):
        kk = min(k, len(u))
        if block.nearness is None:
            block.nearness = _Nearness(u, metric)
        fine, short = block.nearness.of(queries), True
        for a, b in ((a, min(a + SQUARE_ROWS, len(queries))) for a in range(0, len(queries), SQUARE_ROWS)):
            found = None
            if short and fine[a:b].all() and kk <= len(block.nearness.squares.refs):
                found = block.nearness.shortlist(a, b, kk)
                short = found is not None
            # without a shortlist, or too long a one, doubles choose
            for s, e in [(a, b)] if found else ((a + x, a + y) for x, y in chunks(b - a, len(u))):
                q = queries[s:e]
                if found:
                    qi, ui = found
                else:
                    dist = metric.pairwise(q, u)
                    err = pair_slack(metric, q, u)
                    upper = dist + err
                    bar = np.partition(upper, kk - 1, axis=1)[:, kk - 1] if kk < len(u) else upper.max(axis=1)
                    qi, ui = np.nonzero(~(dist - err > bar[:, None]))
                d = paired_in_parts(metric, q, u, qi, ui)
                qi, ids, d, rank = block.expand(qi, ui, d, k)
                parts.append((qi + s, ids, d, rank))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0), z
    return tuple(np.concatenate(c) for c in zip(*parts))


#: Up to this dimension all exact distances cost less than a shortlist; cells of their matrix.
LOW_DIM, LOW_CELLS = 8, 1 << 16


def is_low(metric, dim: int) -> bool:
    """Whether :func:`low_distances` serves this metric in this dimension."""
    return dim <= LOW_DIM and metric.paired in (paired_euclidean, paired_sqeuclidean)


def low_distances(q: np.ndarray, r: np.ndarray, metric) -> np.ndarray:
    """Exact distances of all pairs, summed as the paired form sums them."""
    d, t = np.zeros((len(q), len(r))), np.empty((len(q), len(r)))
    for j in range(q.shape[1]):
        to = t if j else d
        np.subtract(q[:, j, None], r[:, j], out=to)
        np.multiply(to, to, out=to)
        if j:
            np.add(d, t, out=d)
    return np.sqrt(d, out=d) if metric.paired is paired_euclidean else d


def _nearest_low(vecs: np.ndarray, centers: np.ndarray, metric):
    """As :func:`nearest` in few dimensions; None if some distance is not a number."""
    best, out = np.zeros(len(vecs), dtype=np.int32), np.zeros(len(vecs))
    step = max(1, LOW_CELLS // len(centers))
    for s in range(0, len(vecs), step):
        d = low_distances(vecs[s:s + step], centers, metric)
        best[s:s + step] = at = d.argmin(axis=1)
        out[s:s + step] = d[np.arange(len(d)), at]
    return None if np.isnan(out).any() else (best, out)


def nearest(vecs: np.ndarray, centers: np.ndarray, metric):
    """Position of the nearest centre (ties to the lowest) and the exact distance."""
    n = len(vecs)
    if n and len(centers) and is_low(metric, vecs.shape[1]):
        found = _nearest_low(vecs, centers, metric)
        if found:
            return found
    best = np.zeros(n, dtype=np.int32)
    out = np.zeros(n)
    for s, e in chunks(n, len(centers)):
        v = vecs[s:e]
        dist = metric.pairwise(v, centers)
        err = pair_slack(metric, v, centers)
        bar = (dist + err).min(axis=1)
        qi, ci = np.nonzero(~(dist - err > bar[:, None]))
        d = paired_in_parts(metric, v, centers, qi, ci)
        order = np.lexsort((ci, d, qi))
        qi, ci, d = qi[order], ci[order], d[order]
        first = np.searchsorted(qi, np.arange(e - s))
        best[s:e] = ci[first]
        out[s:e] = d[first]
    return best, out


def nearest_and_next(vecs: np.ndarray, centers: np.ndarray, metric):
    """As :func:`nearest`, and a lower bound on the distance to any other centre (infinite if there is none)."""
    best, out = nearest(vecs, centers, metric)
    other = np.full(len(vecs), np.inf)
    if len(centers) > 1:
        for s, e in chunks(len(vecs), len(centers)):
            low = metric.pairwise(vecs[s:e], centers) - pair_slack(metric, vecs[s:e], centers)
            low[np.arange(e - s), best[s:e]] = np.inf
            other[s:e] = low.min(axis=1)
    return best, out, other
