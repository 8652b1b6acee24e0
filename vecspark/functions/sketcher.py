"""State of a one-pass clustering sketch, as it lives inside one task."""

from __future__ import annotations

import numpy as np

from vecspark.functions import kernels

#: Points compared with the same centroids before these move.
BATCH = 128


class Sketcher:
    """At most ``kappa`` weighted centroids for any number of points seen.

    A point at distance d from its nearest centroid founds a new one when its
    own uniform number is below d / cutoff, else it is merged. When there are
    more than kappa centroids they are clustered once more by the same rule,
    and the cutoff grows if that left too many. Centroids move at the end of a
    small batch rather than after every point, which lets a batch share one
    distance matrix.
    """

    def __init__(self, kappa: int, cutoff: float, metric, *, beta=1.3, log_factor=10.0,
                 overshoot=0.5, seed=0, key=0):
        if kappa < 1 or beta <= 1 or cutoff < 0:
            raise ValueError("need kappa >= 1, beta > 1 and cutoff >= 0")
        self.kappa, self.cutoff, self.metric = int(kappa), max(cutoff, 1e-300), metric
        self.beta, self.log_factor, self.overshoot = beta, log_factor, overshoot
        self.seed, self.key = seed, key
        self.n_seen = self.collapses = 0
        self.vecs, self.weights = None, np.zeros(0)
        self.trace: list[tuple[int, int, float, int]] = []

    def add(self, x: np.ndarray, w: np.ndarray, u: np.ndarray) -> None:
        for s in range(0, len(x), BATCH):
            part = slice(s, s + BATCH)
            self._step(x[part], w[part], u[part])
            self.n_seen += len(x[part])
            while len(self.weights) > self.kappa:
                self.kappa = int(max(self.kappa, self.log_factor * np.log(max(self.n_seen, 2))))
                if len(self.weights) <= self.kappa:
                    break
                self._collapse()
                if len(self.weights) > self.overshoot * self.kappa:
                    self.cutoff *= self.beta
                self.trace.append((self.n_seen, self.kappa, self.cutoff, len(self.weights)))

    def _step(self, x, w, u) -> None:
        if self.vecs is None:
            self.vecs, self.weights = x[:1].copy(), w[:1].astype(float)
            x, w, u = x[1:], w[1:], u[1:]
            if not len(x):
                return
        at, d = kernels.nearest(x, self.vecs, self.metric)
        at = at.astype(np.int64)
        old = len(self.vecs)
        founded = self._founders(x, u, d)
        if len(founded):
            at[founded] = old + np.arange(len(founded))
            rest = np.ones(len(x), bool)
            rest[founded] = False
            rest = np.flatnonzero(rest)
            if len(rest):
                i, to_new = kernels.nearest(x[rest], x[founded], self.metric)
                closer = to_new < d[rest]
                at[rest[closer]] = old + i[closer]
            self.vecs = np.vstack([self.vecs, np.zeros((len(founded), x.shape[1]))])
            self.weights = np.append(self.weights, np.zeros(len(founded)))
        gain = np.bincount(at, weights=w, minlength=len(self.vecs))
        hit = np.flatnonzero(gain)
        sums = self.vecs[hit] * self.weights[hit, None]
        np.add.at(sums, np.searchsorted(hit, at), x * w[:, None])
        self.weights[hit] += gain[hit]
        self.vecs[hit] = sums / self.weights[hit, None]

    def _founders(self, x, u, d) -> np.ndarray:
        """Rows that found a centroid, in order: their number is below the distance to the nearest centroid, those
        founded before them included, over the cutoff. Distances between the rows in question are taken at once."""
        ask = np.flatnonzero(u < d / self.cutoff)
        n = len(ask)
        if n < 2:
            return ask
        if kernels.is_low(self.metric, x.shape[1]):
            to = kernels.low_distances(x[ask], x[ask], self.metric)
        else:  # rows that come later only
            i, j = np.triu_indices(n, 1)
            to = np.full((n, n), np.inf)
            to[i, j] = kernels.paired_in_parts(self.metric, x, x, ask[j], ask[i], max(1, kernels.MATRIX_CELLS // max(1, x.shape[1])))
        near, own, founded = d[ask], u[ask], []
        for k in range(n):
            if own[k] < near[k] / self.cutoff:
                founded.append(k)
                np.fmin(near, to[k], out=near)
        return ask[founded]

    def _collapse(self) -> None:
        rng = np.random.default_rng([self.seed & 0xFFFFFFFF, self.key, self.collapses])
        self.collapses += 1
        order = rng.permutation(len(self.weights))
        x, w, u = self.vecs[order], self.weights[order], rng.random(len(order))
        self.vecs, self.weights = None, np.zeros(0)
        for s in range(0, len(x), BATCH):
            self._step(x[s:s + BATCH], w[s:s + BATCH], u[s:s + BATCH])


class Fed(Sketcher):
    """A sketcher that cuts its own batches, so that they do not depend on those in which rows arrive."""

    def __init__(self, *args, **opts):
        super().__init__(*args, **opts)
        self.waiting, self.n = [], 0

    def feed(self, *rows: np.ndarray) -> None:
        self.waiting.append(rows)
        self.n += len(rows[1])
        if self.n >= BATCH:
            x = [np.concatenate(c) for c in zip(*self.waiting)]
            whole = self.n - self.n % BATCH
            self.add(*(c[:whole] for c in x))
            self.waiting, self.n = [tuple(c[whole:] for c in x)], self.n - whole

    def finish(self) -> None:
        if self.n:
            self.add(*(np.concatenate(c) for c in zip(*self.waiting)))
            self.waiting, self.n = [], 0
