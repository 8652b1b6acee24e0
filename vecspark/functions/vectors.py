"""Vector functions as plain Column expressions (no Python in the plan).

Every sum folds from the left in index order, so a result is the same bits
whatever engine or partitioning computes it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.functions import kernels

#: Up to this dimension sums are unrolled, which keeps them inside generated code.
UNROLL = 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(arr: Column, dim: int | None = None) -> Column:
    if dim is not None and dim <= UNROLL:
        terms = [F.element_at(arr, i + 1) for i in range(dim)]
        return functools.reduce(lambda x, y: x + y, terms, F.lit(0.0))
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _pairwise(a: Column, b: Column, term: Callable[[Column, Column], Column],
              dim: int | None) -> Column:
    if dim is not None and dim <= UNROLL:
        terms = [term(F.element_at(a, i + 1), F.element_at(b, i + 1)) for i in range(dim)]
        return functools.reduce(lambda x, y: x + y, terms, F.lit(0.0))
    return _fold(F.zip_with(a, b, term))


def sq_euclidean(a, b, dim: int | None = None) -> Column:
    return _pairwise(_col(a), _col(b), lambda x, y: (x - y) * (x - y), dim)


def euclidean(a, b, dim: int | None = None) -> Column:
    return F.sqrt(sq_euclidean(a, b, dim))


def dot(a, b, dim: int | None = None) -> Column:
    return _pairwise(_col(a), _col(b), lambda x, y: x * y, dim)


def manhattan(a, b, dim: int | None = None) -> Column:
    return _pairwise(_col(a), _col(b), lambda x, y: F.abs(x - y), dim)


def norm(v, p: int = 2) -> Column:
    """L1 or L2 length; ``p=0`` names the squared L2 length."""
    v = _col(v)
    if p == 1:
        return _fold(F.transform(v, F.abs))
    sq = _fold(F.transform(v, lambda x: x * x))
    if p == 0:
        return sq
    if p == 2:
        return F.sqrt(sq)
    raise ValueError("p must be 0 (squared), 1 or 2")


def normalize(v) -> Column:
    """Unit vector; the zero vector stays as it is."""
    v = _col(v)
    # as an element of an array the length is taken once, not for each coordinate
    return F.transform(F.array(norm(v)), lambda length: F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v))[0]


def add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def scale(v, factor) -> Column:
    return F.transform(_col(v), lambda x: x * factor)


def cosine(a, b, dim: int | None = None) -> Column:
    """Cosine distance, 1 - cos."""
    a, b = _col(a), _col(b)
    return F.lit(1.0) - dot(a, b, dim) / (norm(a) * norm(b))


def vectors_equal(a, b) -> Column:
    return _col(a) == _col(b)


@dataclass(frozen=True)
class Metric:
    """A distance in its two forms: a Column builder and a NumPy row function.

    ``paired(A, B)`` gives the exact distance of matching rows. ``pairwise``
    gives all row pairs, possibly with rounding error below ``slack``; search
    uses it only to shortlist and then recomputes with ``paired``.
    """

    name: str
    column: Callable[..., Column]
    paired: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]
    slack: Callable[[np.ndarray, np.ndarray], float]
    triangle: bool = False


METRICS: dict[str, Metric] = {}


def register_metric(name: str, column, paired, *, pairwise=None, slack=None,
                    triangle: bool = False) -> Metric:
    """Add a distance by name, usable wherever a ``metric`` argument is taken."""
    m = Metric(name, column, paired,
               pairwise or functools.partial(kernels.pairwise_by_rows, paired),
               slack or (lambda q, r: 0.0), triangle)
    METRICS[name] = m
    return m


def get_metric(metric: str | Metric) -> Metric:
    if isinstance(metric, Metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(METRICS)}")
    return METRICS[metric]


register_metric("euclidean", euclidean, kernels.paired_euclidean,
                pairwise=kernels.pairwise_euclidean, slack=kernels.slack_euclidean, triangle=True)
register_metric("sqeuclidean", sq_euclidean, kernels.paired_sqeuclidean,
                pairwise=kernels.pairwise_sqeuclidean, slack=kernels.slack_sqeuclidean)
register_metric("manhattan", manhattan, kernels.paired_manhattan, triangle=True)
register_metric("cosine", cosine, kernels.paired_cosine,
                pairwise=kernels.pairwise_cosine, slack=lambda q, r: 1e-12)
