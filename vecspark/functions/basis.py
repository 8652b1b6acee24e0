"""Random bases, projections and sign hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.functions.uniform import local_gaussian, local_uniform
from vecspark.functions.vectors import dot

#: Up to this many multiplications per row the projection stays a JVM expression.
INLINE_TERMS = 256


def make_basis(m: int, d: int, seed: int = 0, kind: str = "gaussian",
               unit: bool = True) -> np.ndarray:
    """``m`` random rows of length ``d``; unit rows unless told otherwise."""
    if m < 1 or d < 1:
        raise ValueError("a basis needs at least one row and one dimension")
    draw = {"gaussian": local_gaussian, "uniform": local_uniform}.get(kind)
    if draw is None:
        raise ValueError("kind must be 'gaussian' or 'uniform'")
    rows = np.array([[draw(seed, i, j) for j in range(d)] for i in range(m)])
    if unit:
        rows /= np.sqrt(kernels.paired_dot(rows, rows))[:, None]
    return rows


def hash_basis(d: int, seed: int = 0, bits: int = 64) -> np.ndarray:
    """Normal rows, not normalised, for the sign hash."""
    if bits not in (32, 64):
        raise ValueError("bits must be 32 or 64")
    return make_basis(bits, d, seed, unit=False)


def literal(row) -> Column:
    return F.array(*[F.lit(float(x)) for x in row])


def project(v, basis: np.ndarray) -> Column:
    """basis x v as an array column."""
    v = F.col(v) if isinstance(v, str) else v
    m, d = basis.shape
    if m * d <= INLINE_TERMS:
        return F.array(*[dot(v, literal(row), d) for row in basis])

    @F.arrow_udf("array<double>")
    def projected(col: pa.Array) -> pa.Array:
        if not len(col):
            return pa.array([], pa.list_(pa.float64()))
        return kernels.to_lists(kernels.project(kernels.to_matrix(col), basis))

    return projected(v)


def _sign_hash(v, basis: np.ndarray, bits: int) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    if len(basis) != bits:
        raise ValueError(f"the basis must have {bits} rows")
    if basis.size <= INLINE_TERMS:
        words = [F.when(dot(v, literal(row), basis.shape[1]) > 0, F.shiftleft(F.lit(1).cast("bigint"), i))
                 .otherwise(F.lit(0).cast("bigint")) for i, row in enumerate(basis)]
        return functools.reduce(lambda a, b: a.bitwiseOR(b), words)

    @F.arrow_udf("bigint")
    def hashed(col: pa.Array) -> pa.Array:
        if not len(col):
            return pa.array([], pa.int64())
        return pa.array(kernels.sign_hash(kernels.to_matrix(col), basis))

    return hashed(v)


def sign_hash64(v, basis: np.ndarray) -> Column:
    """64-bit hash whose bit i tells the sign of the i-th projection."""
    return _sign_hash(v, basis, 64)


def sign_hash32(v, basis: np.ndarray) -> Column:
    return _sign_hash(v, basis, 32)


def hamming(a, b) -> Column:
    """Number of differing bits."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.bit_count(a.bitwiseXOR(b))
