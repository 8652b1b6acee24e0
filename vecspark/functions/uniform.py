"""Random numbers as functions of (seed, keys), the same in every task and retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """Uniform draw in (0, 1) from the first 32 bits of an md5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)),
                               *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def gaussian(seed: int, *keys) -> Column:
    """Standard normal draw by the Box-Muller rule."""
    u = uniform(seed, *keys, F.lit("a"))
    v = uniform(seed, *keys, F.lit("b"))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def local_uniform(seed: int, *keys) -> float:
    """The same draw computed in plain Python, for small driver-side tables."""
    text = ":".join(str(k) for k in (seed, *keys))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def local_gaussian(seed: int, *keys) -> float:
    u, v = local_uniform(seed, *keys, "a"), local_uniform(seed, *keys, "b")
    return float(np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v))


def random_order(seed: int, key="id") -> Column:
    """Sort key that puts rows in a seeded random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)),
                             (F.col(key) if isinstance(key, str) else key).cast("string")))
