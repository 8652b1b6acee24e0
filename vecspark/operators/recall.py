"""How well an approximate search did."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import kernels
from vecspark.functions.basis import hash_basis
from vecspark.operators.hash_search import BITS, hashed
from vecspark.plans.blocks import PairJob, pair_blocks
from vecspark.schema import dimension


def search_overlap(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: shared neighbours, recall, ratios of nearest and of farthest distance.

    Ratios are approximate / exact; a nearest distance of 0 gives null.
    """
    keys = ["query_id", "neighbor_id"]
    shared = approx.select(*keys).join(exact.select(*keys), keys).groupBy("query_id").agg(
        F.count("*").alias("overlap"))

    def ends(df, tag):
        return df.groupBy("query_id").agg(
            F.count("*").alias(f"{tag}_n"), F.min("distance").alias(f"{tag}_near"),
            F.max("distance").alias(f"{tag}_far"))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    return (ends(exact, "e").join(ends(approx, "a"), "query_id", "left")
            .join(shared, "query_id", "left")
            .select("query_id", F.coalesce("overlap", F.lit(0)).alias("overlap"),
                    (F.coalesce("overlap", F.lit(0)) / F.col("e_n")).alias("recall"),
                    ratio("a_near", "e_near").alias("nearest_ratio"),
                    ratio("a_far", "e_far").alias("farthest_ratio")))


@dataclass
class CosineByBits(PairJob):
    """Sum of cosines and number of pairs at each bit distance (no pair leaves the task)."""

    def run(self, queries, refs):
        qv, rv = (x / np.sqrt(kernels.paired_dot(x, x))[:, None]
                  for x in (queries["vec"], refs["vec"]))
        sums, n = np.zeros(BITS + 1), np.zeros(BITS + 1)
        for s, e in kernels.chunks(len(qv), max(1, len(rv))):
            ham = kernels.hamming_matrix(queries["hash"][s:e], refs["hash"]).ravel()
            sums += np.bincount(ham, weights=(qv[s:e] @ rv.T).ravel(), minlength=BITS + 1)
            n += np.bincount(ham, minlength=BITS + 1)
        at = np.nonzero(n)[0]
        return {"hamming": at, "cosines": sums[at], "n": n[at].astype(np.int64)}


def hash_correlation(queries: DataFrame, refs: DataFrame, basis: np.ndarray | None = None,
                     *, seed: int = 0, layout: str = "auto") -> DataFrame:
    """Mean cosine of all (query, reference) pairs at each bit distance."""
    dim = dimension(refs)
    if basis is None:
        basis = hash_basis(dim, seed)
    cols = ["id", "vec", "hash"]
    job = CosineByBits(cols, cols, "hamming int, cosines double, n bigint")
    out, _ = pair_blocks(hashed(queries, basis), hashed(refs, basis), job, dim, layout=layout)
    return out.groupBy("hamming").agg(F.sum("n").alias("pairs"),
                                      (F.sum("cosines") / F.sum("n")).alias("mean_cosine"))
