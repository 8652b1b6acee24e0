"""Documents to vectors: TF-IDF, hashed terms, random projection of sparse rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark import session
from vecspark.functions.text import (
    get_scorer, hash_term, parse_code, parse_message, tokenize_message, tokenize_standard)
from vecspark.functions.uniform import gaussian
from vecspark.functions.vectors import UNROLL
from vecspark.plans.rank import with_rank

#: Memory one dictionary row may take when broadcast, besides the term's own bytes.
TERM_BYTES = 96
#: The part of a dictionary that is broadcast stays below this size.
HEAD_BYTES = 8 << 20
#: Words counted at once.
COUNT_WORDS = 1 << 18


def _count_terms(batches):
    """Rows (doc_id, words) to rows (doc_id, term, tf), each document's different words with how often they stand in it.
    A batch is worked off some documents at a time, so memory does not follow its number of words."""
    for b in batches:
        ends = np.append(0, np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        s = 0
        while s < b.num_rows:
            e = max(s + 1, int(np.searchsorted(ends, ends[s] + COUNT_WORDS, side="right")) - 1)
            ids, words = (c.slice(s, e - s) for c in b.columns)
            flat = words.flatten().dictionary_encode()
            m = max(1, len(flat.dictionary))
            row = np.repeat(np.arange(e - s), np.diff(ends[s:e + 1]))
            key, n = np.unique(row * m + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(key // m)), flat.dictionary.take(pa.array(key % m)),
                                              pa.array(n.astype(np.int64))], names=["doc_id", "term", "tf"])
            s = e


def term_freq(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``(doc_id, term, tf)``, counted within each row, so nothing is shuffled. A document is one row: rows that repeat an
    id are counted one by one."""
    words = tokens if tokens is not None else tokenize_standard(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    return rows.mapInArrow(_count_terms, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, term string, tf bigint")


def doc_freq(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(term, df)`` straight from the documents: one shuffle, keyed by term only."""
    words = tokens if tokens is not None else tokenize_standard(text_col)
    return (docs.select(F.explode(F.array_distinct(words)).alias("term"))
            .groupBy("term").agg(F.count("*").alias("df")))


def doc_freq_of(tf: DataFrame) -> DataFrame:
    """``(term, df)`` from a stored term-frequency table."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def join_terms(tf: DataFrame, per_term: DataFrame) -> DataFrame:
    """Attach a per-term table, ``(term, df, ...)``. Both sides are read more than once: store what is costly.

    A common word owns a large share of all rows, so common terms are broadcast: those whose share of all rows is at least
    their share of ``HEAD_BYTES``, which together cannot exceed it. The rows of the others are shuffled by term, and none
    of these owns enough rows to crowd a task. The planner may not broadcast them: stored terms look small to it.
    """
    row_bytes = F.lit(TERM_BYTES) + F.octet_length("term")
    size = per_term.agg(F.sum(row_bytes), F.sum("df")).first()
    if (size[0] or 0) <= HEAD_BYTES:
        return tf.join(F.broadcast(per_term), "term")
    common = F.col("df") * F.lit(float(HEAD_BYTES)) >= row_bytes * F.lit(float(size[1]))
    head, rest = per_term.filter(common), per_term.filter(~common)
    rare = tf.join(F.broadcast(head.select("term")), "term", "left_anti")
    return tf.join(F.broadcast(head), "term").unionByName(rare.join(rest.hint("merge"), "term"))


def dictionary(df_table: DataFrame) -> DataFrame:
    """``(term, df, dim)`` with dims by sorted term."""
    return with_rank(df_table, ["term"], "dim").select("term", "df", F.col("dim").cast("int").alias("dim"))


def tfidf(docs: DataFrame, scorer: str | Callable = "linear", tokens: Column | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sparse TF-IDF vectors in long form: ``(doc_id, term, dim, val)``.

    A term's position is its place in the sorted dictionary. n counts all
    documents, also those without a term.
    """
    score = get_scorer(scorer)
    tf = session.materialize(term_freq(docs, tokens, id_col, text_col))  # texts are parsed once
    terms = dictionary(doc_freq_of(tf))
    n = F.lit(float(docs.select(id_col).count()))
    return join_terms(tf, terms).select(
        "doc_id", "term", "dim",
        score(F.col("tf").cast("double"), F.col("df").cast("double"), n).alias("val"))


def densify(dims, vals, dim: int) -> Column:
    """Index and value arrays -> dense array."""
    @F.arrow_udf("array<double>")
    def dense(at: pa.Array, val: pa.Array) -> pa.Array:
        n = len(at)
        out = np.zeros((n, dim))
        rows = np.repeat(np.arange(n), at.value_lengths().to_numpy(zero_copy_only=False).astype(int))
        out[rows, at.flatten().to_numpy(zero_copy_only=False)] = val.flatten().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
    return dense(dims, vals)


def hashed_vectors(docs: DataFrame, code: str, dim: int, *, headers: list[str] = (),
                   include_quotes: bool = False, strict: bool = False, floor_ratio: bool = False,
                   dense: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Messages as hashed term vectors weighted by a three-letter code.

    Long form ``(doc_id, bucket, val)``, or ``(doc_id, vec)`` when ``dense``. Documents
    without any term have no rows in long form and a zero vector when dense.
    """
    term_weight, corpus_weight, needs_df, cosine = parse_code(code)
    words = tokenize_message(parse_message(text_col, list(headers), include_quotes, strict))
    tf = term_freq(docs, words, id_col)
    weight = term_weight(F.col("tf"))
    if needs_df:
        n = docs.select(id_col).count()
        tf = session.materialize(tf)  # texts are parsed once
        tf = join_terms(tf, session.materialize(doc_freq_of(tf)))
        weight = corpus_weight(weight, F.col("df"), F.lit(n), floor_ratio)
    else:
        weight = corpus_weight(weight, None, None, floor_ratio)
    # partitioned by document once; the sum per bucket and the length then stay in place
    cells = (tf.select("doc_id", hash_term("term", dim).alias("bucket"), weight.alias("w"))
             .repartition("doc_id").groupBy("doc_id", "bucket").agg(F.sum("w").alias("val")))
    if cosine:
        length = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("doc_id")))
        cells = (cells.withColumn("_len", length)
                 .select("doc_id", "bucket",
                         F.when(F.col("_len") > 0, F.col("val") / F.col("_len")).otherwise(0.0).alias("val")))
    if not dense:
        return cells
    packed = cells.groupBy("doc_id").agg(F.collect_list("bucket").alias("_at"),
                                         F.collect_list("val").alias("_val"))
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    return (docs.select(F.col(id_col).alias("doc_id")).join(packed, "doc_id", "left")
            .select("doc_id", F.coalesce("_at", none[0]).alias("_at"),
                    F.coalesce("_val", none[1]).alias("_val"))
            .select("doc_id", densify("_at", "_val", dim).alias("vec")))


def reduce_sparse(long: DataFrame, m: int, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Random projection of long-form rows ``(doc_id, dim, val)`` to ``(doc_id, vec)``.

    The basis entry for (dim, j) is a function of the two numbers, so no basis
    table is stored, moved or joined, whatever the number of terms.
    """
    if m <= UNROLL:
        parts = [F.sum(F.col("val") * gaussian(seed, "dim", F.lit(j))) for j in range(m)]
        return long.groupBy(id_col).agg(F.array(*parts).alias("vec"))
    cells = (long.select(id_col, "dim", "val", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_j"))
             .groupBy(id_col, "_j").agg(F.sum(F.col("val") * gaussian(seed, "dim", "_j")).alias("_x")))
    return cells.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_j", "_x"))), lambda s: s["_x"]).alias("vec"))
