"""Benchmark items in training texts: BM25 with block-max WAND, then a check of question and answer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.tables import Tables
from vecspark.llm.text import only

K1, B = 1.2, 0.75
#: share of an item's own score from which a passage is retrieved, and shares of its question and answer that must recur
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.8, 0.8
#: words of a question's shingles, of an answer's, and of an answer when the item is one sentence
SHINGLE, ANSWER_SHINGLE, ANSWER_WORDS = 5, 2, 5
#: postings in a block; characters of the items that one index holds
BLOCK, INDEX_CHARS = 8, 4 << 20
#: bytes of the table of impacts by range of items
RANGE_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shingles(w: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(w)} if len(w) <= n else set(zip(*[w[k:] for k in range(n)]))


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence, its last words. Short items are a question only."""
    parts = [p for p in (words(s) for s in _SENTENCE.split(text)) if p]
    if not parts:
        return [], []
    if len(parts) == 1:
        w = parts[0]
        return (w[:-ANSWER_WORDS], w[-ANSWER_WORDS:]) if len(w) > 2 * ANSWER_WORDS else (w, [])
    return [x for p in parts[:-1] for x in p], parts[-1]


class Index:
    """Inverted index of items. Impacts are divided by the item's score for itself, so one threshold serves all.

    ``total``, ``mean``, ``longest`` and ``df`` are those of all items, also when this index holds a part of them."""

    def __init__(self, items: list[tuple[int, str]], total: int, mean: float, longest: int, df: dict[str, int]):
        kept = [(i, t, w) for i, t in items if (w := words(t or ""))]
        self.ids = [i for i, _, _ in kept]
        self.span = max(16, longest)
        counts = [Counter(w) for _, _, w in kept]
        post: dict[str, list[tuple[int, float]]] = {}
        for n, (c, (_, _, w)) in enumerate(zip(counts, kept)):
            weight = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1)
                      / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in c.items()}
            own = sum(weight.values())
            for t, x in weight.items():
                post.setdefault(t, []).append((n, x / own))
        self.number = {t: k for k, t in enumerate(post)}
        self.docs = [[n for n, _ in p] for p in post.values()]
        self.impact = [[x for _, x in p] for p in post.values()]
        self.top = np.array([*(max(i) for i in self.impact), 0.0])  # the last one stands for words of no item
        # greatest impact of each term within each range of items: what a passage can reach there, for all ranges at once
        self.width = width = max(BLOCK, -(-len(kept) * (len(post) + 1) * 4 // RANGE_BYTES))
        self.ranges = np.zeros((len(post) + 1, -(-len(kept) // width)), np.float32)
        for k, (docs, impact) in enumerate(zip(self.docs, self.impact)):
            np.maximum.at(self.ranges[k], np.array(docs) // width, np.array(impact, np.float32))
        self.block_top = [[max(i[a:a + BLOCK]) for a in range(0, len(i), BLOCK)] for i in self.impact]
        qa = [question_and_answer(t) for _, t, _ in kept]
        self.question = [_shingles(q, SHINGLE) for q, _ in qa]
        self.answer = [_shingles(a, ANSWER_SHINGLE) if a else set() for _, a in qa]

    def search(self, terms: list[int], threshold: float, first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items from ``first`` to before ``end`` that reach the threshold, by block-max WAND.

        Cursors stand in the order of their items. The pivot is the first at which the lists' greatest impacts reach
        the threshold: nothing before it can. If the blocks around the pivot cannot reach it either, all lists jump
        behind the nearest of those blocks' ends.
        """
        end = len(self.ids) if end is None else end
        cursor, out = [], []
        for t in terms:
            at = bisect_left(self.docs[t], first)
            if at < len(self.docs[t]) and self.docs[t][at] < end:
                cursor.append([self.docs[t][at], t, at])
        while cursor:
            cursor.sort()
            bound, p = 0.0, -1
            for k, (doc, t, _) in enumerate(cursor):
                bound += self.top[t]
                if bound >= threshold:
                    p = k
                    break
            if p < 0:
                return out
            pivot = cursor[p][0]
            while p + 1 < len(cursor) and cursor[p + 1][0] == pivot:
                p += 1
            bound, nearest = 0.0, end
            for c in cursor[:p + 1]:
                docs, t = self.docs[c[1]], c[1]
                at = bisect_left(docs, pivot, c[2])
                if at < len(docs):
                    bound += self.block_top[t][at // BLOCK]
                    nearest = min(nearest, docs[min((at // BLOCK + 1) * BLOCK, len(docs)) - 1])
            if bound < threshold:
                target = nearest + 1
                if p + 1 < len(cursor):
                    target = min(target, cursor[p + 1][0])
                target = max(target, pivot + 1)
                moved = cursor[:p + 1]
            elif cursor[0][0] == pivot:
                score = sum(self.impact[t][at] for _, t, at in cursor[:p + 1])
                if score >= threshold:
                    out.append((pivot, float(score)))
                target, moved = pivot + 1, cursor[:p + 1]
            else:
                target, moved = pivot, [c for c in cursor[:p + 1] if c[0] < pivot]
            for c in moved:
                c[2] = bisect_left(self.docs[c[1]], target, c[2])
                c[0] = self.docs[c[1]][c[2]] if c[2] < len(self.docs[c[1]]) else end
            cursor = [c for c in cursor if c[0] < end]
        return out

    def hits(self, text: str, threshold: float) -> dict[int, tuple[float, float, float]]:
        """Item: (score, question overlap, answer overlap) of the best passage, for items retrieved from any passage.

        Passages are twice the longest item and start every such length, so an item lies whole in one of them.
        """
        w = words(text)
        if not w or not self.ids:
            return {}
        t = np.fromiter((self.number.get(x, -1) for x in w), np.int64, len(w))
        sums = np.add.reduceat(self.ranges[t], np.arange(0, len(w), self.span), axis=0)
        sums = (sums[:-1] + sums[1:] if len(sums) > 1 else sums).max(axis=1)
        best: dict[int, tuple[float, float, float]] = {}
        for c in np.flatnonzero(sums >= threshold - 1e-4):  # repeated words count again: a bound, before the exact one
            a, b = int(c) * self.span, (int(c) + 2) * self.span
            terms = np.unique(t[a:b])
            terms = terms[terms >= 0]
            reach, terms, found = np.flatnonzero(self.ranges[terms].sum(axis=0) >= threshold - 1e-4), terms.tolist(), []
            for r in reach.tolist():
                found += self.search(terms, threshold - 1e-9, r * self.width, min((r + 1) * self.width, len(self.ids)))
            if not found:
                continue
            five, two = _shingles(w[a:b], SHINGLE), _shingles(w[a:b], ANSWER_SHINGLE)
            for n, score in found:
                q = self._overlap(self.question[n], w[a:b], five, SHINGLE)
                r = self._overlap(self.answer[n], w[a:b], two, ANSWER_SHINGLE)
                key = (min(q / MIN_QUESTION, 1.0) + min(r / MIN_ANSWER, 1.0), score)
                if n not in best or key > best[n][3]:
                    best[n] = (score, q, r, key)
        return {n: x[:3] for n, x in best.items()}

    @staticmethod
    def _overlap(want: set[tuple[str, ...]], passage: list[str], have: set[tuple[str, ...]], width: int) -> float:
        if not want:
            return 1.0
        size = len(next(iter(want)))
        if size < width:  # shorter than a shingle
            have = set(zip(*[passage[k:] for k in range(size)]))
        return len(want & have) / len(want)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, t, n, len(w)) for p, text in zip(b.column("part").to_pylist(), b.column("t").to_pylist())
                if (w := words(text)) for n, t in enumerate(dict.fromkeys(w))]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, types)], names=["part", "term", "n", "length"])


class Indexes:
    """The indexes of a set of items, built one after the other as they are asked for: the driver holds one at a time."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, chars: int):
        tables = Tables(items.sparkSession)
        rows = items.select(items[id_col].cast("long").alias("i"), items[text_col].cast("string").alias("t")).where("t IS NOT NULL")
        self.parts = int((rows.agg(F.sum(F.length("t"))).first()[0] or 0) // chars + 1)
        part = F.pmod(F.xxhash64("i", "t"), F.lit(self.parts)).cast("int")
        self.items = tables.store(rows.withColumn("part", part))
        terms = tables.store(self.items.mapInArrow(_item_terms, "part int, term string, n long, length long"))
        # each item has one row for every different word; its first one stands for the item
        head = terms.where("n = 0").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
        self.total, self.mean, self.longest = head[0], head[1] / max(1, head[0]), head[2]
        held = terms.groupBy("part", "term").agg(F.count("*").alias("here"))
        self.df = tables.store(held.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term"))

    def __iter__(self) -> Iterator[Index]:
        for k in range(self.parts):
            df = {r.term: r.df for r in self.df.where(F.col("part") == k).collect()}
            rows = sorted((r.i if r.i is not None else -1, r.t) for r in self.items.where(F.col("part") == k).collect())
            yield Index(rows, self.total, self.mean, self.longest, df)


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, chars: int = INDEX_CHARS) -> Indexes:
    """Indexes of at most about ``chars`` characters each, so that each is small enough to go to every task.

    Items are spread by a hash over as many indexes as their total length asks for. Document frequencies, mean and
    greatest length are taken over all items, so a score does not depend on the number of indexes. A null text is no
    item, a null id counts as -1, items repeated are items of their own, of equal scores the lesser id comes first, an
    empty table gives an index that finds nothing; other columns are not read.
    """
    return Indexes(items, id_col, text_col, chars)


def _verified(index: Index, text: str | None, threshold: float, question: float, answer: float):
    return [(index.ids[n], *x) for n, x in sorted(index.hits(text or "", threshold).items()) if x[1] >= question and x[2] >= answer]


def contaminations(docs: DataFrame, found: Indexes, id_col: str = "doc_id", text_col: str = "text", *,
                   min_score: float = MIN_SCORE, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """Documents that hold a benchmark item.

    Every passage of every document is a query; every item whose score reaches ``min_score`` of its score for itself
    is retrieved, and counts if enough of its question's five-word shingles and its answer's two-word shingles recur.

    Returns (doc_id, item_id, score, question_overlap, answer_overlap): one row for each pair of a row of ``docs`` and
    an item, with the figures of the best passage. Null and empty texts hold nothing; repeated rows report each; items
    of the same text are found together. Nothing moves between tasks; large item sets take one pass for each index.
    """
    d, out = only(docs, id_col, text_col), None
    for index in found:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *x) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                        for x in _verified(index, t, min_score, min_question, min_answer)]
                types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)],
                                      names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        part = d.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, found: Indexes, text_col: str = "text", *, min_score: float = MIN_SCORE,
                         min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Null and empty texts hold nothing and stay, repeated
    rows stay or go together, without items every row stays."""
    at = docs.columns.index(text_col)
    for index in found:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not _verified(index, t, min_score, min_question, min_answer)
                                         for t in b.column(at).to_pylist()], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@query("op4_decontaminate")
def op4(spark, sf):
    return contaminations(documents(spark, sf), indexes(benchmark(spark, sf)))
