"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.text import only

#: labelled characters that the automaton of a language is built from, and labelled documents fetched to choose them
TRAIN_CHARS, TRAIN_DOCS = 40_000, 64
#: what a text is parsed in: runs of letters and marks, lower case, each with its ends marked
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: the same for a text of ASCII only, where the faster engine finds the same runs
_ASCII_WORD = re.compile(r"[a-z]+")
#: parsed words that a task remembers
CACHE = 1 << 19


def words(text: str) -> list[str]:
    """A text's words in lower case: a letter, then letters and marks."""
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text.lower())


class Automaton:
    """Suffix automaton of a text: every substring is a path from state 0."""

    def __init__(self, text: str):
        self.n = len(text)
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def phrases(self, s: str) -> int:
        """Phrases of the greedy parse: each is the longest match, or a symbol the text does not have."""
        nxt, root = self.next, self.next[0]
        state, count, fresh = root, 0, True
        for ch in s:
            to = state.get(ch)
            if to is None:
                if not fresh:
                    count += 1  # the match so far ends before this symbol
                to = root.get(ch)
                if to is None:
                    count += 1
                    state, fresh = root, True
                    continue
            state, fresh = nxt[to], False
        return count + (not fresh)


class Model:
    """One automaton for each language."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.automata = [Automaton(" " + " ".join(words(texts[lang])) + " ") for lang in self.langs]
        # a phrase of a text of n symbols costs about log2(n) bits
        self.bits = np.array([math.log2(max(a.n, 2)) for a in self.automata])
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, score) of a text."""
        said = words(text) if text else []
        if not said or not self.langs:
            return "und", 0.0
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        for w in set(said).difference(seen):
            seen[w] = tuple(a.phrases(f" {w} ") for a in self.automata)
        count = np.array(list(map(seen.__getitem__, said))).sum(0)
        cost = count * self.bits / sum(map(len, said))
        best = int(np.argmin(cost))
        rest = np.delete(cost, best)
        return self.langs[best], float(rest.min() / (rest.min() + cost[best])) if len(rest) else 1.0


_models: dict[int, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    """Built once in each Python worker; the texts travel, not the automata."""
    key = zlib.crc32(repr(sorted(texts.items())).encode())
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def training_texts(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   *, chars: int = TRAIN_CHARS, sample: int = TRAIN_DOCS) -> dict[str, str]:
    """About ``chars`` characters of labelled text for each language.

    Only rows where ``usable`` holds, with a letter and a label, count; equal texts of a language count once, by their least
    id. Each language gives the ``sample`` texts of least hashed id, of which whole texts are taken in that order, the last
    one as far as it fits, until ``chars`` are there. Ids are ranked before any text is read, and the ranking keeps
    ``sample`` rows of each task, so a hot language is no matter. An empty table, or one without labels, gives no language.
    """
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"),
                        docs[text_col].cast("string").alias("t"), usable.alias("usable"))
    named = named.where(F.col("usable") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("t").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    once = named.groupBy("lang", F.xxhash64("t").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    chosen = once.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).collect()
    rank = {(r.lang, r.doc_id, r.h): r.k for r in chosen}
    got: dict[str, set[tuple[int, str]]] = {}
    if chosen:
        some = named.where(F.col("doc_id").isin(sorted({r.doc_id for r in chosen})))
        for r in some.select("lang", "doc_id", F.xxhash64("t").alias("h"), F.substring("t", 1, chars).alias("t")).distinct().collect():
            if (r.lang, r.doc_id, r.h) in rank:
                got.setdefault(r.lang, set()).add((rank[r.lang, r.doc_id, r.h], r.t))
    out = {}
    for lang, rows in got.items():
        took, n = [], 0
        for _, t in sorted(rows):
            if n < chars:
                took.append(t[:chars - n])
                n += len(took[-1])
        out[lang] = "\n".join(took)
    return out


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each text: the one whose labelled text parses it into the fewest normalised phrases.

    A text is parsed greedily into the longest substrings of a language's text, word by word with the word's ends
    marked, so each word is parsed once in a task and remembered. Phrases times log2 of the language text's length, for
    each letter, estimate the cross entropy; the least wins, ties go to the first name.

    Returns (doc_id, lang_pred, score), one row for each row of ``docs``; ``score`` is the second least cost over the sum
    of the two least (1 if there is one language). Null texts and texts without a letter are ``und`` with score 0, as is
    everything if ``texts`` is empty; rows repeated are judged alike, an empty table gives none. Nothing moves between tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(texts)
        for b in batches:
            said = [model(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([x[0] for x in said], pa.string()),
                                   pa.array([x[1] for x in said], pa.float64())], names=["doc_id", "lang_pred", "score"])
    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, texts: dict[str, str], text_col: str = "text", *, min_score: float = 0.502) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told: neither ``und`` nor a tie of two languages
    (a score below ``min_score``; 0.5 is an exact tie). If there is no labelled text, every text with a letter stays.
    Null and empty texts go, repeated rows stay or go together, an empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(texts)
        for b in batches:
            said = [(t, model(t)) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([x[1] >= min_score if texts else bool(t and words(t)) for t, x in said], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op3_language_id")
def op3(spark, sf):
    docs = documents(spark, sf)
    texts = training_texts(docs, ~held_out(docs["doc_id"]))
    return identify(docs, texts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
