"""Documents drawn like a target distribution: hashed one- and two-word features, log-ratio weights, Gumbel top-k."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.running import running_sum
from vecspark.llm.sent import Sent
from vecspark.llm.tables import Tables
from vecspark.llm.text import only

BUCKETS = 10_000
#: frequent words and pairs that are sent to every task, and the longest of their words in bytes: 65,536 x 64 + 131,072 x 129 bytes at most
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 16, 1 << 17, 64
#: different words, and different pairs, that a task holds while it counts or hashes, and words it takes at once
HELD, SLICE_WORDS = 1 << 18, 1 << 17
#: how often a feature must stand in what a task has counted to be told: rarer ones are no help in the head
TOLD = 4
#: longest word, in bytes, by which a CRC is continued with tables
STEPS = 64
#: share of the documents of at least so many words that is drawn, and the seed of the draw
PERCENT, MIN_WORDS, SEED = 25, 20, "7"

#: words are runs of ASCII letters and digits and of all bytes of other characters; A-Z become a-z, what is left a space
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def slices(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of some texts after another, and how many each text has; a long text makes a slice by itself."""
    words, counts = [], []
    for t in texts:
        w = word_list(t.as_py())
        words += w
        counts.append(len(w))
        if len(words) >= SLICE_WORDS:
            yield words, np.array(counts, np.int64)
            words, counts = [], []
    if counts:
        yield words, np.array(counts, np.int64)


def pair_places(counts: np.ndarray) -> np.ndarray:
    """Where in the words of a slice a pair starts: everywhere but at each text's last word."""
    keep = np.ones(int(counts.sum()), bool)
    keep[np.cumsum(counts)[counts > 0] - 1] = False
    return np.flatnonzero(keep)


class Vocabulary(dict):
    """Numbers of words; each word's CRC-32, the state that the CRC of "word " leaves, and its bytes."""

    def __init__(self, words: list[bytes] = ()):
        super().__init__()
        self.crc, self.state, self.size = array("I"), array("I"), array("I")
        for w in words:
            self[w]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crc)
        c = crc32(word)
        self.crc.append(c)
        self.state.append(crc32(b" ", c))
        self.size.append(len(word))
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _steps() -> np.ndarray:
    """For each length, what each byte of a CRC state becomes after so many zero bytes. CRCs are linear: the CRC of a text that
    goes on from a state is that of the text alone, with the state carried over its length."""
    zeros = [bytes(n) for n in range(STEPS + 1)]
    return np.array([[[crc32(z, v << 8 * k) ^ crc32(z) for v in range(256)] for k in range(4)] for z in zeros], np.uint32)


class Head:
    """The frequent words' CRCs and states, and the frequent pairs' buckets. A shortcut only: every feature has the bucket of
    its own CRC, whether it is in here or not."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        self.frequent = words
        self.words = Vocabulary(words)
        self.n = len(words)
        split = [p.split(b" ") for p in pairs]
        known = [(self.words[a] * self.n + self.words[b], crc32(p) % BUCKETS) for p, (a, b) in zip(pairs, split)
                 if a in self.words and b in self.words]
        self.pairs, self.pair_bucket = np.array(sorted(known), np.int64).reshape(-1, 2).T
        self.steps = _steps()

    def buckets(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words, and of the pairs that :func:`pair_places` names."""
        if len(self.words) > self.n + HELD:  # tail words are kept for as long as there is room
            self.words = Vocabulary(self.frequent)
        i = self.words.numbers(words)
        crc, state = (np.array(x, np.uint32) for x in (self.words.crc, self.words.state))
        at = pair_places(counts)
        a, b = i[at], i[at + 1] if len(at) else at
        two = np.full(len(at), -1, np.int64)
        if len(self.pairs):
            both = np.flatnonzero((a < self.n) & (b < self.n))
            code = a[both] * self.n + b[both]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[place] == code
            two[both[hit]] = self.pair_bucket[place[hit]]
        tail = np.flatnonzero(two < 0)  # goes on from its first word's state
        x, y = state[a[tail]], b[tail]
        n = np.array(self.words.size, np.uint32)[y]
        short = np.minimum(n, STEPS)
        direct = crc[y] ^ self.steps[short, 0, x & 255] ^ self.steps[short, 1, x >> 8 & 255] ^ self.steps[short, 2, x >> 16 & 255] ^ self.steps[short, 3, x >> 24]
        for k in np.flatnonzero(n > STEPS):
            direct[k] = crc32(words[at[tail[k]] + 1], int(x[k]))
        two[tail] = direct % BUCKETS
        return crc[i].astype(np.int64) % BUCKETS, two


def _head(sent: Sent) -> Head:
    return sent.made(lambda value: Head(*value))


class _Counter:
    """Words and pairs of a task, counted by number; told and forgotten once ``HELD`` different words are held."""

    def __init__(self):
        self.words = Vocabulary()
        self.n = np.zeros(0, np.int64)
        self.pairs, self.pair_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], counts: np.ndarray) -> None:
        i, at = self.words.numbers(words), pair_places(counts)
        n = np.bincount(i, minlength=len(self.words))
        n[:len(self.n)] += self.n
        self.n = n
        code, times = np.unique(i[at] << 32 | (i[at + 1] if len(at) else at), return_counts=True)
        code, ix = np.unique(np.concatenate([self.pairs, code]), return_inverse=True)
        times = np.bincount(ix, weights=np.concatenate([self.pair_n, times]), minlength=len(code)).astype(np.int64)
        least = 1
        while (times > least).sum() > HELD:
            least *= 2
        some = times > least if len(code) > HELD else slice(None)
        self.pairs, self.pair_n = code[some], times[some]

    def told(self) -> pa.RecordBatch:
        name = np.array([*self.words, b""], object)[:-1]
        short = np.array(self.words.size, np.int64) <= HEAD_BYTES
        one = np.flatnonzero(short & (self.n >= TOLD))
        a, b = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        two = np.flatnonzero(short[a] & short[b] & (self.pair_n >= TOLD))
        keys = name[one].tolist() + [b"%b %b" % p for p in zip(name[a[two]], name[b[two]])]
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(np.concatenate([self.n[one], self.pair_n[two]]))], names=["key", "n"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = _Counter()
    for b in batches:
        for words, counts in slices(b.column("text")):
            count.add(words, counts)
            if len(count.words) > HELD:
                yield count.told()
                count = _Counter()
    yield count.told()


def frequent(docs: DataFrame, text_col: str = "text") -> tuple[list[bytes], list[bytes]]:
    """The words and pairs found most often in all texts; at most ``HEAD_WORDS`` and ``HEAD_PAIRS`` reach the driver.

    Every task counts all of its texts and tells what it has met ``TOLD`` times or more; what is rarer there, or let go to make
    room, may be missing from a sum, so near the end of the head a feature may stand for one slightly more frequent. No
    result depends on which features are in the head. A histogram of the sums, by steps of a sixteenth of a doubling,
    says from which sum on the features fit.
    """
    counts = (docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(_frequent, "key binary, n long")
              .groupBy("key").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = Tables(docs.sparkSession).store(counts.withColumns({"pair": F.position(F.lit(b" "), F.col("key")) > 0, "step": step}))
    rows = counts.groupBy("pair", "step").agg(F.count("*").alias("n")).collect()
    out = []
    for pair, most in ((False, HEAD_WORDS), (True, HEAD_PAIRS)):
        from_, room = None, most
        for r in sorted((r for r in rows if r.pair == pair), key=lambda r: -r.step):
            room -= r.n
            if room < 0:
                break
            from_ = r.step
        some = [] if from_ is None else counts.where((F.col("pair") == pair) & (F.col("step") >= from_)).select("key").collect()
        out.append(sorted(bytes(r.key) for r in some))
    return out[0], out[1]


def bucket_totals(docs: DataFrame, head: Sent, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; ``BUCKETS`` sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _head(head), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for words, counts in slices(b.column("text")):
                for part in known.buckets(words, counts):
                    total += np.bincount(part, minlength=BUCKETS)
        yield pa.record_batch([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "bucket long, n long").where("n > 0")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Each bucket's log ratio in thousandths, both sides smoothed by one: what a feature there says for the target."""
    s, t = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return [math.floor(1000 * math.log(((int(y) + 1) * s) / ((int(x) + 1) * t))) for x, y in zip(source, target)]


def weights(docs: DataFrame, gain: list[int], head: Sent, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of a text's features, rounded down; 0 without features."""
    worth = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _head(head)
        for b in batches:
            at = 0
            for words, counts in slices(b.column("text")):
                one, two = known.buckets(words, counts)
                text = np.repeat(np.arange(len(counts)), counts)
                total = np.zeros(len(counts), np.int64)
                np.add.at(total, text, worth[one])
                np.add.at(total, text[pair_places(counts)], worth[two])
                features = counts + np.maximum(counts - 1, 0)
                yield pa.record_batch([b.column("doc_id").slice(at, len(counts)), pa.array(counts), pa.array(features),
                                       pa.array(total // np.maximum(features, 1))], names=["doc_id", "n_words", "n_features", "weight"])
                at += len(counts)
    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """Every document's weight towards the texts of ``target``, its Gumbel score, and its rank among those drawn.

    Features are all words and all pairs of consecutive words, each counted in the bucket of its CRC-32; a bucket's gain is the log
    of its share in ``target`` over its share in ``docs``, a document's weight the mean gain of its features. Weight plus a
    Gumbel draw, a function of seed and id, is the score. Of the documents of at least ``min_words`` words, ``percent``
    in a hundred, rounded down, of highest score are drawn: a sample without replacement in which documents like
    the target are likelier. Ties go to the smaller id.

    Returns (doc_id, n_words, n_features, weight, score, rank), one row for each row of ``docs``; ``rank`` counts from 1 and is
    null for rows not drawn. Null and empty texts have no features and weight 0. Null ids draw as an empty id and come
    last among ties; rows repeated are ranked one after the other. Other columns are not read. An empty target makes
    every gain follow the documents alone; an empty table gives none.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    head = Sent(spark, "head", frequent(docs, text_col))
    gain = gains(bucket_totals(docs, head, text_col), bucket_totals(target, head, target_text))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((h.cast("long") + 0.5) / 4294967296.0)))
    each = tables.store(weights(docs, gain, head, id_col, text_col).withColumn("score", F.col("weight") + gumbel))
    able = each.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = running_sum(tables, able, [F.desc("score"), F.col("doc_id").asc_nulls_last()], F.lit(1), "before")
    rank = F.when(F.col("before") < drawn, F.col("before") + 1).cast("long").alias("rank")
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*cols, rank).union(each.where(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long")))


@query("op13_resampling")
def op13(spark, sf):
    out = resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
