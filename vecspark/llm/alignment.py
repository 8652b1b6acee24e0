"""Two tokenizers aligned over a corpus: which ids of the one stand where ids of the other do, and in how many documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.keys import column
from vecspark.llm.registry import documents, query
from vecspark.llm.sent import Sent
from vecspark.llm.tables import Tables
from vecspark.llm.text import only

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: characters encoded at once, tokens of a chunk (documents count a few, also without any), and id pairs expanded at once
SLICE_CHARS, CHUNK_TOKENS, DOC_TOKENS, PAIRS = 1 << 19, 1 << 20, 16, 1 << 21

#: Fixed value: how byte-level BPE cuts a text into words before it merges bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 characters as themselves and the other bytes, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(a_path: str = A_PATH, b_path: str = B_PATH) -> tuple[bytes, bytes]:
    """The two vocabulary files (a byte-level BPE in JSON, a SentencePiece model), read by the driver and sent to the tasks."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and ``same``: for each id of A the id of B with the same bytes, or -1.

    A's vocabulary runs in tiktoken's engine, which merges by id; that is the order of A's merges, or the file is refused.
    """

    def __init__(self, a_file: bytes, b_file: bytes):
        model, symbol = json.loads(a_file)["model"], byte_of_symbol()
        ranks = {bytes(symbol[c] for c in piece): i for piece, i in model["vocab"].items()}
        first = len(ranks) - len(model["merges"])
        for k, pair in enumerate(model["merges"]):
            if model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] != first + k:
                raise ValueError("the ids of the byte-level vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        n = self.b.get_piece_size()
        byte = [self.b.is_byte(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte[i] else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        of: dict[bytes, int] = {}
        for i in sorted(range(n), key=lambda i: (byte[i], i)):  # a piece before the byte it equals
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of.setdefault(self.b_bytes[i], i)
        self.same = np.array([of.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_len = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int64)
        a_ids, b_ids = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(n)]
        #: how an id is written: of A before another of A, or last in its group; of B likewise
        self.written = np.array([x + "," for x in a_ids] + [x + "|" for x in a_ids] + [x + "," for x in b_ids] + [x + ";" for x in b_ids], object)

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both for a space and the text; none if the text is empty or either does not give these bytes back."""
        if text:
            want = (" " + text).encode()
            a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
            if b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b)):
                return a, b
        return [], []


def _build(files: tuple[bytes, bytes]) -> Tokenizers:
    return Tokenizers(*files)


def _folded(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, their times summed; sorted."""
    value, ix = np.unique(key, return_inverse=True)
    return value, np.bincount(ix, weights=times, minlength=len(value)).astype(np.int64)


def _cross(a: np.ndarray, a0: np.ndarray, na: np.ndarray, b: np.ndarray, b0: np.ndarray, nb: np.ndarray, doc: np.ndarray,
           width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times): all pairs of an id of A and one of B within the given groups, ``PAIRS`` at a time."""
    found = []

    def fold(d, code, times):
        key, n = _folded(d * (1 << 40) + code, times)
        found.append((key, n))

    whole = na * nb <= PAIRS
    for g in np.flatnonzero(~whole):  # a group too large to expand: its different ids, some rows at a time
        x, cx = np.unique(a[a0[g]:a0[g] + na[g]], return_counts=True)
        y, cy = np.unique(b[b0[g]:b0[g] + nb[g]], return_counts=True)
        for at in range(0, len(x), step := max(1, PAIRS // len(y))):
            code = (x[at:at + step, None] * width + y[None, :]).ravel()
            fold(np.full(len(code), doc[g]), code, (cx[at:at + step, None] * cy[None, :]).ravel())
    some = np.flatnonzero(whole)
    part = np.cumsum(na[some] * nb[some]) // PAIRS if len(some) else some
    for p in np.unique(part):
        g = some[part == p]
        n = na[g] * nb[g]
        group = np.repeat(np.arange(len(g)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = a[a0[g][group] + k // nb[g][group]] * width + b[b0[g][group] + k % nb[g][group]]
        fold(doc[g][group], code, np.ones(len(code)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    key, times = _folded(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if len(found) > 1 else found[0]
    return key >> 40, key & ((1 << 40) - 1), times


class _Slice:
    """Some documents encoded and aligned. Their tokens lie one after the other: both tokenizers end where a document ends."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        ids = list(map(t.encode, texts))
        self.n_a = np.array([len(a) for a, _ in ids], np.int64)
        self.n_b = np.array([len(b) for _, b in ids], np.int64)
        a = np.array([x for d, _ in ids for x in d], np.int64)
        b = np.array([x for _, d in ids for x in d], np.int64)
        del ids
        docs = len(texts)
        end_a, end_b = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
        cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        first_a, first_b = np.append(0, last_a + 1)[:-1], np.append(0, last_b + 1)[:-1]
        na, nb = last_a - first_a + 1, last_b - first_b + 1
        doc = np.repeat(np.arange(docs), self.n_a)[first_a]
        self.n_groups = np.bincount(doc, minlength=docs)
        self.n_links = np.bincount(doc, weights=na * nb, minlength=docs).astype(np.int64)
        plain = (na == 1) & (nb == 1)
        plain[plain] = t.same[a[first_a[plain]]] == b[first_b[plain]]
        odd = ~plain
        width = len(t.b_bytes)
        d, code, times = _cross(a, first_a[odd], na[odd], b, first_b[odd], nb[odd], doc[odd], width)
        as_plain = t.same[code // width] == code % width  # same bytes, though in a larger group
        key = np.concatenate([doc[plain] << 32 | a[first_a[plain]], d[as_plain] << 32 | code[as_plain] // width])
        key, n = _folded(key, np.concatenate([np.ones(int(plain.sum())), times[as_plain]]))
        self.ids, self.id_doc, self.id_times = key & 0xFFFFFFFF, key >> 32, n
        self.codes, self.code_doc, self.code_times = code[~as_plain], d[~as_plain], times[~as_plain]
        # groups as text: a group's ids of A, then its ids of B
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + first_b[group_a]] = a + cut_a * len(t.a_bytes)
        order[np.arange(len(b)) + last_a[group_b] + 1] = b + 2 * len(t.a_bytes) + cut_b * len(t.b_bytes)
        end = np.cumsum(self.n_a + self.n_b)
        self.sha = [hashlib.sha256("".join(t.written[order[e - n:e]])[:-1].encode()).hexdigest() if n else ""
                    for e, n in zip(end.tolist(), (self.n_a + self.n_b).tolist())]


def _lists(values: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """One list of each document; ``doc`` ascends."""
    ends = np.searchsorted(doc, np.arange(docs + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int64)))


_COLUMNS = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "whole", "ids", "id_times", "codes", "code_times"]
_SCHEMA = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, whole boolean, "
           "ids array<long>, id_times array<long>, codes array<long>, code_times array<long>")


def _chunk_rows(chunk: int, ids: list, parts: list[_Slice], a_size: int) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, their pairs as places in the chunk's sorted pairs; then the chunk itself: in how many of its
    documents each id (a vector over the vocabulary) and each other pair is linked."""
    codes, held = np.unique(np.concatenate([p.codes for p in parts]), return_counts=True)
    vector = np.zeros(a_size, np.int64)
    at = 0
    for p in parts:
        vector += np.bincount(p.ids, minlength=a_size)
        n = len(p.n_a)
        yield pa.record_batch([
            pa.array(np.full(n, chunk)), pa.array(ids[at:at + n], pa.int64()), pa.array(p.n_a), pa.array(p.n_b), pa.array(p.n_groups),
            pa.array(p.n_links), pa.array(p.sha, pa.string()), pa.array(np.zeros(n, bool)),
            _lists(p.ids, p.id_doc, n), _lists(p.id_times, p.id_doc, n),
            _lists(np.searchsorted(codes, p.codes), p.code_doc, n), _lists(p.code_times, p.code_doc, n)], names=_COLUMNS)
        at += n
    some = np.flatnonzero(vector)
    null = pa.array([None], pa.int64())
    one = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
    yield pa.record_batch([pa.array([chunk]), null, null, null, null, null, pa.array([None], pa.string()), pa.array([True]),
                           one(some), one(vector[some]), one(codes), one(held)], names=_COLUMNS)


def _align(sent: Sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.made(_build)
        chunk, tokens = TaskContext.get().partitionId() << 32, 0
        ids, parts, texts, chars = [], [], [], 0

        def aligned():
            nonlocal texts, chars, tokens
            parts.append(_Slice(t, texts))
            tokens += int(parts[-1].n_a.sum()) + DOC_TOKENS * len(texts)
            texts, chars = [], 0

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                chars += len(text or "") + DOC_TOKENS
                if chars >= SLICE_CHARS:
                    aligned()
                    if tokens >= CHUNK_TOKENS:
                        yield from _chunk_rows(chunk, ids, parts, len(t.a_bytes))
                        chunk, tokens, ids, parts = chunk + 1, 0, [], []
        if texts:
            aligned()
        if parts:
            yield from _chunk_rows(chunk, ids, parts, len(t.a_bytes))
    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(plain: np.ndarray, best: np.ndarray, width: int):
    """Per document, its links' counts: same-bytes ids from the vector, other pairs from the chunk's answers."""
    def total(lists: pa.ChunkedArray, times: pa.ChunkedArray, of: np.ndarray, n: int) -> np.ndarray:
        lists, times = lists.combine_chunks(), times.combine_chunks()
        doc = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
        out = np.zeros(n, np.int64)
        np.add.at(out, doc, of[np.asarray(lists.flatten())] * np.asarray(times.flatten()))
        return out

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        code = np.asarray(column(answers, "code").cast(pa.int64()))
        order = np.argsort(code)
        n_of, code = np.asarray(column(answers, "n").cast(pa.int64()))[order], code[order]
        n = docs.num_rows
        ids, codes = (docs.column("ids"), docs.column("id_times")), (docs.column("codes"), docs.column("code_times"))
        count = total(*ids, plain, n) + total(*codes, n_of, n)
        top = total(*ids, (plain == best).astype(np.int64), n) + total(*codes, (n_of == best[code // width]).astype(np.int64), n)
        same = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*same, pa.array(top), pa.array(count), docs.column("groups_sha256")],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


@dataclass
class Alignment:
    """``pairs``: (a, b, n), every linked id pair and the number of documents that hold it; ``documents``: one row for each text."""

    pairs: DataFrame
    documents: DataFrame


def align(docs: DataFrame, files: tuple[bytes, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    """Aligns the ids of two tokenizers, A (byte-level BPE) and B (SentencePiece), over all texts.

    A encodes a space and the text, B the text; offsets where tokens of both end cut a text into groups, and every id of A in a
    group is linked with every id of B in it. A group of one id each with the same bytes needs no pair: an array tells B's
    id, and a vector over A's vocabulary counts the documents. Only other groups give pairs, which are folded over a chunk of
    documents before they are shuffled; so a pair has one row for each chunk at most, however many documents
    hold it, and the counts return to the documents by chunk.

    ``documents`` has (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``:
    ``n_best`` is the number of links whose pair is, ties included, the most widely held of its id of A, ``count_sum`` the sum of
    the links' counts. A text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens:
    zeros and an empty digest. Null ids are kept, rows repeated count as documents of their own, other columns are not read,
    an empty table gives empty tables. A very long text is a chunk of its own.
    """
    spark: SparkSession = docs.sparkSession
    files = files or load()
    t, tables = _build(files), Tables(spark)
    a_size, width = len(t.a_bytes), len(t.b_bytes)
    each = tables.store(only(docs, id_col, text_col).mapInArrow(_align(Sent(spark, "tokenizers", files)), _SCHEMA))
    chunks = each.where("whole")
    held = lambda ids, n: F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(n).alias("n"))).alias("p")
    plain = np.zeros(a_size, np.int64)  # one entry for each id of the vocabulary
    for r in (chunks.select(held("ids", "id_times")).groupBy("p.id").agg(F.sum("p.n").alias("n"))).collect():
        plain[r.id] = r.n
    asked = chunks.select("chunk", held("codes", "code_times")).select("chunk", F.col("p.id").alias("code"), F.col("p.n").alias("n"))
    counts = tables.store(asked.groupBy("code").agg(F.sum("n").alias("n")))
    best = plain.copy()
    for r in counts.groupBy(F.floor(F.col("code") / width).cast("long").alias("a")).agg(F.max("n").alias("n")).collect():
        best[r.a] = max(best[r.a], r.n)
    answers = asked.select(F.col("chunk").alias("to"), "code").join(counts, "code")
    texts = each.where("not whole").drop("whole")
    done = texts.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(_counted(plain, best, width), _OUT)
    same = [(i, int(t.same[i]), int(plain[i])) for i in np.flatnonzero(plain).tolist()]
    pairs = spark.createDataFrame(same, "a long, b long, n long").union(counts.select(
        F.floor(F.col("code") / width).cast("long"), F.col("code") % width, "n"))
    return Alignment(pairs, done)


@query("op12_alignment")
def op12(spark, sf):
    return align(documents(spark, sf)).documents
