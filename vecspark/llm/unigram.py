"""Encoding texts to pieces by Viterbi over a double-array trie, and decoding them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query

#: where the query's vocabulary lies; any SentencePiece model with byte pieces will do
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: a space inside a buffer: no byte of UTF-8, so a mark that the text itself holds stays apart and falls back to bytes
SPACE = b"\xff"
#: a text as chunks; no piece has a mark after anything else, so none crosses from one chunk to the next
_CHUNK = re.compile(rb"\xff*[^\xff]+|\xff+")
#: cached chunks of a task
CACHE = 1 << 17


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: the trie's base, check and piece at each cell, scores, bytes of each piece, and byte pieces."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    flat: np.ndarray
    offset: np.ndarray
    byte_id: np.ndarray
    unknown: float
    longest: int


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of cell s under byte c is base[s] + c + 1 if check there says s."""
    tree: dict = {}
    for key, value in keys.items():
        node = tree
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = value
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], free, todo = 0, 1, [(0, tree)]
    for s, node in todo:
        value[s] = node.pop(-1, -1)
        if not node:
            continue
        kids = sorted(k + 1 for k in node)
        b, tried = max(0, free - kids[0]), 0
        while True:
            if b + 257 >= len(base):
                base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
            if all(check[b + k] < 0 for k in kids):
                break
            b, tried = b + 1, tried + 1
        base[s] = b
        for k in kids:
            check[b + k] = s
        # a crowded stretch is left behind, holes and all
        free = b if tried > 64 else free
        while check[free] >= 0:
            free += 1
        todo.extend((b + k, node[k - 1]) for k in kids)
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    """Reads a SentencePiece model file on the driver. Scores are taken as log scores, whatever trained them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    keys, score, texts, byte_id = {}, [], [], np.full(256, -1, np.int32)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        score.append(sp.get_score(i))
        if sp.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} has a mark after other characters")
            texts.append(p.encode().replace(MARK.encode(), SPACE))
            keys[texts[-1]] = i
    if (byte_id < 0).any():
        raise ValueError("the vocabulary has no pieces for single bytes")
    base, check, piece = double_array(keys)
    normal = [score[i] for i in keys.values()]
    return Pieces(base, check, piece, np.array(score, np.float64), np.frombuffer(b"".join(texts), np.uint8),
                  np.concatenate([[0], np.cumsum([len(t) for t in texts])]), byte_id, min(normal) - 10.0, max(map(len, keys)))


def ragged(flat: np.ndarray, offset: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number ``which`` of (flat, offset), one after the other, and their lengths."""
    n = (offset[1:] - offset[:-1])[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(offset[which], n)
    return flat[at], n


def segment(v: Pieces, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of each chunk, as (ids, offsets). All chunks take their steps together.

    The best segmentation has the greatest sum of scores; of equal ones the piece that ends first in question starts
    earliest. A character that no piece stands for costs ``v.unknown`` and becomes its bytes.
    """
    buf = np.frombuffer(b"".join(chunks), np.uint8)
    length = np.array([len(c) for c in chunks], np.int64)
    begin = np.cumsum(length) - length
    n = len(buf)
    head = (buf & 0xC0) != 0x80  # a character starts here
    limit = np.repeat(begin + length, length)
    start = np.flatnonzero(head)
    nxt = np.append(start[1:], n)
    width = nxt - start  # chunks start at characters, so no character crosses a chunk
    # every piece that starts anywhere
    at, state, depth = start, np.zeros(len(start), np.int64), 0
    m_start, m_end, m_id = [], [], []
    while len(at):
        ok = at + depth < limit[at]
        at, state = at[ok], state[ok]
        cell = v.base[state] + buf[at + depth].astype(np.int64) + 1
        ok = v.check[cell] == state
        at, state = at[ok], cell[ok]
        depth += 1
        hit = v.piece[state] >= 0
        m_start.append(at[hit])
        m_end.append(at[hit] + depth)
        m_id.append(v.piece[state][hit].astype(np.int64))
    s, e, i = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (m_start, m_end, m_id))
    single = np.zeros(n + 1, bool)
    whole = np.zeros(n + 1, np.int64)
    whole[start] = nxt
    single[s[e == whole[s]]] = True
    lone = start[~single[start]]
    s, e, i = np.concatenate([s, lone]), np.concatenate([e, whole[lone]]), np.concatenate([i, np.full(len(lone), -1)])
    cost = np.where(i < 0, v.unknown, v.score[i])
    where = np.repeat(begin, length)
    rel = e - where[s]  # how far into its chunk a match ends; a chunk's positions lie at begin + chunk number .. so as not to overlap
    slot = np.arange(len(chunks)).repeat(length)
    ps, pe = s + slot[s], e + slot[s]
    order = np.lexsort((ps, pe, rel))
    ps, pe, i, cost, rel, s = ps[order], pe[order], i[order], cost[order], rel[order], s[order]
    best = np.full(n + len(chunks) + 1, -np.inf)
    best[begin + np.arange(len(chunks))] = 0.0
    via = np.full(n + len(chunks) + 1, -1, np.int64)
    step = np.flatnonzero(np.concatenate(([True], rel[1:] != rel[:-1]))) if len(rel) else np.zeros(0, np.int64)
    for a, b in zip(step, np.append(step[1:], len(rel))):
        to, c = pe[a:b], best[ps[a:b]] + cost[a:b]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        top = np.maximum.reduceat(c, first)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(to))))
        win = np.flatnonzero(c == top[run])
        keep = np.concatenate(([True], run[win][1:] != run[win][:-1]))
        best[to[first]] = top
        via[to[first]] = a + win[keep]
    # back from the ends, all chunks at once; a lone character gives as many ids as it has bytes
    pos, lane = begin + length + np.arange(len(chunks)), np.arange(len(chunks))
    floor = begin + np.arange(len(chunks))
    out_lane, out_match, turn, k = [], [], [], 0
    while len(pos):
        live = pos > floor[lane]
        pos, lane = pos[live], lane[live]
        m = via[pos]
        out_lane.append(lane)
        out_match.append(m)
        turn.append(np.full(len(m), -k))
        pos = ps[m]
        k += 1
    lanes, match, turn = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_lane, out_match, turn))
    order = np.lexsort((turn, lanes))
    lanes, match = lanes[order], match[order]
    ids, n_ids = i[match], np.where(i[match] < 0, pe[match] - ps[match], 1)
    flat = np.repeat(ids, n_ids)
    gap = np.flatnonzero(flat < 0)
    byte_at = np.repeat(s[match], n_ids) + (np.arange(len(flat)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids))
    flat[gap] = v.byte_id[buf[byte_at[gap]]]
    per = np.bincount(np.repeat(lanes, n_ids), minlength=len(chunks))
    return flat.astype(np.int32), np.concatenate([[0], np.cumsum(per)])


class _Encoder:
    """Chunks seen in this task, with their pieces."""

    def __init__(self, v: Pieces):
        self.v, self.number = v, {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > CACHE:
            self.__init__(self.v)
        split = [_CHUNK.findall(SPACE + t.encode().replace(b" ", SPACE)) if t else [] for t in texts]
        new = list({c for s in split for c in s}.difference(self.number))
        if new:
            flat, offset = segment(self.v, new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.offset = np.concatenate([self.offset, offset[1:] + self.offset[-1]])
            self.flat = np.concatenate([self.flat, flat])
        n = [len(s) for s in split]
        which = np.fromiter((self.number[c] for s in split for c in s), np.int64, sum(n))
        ids, k = ragged(self.flat, self.offset, which)
        ends = np.concatenate([[0], np.cumsum(k)])
        return ids, ends[np.concatenate([[0], np.cumsum(n)])]


#: texts that are encoded together: enough to share the steps, few enough to keep the buffers small
TOGETHER = 256


def encode(docs: DataFrame, v: Pieces, text_col: str = "text", *, ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` (array<int>) to ``docs``: the pieces of each text, as SentencePiece writes them.

    A space is put first, and spaces become marks; nothing else is normalised. Characters without a piece, and marks
    that the text itself holds, fall back to bytes, so decoding gives back every text exactly. Null stays null, an
    empty text has no pieces. Other columns pass as they are; ``ids_col`` replaces a column of that name.
    """
    rest = [c for c in docs.columns if c != ids_col]
    docs = docs.select(*[docs[c] for c in rest])
    schema = docs.withColumn(ids_col, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _Encoder(v)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                texts = b.column(rest.index(text_col)).to_pylist()
                ids, ends = enc(texts)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()),
                                               mask=pa.array([t is None for t in texts]))
                yield pa.record_batch([*b.columns, ids], names=[*rest, ids_col])
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, v: Pieces, ids_col: str = "ids", *, text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text of each list of pieces. Marks become spaces and the first one goes; bytes that are
    not UTF-8 become U+FFFD. Null stays null; an id outside the vocabulary is an error."""
    rest = [c for c in df.columns if c != text_col]
    df = df.select(*[df[c] for c in rest])
    schema = df.withColumn(text_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = v.offset[1:] - v.offset[:-1]
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                col = b.column(rest.index(ids_col))
                null = col.is_null().to_pylist()
                ids = np.asarray(col.flatten()).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size)):
                    raise ValueError("piece id outside the vocabulary")
                count = np.asarray(col.value_lengths().fill_null(0))
                data, n = ragged(v.flat, v.offset, ids)
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
                data = data.tobytes()
                out = [None if z else data[x:y].removeprefix(SPACE).replace(SPACE, b" ").decode("utf-8", "replace")
                       for z, x, y in zip(null, ends[:-1], ends[1:])]
                yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*rest, text_col])
    return df.mapInArrow(run, schema)


@query("op9_sentencepiece")
def op9(spark, sf):
    v = load_pieces(MODEL_PATH)
    lowest, highest = int(v.byte_id.min()), int(v.byte_id.max())
    df = encode(documents(spark, sf).select("doc_id", "text"), v)
    df = decode(df.select("doc_id", F.sha2("text", 256).alias("digest"), "ids"), v)
    return df.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
                     F.size(F.filter("ids", lambda i: i.between(lowest, highest))).cast("long").alias("n_bytes"),
                     F.sha2("decoded", 256).eqNullSafe(F.col("digest")).alias("round_trip"), "ids")
