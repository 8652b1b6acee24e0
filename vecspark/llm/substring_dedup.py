"""Repeated word passages across documents, by level-wise doubling of windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.keys import blobs, column, cut, joined, mix, pack, pack_ints, runs, unpack, unpack_ints
from vecspark.llm.registry import documents, query
from vecspark.llm.tables import Tables
from vecspark.llm.text import only

#: text per block of documents, and least number of blocks
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 128
#: text behind each bucket of keys, and least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
#: keys of candidates behind each bucket of a level, and least number of those
LEVEL_BYTES, LEAST_LEVEL_BUCKETS = 4 << 20, 32
#: windows a task gathers before it hands them on
GATHER = 1 << 20
#: bits of a window's first key beyond those that choose its bucket
REST_BITS = 40
#: a document without an id ranks after all others
NO_ID = np.iinfo(np.int64).max
_rng = np.random.default_rng(13)
_ODD = _rng.integers(1, 1 << 63, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: what a byte stands for in each family of keys
_BYTE = _rng.integers(1, 1 << 64, (2, 256), dtype=np.uint64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _window_keys(words: list[bytes], length: int, which: int) -> np.ndarray:
    """One key for each window of ``length`` words, from running sums over the bytes of the words, joined by one space;
    ``which`` chooses one of two independent families."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    text = np.frombuffer(b" ".join(words), np.uint8)
    n = len(text)
    if which not in _powers or len(_powers[which][0]) < n:
        base = int(_ODD[0][which])
        _powers[which] = tuple(np.multiply.accumulate(np.array([1] + [x] * max(n, 1 << 16), np.uint64))
                               for x in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[which]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[which][text] * down[:n], out=sums[1:])
    gap = np.flatnonzero(text == 32)
    start, end = np.append(0, gap + 1)[:len(words) - length + 1], np.append(gap, n)[length - 1:]
    return mix((sums[end] - sums[start]) * up[start])


def _double(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD[0][0] + mix(second * _ODD[1][1]))


def bucketed(bits: int):
    """Each window's first key, with the bucket as its leading bits."""
    return lambda keys: keys >> np.uint64(64 - REST_BITS - bits)


ENTRY = "dest long, kind int, block long, keys binary, blocks binary"


def first_keys(batches: Iterator[pa.RecordBatch], keys_of: Callable[[bytes], np.ndarray], bits: int,
               within: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets: keys of single documents here, and keys already seen twice here (``within``: also twice in
    one document).

    A key that two documents of this task share is known to be repeated: the blocks of those documents are told
    straight away (kind 1), and its bucket gets one mark. So a bucket holds one entry for each key and task.
    """
    shape, rest = bucketed(bits), np.uint64(REST_BITS)

    def flush(keys, owner, block):
        v = shape(np.concatenate(keys))
        d = np.repeat(np.arange(len(owner)), owner)
        order = np.argsort(v)
        v, d = v[order], d[order]
        starts, _ = runs(v)
        ends = np.append(starts[1:], len(v))
        least = np.minimum.reduceat(d, starts)
        many = ends - starts > 1 if within else least != np.maximum.reduceat(d, starts)
        b = np.asarray(block, np.int64)
        where, mark = v[starts], np.where(many, -1, b[least])
        out = [(dest, 0, None, pack(where[x:y]), pack_ints(mark[x:y])) for dest, x, y in cut((where >> rest).astype(np.int64))]
        hit = np.repeat(many, ends - starts)
        hv, hb = v[hit], b[d[hit]]
        order = np.lexsort((hv, hb))
        hv, hb = hv[order], hb[order]
        for blk, x, y in cut(hb):
            out.append((blk % (1 << bits), 1, blk, pack(np.unique(hv[x:y])), None))
        cols = list(zip(*out)) or [[]] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(
            cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
            names=["dest", "kind", "block", "keys", "blocks"])

    keys, owner, block, n = [], [], [], 0
    for batch in batches:
        for text, blk in zip(batch.column("text"), batch.column("block").to_pylist()):
            k = keys_of((text.as_py() or "").encode())
            if len(k):
                keys.append(k)
                owner.append(len(k))
                block.append(blk)
                n += len(k)
            if n >= GATHER:
                yield flush(keys, owner, block)
                keys, owner, block, n = [], [], [], 0
    if n:
        yield flush(keys, owner, block)


def met(table: pa.Table) -> pa.Table:
    """In one bucket: tell each block which of its keys other tasks have too."""
    kind = np.asarray(table.column("kind"))
    direct, rest = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
    out_block, out_keys = direct.column("block").to_pylist(), direct.column("keys").to_pylist()
    v, b = joined(rest.column("keys"), unpack, np.uint64), joined(rest.column("blocks"), unpack_ints, np.int64)
    if len(v):
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        starts, run = runs(v)
        several = (np.diff(np.append(starts, len(v))) > 1)[run] & (b >= 0)
        v, b = v[several], b[several]
        order = np.argsort(b, kind="stable")
        v, b = v[order], b[order]
        for blk, x, y in cut(b):
            out_block.append(blk)
            out_keys.append(pack(np.unique(v[x:y])))
    return pa.table({"block": pa.array(out_block, pa.int64()), "keys": pa.array(out_keys, pa.binary())})


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they travel."""
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [None if t is None else c.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("block"), batch.column("doc_id"), pa.array(z, pa.binary())],
                              names=["block", "doc_id", "z"])


STATE = ("uid long, block long, doc_id long, rank long, n_words long, kept_sha256 string, z binary, "
         "pos binary, keys binary")


def _candidates(docs: pa.Table, told: pa.Table, length: int, bits: int) -> pa.Table:
    """One block: documents without a repeated key are done, the others keep their candidate windows."""
    known = np.unique(joined(column(told, "keys"), unpack, np.uint64))
    shape, d = bucketed(bits), zstandard.ZstdDecompressor()
    rows = []
    # arrival order of shuffled rows may change when a task is repeated: numbering follows the content
    ids = docs.column("doc_id").to_pylist()
    zs = docs.column("z").to_pylist()
    block = docs.column("block")[0].as_py() if len(docs) else 0
    for i, k in enumerate(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, zs[k] or b""))):
        words = d.decompress(zs[k]).split() if zs[k] else []
        v = shape(_window_keys(words, length, 0))
        at = np.searchsorted(known, v)
        pos = np.flatnonzero(known[np.minimum(at, max(len(known) - 1, 0))] == v) if len(known) else np.zeros(0, int)
        base = [(block << 31) + i, block, ids[k], NO_ID if ids[k] is None else ids[k], len(words)]
        if len(pos):
            keys = _window_keys(words, length, 1)[pos]
            rows.append(base + [None, zs[k], pack(pos), pack_ints(keys.view(np.int64))])
        else:
            rows.append(base + [hashlib.sha256(b" ".join(words)).hexdigest(), None, None, None])
    types = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, types)],
                    names=["uid", "block", "doc_id", "rank", "n_words", "kept_sha256", "z", "pos", "keys"])


def _level_entries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For each block here and each key: its first and its last document."""
    for batch in batches:
        at = {}
        for i, b in enumerate(batch.column("block").to_pylist()):
            at.setdefault(b, []).append(i)
        out = []
        for b, ids in at.items():
            part = batch.take(pa.array(ids))
            k = [unpack_ints(x).view(np.uint64) for x in blobs(part.column("keys"))]
            doc = np.repeat(np.asarray(part.column("rank")), [len(x) for x in k])
            k = np.concatenate(k)
            order = np.lexsort((doc, k))
            k, doc = k[order], doc[order]
            starts, _ = runs(k)
            lo, hi, k = doc[starts], doc[np.append(starts[1:], len(k)) - 1], k[starts]
            for dest, x, y in cut((k >> np.uint64(64 - bits)).astype(np.int64)):
                out.append((dest, b, pack(k[x:y]), pack_ints(lo[x:y]), pack_ints(hi[x:y] - lo[x:y])))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(
            list(zip(*out)) or [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            names=["dest", "block", "keys", "lo", "span"])


def _with_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _level_entries(batches, bits)
    return run


def _level_met(table: pa.Table) -> pa.Table:
    """In one bucket: keys with two documents, and the first of them, back to each block that has the key."""
    ks = [unpack(x) for x in blobs(table.column("keys"))]
    b = np.repeat(np.asarray(table.column("block")), [len(x) for x in ks])
    k = np.concatenate(ks)
    lo = joined(table.column("lo"), unpack_ints, np.int64)
    hi = lo + joined(table.column("span"), unpack_ints, np.int64)
    order = np.argsort(k, kind="stable")
    k, lo, hi, b = k[order], lo[order], hi[order], b[order]
    starts, run = runs(k)
    first = np.minimum.reduceat(lo, starts)[run]
    keep = first < np.maximum.reduceat(hi, starts)[run]
    k, first, b = k[keep], first[keep], b[keep]
    order = np.argsort(b, kind="stable")
    k, first, b = k[order], first[order], b[order]
    rows = [(blk, pack(k[x:y]), pack_ints(first[x:y])) for blk, x, y in cut(b)]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))],
                    names=["block", "keys", "lo"])


LEVEL = "uid long, block long, rank long, late binary, any_late boolean, pos binary, keys binary"


def _extender(length: int):
    def extend(state: pa.Table, told: pa.Table) -> pa.Table:
        return _extend(state, told, length)
    return extend


def _extend(state: pa.Table, told: pa.Table, length: int) -> pa.Table:
    """One block: which windows are later copies, and the windows of twice the length that may still repeat."""
    known = joined(column(told, "keys"), unpack, np.uint64)
    first = joined(column(told, "lo"), unpack_ints, np.int64)
    order = np.argsort(known, kind="stable")
    known, first = known[order], first[order]
    rows = []
    for uid, block, rank, pos, keys in zip(*(state.column(c).to_pylist() for c in ("uid", "block", "rank", "pos", "keys"))):
        pos, keys = unpack(pos), unpack_ints(keys).view(np.uint64)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        pos, keys, at = pos[hit], keys[hit], at[hit]
        late = pos[first[at] < rank] if len(known) else pos
        # both halves must have survived
        nxt = np.minimum(np.searchsorted(pos, pos + np.uint64(length)), max(len(pos) - 1, 0))
        both = pos[nxt] == pos + np.uint64(length) if len(pos) else np.zeros(0, bool)
        rows.append((uid, block, rank, pack(late) if len(late) else None, bool(len(late)),
                     pack(pos[both]) if both.any() else None,
                     pack_ints(_double(keys[both], keys[nxt[both]]).view(np.int64)) if both.any() else None))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)],
                    names=["uid", "block", "rank", "late", "any_late", "pos", "keys"])


DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long, spans array<struct<start:long,end:long>>, z binary"


def _finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    c, d = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc_id, n, z, late, longest in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n_words", "z", "late", "longest"))):
            words = d.decompress(z).split()
            delta = np.zeros(n + 1, np.int32)
            if late:
                p = unpack(late).astype(np.int64)
                np.add.at(delta, p, 1)
                np.add.at(delta, p + length, -1)
            gone = np.cumsum(delta[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            rows.append((doc_id, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), longest or 0,
                         [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])], c.compress(kept)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 7, types)],
                              names=["doc_id", "n_words", "n_removed", "kept_sha256", "longest", "spans", "z"])


def in_blocks(d: DataFrame) -> tuple[DataFrame, int]:
    """Adds the block of each document; how many bits choose a bucket. Both follow the size of the texts."""
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_BLOCKS, size // BLOCK_BYTES)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return (d.withColumn("block", F.pmod(key, F.lit(n)).cast("long")),
            int(max(LEAST_BUCKETS, size // BUCKET_BYTES)).bit_length())


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 13) -> DataFrame:
    """Words of each document that lie in a window of ``min_words`` words which a document of smaller id also has.

    Windows of ``min_words`` words repeated across documents survive; two survivors side by side make a candidate of
    twice the length; that goes on until no candidate survives. Removal follows from the first length; the later ones
    tell how long the repetition is.

    Returns (doc_id, n_words, n_removed, kept_sha256, longest, spans): ``spans`` are the removed runs in word
    positions, end exclusive; ``longest`` the greatest of min_words * 2^k for which a window of that many words also
    starts in an earlier document (0: none). One row for each row of ``docs``. A null text has no words. Rows of the
    same id do not remove each other; a null id ranks after all others.

    Keys of all windows travel once, packed, as a filter of 40 bits beyond the bucket. Only windows that share such a
    key get a full 64-bit key of another family, and only those are extended. Tasks fold equal keys before they
    travel, blocks of documents do so at each level: a window of a third of all documents is one entry for each task.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    d, first_bits = in_blocks(only(docs, id_col, text_col))
    told = (d.select("block", "text").mapInArrow(
        lambda it: first_keys(it, lambda t: _window_keys(t.split(), min_words, 0), first_bits), ENTRY)
            .groupBy("dest").applyInArrow(met, "block long, keys binary"))
    packed = d.mapInArrow(squeeze, "block long, doc_id long, z binary")
    base = tables.store(packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        lambda x, y: _candidates(x, y, min_words, first_bits), STATE).where("uid IS NOT NULL"))
    tables.sweep()
    state = base.where("pos IS NOT NULL").select("uid", "block", "rank", "pos", "keys")
    levels, length = [], min_words
    while True:
        n = state.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
        bits = int(max(LEAST_LEVEL_BUCKETS, n // LEVEL_BYTES)).bit_length()
        told = (state.mapInArrow(_with_bits(bits), "dest long, block long, keys binary, lo binary, span binary")
                .groupBy("dest").applyInArrow(_level_met, "block long, keys binary, lo binary"))
        found = tables.store(state.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
            _extender(length), LEVEL))
        tables.sweep()
        levels.append(found.where("any_late").select("uid", F.lit(length).cast("long").alias("length"),
                                                     *(["late"] if not levels else [])))
        state = found.where("pos IS NOT NULL").select("uid", "block", "rank", "pos", "keys")
        length *= 2
        if state.isEmpty():
            break
    longest = levels[0].select("uid", "length")
    for x in levels[1:]:
        longest = longest.union(x)
    marks = levels[0].select("uid", "late").join(longest.groupBy("uid").agg(F.max("length").alias("longest")), "uid")
    open_ = (base.where("pos IS NOT NULL").select("uid", "doc_id", "n_words", "z").join(marks, "uid", "left")
             .mapInArrow(lambda it: _finish(it, min_words), DONE).drop("z"))
    closed = base.where("pos IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(0).cast("long").alias("longest"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    return closed.unionByName(open_)


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM p),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS f FROM wins) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(0, 13) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark, sf):
    return repeated_passages(documents(spark, sf)).select("doc_id", "n_words", "n_removed", "kept_sha256")
