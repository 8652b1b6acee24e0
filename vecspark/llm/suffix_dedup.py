"""Repeated byte strings, by suffixes sorted column by column over the documents of a bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.keys import blobs, column, cut, joined, mix, pack, pack_ints, runs, unpack, unpack_ints
from vecspark.llm.registry import documents, query
from vecspark.llm.substring_dedup import ENTRY, NO_ID, bucketed, first_keys, in_blocks, met, squeeze
from vecspark.llm.tables import Tables
from vecspark.llm.text import only

#: bytes of the grams that anchor a window
GRAM = 32
#: starts of a text that are looked at together
CHUNK = 1 << 19
#: windows of a piece at most
PIECE = 23
#: bytes of pieces behind each bucket, and least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 256
#: bits of a gram's hash that give way to its place
_PLACE = np.uint64((1 << 20) - 1)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_B, CHUNK + (1 << 12)), _powers(_INV, CHUNK + (1 << 12))


class _Rolling:
    """Hash of any substring of a chunk; it depends on the substring alone."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _down[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * _up[start])

    def everywhere(self, length: int) -> np.ndarray:
        """The hashes of all substrings of one length."""
        x = self.sums[length:] - self.sums[:-length]
        x *= _up[:len(x)]
        return mix(x)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def core_length(length: int) -> int:
    """Bytes that all windows of a whole piece have in common."""
    return length - min(PIECE, length - min(GRAM, length) + 1) + 1


def pieces(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, key, hash of the bytes, where the core begins) of the pieces of a text's windows of ``length`` bytes.

    A window's anchor is its gram of least hash, the first of equals; windows of one anchor fall into pieces by their
    distance to it. All this, and the key, which hashes what the windows of a whole piece have in common, depends on
    the window's own bytes: equal windows stand at the same place of pieces of the same key, wherever they occur.
    """
    gram = min(GRAM, length)
    starts, sizes, keys, wholes, offs = [], [], [], [], []
    for c in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data[c:c + CHUNK + length - 1], np.uint8)
        h = _Rolling(part)
        tagged = h.everywhere(gram)
        tagged &= ~_PLACE
        tagged |= np.arange(len(tagged), dtype=np.uint64)
        anchor = (_least(tagged, length - gram + 1) & _PLACE).astype(np.int64)
        s = np.arange(len(anchor))
        core = anchor - (anchor - s) // PIECE * PIECE
        # a piece ends where its anchor or its core changes
        new = np.ones(len(s), bool)
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        new[1:] |= core[1:] != core[:-1]
        first = np.flatnonzero(new)
        # what the windows share; one fixed length, so that it does not depend on which of them are there
        key = h(core[first], core_length(length)) + (anchor[first] - core[first]).astype(np.uint64)
        size = np.diff(np.append(first, len(s)))
        starts.append(first + c)
        sizes.append(size)
        keys.append(mix(key))
        wholes.append(h(first, size + length - 1) + size.astype(np.uint64))
        offs.append(core[first] - first)
    if not starts:
        none, no_key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, no_key, no_key, none
    return tuple(map(np.concatenate, (starts, sizes, keys, wholes, offs)))


BASE = ("uid long, doc_id long, rank long, copies long, n_bytes long, kept_sha256 string, z binary, "
        "starts binary, sizes binary, keys binary, wholes binary, offs binary")


def _candidates(length: int, bits: int):
    """One block: documents without a repeated key are done, the others keep the pieces that may repeat."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        known = np.unique(joined(column(told, "keys"), unpack, np.uint64))
        shape, d = bucketed(bits), zstandard.ZstdDecompressor()
        ids, zs = column(docs, "doc_id").to_pylist(), column(docs, "z").to_pylist()
        block = docs.column("block")[0].as_py() if len(docs) else 0
        rows, copies = [], {}
        for x in zip(ids, zs):
            copies[x] = copies.get(x, 0) + 1
        for i, (doc_id, z) in enumerate(sorted(copies, key=lambda x: (x[0] is None, x[0] or 0, x[1] or b""))):
            data = d.decompress(z) if z else b""
            start, size, key, whole, off = pieces(data, length)
            v = shape(key)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v) if len(known) else []
            base = [(block << 31) + i, doc_id, NO_ID if doc_id is None else doc_id, copies[doc_id, z], len(data)]
            if len(hit):
                rows.append(base + [None, z, pack(start[hit]), pack_ints(size[hit]),
                                    pack_ints(key[hit].view(np.int64)), pack_ints(whole[hit].view(np.int64)),
                                    pack_ints(off[hit])])
            else:
                rows.append(base + [hashlib.sha256(data).hexdigest(), *[None] * 6])
        types = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 12, types)],
                        names=["uid", "doc_id", "rank", "copies", "n_bytes", "kept_sha256", "z", "starts", "sizes", "keys", "wholes",
                               "offs"])
    return run


#: pieces folded together before they travel
TOGETHER = 1 << 15
FIELDS = ("key", "whole", "uid", "rank", "start", "size", "off")
PART = "dest long, uid long, starts array<long>, sizes array<int>, fields array<binary>, data binary"
VERDICT = "uid long, starts array<long>, sizes array<int>"


def _fold(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces with the same bytes the first stays, in the order of rank, row and start; the others are repeated
    throughout. (Pieces of another row with the same id are not later: they stay too.) Returns both as positions.

    Pieces are alike when the hash of what their windows share and the hash of all their bytes are, 128 bits in all.
    """
    order = np.lexsort((p["start"], p["uid"], p["rank"], p["whole"], p["key"]))
    key, whole, uid, rank = (p[c][order] for c in ("key", "whole", "uid", "rank"))
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    first = rank[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.zeros(len(order), bool)
    again[1:] = ~new[1:] & (uid[1:] == uid[:-1])
    late = (rank > first) | again
    return order[~late], order[late]


def _verdicts(uid: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(uid, starts, sizes) of runs of repeated windows, one for each document; runs that follow on each other are one."""
    order = np.lexsort((start, uid))
    uid, start, size = uid[order], start[order], size[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + size[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(size, first) if len(first) else size
    uid, start = uid[first], start[first]
    at, _ = runs(uid)
    ends = pa.array(np.append(at, len(uid)), pa.int32())
    return (pa.array(uid[at], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(start, pa.int64())),
            pa.ListArray.from_arrays(ends, pa.array(size, pa.int32())))


def _slices(buf: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """The bytes at, of n each, one after the other."""
    ends = np.cumsum(n)
    return buf[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - ends + n, n)].tobytes()


def _parts(length: int, buckets: int):
    """The candidate pieces for their buckets, folded as far as they are here; verdicts on those folded away."""
    types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary())

    def flush(docs: list[bytes], cols: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *map(len, docs)])[:-1]
        p = {c: np.concatenate([x[k] for x in cols]) for k, c in enumerate(FIELDS)}
        at = np.concatenate([x[4] + b for x, b in zip(cols, base)])
        buf = np.frombuffer(b"".join(docs), np.uint8)
        stay, late = _fold(p)
        told = _verdicts(p["uid"][late], p["start"][late], p["size"][late])
        none = pa.nulls(len(told[0]))
        verdicts = [pa.array(np.asarray(told[0]) % buckets, pa.int64()), *told, none.cast(types[4]), none.cast(types[5])]
        dest = (p["key"][stay] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(dest, kind="stable")
        stay, dest = stay[order], dest[order]
        rows = []
        for e, x, y in cut(dest):
            i = stay[x:y]
            rows.append((e, None, None, None, [pack_ints(p[c][i].view(np.int64)) for c in FIELDS],
                         _slices(buf, at[i], p["size"][i] + length - 1)))
        for cols in (verdicts, [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)]):
            yield pa.record_batch(cols, names=["dest", "uid", "starts", "sizes", "fields", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, docs, cols, n = zstandard.ZstdDecompressor(), [], [], 0
        for b in batches:
            for k in range(b.num_rows):
                uid, rank, z, starts, sizes, keys, wholes, offs = (
                    b.column(c)[k].as_py() for c in ("uid", "rank", "z", "starts", "sizes", "keys", "wholes", "offs"))
                start = unpack(starts).astype(np.int64)
                docs.append(d.decompress(z))
                cols.append((unpack_ints(keys).view(np.uint64), unpack_ints(wholes).view(np.uint64),
                             np.full(len(start), uid), np.full(len(start), rank), start, unpack_ints(sizes), unpack_ints(offs)))
                n += len(start)
                if n >= TOGETHER:
                    yield from flush(docs, cols)
                    docs, cols, n = [], [], 0
        if n:
            yield from flush(docs, cols)
    return run


def sort_suffixes(buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, length) of all suffixes of a collection, in order, built column by column from the right.

    Round j knows the order of all suffixes shorter than j, and the symbol before each: the collection's
    Burrows-Wheeler transform so far. Putting those symbols into order, stably, is putting in order the suffixes that
    begin with them, so every round inserts one symbol of each text and passes over the transform once.
    """
    last = (begin + length - 1).astype(np.int32)
    empty = np.arange(len(begin), dtype=np.int32)
    which, size = empty, np.zeros(len(begin), np.int32)
    short = int(length.min(initial=0))
    for j in range(int(length.max(initial=0))):
        if j >= short:  # some texts are through
            more = size < length[which]
            which, size = which[more], size[more]
        order = np.argsort(buf[last[which] - size], kind="stable")
        which = np.concatenate([empty, which[order]])
        size = np.concatenate([np.zeros(len(begin), np.int32), size[order] + np.int32(1)])
    return which, size


def _same(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each start shares ``length`` symbols with the start before it: common prefixes, as far as they matter."""
    four = np.lib.stride_tricks.sliding_window_view(buf, 4)
    eq = np.ones(len(at), bool)
    eq[:1] = False
    for k in [*range(0, length - 3, 4), max(0, length - 4)]:
        i = np.flatnonzero(eq)
        eq[i] = (four[at[i] + k] == four[at[i - 1] + k]).all(axis=1)
    return eq


def _shorten(buf: np.ndarray, begin: np.ndarray, n: np.ndarray, off: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces with their core written as one symbol of its own: (symbols, where each piece begins).

    All windows of a piece hold its core whole, so what they compare like does not change; columns that all pieces of a
    key share are passed once instead of ``core`` times.
    """
    same = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, core)[begin + off]).view(f"V{core}").ravel()
    symbol = np.unique(same, return_inverse=True)[1]
    kind = np.uint16 if len(same) < (1 << 16) - 256 else np.uint32
    m = n - core + 1
    first = np.cumsum(m) - m
    t = np.arange(int(m.sum())) - np.repeat(first, m)
    o = np.repeat(off, m)
    out = buf[np.minimum(np.repeat(begin, m) + t + np.where(t > o, core - 1, 0), len(buf) - 1)].astype(kind)
    out[first + off] = 256 + symbol
    return np.concatenate([out, np.zeros(4, kind)]), first


def later_windows(p: dict[str, np.ndarray], buf: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, start) of the windows that repeat an earlier one among pieces whose bytes stand at ``begin``."""
    core = core_length(length)
    symbols, begin = _shorten(buf, begin, p["size"] + length - 1, p["off"], core)
    length = length - core + 1
    text_len = p["size"] + length - 1
    which, size = sort_suffixes(symbols, begin, text_len)
    keep = size >= length
    which, size = which[keep].astype(np.int64), size[keep].astype(np.int64)
    into = text_len[which] - size
    cls = np.cumsum(~_same(symbols, begin[which] + into, length)) - 1
    uid, rank, start = p["uid"][which], p["rank"][which], p["start"][which] + into
    order = np.lexsort((start, uid, rank, cls))
    cls, uid, rank, start = cls[order], uid[order], rank[order], start[order]
    new = np.concatenate(([True], cls[1:] != cls[:-1]))
    low = rank[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.concatenate(([False], (cls[1:] == cls[:-1]) & (uid[1:] == uid[:-1])))
    late = (rank > low) | again
    return uid[late], start[late]


#: pieces whose suffixes are sorted together
COLLECTION = 2048


def _judge(length: int):
    """One bucket: every window that repeats an earlier one.

    Pieces are folded once more. Where several different ones of a key are left, their windows may still agree in part:
    those collections are sorted, as many keys together as make about ``COLLECTION`` pieces.
    """
    types = pa.schema([("uid", pa.int64()), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table.column("uid"))).select(["uid", "starts", "sizes"]).cast(types)
        parts = [f for f in table.column("fields").to_pylist() if f is not None]
        if parts:
            p = {c: np.concatenate([unpack_ints(f[k]) for f in parts]) for k, c in enumerate(FIELDS)}
            p["key"], p["whole"] = p["key"].view(np.uint64), p["whole"].view(np.uint64)
            buf = np.frombuffer(b"".join(blobs(table.column("data"))) + bytes(8), np.uint8)
            n = p["size"] + length - 1
            begin = np.cumsum(n) - n
            stay, late = _fold(p)
            uid, start, size = [p["uid"][late]], [p["start"][late]], [p["size"][late]]
            key = p["key"][stay]  # in order
            first, run_ = runs(key)
            several = np.diff(np.append(first, len(key))) > 1
            stay, key = stay[several[run_]], key[several[run_]]
            first, _ = runs(key)
            a = 0
            while a < len(stay):
                b = first[min(np.searchsorted(first, a + COLLECTION), len(first) - 1)]
                b = len(stay) if b <= a or len(stay) - b < COLLECTION // 2 else int(b)
                i = stay[a:b]
                text = np.frombuffer(_slices(buf, begin[i], n[i]) + bytes(8), np.uint8)
                u, s = later_windows({c: p[c][i] for c in FIELDS}, text, np.cumsum(n[i]) - n[i], length)
                uid.append(u)
                start.append(s)
                size.append(np.ones(len(s), np.int64))
                a = b
            known = pa.concat_tables([known, pa.table(_verdicts(*(np.concatenate(x) for x in (uid, start, size))), schema=types)])
        return known
    return run


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, copies long"


def _marks(late: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists of verdicts: where each document's runs begin (and, last, end), and all starts and sizes."""
    verdicts = late.flatten()
    starts, sizes = (verdicts.field(c) for c in ("starts", "sizes"))
    runs_before = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(starts)))))
    lists_before = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(late), 0)))))
    return runs_before[lists_before], np.asarray(starts.flatten()), np.asarray(sizes.flatten()).astype(np.int64)


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            late, starts, sizes = _marks(b.column("late"))
            for i, (doc_id, n, z, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "z", "copies")))):
                s = starts[late[i]:late[i + 1]]
                e = s + sizes[late[i]:late[i + 1]] - 1 + length
                data, gone = d.decompress(z), np.cumsum(np.bincount(s, minlength=n + 1) - np.bincount(e, minlength=n + 1))[:n] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((doc_id, n, int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(),
                             [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])], copies))
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "copies"])
    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100) -> DataFrame:
    """Bytes of each text that lie in a string of ``length`` bytes which also starts earlier: in a document of smaller
    id, or before it in the same document.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row for each row of ``docs``; ``spans`` are
    the maximal removed runs in bytes, end exclusive. A null text has no bytes. Rows of the same id and text are judged
    once; rows of the same id with other texts do not remove each other's bytes; a null id ranks after all others.

    Windows are cut into pieces by their own content, so equal windows meet wherever they occur. Keys of pieces travel
    first; only pieces whose key repeats send their bytes, pieces alike being folded before they do. A bucket then
    sorts the suffixes of the pieces that share a key, column by column, and neighbours that agree in ``length`` bytes
    are one string.
    """
    if length < 8:
        raise ValueError("strings of fewer than 8 bytes are not supported")
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    d, bits = in_blocks(only(docs, id_col, text_col))
    told = (d.select("block", "text").mapInArrow(
        lambda it: first_keys(it, lambda t: pieces(t, length)[2], bits, within=True), ENTRY)
        .groupBy("dest").applyInArrow(met, "block long, keys binary"))
    packed = d.mapInArrow(squeeze, "block long, doc_id long, z binary")
    base = tables.store(packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_candidates(length, bits), BASE))
    tables.sweep()
    open_ = base.where("starts IS NOT NULL")
    n = (open_.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8 * (length + PIECE)
    buckets = max(LEAST_BUCKETS, n // BUCKET_BYTES)
    late = tables.store(open_.select("uid", "rank", "z", "starts", "sizes", "keys", "wholes", "offs").mapInArrow(_parts(length, buckets), PART)
                        .groupBy("dest").applyInArrow(_judge(length), VERDICT))
    tables.sweep()
    marks = late.groupBy("uid").agg(F.collect_list(F.struct("starts", "sizes")).alias("late"))
    judged = (open_.select("uid", "doc_id", "n_bytes", "z", "copies").join(marks, "uid", "left")
              .mapInArrow(_finish(length), DONE))
    clear = base.where("starts IS NULL").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256",
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), "copies")
    out = clear.unionByName(judged)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


@query("op10_suffix_dedup")
def op10(spark, sf):
    return repeated_bytes(documents(spark, sf)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
