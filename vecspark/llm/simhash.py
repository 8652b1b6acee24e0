"""SimHash near-duplicates under the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.components import components
from vecspark.llm.registry import documents, query
from vecspark.llm.tables import Tables
from vecspark.llm.text import only
from vecspark.session import BROADCAST_BYTES

#: fingerprints against which the number of candidates of a part and threshold is estimated
SAMPLE = 128
#: thresholds above this are not offered: their signatures would outnumber any saving
MOST = 4
#: nanoseconds of a signature that travels, and of a pair that is compared
ROW_COST, PAIR_COST = 500.0, 4.0
#: signatures in one task, and signatures of one value beyond which the value is split
TASK_ROWS, HOT_ROWS = 1 << 20, 1 << 18


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
    votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each text's word shingles, repeats included, as a signed long.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words is one shingle; a text without
    words, null included, has fingerprint zero. A bit is set if over half of the shingles' XXH64 (seed 42) have it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([_fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# -- the plan: which bits form a part, and how many differing bits each part may have

def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for b in batches:
        fp = np.asarray(b.column("fp")).view(np.uint64)
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += (x.T @ x).astype(np.int64)
    i, j = np.indices((64, 64))
    yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "n"])


def correlation(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how strongly each two of the 64 bits go together. 4,096 sums reach the driver."""
    both = np.zeros((64, 64))
    for r in fps.mapInArrow(_bit_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    n = fps.count()
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near equal size; each starts at a free bit and takes the free bits most correlated with it."""
    free, out = list(range(64)), []
    for k in range(parts):
        want = len(free) // (parts - k)
        part = [free.pop(0)]
        while len(part) < want:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _rows(bits: int, limit: int) -> float:
    """Signatures of one fingerprint. From two differing bits on both sides give way, and meet half-way."""
    return {-1: 0, 0: 1, 1: 1 + bits, 2: 1 + bits}.get(limit, 1 + bits + bits * (bits - 1) / 2)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that sum up to ``total``; ``costs[i][t + 1]`` is the cost of t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, x in enumerate(c, -1):
                if s + t not in step or cost + x < step[s + t][0]:
                    step[s + t] = (cost + x, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(fps: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed.

    If every part i differs in more than t_i bits, the whole differs in at least sum(t_i + 1) bits; so thresholds
    that sum up to max_bits - parts + 1 miss nothing. Candidates are estimated by the distances, part by part, of all
    fingerprints to a sample of ``SAMPLE`` fingerprints; the cheapest number of parts and thresholds is taken. The
    choice changes the work, never the links.
    """
    n, corr = correlation(fps)
    layouts = {m: group_bits(corr, m) for m in range(1, min(max_bits + 1, 6) + 1)}
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks = [(m, k, np.uint64(_mask(bits))) for m, parts in layouts.items() for k, bits in enumerate(parts)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(masks), MOST + 1), np.int64)
        for b in batches:
            x = np.asarray(b.column("fp")).view(np.uint64)
            for at in range(0, len(x), 4096):
                d = x[at:at + 4096, None] ^ sample[None, :]
                for row, (_, _, mask) in enumerate(masks):
                    hist[row] += np.bincount(np.minimum(np.bitwise_count(d & mask), MOST + 1).ravel(), minlength=MOST + 2)[:-1]
        i, t = np.indices(hist.shape)
        yield pa.record_batch([pa.array(i.ravel()), pa.array(t.ravel()), pa.array(hist.ravel())], names=["i", "t", "n"])

    hist = np.zeros((len(masks), MOST + 1))
    if len(sample):
        for r in fps.mapInArrow(near, "i long, t long, n long").groupBy("i", "t").agg(F.sum("n").alias("n")).collect():
            hist[r.i, r.t] = r.n
    pairs = np.cumsum(hist, axis=1) * n / max(len(sample), 1) / 2
    choices = []
    for m, parts in layouts.items():
        at = [row for row, (mm, _, _) in enumerate(masks) if mm == m]
        costs = [[0.0] + [_rows(len(bits), t) * n * ROW_COST + pairs[row, t] * PAIR_COST for t in range(MOST + 1)]
                 for row, bits in zip(at, parts)]
        cost, limits = allocate(costs, max_bits - m + 1)
        choices.append((cost, m, limits))
    _, m, limits = min(choices, key=lambda c: c[:2])
    return [(bits, t) for bits, t in zip(layouts[m], limits) if t >= 0]


# -- probing and verifying

CELL = "part int, value long, fp long, own boolean"


def _signatures(parts: list[tuple[list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("fp")).view(np.uint64)
            for k, (bits, limit) in enumerate(parts):
                flips = [0]
                if limit >= 1:
                    flips += [1 << i for i in bits]
                if limit >= 3:
                    flips += [(1 << i) | (1 << j) for i in bits for j in bits if i < j]
                v = x & np.uint64(_mask(bits))
                for at in range(0, len(flips), 64):
                    f = np.array(flips[at:at + 64], np.uint64)
                    n = len(f) * len(x)
                    yield pa.record_batch([
                        pa.array(np.full(n, k, np.int32)), pa.array((v[None, :] ^ f[:, None]).ravel().view(np.int64)),
                        pa.array(np.tile(x, len(f)).view(np.int64)), pa.array(np.repeat(f == 0, len(x)))],
                        names=["part", "value", "fp", "own"])
    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links given, as many as join the same fingerprints: each to the least of its component."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[:len(a)], ix[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        while True:
            up = nxt[nxt]
            if (up == nxt).all():
                break
            nxt = up
        if (nxt == root).all():
            keep = root != np.arange(len(nodes))
            return nodes[keep], nodes[root[keep]]
        root = nxt


def _compare(parts: list[tuple[list[int], int]], max_bits: int):
    """All signatures of a task: pairs of one value are compared whole, links folded to a forest as they come."""
    both = np.array([t >= 2 for _, t in parts] or [False])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(np.asarray(b.column("part")), np.asarray(b.column("value")).view(np.uint64), np.asarray(b.column("cell")),
                 np.asarray(b.column("fp")).view(np.uint64), np.asarray(b.column("own").cast(pa.int8())).astype(bool)) for b in batches]
        if not cols:
            return
        part, value, cell, fp, own = (np.concatenate(c) for c in zip(*cols))
        del cols
        order = np.lexsort((fp, cell, value, part))
        part, value, cell, fp, own = part[order], value[order], cell[order], fp[order], own[order]
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        end = np.repeat(start + size, size)
        any_pair = both[part]  # elsewhere one of the two must stand at its own value
        found_a, found_b, n = [], [], 0

        def keep(i, j):
            nonlocal found_a, found_b, n
            if len(i):
                found_a.append(fp[i])
                found_b.append(fp[j])
                n += len(i)
                if n > 1 << 20:
                    a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b, n = [a], [b], len(a)

        small = size <= 256
        i = np.flatnonzero(np.repeat(small, size))
        step = 1
        while len(i):  # each signature with the one that stands ``step`` further
            i = i[i + step < end[i]]
            j = i + step
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            ok &= any_pair[i] | own[i] | own[j]
            keep(i[ok], j[ok])
            step += 1
        for s, k in zip(start[~small], size[~small]):
            for x in range(s, s + k, 1024):
                for y in range(x, s + k, 4096):
                    hit = np.argwhere(np.bitwise_count(fp[x:min(x + 1024, s + k), None] ^ fp[None, y:min(y + 4096, s + k)]) <= max_bits)
                    keep(hit[:, 0] + x, hit[:, 1] + y)
        if n:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    return run


def links(tables: Tables, fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) among distinct fingerprints ``fps``: links that join exactly the fingerprints that all links of at most
    ``max_bits`` differing bits join.

    A value held by more than ``HOT_ROWS`` signatures is split into s groups, and every two groups meet in a cell of
    their own; so no task holds more of it than two groups.
    """
    parts = plan(fps, max_bits)
    cells = fps.mapInArrow(_signatures(parts), CELL)
    n = int(fps.count() * sum(_rows(len(bits), t) for bits, t in parts))
    hot = tables.store(cells.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
                       .select("part", "value", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("s")))
    n_hot = hot.count()
    if n_hot:
        cells = cells.join(F.broadcast(hot) if n_hot * 64 < BROADCAST_BYTES else hot, ["part", "value"], "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        cells = cells.withColumn("cell", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("s") - 1),
                        lambda o: F.least(mine, o) * F.col("s") + F.greatest(mine, o))))).drop("s")
    else:
        cells = cells.withColumn("cell", F.lit(0))
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS + 1)
    return (cells.repartition(tasks, "part", "value", "cell").mapInArrow(_compare(parts, max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """Class of each document under links of at most ``max_bits`` differing fingerprint bits.

    Returns (doc_id, fp, component_id), one row for each row of ``docs``: ``component_id`` is the least id that a
    chain of links reaches, the document itself included (null only if the whole component has no id). Documents of one
    fingerprint are one class and are never paired. Null and empty texts share fingerprint zero, which links like any
    other; rows with a null id take part but never name a component. Needs a 64-bit fingerprint to be computed once:
    it is stored.
    """
    tables = Tables(docs.sparkSession)
    each = tables.store(fingerprints(docs, id_col, text_col, shingle=shingle))
    first = tables.store(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = first.join(classes(tables, first.select("fp"), max_bits), "fp")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(member.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def classes(tables: Tables, fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of distinct fingerprints: those with the same root are joined by links."""
    edges = tables.store(links(tables, fps, max_bits))
    tables.sweep()
    roots = components(tables, edges)
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: the one of least id (no id comes last; of equal
    ids, the least hash of the text). Rows repeated with the same id and text are one row, null and empty texts are one
    class, an empty table stays empty.
    """
    tables = Tables(docs.sparkSession)
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    d = docs.select(*[docs[c].alias(n) for c, n in names.items()]).withColumns({
        "id": F.coalesce(F.col(names[id_col]).cast("long"), F.lit((1 << 63) - 1)),
        "h": F.xxhash64(F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([_fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.record_batch([b.column("id"), b.column("h"), pa.array(fp.view(np.int64))], names=["id", "h", "fp"])
    each = tables.store(d.select("id", "h", F.col(names[text_col]).cast("string").alias("text"))
                        .mapInArrow(run, "id long, h long, fp long"))
    first = tables.store(each.groupBy("fp").agg(F.min(F.struct("id", "h")).alias("first")))
    member = first.join(classes(tables, first.select("fp"), max_bits), "fp")
    chosen = member.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.h")
    return (d.join(chosen, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
            .select(*[F.col(n).alias(c) for c, n in names.items()]))


@query("op2_simhash_dedup")
def op2(spark, sf):
    return near_duplicates(documents(spark, sf)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
