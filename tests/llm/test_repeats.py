"""Repeated passages and bytes, fingerprints and their links, against brute force on awkward rows."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tests.conftest import SF
from vecspark.llm import QUERIES, simhash, suffix_dedup
from vecspark.llm.components import components
from vecspark.llm.keys import pack, pack_ints, unpack, unpack_ints
from vecspark.llm.substring_dedup import repeated_passages
from vecspark.llm.suffix_dedup import repeated_bytes
from vecspark.llm.tables import Tables

LAST = 1 << 62


def awkward():
    """(doc_id, text): copies, near copies, repetition within, null and empty texts, repeated rows, missing ids."""
    rnd = random.Random(5)
    vocab = ["uno", "dos", "Tres", "cuatro", "é", "ßen", "x", "tail end", "日本"]
    text = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(40)) for _ in range(n))
    a, b, c = text(60), text(40), text(25)
    rows = [(7, a), (3, a), (3, a), (9, b + " " + a[:200]), (4, None), (5, ""), (6, " \t\n "), (None, a), (None, b), (8, c),
            (8, c + " more"), (11, c.replace(" ", "\n", 3)), (12, "short"), (13, "short"), (14, " ".join(["la"] * 400)),
            (15, text(3000) + " " + b), (16, a.upper()), (17, "x" * 700), (18, None)]
    return rows


def frame(spark, rows):
    """With columns whose names operators might use for themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "k", 0) for i, t in rows],
                                 "doc_id long, text string, uid int, block int, key string, fp int")


def rank(i):
    return LAST if i is None else i


def brute_words(rows, n):
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, LAST + 1), rank(i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < rank(i):
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [3, 13])
def test_passages(spark, n):
    rows = awkward()
    got = repeated_passages(frame(spark, rows), min_words=n).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_words(rows, n)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert (r.longest >= n) == (r.n_removed > 0)


def test_passage_lengths(spark):
    text = " ".join(f"w{k}" for k in range(100))
    got = {r.doc_id: r.longest for r in repeated_passages(
        frame(spark, [(1, text), (2, text), (3, " ".join(text.split()[10:40]))]), min_words=13).collect()}
    assert got == {1: 0, 2: 52, 3: 26}


def test_no_rows(spark):
    none = frame(spark, []).limit(0)
    assert repeated_passages(none).collect() == []
    assert repeated_bytes(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


def brute_bytes(rows, n):
    data = [(t or "").encode() for _, t in rows]
    where = {}
    for k, ((i, _), b) in enumerate(zip(rows, data)):
        for s in range(len(b) - n + 1):
            where.setdefault(b[s:s + n], []).append((rank(i), k, s))
    out = []
    for k, ((i, _), b) in enumerate(zip(rows, data)):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if any(r < rank(i) or (kk == k and ss < s) for r, kk, ss in where[b[s:s + n]]):
                gone[s:s + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [20, 100])
def test_bytes(spark, n):
    rows = awkward()
    got = repeated_bytes(frame(spark, rows), length=n).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(rows, n)


def test_pieces_depend_on_windows_alone(monkeypatch):
    rnd = random.Random(2)
    inner = bytes(rnd.choice(b"abc ") for _ in range(400))
    for chunk in (1 << 19, 150):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        at = {}
        for before in (b"", b"abcab", b"c" * 77):
            start, size, key, *_ = suffix_dedup.pieces(before + inner + b"ab" * len(before), 100)
            assert int(size.sum()) == max(0, len(before + inner) + 2 * len(before) - 99)
            for s, n, k in zip(start.tolist(), size.tolist(), key.tolist()):
                for w in range(s, s + n):
                    inside = w - len(before)
                    if 0 <= inside <= len(inner) - 100:
                        assert at.setdefault(inside, k) == k


def test_sort_suffixes():
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    length = np.array([len(t) for t in texts])
    which, size = suffix_dedup.sort_suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length)
    got = [texts[w][len(texts[w]) - s:] for w, s in zip(which, size)]
    assert got == sorted(t[k:] for t in texts for k in range(len(t) + 1))


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 100, dtype=np.uint64))
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0
    y = np.array([5, -3, 1 << 60])
    assert (unpack_ints(pack_ints(y)) == y).all()


# -- SimHash

def fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k:k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), LAST), rank(d))
    return [None if low[find(i)] == LAST else low[find(i)] for i in range(len(fps))]


def test_near_duplicates(spark):
    rows = awkward()
    fps = [fingerprint(t) for _, t in rows]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    want = classes(fps, [i for i, _ in rows], 4)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == sorted(
        ((i, f, c) for (i, _), f, c in zip(rows, fps, want)), key=str)
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, set(want)))
    assert kept[0].asDict().keys() == {"doc_id", "text", "uid", "block", "key", "fp"}


def test_classes_of_the_table(spark):
    """Whole tables: op2's fingerprints and components, and what the pipeline's stage keeps."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    fps = [fingerprint(t) for _, t in rows]
    want = classes(fps, [i for i, _ in rows], 4)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op2_simhash_dedup"](spark, SF).collect()}
    assert got == {i: (f, c) for (i, _), f, c in zip(rows, fps, want)}
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_missing_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "u v w x y z"), (7, "u v w x y z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == [(7, "u v w x y z"), (None, "a b c d e f")]


@pytest.mark.parametrize("bits", [1, 4, 8, 9])
@pytest.mark.parametrize("hot", [False, True])
def test_links_miss_nothing(spark, bits, hot, monkeypatch):
    """Clustered fingerprints, some of them a chain of few bits; also with values split and large groups."""
    if hot:
        monkeypatch.setattr(simhash, "HOT_ROWS", 40)
    rnd = random.Random(bits)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64) | 0xFFFF if hot else rnd.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for _ in range(rnd.randrange(1, bits + 3)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.fp % (1 << 64): r.root for r in simhash.classes(Tables(spark), df, bits).collect()}
    want = classes(fps, range(len(fps)), bits)
    ours, theirs = {}, {}
    for f, w in zip(fps, want):
        ours.setdefault(got[f], set()).add(f)
        theirs.setdefault(w, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("limits", [(0, 0, 0, 0, 0), (2, 0, 0), (1, 1, 0), (3, 0), (2, 1), (4,), (-1, 4, 0), (-1, 3)])
def test_any_allocation_is_complete(limits):
    """Two fingerprints of at most four differing bits share a signature under every allocation of the principle."""
    parts = [(list(b), t) for b, t in zip(np.array_split(np.arange(64), len(limits)), limits)]
    total = sum(limits)
    bits = total + len(limits) - 1
    rnd, run = random.Random(3), simhash._signatures([(list(map(int, b)), t) for b, t in parts if t >= 0])
    import pyarrow as pa
    for _ in range(30):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), bits):
            y ^= 1 << b
        batch = pa.record_batch([pa.array(np.array([x, y], np.uint64).view(np.int64))], names=["fp"])
        seen = {}
        kept = [t for _, t in parts if t >= 0]
        for out in run(iter([batch])):
            for p, v, f, own in zip(*(c.to_pylist() for c in out.columns)):
                seen.setdefault((p, v), []).append((f, own))
        assert any(len({f for f, _ in s}) == 2 and (kept[p] >= 2 or any(own for _, own in s)) for (p, _), s in seen.items())


def test_allocate():
    import itertools
    rnd = random.Random(4)
    costs = [[rnd.random() for _ in range(6)] for _ in range(4)]
    best = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in itertools.product(range(-1, 5), repeat=4) if sum(ts) == 1)
    got = simhash.allocate(costs, 1)
    assert abs(got[0] - best[0]) < 1e-12 and tuple(got[1]) == best[1]


def test_components(spark):
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.root for r in components(Tables(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def test_fingerprint_words(spark):
    rows = [(1, "A b\x0bC D e"), (2, "É é"), (3, None), (4, "")]
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(frame(spark, rows)).collect()}
    assert got == {i: fingerprint(t) for i, t in rows} and got[3] == got[4] == 0


def test_verdicts_join_runs_that_touch():
    """Windows that follow on each other are one run of their document, not a row or a list entry each."""
    uid, start, size = suffix_dedup._verdicts(np.array([9, 4, 4, 4, 9, 4, 9]), np.array([5, 30, 7, 1, 1 << 40, 8, 6]),
                                              np.array([1, 2, 1, 6, 1, 3, 23]))
    assert uid.to_pylist() == [4, 9]
    assert start.to_pylist() == [[1, 30], [5, 1 << 40]] and size.to_pylist() == [[10, 2], [24, 1]]
    none = np.zeros(0, np.int64)
    assert [x.to_pylist() for x in suffix_dedup._verdicts(none, none, none)] == [[], [], []]


def test_marks_of_a_batch():
    """Runs of each document stand together, whichever verdicts hold them, also in a slice and where there are none."""
    verdict = pa.struct([("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
    late = pa.array([[{"starts": [90], "sizes": [9]}], [{"starts": [1, 5], "sizes": [2, 1]}, {"starts": [3], "sizes": [7]}], None, [],
                     [{"starts": [8], "sizes": [4]}]], pa.list_(verdict))
    at, starts, sizes = suffix_dedup._marks(late[1:])
    assert at.tolist() == [0, 3, 3, 3, 4] and starts.tolist() == [1, 5, 3, 8] and sizes.tolist() == [2, 1, 7, 4]
    at, starts, sizes = suffix_dedup._marks(late[2:4])
    assert at.tolist() == [0, 0, 0] and not len(starts) and not len(sizes)


def test_long_repeats_are_few_runs(spark):
    """Text shared at several places by documents that differ around it; the verdicts folded in a task and those of buckets meet."""
    rnd = random.Random(8)
    part = lambda n: "".join(rnd.choice("abcdef é") for _ in range(n))
    shared = [part(n) for n in (130, 400, 1500)]
    rows = [(i, part(60) + shared[i % 3] + part(30) + shared[(i + 1) % 3][:300] + part(50)) for i in range(12)]
    rows += [(20, shared[2] + shared[2]), (None, rows[3][1] + shared[0]), (20, shared[1])]
    got = repeated_bytes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_bytes(rows, 100)
