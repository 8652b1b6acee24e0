"""Mixing, alignment and resampling against brute force."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vecspark.llm import QUERIES, alignment, mixing, resampling
from vecspark.llm.running import running_sum
from vecspark.llm.tables import Tables

HEAD = "doc_id long, text string, source string, size int, slot int, n int, chunk int, score int, key string, at int, part int"


def frame(spark, rows):
    """(doc_id, text, source), with columns named as the operators name theirs."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "k", 6, 7) for r in rows], HEAD)


AWKWARD = [(1, None, "b"), (2, "", "b"), (3, " \n\t ", None), (None, "one line.", "a"), (4, "same same.", "a"), (4, "same same.", "a"),
           (5, "same", "a"), (6, "x" * 300_000, "é"), (7, "word " * 20_000, None), (8, "né 日本 😀 ﬁ ▁ \x00 end", ""), (9, "<|endoftext|> <s>", "")]


# -- running sums and mixing

def test_running_sum(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab"), rnd.randrange(50), k, rnd.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, k int, v int").repartition(7)
    got = {r.k: r.s for r in running_sum(Tables(spark), df, ["x", "k"], F.col("v"), "s", by=["g"]).collect()}
    assert got == {k: sum(w for h, y, j, w in rows if h == g and (y, j) < (x, k)) for g, x, k, v in rows}


def shares(sizes, weights, most):
    """By rounds: what is above its bound stops, the excess goes to the others by weight."""
    total, stopped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in stopped)
        free = sum(w for k, w in enumerate(weights) if k not in stopped)
        out = [most * s if k in stopped else left * w / free for k, (s, w) in enumerate(zip(sizes, weights))]
        above = {k for k in range(len(sizes)) if k not in stopped and out[k] > most * sizes[k] + 1e-9}
        if not above:
            return out
        stopped |= above


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix(spark, seed):
    rnd = random.Random(seed)
    names = [None, "", "a", "b", "B", "ж", "z"]
    many = {s: rnd.choice([1, 3, 30, 60]) for s in names}
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), s) for k, s in enumerate(s for s in names for _ in range(many[s]))]
    plan = mixing.schedule(frame(spark, rows), block=32, weights=(1, 5, 2))
    got = {r.doc_id: r for r in mixing.taken(plan).collect()}
    order = sorted((s for s in names if s is not None), key=str.encode) + [None]
    words = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in order}
    want = dict(zip(order, shares([words[s] for s in order], [(1, 5, 2)[k % 3] for k in range(len(order))], 3)))
    assert len(got) == len(rows)
    for k, t, s in rows:
        assert got[k].size == len(t.split()) and got[k].source_size == words[s] and got[k].taken <= 3 * got[k].size
        assert math.isclose(got[k].target, want[s], abs_tol=1e-6)
    for s in order:
        assert sum(r.taken for r in got.values() if r.source == s) == math.floor(want[s] + 0.5)
    # slots: whole blocks of one source each, words taken in turn, every stretch near the shares
    held, last = defaultdict(list), {r.source_no: r for r in plan.sources.collect()}
    for r in mixing.mix(plan).collect():
        held[r.slot].append(r)
    turn = sorted(held)
    for s in turn:
        assert len({r.source_no for r in held[s]}) == 1
    by = defaultdict(list)
    for s in turn:
        by[held[s][0].source_no].append(sum(r.n for r in held[s]))
    total = sum(map(len, by.values()))
    for k, n in by.items():
        assert n[:-1] == [32] * (len(n) - 1) and sum(n) == last[k].words
        for stretch in (total // 4, total // 2):
            seen = sum(held[s][0].source_no == k for s in turn[:stretch])
            assert abs(seen - stretch * len(n) / total) <= 2 + total.bit_length() + 0.1 * stretch
    again = mixing.schedule(frame(spark, rows).repartition(5), block=32, weights=(1, 5, 2))
    assert {r.doc_id: r.taken for r in mixing.taken(again).collect()} == {k: r.taken for k, r in got.items()}


def test_mix_awkward(spark, monkeypatch):
    plan = mixing.schedule(frame(spark, AWKWARD))
    got = mixing.taken(plan).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in AWKWARD)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)  # the other way to give documents their source's columns
    assert sorted(map(str, mixing.taken(mixing.schedule(frame(spark, AWKWARD))).collect())) == sorted(map(str, got))
    for none in ([], [(1, None, "a"), (2, " ", None)]):
        plan = mixing.schedule(frame(spark, none))
        assert [(r.taken, r.target) for r in mixing.taken(plan).collect()] == [(0, 0.0)] * len(none) and mixing.mix(plan).count() == 0


# -- alignment

@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)


def tokens(both, text):
    """[(id, bytes)] of both, by the two libraries themselves."""
    a, b = both
    symbol = alignment.byte_of_symbol()
    if not text:
        return [], []
    x = a.encode(" " + text, add_special_tokens=False)
    x = [(i, bytes(symbol[c] for c in a.id_to_token(i))) for i in x.ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])


def groups(x, y):
    def ends(tokens):
        at, out = 0, []
        for _, t in tokens:
            at += len(t)
            out.append(at)
        return out
    ex, ey = ends(x), ends(y)
    common = sorted(set(ex) & set(ey))
    out = [([], []) for _ in common]
    for (i, _), e in zip(x, ex):
        out[bisect.bisect_left(common, e)][0].append(i)
    for (i, _), e in zip(y, ey):
        out[bisect.bisect_left(common, e)][1].append(i)
    return out


def brute_alignment(both, rows):
    cut = [groups(*tokens(both, r[1])) for r in rows]
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g in cut]
    count = Counter(p for n in links for p in n)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for r, g, n in zip(rows, cut, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((str(r[0]), sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), n.total(),
                    sum(k for p, k in n.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in n.items()),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out), count


def said(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, both, small, monkeypatch):
    if small:  # many slices and chunks, and groups too large to expand at once
        for name, value in (("SLICE_CHARS", 200), ("CHUNK_TOKENS", 300), ("PAIRS", 3)):
            monkeypatch.setattr(alignment, name, value)
    rnd = random.Random(5)
    alphabet = ["the ", "and", "tion ", "  ", "\n", "é", "ß", "日本", "😀", "1234", "don't", "x", "_", "\x00", "Qz", "��"]
    rows = [r for r in AWKWARD if not small or len(r[1] or "") < 1000]
    rows += [(20 + k, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))), "s") for k in range(60)]
    df = frame(spark, rows).repartition(3)
    if small:
        monkeypatch.setattr(alignment, "PAIRS", 3)
        t = alignment._build(alignment.load())
        part = [r[1] for r in rows]
        whole = alignment._Slice(t, part)
        monkeypatch.setattr(alignment, "PAIRS", 1 << 20)
        other = alignment._Slice(t, part)
        for name in ("ids", "id_times", "codes", "code_times", "code_doc"):
            assert (getattr(whole, name) == getattr(other, name)).all()
    got = alignment.align(df)
    want, count = brute_alignment(both, rows)
    assert said(got.documents) == want
    assert {(r.a, r.b): r.n for r in got.pairs.collect()} == count


def test_alignment_table(spark, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert said(QUERIES["op12_alignment"](spark, SF)) == brute_alignment(both, rows)[0]
    assert alignment.align(frame(spark, [])).documents.collect() == []
    got = alignment.align(frame(spark, [(1, None, "a"), (1, "", "a")])).documents.collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


# -- resampling

def brute_resampling(docs, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))]]
    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    n, m = s.total() + 10000, t.total() + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in range(10000)]
    out = []
    for i, words, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[:25 * len(able) // 100], 1)}
    return sorted(str((*r[:4], rank.get(id(r)))) for r in out)


def drawn(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


@pytest.mark.parametrize("head", [None, 5])
def test_resampling_table(spark, head, monkeypatch):
    if head:  # a small head, small slices, and words and pairs let go at once change nothing
        for name, value in (("HEAD_WORDS", head), ("HEAD_PAIRS", head), ("HELD", 20), ("SLICE_WORDS", 50), ("STEPS", 3)):
            monkeypatch.setattr(resampling, name, value)
    con = duckdb.connect()
    docs, target = (con.execute(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    assert drawn(QUERIES["op13_resampling"](spark, SF)) == brute_resampling([r[:2] for r in docs], [r[1] for r in target])


def test_resampling_awkward(spark):
    rnd = random.Random(3)
    words = ["the", "The", "né", "日本", "a1", "x-y", "ÀB", "\x7f", "ﬁ", "q" * 100]
    rows = [(i, t) for i, t, _ in AWKWARD]
    rows += [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(15, 40)))) for k in range(100, 160)]
    rows += [(None, "the a1 " * 12), (170, "word " * 25), (170, "word " * 25), (169, "word " * 25)]
    target = [("the né a1 the né", None), (None, None), ("", None)]
    to = spark.createDataFrame(target, "text string, doc_id long")
    got = resampling.resample(frame(spark, [(*r, "s") for r in rows]), to)
    assert drawn(got) == brute_resampling(rows, [t for t, _ in target])
    assert resampling.resample(frame(spark, []), to).collect() == []
    assert drawn(resampling.resample(frame(spark, [(*r, "s") for r in rows]), to.limit(0))) == brute_resampling(rows, [])


def test_head_is_a_shortcut():
    texts = [b"a b a b c", b"", b"b", b"c " + b"long" * 40 + " \u00e9 a b".encode()]
    words, counts = [w for t in texts for w in t.split()], resampling.np.array([len(t.split()) for t in texts])
    pairs = [p for t in texts for p in zip(t.split(), t.split()[1:])]
    for head in (resampling.Head([b"a", b"b"], [b"a b", b"b c"]), resampling.Head([], []), resampling.Head([b"a", b"b", b"c"], [b"b a"])):
        one, two = head.buckets(words, counts)
        assert one.tolist() == [zlib.crc32(w) % 10000 for w in words]
        assert two.tolist() == [zlib.crc32(b" ".join(p)) % 10000 for p in pairs]


def test_frequent(spark):
    rows = [(k, "the cat and the dog " * 3 + f"w{k}", "s") for k in range(50)] + [(99, "x" * 200 + " " + "x" * 200, "s")] * 9
    words, pairs = resampling.frequent(frame(spark, rows))
    assert words == [b"and", b"cat", b"dog", b"the"] and pairs == [b"and the", b"cat and", b"dog the", b"the cat", b"the dog"]
