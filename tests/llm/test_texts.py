"""The other operators and the pipeline, against brute force on awkward rows and on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from vecspark.llm import ORACLE, QUERIES, decontaminate, langid, licenses, quality, secret_scan, sharding, unigram

HEAD = "doc_id long, text string, lang string, source string, n_chars long, w int, spans int, unit string, shard int, ids int"


def frame(spark, rows):
    """(doc_id, text[, lang]) with other columns, some named as operators name theirs."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1] or ""), 1, 2, "u", 3, 4) for r in rows], HEAD)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, "one line."), (4, "same."), (4, "same."), (5, "same."), (6, "x" * 5000),
           (7, "\n".join(["a b c."] * 300)), (8, "né 日本 😀 ﬁ ▁ \x00 end")]


# -- SQL twins

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    by = list(want.columns)
    assert got.sort_values(by, ignore_index=True).astype(object).equals(want.sort_values(by, ignore_index=True).astype(object))


# -- sharding

def least_capacity(sizes, shards):
    def fits(c):
        n, now = 1, 0
        for x in sizes:
            n, now = (n, now + x) if now + x <= c else (n + 1, x)
        return n <= shards
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", [0, 2])
def test_smallest_capacity(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "FETCH", 30)
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 9, 30, 400]) for _ in range(120)] + ([5000] if seed == 2 else [])
    rnd.shuffle(sizes)
    upto = np.cumsum(sizes).tolist()
    df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, upto)), "pos long, size long, upto long")
    got, cuts = sharding.smallest_capacity(df, 7)
    assert got == least_capacity(sizes, 7) and cuts[-1] == upto[-1] and set(cuts) <= {0, *upto}
    assert max(np.diff([0, *cuts])) <= got


def test_shards(spark):
    rows = AWKWARD + [(20 + k, f"text {k % 60} " * (k % 9)) for k in range(200)]
    got = sharding.shard_by_bytes(frame(spark, rows), shards=5).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    shard = {}
    for r in got:
        if r.doc_id is not None:
            assert shard.setdefault(dict(rows)[r.doc_id], r.shard) == r.shard
    group = {}
    for i, t in rows:
        group.setdefault(t, []).append((1 << 62 if i is None else i, len((t or "").encode()) + 8))
    ordered = [sum(x[1] for x in g) for _, g in sorted(group.items(), key=lambda g: min(g[1])[0])]
    assert max(sum(r.size for r in got if r.shard == s) for s in range(5)) <= least_capacity(ordered, 5)
    assert sharding.shard_by_bytes(frame(spark, [])).collect() == []


# -- quality, licences

def test_line_rules(spark):
    prose = "\n".join(" ".join(f"word{k}{c}" for c in "abcdefg") + "." for k in range(6))
    rows = [(1, prose), (2, prose + "\nHome | About | Contact | Help"), (3, "\n".join(["Home | About | Contact"] * 3 + ["menu"] * 30)),
            (4, "la " * 400), (5, prose.replace(".", "")), (6, None), (7, "")]
    got = {r.doc_id: r for r in quality.line_rules(frame(spark, rows)).collect()}
    assert [got[k].kept for k in range(1, 8)] == [True, True, False, False, False, False, False]
    assert got[2].clean_text == prose and got[2].n_bad_lines == 1 and got[6].clean_text is None and got[7].clean_text == ""
    assert got[3].n_dup_lines == 31 and got[4].n_repeat_words == 400 and got[4].base_failed
    assert quality.line_rules(frame(spark, [])).collect() == []
    assert quality.line_rules(frame(spark, AWKWARD)).count() == len(AWKWARD)


def test_repeat_words(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 60)))) for k in range(40)]
    for r in quality.line_rules(frame(spark, rows)).collect():
        w = rows[r.doc_id][1].split()
        wins = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        assert r.n_repeat_words == len({k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)})


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"][1]
    rows = [(1, "Some text.\nReleased under the MIT license\nMore text."), (2, mit.replace(" ", "\n", 5)), (3, "the MIT campus"),
            *((10 + i if i else i, t) for i, t in AWKWARD)]
    got = {(r.doc_id, r.line): (r.license, r.dice) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {(1, 1): ("mit", 1.0), (2, -1): ("mit", 1.0)} or set(got) >= {(1, 1), (2, -1)} and got[2, -1] == ("mit", 1.0)
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


# -- secrets

def test_secrets(spark):
    rnd = random.Random(4)
    mixed = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    names = ["getUserNameFromRequest", "parse_configuration_file", "InternationalizationHelper", "make_connection_pool"]
    labelled = spark.createDataFrame([(mixed(40), True) for _ in range(60)] + [
        (rnd.choice(names) + rnd.choice(names), False) for _ in range(200)], "token string, random boolean")
    model = secret_scan.train(labelled)
    key = mixed(44)
    rows = [(1, f"é {key} end"), (2, "parse_configuration_fileInternationalizationHelper"), (3, 'Token = "abcdefgh1" and api-key: x'),
            (4, "AKIA" + "B" * 11 + " AKIA" + "C" * 12), (5, "0" * 31 + " " + "f" * 32), (6, 'token=secret"=abcdefgh12'),
            *((10 + i if i else i, t) for i, t in AWKWARD)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(frame(spark, rows), model).collect()}
    assert got[1] == [("markov", 2, 46)] and got[2] == [] and got[3] == [("assign", 0, 18)]
    assert got[4] == [("access", 16, 32)] and got[6] == [] and [x for x in got[5] if x[0] != "markov"] == [("hex", 32, 64)]
    clean = {r.doc_id: r for r in secret_scan.without_secrets(frame(spark, rows), model).collect()}
    assert clean[1].text == "é [secret] end" and clean[1].n_chars == len("é [secret] end") and clean[2].text == rows[1][1]
    assert clean[11].text is None and list(clean[1].asDict()) == [c.split()[0] for c in HEAD.split(", ")]
    assert secret_scan.without_secrets(frame(spark, []), model).collect() == []
    assert all(abs(x) < 1e-9 for x in secret_scan.train(labelled.limit(0)))


def test_secret_scores_are_the_chain_s(spark):
    """ab, ba, ab against aa, ab, bb, worked out by hand."""
    model = secret_scan.train(spark.createDataFrame([("abab", True), ("aabb", False)], "token string, random boolean"))
    k = len(secret_scan.ALPHABET)
    p = lambda pair, row, symbol: math.log((pair + 5 * (symbol + 0.5) / (3 + 0.5 * k)) / (row + 5))
    assert abs(model[1] - (p(2, 2, 2) - p(1, 2, 2))) < 1e-9 and abs(model[0] - (p(0, 2, 1) - p(1, 2, 1))) < 1e-9


def test_base_spans_on_the_table(spark):
    pattern = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    got = QUERIES["op8_secret_scan"](spark, SF).collect()
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert len(got) == len(text)
    for r in got:
        t = text[r.doc_id]
        spans = [(m.start(), 0, "assign", m.end()) for m in pattern.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()


# -- languages

def longest_phrases(text, s):
    n, at = 0, 0
    while at < len(s):
        k = 1
        while at + k < len(s) and s[at:at + k + 1] in text:
            k += 1
        n, at = n + 1, at + k
    return n


def test_automaton():
    rnd = random.Random(1)
    for _ in range(20):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 60)))
        a = langid.Automaton(text)
        for _ in range(20):
            s = "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 12)))
            assert a.phrases(s) == longest_phrases(text, s)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op3_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in got)
    texts = {"aa": "lalo malo kalo", "bb": "xyz zyx xzy"}
    said = {(r.doc_id, r.lang_pred) for r in langid.identify(frame(spark, [(1, None), (2, ""), (3, "12 %"), (4, "malo LALO"), (4, "Zyx")]), texts).collect()}
    assert said == {(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "bb")}
    assert {r.lang_pred for r in langid.identify(frame(spark, AWKWARD), {}).collect()} == {"und"}
    assert langid.training_texts(frame(spark, [(1, "text", None), (2, None, "en")]), F.lit(True)) == {}
    kept = langid.with_language(frame(spark, [(1, "malo kalo"), (2, "77"), (3, None)]), texts).collect()
    assert [r.doc_id for r in kept] == [1] and len(kept[0]) == 10


def test_letters(spark):
    """Numbers that count as word characters elsewhere are no letters; marks belong to the letter before them."""
    assert langid.words("½ ² ⅷ 7 _ ٣") == [] and langid.words("Été e\u0301te\u0301 x2y") == ["été", "e\u0301te\u0301", "x", "y"]
    assert langid.words("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]
    got = langid.identify(frame(spark, [(1, "½ ²"), (2, "ⅷ"), (3, "e\u0301")]), {"aa": "lalo", "bb": "xyz"}).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id < 3} == {1: "und", 2: "und"} and {r.score for r in got if r.doc_id < 3} == {0.0}


def test_training_on_long_and_equal_texts(spark):
    rows = [(k, "same words again and again", "en") for k in range(90)] + [(100, "other words", "en"), (101, "x" * 60_000, "xx"), (102, "12", "zz")]
    got = langid.training_texts(frame(spark, rows), F.lit(True), sample=3)
    assert set(got) == {"en", "xx"} and sorted(got["en"].split("\n")) == ["other words", "same words again and again"]
    assert got["xx"] == "x" * langid.TRAIN_CHARS


def test_cost_and_score(spark):
    """Prediction and score by counting phrases of each word in each language's text."""
    texts = {"aa": "lalo malo kalo mola", "bb": "xyz zyx xzy mol", "cc": "lax may"}
    rows = [(k, t) for k, t in enumerate(["lamo xal", "malo", "zzyx mol", "LAX lax, may", "qqq", "mol la 77 xy"])]
    cost = lambda t, x: sum(longest_phrases(f" {' '.join(langid.words(x))} ", f" {w} ") for w in langid.words(t)) * math.log2(len(x) + 2)
    for r in langid.identify(frame(spark, rows), texts).collect():
        costs = sorted((cost(rows[r.doc_id][1], x), lang) for lang, x in texts.items())
        assert r.lang_pred == costs[0][1] and math.isclose(r.score, costs[1][0] / (costs[0][0] + costs[1][0]))


# -- benchmark

def test_wand_finds_all():
    rnd = random.Random(2)
    items = [(k, " ".join(f"t{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randrange(1, 25)))) for k in range(150)]
    said = [decontaminate.words(t) for _, t in items]
    df = Counter(t for w in said for t in set(w))
    index = decontaminate.Index(items, len(items), sum(map(len, said)) / len(said), max(map(len, said)), df)
    for _ in range(200):
        terms = sorted({index.number[f"t{k}"] for k in rnd.sample(range(60), 12) if f"t{k}" in index.number})
        score = np.zeros(len(items))
        for t in terms:
            score[index.docs[t]] += index.impact[t]
        for threshold in (0.15, 0.4, 0.8):
            a, b = sorted((rnd.randrange(151), rnd.randrange(151)))
            for first, end in ((0, None), (a, b)):
                want = [k for k in np.flatnonzero(score >= threshold) if first <= k < (150 if end is None else end)]
                got = index.search(terms, threshold - 1e-9, first, end)
                assert [n for n, _ in got] == want and np.allclose([s for _, s in got], score[want])


def test_contamination(spark):
    item = "Which river crosses the old town of Lisbon on its way to the sea? The Tagus does, as every child there knows."
    other = "What weighs more, a ton of iron or a ton of feathers? Both weigh the same, which is one ton."
    fill = " ".join(f"filler{k}" for k in range(300))
    index = decontaminate.indexes(spark.createDataFrame([(1, item), (2, other), (3, None), (None, "")], "item_id long, text string"))
    rows = [(1, fill + " " + item.upper().replace(",", "") + " " + fill), (2, fill), (3, item.split("?")[0] + fill), (4, other),
            (4, other), (5, "the old town of the sea a ton of iron"), *((10 + i if i else i, t) for i, t in AWKWARD)]
    got = decontaminate.contaminations(frame(spark, rows), index).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (4, 2), (4, 2)]
    assert sorted({r.doc_id for r in decontaminate.without_contaminated(frame(spark, rows), index).collect()} & {1, 2, 3, 4, 5}) == [2, 3, 5]
    many = decontaminate.indexes(spark.createDataFrame([(1, item), (2, other)], "item_id long, text string"), chars=50)
    assert many.parts > 1 and sorted((r.doc_id, r.item_id) for r in decontaminate.contaminations(frame(spark, rows), many).collect()) == [(1, 1), (4, 2), (4, 2)]
    none = decontaminate.indexes(spark.createDataFrame([], "item_id long, text string"))
    assert decontaminate.contaminations(frame(spark, rows), none).collect() == []
    assert decontaminate.without_contaminated(frame(spark, rows), none).count() == len(rows)


@pytest.mark.parametrize("parts", [13, 46])
def test_scores_do_not_depend_on_the_number_of_indexes(spark, parts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(items.select(F.col("item_id") + 10_000, "text"))
    some = decontaminate.indexes(items, chars=chars // (parts - 1) - 1)
    assert some.parts == parts
    said = lambda found: sorted((r.doc_id, r.item_id, round(r.score, 12), r.question_overlap, r.answer_overlap)
                                for r in decontaminate.contaminations(docs, found).collect())
    assert said(some) == said(decontaminate.indexes(items)) and len(said(some)) >= 40


def test_leaks_in_the_table(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, SF).collect()} == want


# -- pieces

@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load_pieces(unigram.MODEL_PATH)


def best_score(v, keys, chunk):
    best = [0.0] + [-math.inf] * len(chunk)
    heads = [k for k, c in enumerate(chunk) if c & 0xC0 != 0x80] + [len(chunk)]
    for s in range(len(chunk)):
        for n in range(1, min(v.longest, len(chunk) - s) + 1):
            i = keys.get(chunk[s:s + n])
            if i is not None:
                best[s + n] = max(best[s + n], best[s] + v.score[i])
        if s in heads:
            e = heads[heads.index(s) + 1]
            if chunk[s:e] not in keys:
                best[e] = max(best[e], best[s] + v.unknown)
    return best[-1]


def test_segments_are_the_best(vocabulary):
    v = vocabulary
    keys = {bytes(v.flat[a:b]): i for i, (a, b) in enumerate(zip(v.offset[:-1], v.offset[1:])) if b > a and i not in set(v.byte_id.tolist())}
    rnd = random.Random(7)
    chunks = [unigram.SPACE * rnd.randrange(0, 4) + "".join(rnd.choice("theanisch éß日😀\n▁Q") for _ in range(rnd.randrange(1, 14))).replace(" ", "").encode()
              for _ in range(300)]
    ids, ends = unigram.segment(v, chunks)
    lone = set(v.byte_id.tolist())
    for c, a, b in zip(chunks, ends[:-1], ends[1:]):
        mine = ids[a:b].tolist()
        assert b"".join(bytes(v.flat[v.offset[i]:v.offset[i + 1]]) for i in mine) == c
        score, k = 0.0, 0
        while k < len(mine):
            if mine[k] in lone:
                first = v.flat[v.offset[mine[k]]]
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                score += v.unknown
            else:
                score, k = score + v.score[mine[k]], k + 1
        assert score == best_score(v, keys, c)


def test_double_array():
    rnd = random.Random(8)
    keys = {bytes(rnd.choice(b"\x00abc\xff") for _ in range(rnd.randrange(1, 6))): k for k in range(300)}
    base, check, value = unigram.double_array(keys)

    def find(key):
        s = 0
        for c in key:
            t = base[s] + c + 1
            if check[t] != s:
                return -1
            s = t
        return value[s]
    assert all(find(k) == i for k, i in keys.items())
    assert all(find(k + b"b") == keys.get(k + b"b", -1) for k in keys)


def test_round_trip(spark, vocabulary):
    rows = AWKWARD + [(20, "  two  spaces \r\n"), (21, "▁▁ marks ▁"), (22, "long " * 3000), (23, "퟿�\U0010ffff")]
    df = frame(spark, rows)
    out = unigram.decode(unigram.encode(df, vocabulary), vocabulary).collect()
    assert len(out) == len(rows) and all(r.decoded == r.text for r in out)
    assert {r.doc_id: r.ids for r in out}[1] is None and {r.doc_id: r.ids for r in out}[2] == []
    assert out[0].asDict().keys() == {*df.columns, "decoded"}
    assert unigram.encode(df.limit(0), vocabulary).collect() == []
    assert all(r.round_trip for r in QUERIES["op9_sentencepiece"](spark, SF).collect())


# -- pipeline

def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    texts = [docs[i].text for i in got]
    assert len(set(texts)) == len(texts) and not any(x in t for t in texts for x in items)
    assert len(got) >= 0.8 * len(docs)
    v = unigram.load_pieces(unigram.MODEL_PATH)
    for i, r in list(got.items())[:40]:
        text = b"".join(bytes(v.flat[v.offset[k]:v.offset[k + 1]]) for k in r.ids).removeprefix(unigram.SPACE).replace(unigram.SPACE, b" ").decode()
        assert text == docs[i].text or "[secret]" in text


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, name, stage):
    rows = [(*r, "en") for r in AWKWARD] + [(30, "token = abcdefgh12345", None), (31, "plain words here.", "de")]
    docs = frame(spark, rows)
    out = stage(spark, docs, SF)
    if name != "pieces":
        assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert {30, 31} <= set(ids)
    if name == "near_duplicates":
        assert len([i for i in ids if i in (4, 5)]) == 1
    assert stage(spark, docs.limit(0), SF).collect() == []
