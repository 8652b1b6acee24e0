"""Secrets in texts: fixed patterns, and tokens that two Markov models find random; in built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.text import only

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: what a model judges: maximal runs of these, of some length
TOKEN_CHARS = "A-Za-z0-9+/_-"
ALPHABET = "".join(chr(c) for a, b in ("az", "AZ", "09") for c in range(ord(a), ord(b) + 1)) + "+/_-"
KINDS = ("assign", "access", "hex", "markov")

#: labelled documents that the models are trained on, at most about so many, and the shortest ordinary word they learn from
TRAIN_DOCS, TRAIN_WORD = 4000, 6
#: shortest token judged, and the log-likelihood ratio (nats, in all and for each symbol) from which it is a secret
MIN_TOKEN, MIN_LLR, MIN_MEAN = 20, 20.0, 0.7

_SPANS = "array<struct<start:int,end:int>>"


def _found(matches: str, pieces: str) -> Column:
    """Where matches lie, from the texts between them: starts and ends in code points."""
    return F.coalesce(F.expr(f"""aggregate(
        if(size({matches}) > 0, sequence(0, size({matches}) - 1), array()),
        named_struct('at', 0, 'out', cast(array() AS {_SPANS})),
        (a, i) -> named_struct('at', a.at + length({pieces}[i]) + length({matches}[i]), 'out', concat(a.out, array(named_struct(
            'start', a.at + length({pieces}[i]), 'end', a.at + length({pieces}[i]) + length({matches}[i]))))),
        a -> a.out)"""), F.expr(f"cast(array() AS {_SPANS})"))


def _matches(d: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: the spans of a pattern's leftmost non-overlapping matches. Texts without one are left early."""
    has, p = F.col("text").rlike(pattern), F.lit(pattern)
    d = d.withColumns({f"{name}_m": F.when(has, F.regexp_extract_all("text", p, F.lit(0))),
                       f"{name}_p": F.when(has, F.split("text", pattern, -1))})
    return d.withColumn(name, _found(f"{name}_m", f"{name}_p")).drop(f"{name}_p")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, whole_row: bool = False) -> DataFrame:
    """(doc_id, text, assign, access, hex): spans of the base kinds, starts and ends in code points, end exclusive.
    ``whole_row`` adds ``row``, a struct of the other columns."""
    d = only(docs, id_col, text_col)
    if whole_row:
        d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                        F.struct(F.lit(0).alias("__"), *[docs[c] for c in docs.columns if c != text_col]).alias("row"))
    d = _matches(d, "assign", ASSIGN).withColumn(
        "v", F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))))
    d = d.withColumn("assign", F.filter("assign", lambda s, i: F.length(F.get(F.col("v"), i)) >= 8)).drop("v", "assign_m")
    return _matches(_matches(d, "access", ACCESS), "hex", HEX).drop("access_m", "hex_m")


def _bigrams(tokens: DataFrame) -> DataFrame:
    """(random, pair, n): how often two symbols follow each other in the tokens of each class."""
    t = tokens.select("random", F.split(F.regexp_replace("token", f"[^{TOKEN_CHARS}]", ""), "").alias("c"))
    t = t.where(F.size("c") > 1).select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i)))).alias("pair"))
    return t.where(F.length("pair") == 2).groupBy("random", "pair").agg(F.count("*").alias("n"))


def labelled_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = TRAIN_DOCS) -> DataFrame:
    """(token, random): secrets that the base patterns find, and ordinary words of the same documents.

    ``sample`` bounds the documents: they are the ones whose id's hash is divisible by a number chosen from the count.
    """
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(docs[id_col]), F.lit(max(1, n // sample))) == 0)
    b = base_spans(some, id_col, text_col)
    cut = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    secrets = b.select(F.explode(F.concat(
        F.transform("assign", lambda s: F.regexp_extract(cut(s), ASSIGN, 1)),
        F.transform("access", cut), F.transform("hex", cut))).alias("token"), F.lit(True).alias("random"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = b.select(F.explode(F.regexp_extract_all(clean, F.lit(f"[{TOKEN_CHARS}]{{{TRAIN_WORD},}}"), F.lit(0))).alias("token"),
                     F.lit(False).alias("random"))
    return secrets.union(words)


def train(tokens: DataFrame, *, prior: float = 0.5, back_off: float = 5.0) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each two symbols in a row.

    ``tokens`` has (token, random). Both models are first-order chains over 66 symbols: pairs are smoothed with
    ``back_off`` times how common the second symbol is in the class, symbols with ``prior`` counts each. A class without samples
    is the uniform chain. At most 2 x 66 x 66 counts reach the driver.
    """
    k = len(ALPHABET)
    n = {c: [[0] * k for _ in range(k)] for c in (True, False)}
    for r in _bigrams(tokens).collect():
        n[r.random][ALPHABET.index(r.pair[0])][ALPHABET.index(r.pair[1])] += r.n

    def logs(rows: list[list[int]]) -> list[float]:
        symbol = [sum(row[j] for row in rows) + prior for j in range(k)]
        total = sum(symbol)
        return [math.log((x + back_off * y / total) / (sum(row) + back_off)) for row in rows for x, y in zip(row, symbol)]
    return [x - y for x, y in zip(logs(n[True]), logs(n[False]))]


def scan_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", *,
                 min_token: int = MIN_TOKEN, min_llr: float = MIN_LLR, min_mean: float = MIN_MEAN,
                 whole_row: bool = False) -> DataFrame:
    """Spans of secrets in each text.

    Base kinds come from fixed patterns. A token of ``min_token`` symbols or more that overlaps none of them is a
    secret of kind markov when its log-likelihood ratio reaches ``min_llr``, and ``min_mean`` for each pair of symbols.

    Returns (doc_id, text, spans): ``spans`` has (start, rank, kind, end) by start and kind, in code points, end
    exclusive. One row for each row of ``docs``, nothing moves between tasks. A null text has no spans.
    """
    d = base_spans(docs, id_col, text_col, whole_row=whole_row)
    d = _matches(d, "run", f"[{TOKEN_CHARS}]{{{min_token},}}")
    k, table = len(ALPHABET), F.array(*[F.lit(round(x, 6)) for x in model])
    known = F.concat("assign", "access", "hex")
    free = F.filter(F.arrays_zip(F.col("run").alias("s"), F.col("run_m").alias("t")), lambda x: ~F.exists(
        known, lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"])))
    d = d.withColumn("free", F.when(F.size("run") > 0, F.transform(free, lambda x: F.struct(
        x["s"].alias("s"), F.transform(F.split(x["t"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1).alias("i")))))
    llr = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.size(x["i"]) - 1), F.lit(0.0),
        lambda a, j: a + F.coalesce(F.get(table, F.get(x["i"], j - 1) * k + F.get(x["i"], j)), F.lit(0.0)))
    scored = F.transform("free", lambda x: F.struct(x["s"].alias("s"), llr(x).alias("llr")))
    d = d.withColumn("markov", F.coalesce(F.transform(F.filter(scored, lambda x: (x["llr"] >= min_llr) & (
        x["llr"] >= min_mean * (x["s"]["end"] - x["s"]["start"] - 1))), lambda x: x["s"]), F.expr(f"cast(array() AS {_SPANS})")))
    tagged = [F.expr(f"transform({kind}, s -> named_struct('start', s.start, 'rank', {r}, 'kind', '{kind}', 'end', s.end))")
              for r, kind in enumerate(KINDS)]
    return d.select("doc_id", "text", F.sort_array(F.concat(*tagged)).alias("spans"), *(["row"] if whole_row else []))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced by ``mark``; spans that overlap become one mark."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def without_secrets(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text",
                    length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their columns, secrets replaced by a mark; a length column follows the new text."""
    found = scan_secrets(docs, model, id_col, text_col, whole_row=True).withColumn("new", redact(F.col("text"), F.col("spans")))
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            cols.append(F.col("new").cast(kind).alias(c))
        elif c == length_col:
            cols.append(F.when(F.size("spans") > 0, F.length("new").cast(kind)).otherwise(F.col("row").getField(c)).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return found.select(*cols)


@query("op8_secret_scan")
def op8(spark, sf):
    docs = documents(spark, sf)
    found = scan_secrets(docs, train(labelled_tokens(docs)))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"))
