"""Text functions and vectorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspark.catalog.registry import documents, query, r6, s6, sql_gaussian, table
from vecspark.functions import text as X
from vecspark.operators import textvec as V
from vecspark.session import materialize

HEADERS = ["subject", "from", "page"]

STANDARD = r"regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’.][\p{L}\p{N}]+)*')"
MESSAGE = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}./:]+'), lambda x: x <> '')"
TOK = f"tok AS (SELECT doc_id, unnest({STANDARD}) AS term FROM documents)"
TF = f"{TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
DF = "df AS (SELECT term, count(*) AS df, CAST(row_number() OVER (ORDER BY encode(term)) - 1 AS INTEGER) AS dim FROM tf GROUP BY term)"
QUOTED = r"'^(In article .*|> .*|.*writes:|\|>.*)$'"


def parsed_sql(source: str, key: str, headers: list[str], quotes: bool) -> str:
    names = ", ".join(f"'{h}'" for h in headers) or "''"
    keep = "true" if quotes else f"NOT regexp_matches(s, {QUOTED})"
    return f"""ln AS (SELECT {key} AS doc_id, regexp_split_to_array({source}, '\\r?\\n') AS ls FROM {{table}}),
hd AS (SELECT doc_id, ls, CASE WHEN list_position(ls, '') > 0 THEN list_position(ls, '') - 1 ELSE len(ls) END AS h FROM ln),
kept AS (SELECT doc_id, list_concat(
  list_transform(list_filter(ls[1:h], lambda s: lower(split_part(s, ':', 1)) IN ({names})),
                 lambda s: substr(s, instr(s, ':') + 1)),
  list_filter(ls[h+1:], lambda s: {keep})) AS ks FROM hd),
msg AS (SELECT doc_id, coalesce(array_to_string(ks, chr(10)), '') AS text FROM kept)"""


#: documents with a header line each, so that all parts of the parser have work
MAIL = ("mail AS (SELECT doc_id, 'Subject: ' || source || chr(10) || 'Lang: ' || lang || chr(10) || "
        "CASE WHEN doc_id % 3 = 0 THEN text ELSE chr(10) || '> ' || text || chr(10) || 'x writes:' || chr(10) || text END AS text FROM documents)")


def mail(spark, sf):
    head = F.concat(F.lit("Subject: "), "source", F.lit("\nLang: "), "lang", F.lit("\n"))
    body = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        F.concat(F.lit("\n> "), "text", F.lit("\nx writes:\n"), "text"))
    return documents(spark, sf).select("doc_id", F.concat(head, body).alias("text"))


@query("tokenize_standard", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def tokenize_standard(spark, sf):
    return V.term_freq(documents(spark, sf), X.tokenize_standard("text"))


@query("tokenize_message", f"WITH tok AS (SELECT doc_id, unnest({MESSAGE}) AS term FROM documents) "
       "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")
def tokenize_message(spark, sf):
    return V.term_freq(documents(spark, sf), X.tokenize_message("text"))


@query("tokenize_conversations", f"WITH tok AS (SELECT conv_id * 1000 + turn AS doc_id, unnest({MESSAGE}) AS term FROM conversations) "
       "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")
def tokenize_conversations(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return V.term_freq(c, X.tokenize_message("text"))


@query("header_allow_list", f"WITH {MAIL}, {parsed_sql('text', 'doc_id', HEADERS, True).format(table='mail')}, "
       "x AS (SELECT doc_id, unnest(list_filter(ls[1:h], lambda s: lower(split_part(s, ':', 1)) IN ('subject', 'from', 'page'))) AS line FROM hd) "
       "SELECT doc_id, line, count(*) AS n FROM x GROUP BY ALL")
def header_allow_list(spark, sf):
    return (mail(spark, sf).select("doc_id", F.explode(X.header_lines("text", HEADERS)).alias("line"))
            .groupBy("doc_id", "line").agg(F.count("*").alias("n")))


@query("quoted_line_filter", f"WITH {MAIL}, {parsed_sql('text', 'doc_id', HEADERS, False).format(table='mail')}, "
       f"x AS (SELECT doc_id, unnest(list_filter(ls[h+1:], lambda s: NOT regexp_matches(s, {QUOTED}))) AS line FROM hd) "
       "SELECT doc_id, md5(line) AS line, count(*) AS n FROM x GROUP BY ALL")
def quoted_line_filter(spark, sf):
    return (mail(spark, sf).select("doc_id", F.explode(X.body_lines("text")).alias("line"))
            .select("doc_id", F.md5("line").alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n")))


@query("parse_message", f"WITH {MAIL}, {parsed_sql('text', 'doc_id', HEADERS, False).format(table='mail')} "
       "SELECT doc_id, md5(text) AS digest, length(text) AS n_chars FROM msg")
def parse_message(spark, sf):
    return mail(spark, sf).select("doc_id", X.parse_message("text", HEADERS).alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query("label_from_path", "SELECT page_id, string_split(url, '/')[-2] AS label FROM pages")
def label_from_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.label_from_path("url").alias("label"))


@query("hash_term", f"WITH {TF}, u AS (SELECT DISTINCT term FROM tf) SELECT term, "
       "CAST(CAST('0x' || substr(md5(term), 1, 8) AS UBIGINT) % 1000 AS INTEGER) AS bucket FROM u")
def hash_term(spark, sf):
    return V.doc_freq(documents(spark, sf)).select("term", X.hash_term("term", 1000).alias("bucket"))


def _weight(name, sql, column):
    @query(name, f"WITH {TF}, {DF} SELECT doc_id, tf.term, {s6(sql)} AS w FROM tf JOIN df USING (term)")
    def run(spark, sf):
        d = documents(spark, sf)
        tf = V.join_terms(materialize(V.term_freq(d)), materialize(V.doc_freq(d)))
        n = F.lit(d.count())
        return tf.select("doc_id", "term", r6(column(F.col("tf"), F.col("df"), n)).alias("w"))


_N = "(SELECT count(*) FROM documents)"
_weight("term_weight_log", "ln(tf + 1)", lambda tf, df, n: X.TERM_WEIGHTS["l"](tf))
_weight("term_weight_sqrt", "sqrt(tf)", lambda tf, df, n: X.TERM_WEIGHTS["s"](tf))
_weight("term_weight_linear", "CAST(tf AS DOUBLE)", lambda tf, df, n: X.TERM_WEIGHTS["t"](tf))
_weight("term_weight_unit", "CAST(1 AS DOUBLE)", lambda tf, df, n: X.TERM_WEIGHTS["x"](tf))
_weight("corpus_weight_idf", f"tf * ln(({_N} + 1) / (df + 1))", lambda tf, df, n: X.CORPUS_WEIGHTS["i"](tf, df, n, False))
_weight("corpus_weight_idf_floor", f"tf * ln(({_N} + 1) // (df + 1))", lambda tf, df, n: X.CORPUS_WEIGHTS["i"](tf, df, n, True))
_weight("corpus_weight_none", "CAST(tf AS DOUBLE)", lambda tf, df, n: X.CORPUS_WEIGHTS["x"](tf.cast("double"), df, n, False))
for _name, _sql in {"linear": "tf * ln(n / df)", "const": "ln(n / df)", "log": "ln(tf) * ln(n / df)",
                    "sqrt": "sqrt(tf) * ln(n / df)"}.items():
    _weight(f"scorer_{_name}", _sql.replace("n / df", f"{_N} / df"),
            lambda tf, df, n, s=_name: X.get_scorer(s)(tf, df, n))


@query("doc_freq", f"WITH {TF}, {DF} SELECT term, df FROM df")
def doc_freq(spark, sf):
    return V.doc_freq(documents(spark, sf))


@query("doc_freq_from_counts", f"WITH {TF}, {DF} SELECT term, df FROM df")
def doc_freq_from_counts(spark, sf):
    return V.doc_freq_of(V.term_freq(documents(spark, sf)))


@query("dictionary", f"WITH {TF}, {DF} SELECT term, df, dim FROM df")
def dictionary(spark, sf):
    return V.dictionary(V.doc_freq(documents(spark, sf)))


@query("tfidf", f"WITH {TF}, {DF} SELECT doc_id, dim, {s6(f'tf * ln({_N} / df)')} AS val FROM tf JOIN df USING (term)")
def tfidf(spark, sf):
    return V.tfidf(documents(spark, sf)).select("doc_id", "dim", r6("val").alias("val"))


def _hashed_sql(term: str, corpus: str, cosine: bool, source: str = "msg") -> str:
    val = "w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0)" if cosine else "w"
    return f"""WITH {MAIL}, {parsed_sql('text', 'doc_id', HEADERS, False).format(table='mail')},
tok AS (SELECT doc_id, unnest({MESSAGE}) AS term FROM msg),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(tf.term), 1, 8) AS UBIGINT) % 100 AS INTEGER) AS bucket,
  sum({term} * {corpus}) AS w FROM tf JOIN df USING (term) GROUP BY ALL)
SELECT doc_id, bucket, {s6(f'coalesce({val}, 0)')} AS val FROM b"""


_IDF = f"ln(({_N} + 1) / (df + 1))"
for _code, (_t, _c) in {"lic": ("ln(tf + 1)", _IDF), "sxc": ("sqrt(tf)", "1"), "tix": ("tf", _IDF),
                        "xxx": ("1.0", "1")}.items():
    def _run(spark, sf, code=_code):
        v = V.hashed_vectors(mail(spark, sf), code, 100, headers=HEADERS)
        return v.select("doc_id", "bucket", r6("val").alias("val"))
    query(f"hashed_vectors_{_code}", _hashed_sql(_t, _c, _code[2] == "c"))(_run)


@query("hashed_vectors_dense", _hashed_sql("ln(tf + 1)", _IDF, True))
def hashed_dense(spark, sf):
    v = V.hashed_vectors(mail(spark, sf), "lic", 100, headers=HEADERS, dense=True)
    return (v.select("doc_id", F.posexplode("vec").alias("bucket", "val")).filter("val <> 0")
            .select("doc_id", "bucket", r6("val").alias("val")))


_PROJ = ", ".join(f"{s6(f'sum(val * g{j})')} AS v{j}" for j in range(4))
_G = ", ".join(f"{sql_gaussian('21', 'dim', str(j))} AS g{j}" for j in range(4))


@query("reduce_dimension_sparse", f"WITH {TF}, {DF}, g AS (SELECT term, dim, df, {_G} FROM df), "
       f"x AS (SELECT doc_id, tf * ln({_N} / df) AS val, g0, g1, g2, g3 FROM tf JOIN g USING (term)) "
       f"SELECT doc_id, {_PROJ} FROM x GROUP BY doc_id")
def reduce_sparse(spark, sf):
    v = V.reduce_sparse(V.tfidf(documents(spark, sf)), 4, 21)
    return v.select("doc_id", *[r6(F.col("vec")[j]).alias(f"v{j}") for j in range(4)])
