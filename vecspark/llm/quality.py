"""Line-first quality rules, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.text import BLANKS, only, words

#: words of a window whose repetition counts
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: a line must end in one of these, closing quotes and brackets aside
ENDING = r"[.!?:;…][\"'”’»)\]]*[ \t\x0B\x0C\r]*$"
#: menu separators; two of them, or a line that opens like a menu
NAVIGATION = r"(?i)([|»›>•][^|»›>•]*){2}|^[ \t]*(home|menu|skip to|next page|previous page|back to top)\b"
BOILERPLATE = (r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|javascript|lorem ipsum"
               r"|subscribe to our|click here|sign in to|log in to")


def _windows(w: Column, n: Column) -> Column:
    """One hash for each window, from its words one by one."""
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 20,
               max_repeated: int = 30, max_lost: float = 0.5) -> DataFrame:
    """Judge every line, take out those that fail, then judge what each document lost.

    A line that has a word fails when it does not end a sentence, looks like navigation, or holds a stock phrase.
    A document is kept if it has ``min_words`` words, at most ``max_repeated`` percent of them in repeated windows
    of eight, and loses at most ``max_lost`` of its word characters with the failed lines.

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_bad_lines, lost_chars, clean_text), one row for each row of ``docs``. A null text counts as an empty one
    (its clean text is null) and fails for want of words; repeated rows and equal ids are judged one by one.
    Everything is computed within the row: no shuffle, whatever the keys look like.
    """
    text = F.coalesce("text", F.lit(""))
    d = only(docs, id_col, text_col).select(
        "doc_id", "text", words(F.col("text")).alias("w"), F.split(text, "\n").alias("lines"))
    has_word = lambda x: F.length(F.translate(x, BLANKS, "")) > 0
    bad = lambda x: has_word(x) & (~x.rlike(ENDING) | x.rlike(NAVIGATION) | x.rlike(BOILERPLATE))
    d = d.select(
        "doc_id", "text", F.size("w").alias("n"), _windows(F.col("w"), F.size("w")).alias("h"),
        F.filter("lines", has_word).alias("full"), F.filter("lines", bad).alias("bad"),
        F.when(F.col("text").isNotNull(), F.concat_ws("\n", F.filter("lines", lambda x: ~bad(x)))).alias("clean_text"))
    # only a text with two equal windows is looked at closer: equal hashes stand side by side once sorted
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(F.col("s"), k)["h"]
    d = d.withColumn("p", F.sort_array(F.filter(F.transform("s", lambda x, k: F.when(
        (F.coalesce(at(k - 1) == x["h"], F.lit(False))) | (F.coalesce(at(k + 1) == x["h"], F.lit(False))), x["i"])),
        lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    chars = lambda x: F.length(F.translate(x, BLANKS, "")).cast("long")
    d = d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), chars(text).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("full").cast("long").alias("n_lines"), F.size("bad").cast("long").alias("n_bad_lines"),
        chars(F.array_join("bad", "")).alias("lost_chars"), "clean_text")
    d = d.withColumn("base_failed", (F.col("n_words") < min_words)
                     | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars")))


_BAD = (f"regexp_matches(x, '[^\\x20\\x09-\\x0D]') AND (NOT regexp_matches(x, '{ENDING.replace(chr(39), chr(39) * 2)}') "
        f"OR regexp_matches(x, '{NAVIGATION}') OR regexp_matches(x, '{BOILERPLATE}'))")
for _c in "…”’»›•":  # the one dialect writes these as escapes, the other as themselves
    _BAD = _BAD.replace(f"\\u{ord(_c):04x}", _c)

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS f,
  list_filter(string_split(text, chr(10)), lambda x: {_BAD}) AS bad FROM d),
wins AS (SELECT doc_id, t.i, array_to_string(w[t.i:t.i + {WINDOW - 1}], ' ') AS win
  FROM w, range(1, (SELECT max(len(w)) FROM w) + 1) t(i) WHERE t.i <= len(w) - {WINDOW - 1}),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(0, {WINDOW}) r(k) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(f) - len(list_distinct(f)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(f) AS BIGINT) AS n_lines, CAST(len(bad) AS BIGINT) AS n_bad_lines,
  length(regexp_replace(array_to_string(bad, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM b"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark, sf):
    return line_rules(documents(spark, sf)).drop("clean_text")
