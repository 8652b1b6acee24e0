"""Sources mixed to target weights by a low-discrepancy schedule of slots; in built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.running import running_sum
from vecspark.llm.tables import Tables
from vecspark.llm.text import words
from vecspark.session import BROADCAST_BYTES

#: words of a slot; times that a document may be taken; weights, in turn, of sources in the order of their names
BLOCK, MOST, WEIGHTS = 4096, 3, (1, 2, 3)
#: names the shuffle of each source's documents
SEED = "mix"
#: slots that one row of a source unfolds into at once, and ways that a source's documents are dealt to its row
SPREAD, SALTS = 4096, 64

_BIG = "decimal(38,0)"


@dataclass
class Mix:
    """``sources``: (source, source_no, weight, source_size, target, words, slots, start); ``line``: (doc_id, source_no, source,
    size, source_size, target, words, at), each source's documents shuffled, ``at`` counting the words before; ``slots``: (slot, source_no, r)."""

    sources: DataFrame
    line: DataFrame
    slots: DataFrame
    block: int
    most: int


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _targets(sources: DataFrame, total: int, most: int) -> DataFrame:
    """Adds ``target``: ``total`` shared by weight, no source above ``most`` times its size.

    A round fixes the sources whose share is above their bound and shares the rest anew, until none is above. Shares are
    compared as integers; only two sums reach the driver in a round.
    """
    bound, weight = (F.col("source_size") * most).cast(_BIG), F.col("weight").cast(_BIG)
    every = int(sources.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    left, open_, fixed = total, every, F.lit(False)
    while open_:
        above = bound * F.lit(open_).cast(_BIG) > weight * F.lit(left).cast(_BIG)
        fixed = ~above & (bound * F.lit(open_).cast(_BIG) < weight * F.lit(left).cast(_BIG))
        took, gone = sources.where(fixed).agg(F.coalesce(F.sum(bound), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - int(took), every - int(gone)) == (left, open_):
            break
        left, open_ = total - int(took), every - int(gone)
    share = (F.col("weight") * left).cast("double") / F.lit(float(max(open_, 1)))
    return sources.withColumn("target", F.when(fixed, bound.cast("double")).otherwise(share))


def _deal(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's columns. A hot source's documents are spread by a salt where sources are too many to send."""
    size = sources.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    if size < BROADCAST_BYTES:
        return d.join(F.broadcast(sources), "key")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _reversed(position: Column, bits: int) -> Column:
    """The van der Corput point of a number, in units of 2 to the minus ``bits``: its bits in reverse. Its own inverse."""
    return F.conv(F.reverse(F.lpad(F.bin(position), bits, "0")), 2, 10).cast("long") if bits else position


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
             weights: Sequence[int] = WEIGHTS, block: int = BLOCK, most: int = MOST, seed: str = SEED) -> Mix:
    """The slots of a mix, and the order of documents that fills them.

    Sources, in code point order and null last, take ``weights`` in turn; their targets share the words of all documents
    (``_targets``). Each target makes ceil(target / block) slots. Cumulative slot counts, in units of a power of two,
    are the cumulative weights: slot k belongs to the source in whose interval the van der Corput point k falls, so every
    stretch of the schedule holds each source in near its share, and a source's count is exact. Slot numbers beyond all
    intervals stay unused. Slots are ranked within their source; a source's r-th slot is the r-th block of its words, its
    documents shuffled by a hash of seed and id, and repeated once all are used.

    Null ids and null texts are allowed (a null text has no words); rows repeated are taken one by one, ties of the hash
    go by id, then size. Other columns are not read. An empty table, or one without words, has no slots.
    """
    if min(weights, default=0) < 1 or block < 1 or most < 1:
        raise ValueError("weights, block and most must be positive")
    tables = Tables(docs.sparkSession)
    d = tables.store(docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        F.size(words(docs[text_col].cast("string"))).cast("long").alias("size")).withColumns({
            "key": _key(F.col("source")),
            "h": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)}))
    named = d.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    named = running_sum(tables, named, [F.col("source").asc_nulls_last()], F.lit(1), "source_no")
    named = tables.store(named.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")))
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = _targets(named, total, most).withColumn("words", F.floor(F.col("target") + 0.5))
    sources = sources.withColumn("slots", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    sources = tables.store(running_sum(tables, sources, ["source_no"], F.col("slots"), "start"))
    line = _deal(d.drop("source"), sources.drop("start", "slots", "weight"))
    line = tables.store(running_sum(tables, line.drop("key"), ["h", F.col("doc_id").asc_nulls_last(), "size"], F.col("size"), "at",
                                    by=["source_no"]).drop("h"))
    tables.drop(d, named)
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(0, n - 1).bit_length()
    end = F.col("start") + F.col("slots") - 1
    points = (sources.where("slots > 0").withColumn("from", F.explode(F.sequence(F.col("start"), end, F.lit(SPREAD).cast("long"))))
              .repartition("from")
              .select("source_no", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SPREAD - 1, end))).alias("point")))
    slots = running_sum(tables, points.select("source_no", _reversed(F.col("point"), bits).alias("slot")), ["slot"], F.lit(1), "r",
                        by=["source_no"])
    return Mix(sources.drop("key", "start"), line, tables.store(slots), block, most)


def mix(plan: Mix) -> DataFrame:
    """What each slot holds: (slot, source, doc_id, at, copy, first, n): ``n`` words of the document from word ``first`` (from 0)
    on, in its ``copy``-th repetition; in a slot, ordered by (copy, at).

    A document's words are cut where blocks end. Blocks and slots meet on (source, rank), one slot and at most ``block``
    pieces each, so no source is hot.
    """
    copies = plan.line.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(plan.most - 1))))
    copies = copies.withColumn("from", F.col("at") + F.col("copy") * F.col("source_size"))
    copies = copies.where("from < words").withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    block = F.lit(plan.block)
    number = lambda x: F.floor(x / block).cast("long")
    pieces = copies.withColumn("r", F.explode(F.sequence(number(F.col("from")), number(F.col("to") - 1))))
    first = F.greatest(F.col("from"), F.col("r") * block)
    pieces = pieces.select("source_no", "r", "source", "doc_id", "at", "copy", (first - F.col("from")).alias("first"),
                           (F.least(F.col("to"), (F.col("r") + 1) * block) - first).alias("n"))
    return pieces.join(plan.slots, ["source_no", "r"])


def taken(plan: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): for each row of the documents, the words that the mix takes."""
    got = mix(plan).groupBy("source_no", "at").agg(F.sum("n").alias("taken"))
    some = plan.line.where("size > 0").join(got, ["source_no", "at"], "left")
    cols = ["doc_id", "source", "size", "source_size", "target"]
    return (some.select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
            .union(plan.line.where("size = 0").select(*cols, F.lit(0).cast("long"))))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST(sum(sum(size)) OVER () AS BIGINT) AS total,
  1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(CAST(sum({MOST} * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS c,
  CAST(sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM s),
f AS (SELECT max(total - c) AS left_, max(ws) AS open_ FROM o WHERE {MOST} * n * ws >= w * (total - c)),
t AS (SELECT source, n, CASE WHEN {MOST} * n * open_ < w * left_ THEN CAST({MOST} * n AS DOUBLE)
  ELSE CAST(w * left_ AS DOUBLE) / open_ END AS target FROM s, f),
l AS (SELECT doc_id, size, n AS source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words, CAST(coalesce(sum(size) OVER (
  PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, {" + ".join(
    f"greatest(0, least(pos + {e} * source_size + size, words) - (pos + {e} * source_size))" for e in range(MOST))} AS taken FROM l"""


@query("op11_mixing", OP11_SQL)
def op11(spark, sf):
    return taken(schedule(documents(spark, sf))).select("doc_id", "size", "source_size", "target", "taken")
