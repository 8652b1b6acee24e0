"""Shards of near equal bytes: minimax contiguous partition of ordered, indivisible groups."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.tables import Tables
from vecspark.llm.text import only
from vecspark.plans.rank import with_rank

#: positions that reach the driver in one round of the search
FETCH = 20_000


class _Known:
    """Prefix sums known at some positions of the ordered groups: the first ``at[k]`` groups have ``upto[k]`` bytes."""

    def __init__(self, groups: int, total: int):
        self.at, self.upto, self.unknown = [0, groups], [0, total], set()

    def add(self, points: list[tuple[int, int]]) -> None:
        both = dict(zip(self.at, self.upto)) | dict(points)
        self.at = sorted(both)
        self.upto = [both[p] for p in self.at]
        self.unknown = set()

    def down(self, target: int, best: bool = False) -> int:
        """The furthest prefix of at most ``target``: what is surely reached, or the best that may be."""
        k = bisect.bisect_right(self.upto, target) - 1
        if k == len(self.at) - 1 or self.at[k + 1] - self.at[k] <= 1:
            return self.upto[k]
        self.unknown.add(k)
        return min(target, self.upto[k + 1] - 1) if best else self.upto[k]

    def up(self, target: int) -> int:
        """The first prefix of at least ``target``, as far as known."""
        k = bisect.bisect_left(self.upto, target)
        if k and self.at[k] - self.at[k - 1] > 1:
            self.unknown.add(k - 1)
        return self.upto[k]

    def fits(self, capacity: int, shards: int, best: bool) -> bool:
        """The greedy check: fill shard after shard."""
        done = 0
        for _ in range(shards):
            done = self.down(done + capacity, best)
        return done >= self.upto[-1]

    def smallest(self, shards: int, low: int, high: int, best: bool) -> int:
        """Binary search; whether a capacity passes is monotone in it."""
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards, best) else (mid + 1, high)
        return low

    def spread(self, capacity: int, shards: int) -> list[int]:
        """Cuts within the capacity. Each shard takes an even share of what is left, rounded up to whole groups; more
        where the rest would not fit otherwise. (Filled to the brim, the last shards would stay empty whenever one
        group exceeds an equal share.)"""
        total = self.upto[-1]
        need = [total]
        for _ in range(shards - 1):
            need.append(self.up(max(0, need[-1] - capacity)))
        done, cuts = 0, []
        for i, least in enumerate(reversed(need)):
            even = self.up(done + -(-(total - done) // (shards - i)))
            done = min(self.down(done + capacity), max(least, even))
            cuts.append(done)
        return cuts


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of a shard, and where to cut: bytes before each shard's end.

    ``groups`` has (pos, size, upto): the order from 0, a group's bytes, and the bytes up to and with it. The driver
    knows prefix sums at a bounded set of positions only, so the greedy check of a capacity has a surely reached and a
    best possible outcome. Each round fetches at most about ``FETCH`` positions inside the gaps that the checks
    touched, until both outcomes agree; a round refines every gap some thousandfold.
    """
    head = groups.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    n, total, largest = head[0], head[1] or 0, head[2] or 0
    if not n:
        return 0, [0] * shards
    known, want = _Known(n, total), (F.col("pos") + 1) % max(1, n // FETCH) == 0
    while True:
        known.add([(r.pos + 1, r.upto) for r in groups.where(want).select("pos", "upto").collect()])
        low = known.smallest(shards, max(largest, -(-total // shards)), total, True)
        high = known.smallest(shards, low, total, False)
        known.unknown = set()
        for c in {low, (low + high) // 2, high}:
            known.fits(c, shards, True), known.fits(c, shards, False)
        cuts = known.spread(high, shards)
        if low == high and not known.unknown:
            return low, cuts
        want, spans = F.lit(False), [(known.at[g], known.at[g + 1]) for g in sorted(known.unknown)]
        for a, b in spans:
            step = max(1, min((b - a) // 2, (b - a) * len(spans) // FETCH))  # every gap is cut at least once
            want = want | ((F.col("pos") + 1).between(a + 1, b - 1) & ((F.col("pos") + 1 - a) % step == 0))


def group_key(text: Column) -> Column:
    """Equal texts, and only those, have equal keys. Null texts are one group."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 24,
                   overhead: int = 8) -> DataFrame:
    """Every document with its shard, equal texts together, so that the largest shard is as small as contiguous
    shards of the groups in the order of their least id can be.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``docs``. ``size`` is
    the text's UTF-8 bytes (null: none) plus ``overhead``; ``text_crc32`` of a null text is that of no bytes; ``slot``
    numbers the documents of a shard from 0 in the order of group, id and checksum. Null ids come after all others. A group is never
    cut: one that exceeds an equal share makes its shard as large as itself. ``grown_shard`` is null under this law.
    Only small rows (key, id, size) move; equal texts are summed before they do.
    """
    tables = Tables(docs.sparkSession)
    d = only(docs, id_col, text_col).select(
        "doc_id", group_key(F.col("text")).alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    d = tables.store(d)
    groups = d.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"))
    ranked = tables.store(with_rank(groups, [F.col("first").asc_nulls_last(), "key"]))
    # running bytes without a single-task window: sums of bounded blocks, then within each block
    block = F.col("pos").cast("long") / F.lit(4096)
    blocks = ranked.groupBy(F.floor(block).alias("block")).agg(F.sum("size").alias("bytes"))
    over = with_prefix(tables, blocks, "block", "bytes", "before")
    inside = F.sum("size").over(_w("block", "pos"))
    groups = tables.store(ranked.withColumn("block", F.floor(block)).join(over, "block")
                          .withColumn("upto", F.col("before") + inside).select("key", "pos", "size", "upto"))
    _, cuts = smallest_capacity(groups.select("pos", "size", "upto"), shards)
    shard = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    placed = d.join(groups.select("key", "pos", shard.alias("shard")), "key").drop("key")
    out = with_rank(placed, ["pos", F.col("doc_id").asc_nulls_last(), "text_crc32"], "slot", by=["shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def _w(part: str, order: str):
    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def with_prefix(tables: Tables, df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the sum of ``value`` over smaller keys. Keys are dense integers; folds 4,096 of them at a time, so
    no window holds more than 4,096 rows, whatever the length."""
    df = tables.store(df.select(key, value))
    top = df.agg(F.max(key)).first()[0] or 0
    before = (F.coalesce(F.sum(value).over(_w("__up", key)), F.lit(0)) - F.col(value))
    folded = df.withColumn("__up", F.floor(F.col(key) / F.lit(4096)))
    if top < 4096:
        return folded.select(key, before.alias(name))
    ups = with_prefix(tables, folded.groupBy("__up").agg(F.sum(value).alias("__sum")), "__up", "__sum", "__base")
    return folded.join(ups, "__up").select(key, (F.col("__base") + before).alias(name))


@query("op5_sharding")
def op5(spark, sf):
    return shard_by_bytes(documents(spark, sf))
