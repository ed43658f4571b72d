"""Exact dedup of texts with a heavy-hitter split, in built-in functions only.

A few texts may make up most of the rows. Misra-Gries summaries of the digests, merged in a tree,
hold every digest above a fixed share of the rows. Those few are counted and their winners found
by one aggregate; sent to every task, they decide their rows where they are. All other digests
go through ordinary shuffles, in which none of them is frequent.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .text import WHITE_RUN, free_name, quoted

#: counters of a summary: a digest on more than 1 of (COUNTERS + 1) rows is always found
COUNTERS = 1024
#: rows of one leaf are at most 2 to this power
LEAF_BITS = 16
#: summaries merged into one
FAN = 16


def text_digest(text: Column) -> Column:
    """sha256, as bytes, of the text in UTF-8 with each run of white space as one space; null
    counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " "), 256))


def _trimmed(counts: DataFrame, item: str, counters: int) -> DataFrame:
    """A summary of each part: the count after the ``counters`` largest is taken off all of them."""
    w = Window.partitionBy("part").orderBy(F.desc("n"), item)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = F.coalesce(F.nth_value("n", counters + 1).over(every), F.lit(0))
    return counts.select("part", item, (F.col("n") - over).alias("n")).where("n > 0")


def frequent(items: DataFrame, item: str, row: str, counters: int = COUNTERS, leaf_bits: int = LEAF_BITS,
             fan: int = FAN) -> DataFrame:
    """``counters`` items at most, among them each that more than 1 of (``counters`` + 1) rows hold.

    Misra-Gries: a leaf's rows (those whose number ``row`` agrees above ``leaf_bits``) are counted
    and trimmed, summaries are added up and trimmed again, ``fan`` at a time. What is taken off an
    item's count is taken off ``counters`` others as well, so in all it is at most 1 of (``counters`` + 1) rows.
    """
    counts = items.select(F.shiftright(row, leaf_bits).alias("part"), item).groupBy("part", item).agg(F.count(F.lit(1)).alias("n"))
    found = cut(_trimmed(counts, item, counters))
    parts = found.agg(F.count_distinct("part")).first()[0]
    while parts > 1:
        parts = -(-parts // fan)
        counts = found.groupBy(F.pmod(F.xxhash64("part", F.lit(parts)), F.lit(parts)).alias("part"), item).agg(F.sum("n").alias("n"))
        found = cut(_trimmed(counts, item, counters))
    return found.select(item)


def _split(docs: DataFrame, key: str, text: str, counters: int, leaf_bits: int):
    """(narrow rows, frequent digests, their winners, winners of the others' groups)."""
    rows = cut(docs.select(quoted(key).alias("id"), text_digest(quoted(text)).alias("digest"),
                           F.monotonically_increasing_id().alias("row")))
    heavy = frequent(rows, "digest", "row", counters, leaf_bits)
    best = [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("size")]
    winners = cut(rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*best))
    light = rows.join(F.broadcast(heavy), "digest", "left_anti").groupBy("digest").agg(*best).where("size > 1")
    return rows, heavy, winners, cut(light)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS,
                     leaf_bits: int = LEAF_BITS) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id`` (the key that stays of the rows with this text),
    ``group_size`` (their number), ``kept`` and ``digest`` (sha256 of the text, bytes).

    Texts are equal if they are once each run of white space is one space; null counts as empty.
    The smallest key stays. A null key counts as larger than all others; of rows with one text and
    one key a single one is ``kept``. No row gives no row. Other columns are left out, so any will do.
    """
    rows, heavy, winners, light = _split(docs, key, text, counters, leaf_bits)
    named = [F.col("id").alias(key), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best")["id"]).alias("keep_id"),
             F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
             F.coalesce(F.col("row") == F.col("best")["row"], F.lit(True)).alias("kept"), "digest"]
    near = rows.join(F.broadcast(winners), "digest").select(*named)
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti").join(light, "digest", "left").select(*named)
    return near.unionByName(rest)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS,
               leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns. Of rows that have
    text and key in common any one stays."""
    rows, heavy, winners, light = _split(docs, key, text, counters, leaf_bits)
    digest, best = free_name(docs, "digest"), free_name(docs, "best")
    d = docs.withColumn(digest, text_digest(quoted(text)))

    def named(df):
        return df.select(F.col("digest").alias(digest), F.struct("best.id", "size").alias(best))

    first = F.col(best).isNull() | quoted(key).eqNullSafe(F.col(best)["id"])
    heavy = heavy.withColumnRenamed("digest", digest)
    near = d.join(F.broadcast(named(winners)), digest).where(first)
    rest = d.join(F.broadcast(heavy), digest, "left_anti").join(named(light), digest, "left").where(first)
    kept = near.unionByName(rest)
    both = winners.unionByName(light)
    ties = rows.join(both, "digest").where(F.col("id").eqNullSafe(F.col("best")["id"])).groupBy("digest").count().where("count > 1")
    ties = cut(ties.select(F.col("digest").alias(digest)))
    if not ties.isEmpty():
        kept = kept.join(ties, digest, "left_anti").unionByName(kept.join(ties, digest, "left_semi").dropDuplicates([digest]))
    return kept.select(*[quoted(c) for c in docs.columns])
