"""Running sums in a fixed pseudo-random order, without one long window.

Rows are ordered by an md5 of their key. Its leading bits cut the order into buckets of about
the square root of the row count (``least`` rows or more), so neither a bucket nor a group's
list of buckets is long, whatever share of the rows one group holds.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, sized

HASH_BITS = 60
#: times its share of rows that make a bucket a hot one
HOT = 8


def order_hash(key: Column, seed) -> Column:
    """60 bits of ``md5('seed:key')`` as a BIGINT; a null key hashes as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def per_bucket(n_rows: int, least: int = 512) -> int:
    """Rows that a bucket should hold."""
    return max(least, math.isqrt(max(0, n_rows)))


def bucket_of(h: Column, n_rows: int, least: int = 512) -> Column:
    per = per_bucket(n_rows, least)
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / per))) if n_rows else 0
    return F.shiftright(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def bucket_sums(df: DataFrame, group: Sequence[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (group, bucket) with the given sums, written once: at most a few rows a
    bucket, read again for totals and offsets."""
    return cut(df.groupBy(*group, bucket).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()]))


def offsets(table: DataFrame, group: Sequence[str], bucket: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the group's earlier buckets."""
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return table.select(*group, bucket, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(out))


def before_in_bucket(value: Column, group: Sequence[str], bucket: str, order: Sequence[str]) -> Column:
    """Sum of ``value`` over the rows before this one in its bucket."""
    w = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(w) - value


def with_before(df: DataFrame, value: Column, group: Sequence[str], bucket: str, order: Sequence[str], table: DataFrame,
                count: str, n_rows: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its bucket. ``table`` has the number
    of rows (``count``) of each bucket.

    A bucket far above its share of rows holds a repeated key. Its rows are sorted by ranges of the order and
    a random number, which spreads equal rows as well, and written; then every range has its own sums."""
    hot = table.where(F.col(count) > HOT * per_bucket(n_rows)).select(*group, bucket)
    if hot.isEmpty():
        return df.withColumn(out, before_in_bucket(value, group, bucket, order))
    hot, on = sized(hot), [*group, bucket]
    cold = df.join(hot, on, "left_anti").withColumn(out, before_in_bucket(value, group, bucket, order))
    s = df.join(hot, on, "left_semi").withColumn("_bf_salt", F.rand(1)).withColumn("_bf_value", value)
    s = s.repartitionByRange(*on, *order, "_bf_salt").sortWithinPartitions(*on, *order, "_bf_salt")
    s = cut(s.withColumn("_bf_part", F.spark_partition_id()).withColumn("_bf_row", F.monotonically_increasing_id()))
    sums = s.groupBy(*on, "_bf_part").agg(F.sum("_bf_value").alias("_bf_sum"))
    earlier = Window.partitionBy(*on).orderBy("_bf_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*on, "_bf_part", F.coalesce(F.sum("_bf_sum").over(earlier), F.lit(0)).alias("_bf_start"))
    own = Window.partitionBy(*on, "_bf_part").orderBy("_bf_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_bf_in", F.sum("_bf_value").over(own) - F.col("_bf_value")).join(start, [*on, "_bf_part"])
    s = s.withColumn(out, (F.col("_bf_start") + F.col("_bf_in")).cast("long"))
    return cold.withColumn(out, F.col(out).cast("long")).unionByName(
        s.drop("_bf_salt", "_bf_value", "_bf_part", "_bf_row", "_bf_in", "_bf_start"))


def positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... in the given order: a range sort, numbered within partitions,
    plus the counts of the partitions before (one row a partition)."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    s = cut(s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    n = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select("_pid", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_start"))
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return s.join(F.broadcast(start), "_pid").withColumn(out, F.col("_start") + within).drop("_pid", "_mid", "_start")
