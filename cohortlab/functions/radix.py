"""Order-preserving 64-bit images of doubles, and selection by their leading bits.

The image of a double is the integer that its bits spell, so numbers compare as their images do.
Counting the leading bits of all values is one aggregate that tells where any rank lies; a prefix
that holds too many values is counted by its next bits. After 64 bits a prefix is a single value.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import materialize

BITS = 64
SMALLEST, NORMAL = 5e-324, 2.2250738585072014e-308
#: images of nothing, infinity and not-a-number: nulls come first, nan last
NULL_IMAGE, INF_IMAGE, NAN_IMAGE = -(1 << 63), 2047 << 52, (1 << 63) - 1


def image(x: Column) -> Column:
    """BIGINT that orders as the doubles do; both zeros are 0, null comes first, nan last. The exponent
    is the logarithm's floor, put right where that is off by one; what is left of the number is exact."""
    x = x.cast("double")
    a = F.abs(x)
    guess = F.floor(F.log2(F.greatest(F.least(a, F.lit(1.7e308)), F.lit(NORMAL)))).cast("int")
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(a >= power * 2.0, 1).when(a < power, -1).otherwise(0)
    fraction = (a / F.pow(F.lit(2.0), exponent) - 1.0) * float(1 << 52)
    size = (F.when(a < NORMAL, (a / F.lit(SMALLEST)).cast("long")).when(a == float("inf"), F.lit(INF_IMAGE))
            .otherwise((exponent + 1023).cast("long") * (1 << 52) + fraction.cast("long")))
    return F.when(x.isNull(), F.lit(NULL_IMAGE)).when(F.isnan(x), F.lit(NAN_IMAGE)).otherwise(F.when(x < 0, -size).otherwise(size))


def leading(img, bits: int) -> Column:
    """The first ``bits`` bits of an image, as a number that orders as it does."""
    img = F.col(img) if isinstance(img, str) else img
    return F.shiftright(img, BITS - bits) if bits < BITS else img


def placed(counts: DataFrame, wanted, within: str = "up") -> list:
    """Where ranks lie: ``counts`` (column, up, part, n, lo, hi) of the parts, in order, of each (column, up); ``wanted``
    rows (column, up, rank from 0, p, weight). Returns rows (column, part, rank inside, p, weight, n, lo, hi), one a
    wanted one."""
    w = Window.partitionBy("column", within).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("upto", F.sum("n").over(w))
    t = counts.sparkSession.createDataFrame(wanted, f"column string, {within} long, rank long, p double, weight double")
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    return c.join(F.broadcast(t), ["column", within]).where(hit).select(
        "column", "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "p", "weight", "n", "lo", "hi").collect()


def hot_prefixes(images: DataFrame, most: int, img: str = "_img") -> list[tuple[int, DataFrame]]:
    """(bits, table of the prefixes of that length that hold over ``most`` rows, with their count), level by
    level while there are any: each table has as many rows as fit that often into all at most."""
    out, left, bits = [], images, 0
    while bits < BITS:
        bits += 16
        counts = left.groupBy(leading(img, bits).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        hot = materialize(counts.where(F.col("n") > most))
        if hot.isEmpty():
            break
        out.append((bits, hot))
        left = left.join(F.broadcast(hot.select(F.col("part").alias("_hot"))), leading(img, bits) == F.col("_hot"), "left_semi")
    return out
