"""Parameter tables in blocks: one row per (ids..., tensor, block) with an array of up to ``BLOCK``
doubles, instead of one row per weight.

Element-wise sums and means over clients are Spark ML's vector summarizer, a JVM aggregate whose
buffers are combined before the shuffle; arithmetic within a block is ``zip_with``. A model of
21,263 weights is some thirty rows a client.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def is_blocked(df: DataFrame) -> bool:
    return "values" in df.columns


def to_blocks(params: DataFrame, ids: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Long (ids..., tensor, idx, value) -> blocks. Indices of a block that have no row hold 0 up to
    the largest one that has."""
    g = params.groupBy(*ids, "tensor", F.floor(F.col("idx") / size).cast("int").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("idx") % size).cast("int"), F.col("value").cast("double")))).alias("_m"),
        F.max(F.col("idx") % size).cast("int").alias("_last"))
    values = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return g.select(*ids, "tensor", "block", values.alias("values"))


def from_arrays(df: DataFrame, array_col: str, ids: Sequence[str], splits: Sequence[tuple[str, int]], size: int = BLOCK) -> DataFrame:
    """Flat ARRAY weights -> blocks of the tensors ``splits`` = [(tensor, length), ...], by slices and
    without a shuffle."""
    parts, start = [], 1
    for name, n in splits:
        for b in range(-(-n // size)):
            parts.append(F.struct(F.lit(name).alias("tensor"), F.lit(b).alias("block"), F.slice(
                F.col(array_col).cast("array<double>"), start + b * size, min(size, n - b * size)).alias("values")))
        start += n
    return df.select(*ids, F.explode(F.array(*parts)).alias("_p")).select(*ids, "_p.*")


def exploded(blocks: DataFrame, ids: Sequence[str], size: int = BLOCK, value: str = "value", others: Sequence[str] = ()) -> DataFrame:
    """Blocks -> long (ids..., tensor, idx, value, others...); ``others`` are arrays as long as ``values``."""
    if not others:
        e = blocks.select(*ids, "tensor", "block", F.posexplode("values").alias("_i", value))
        return e.select(*ids, "tensor", (F.col("block") * size + F.col("_i")).cast("int").alias("idx"), value)
    e = blocks.select(*ids, "tensor", "block", F.posexplode(F.arrays_zip("values", *others)).alias("_i", "_z"))
    return e.select(*ids, "tensor", (F.col("block") * size + F.col("_i")).cast("int").alias("idx"),
                    F.col("_z")["values"].alias(value), *[F.col("_z")[c].alias(c) for c in others])


def summed(weight: Column | None = None, values: str = "values") -> Column:
    """Aggregate: the element-wise sum of arrays, each times ``weight`` (not negative)."""
    v = array_to_vector(F.col(values))
    return vector_to_array(Summarizer.sum(v, weight) if weight is not None else Summarizer.sum(v))


def averaged(weight: Column | None = None, values: str = "values") -> Column:
    """Aggregate: the element-wise mean of arrays, weighted by ``weight``."""
    v = array_to_vector(F.col(values))
    return vector_to_array(Summarizer.mean(v, weight) if weight is not None else Summarizer.mean(v))


def plus(a, b, factor: Column | float = 1.0) -> Column:
    """a + factor * b, element by element."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.zip_with(a, b, lambda x, y: x + f * y)


def squares(a) -> Column:
    """Sum of the squares of a block."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
