"""Stratified train/test split.

Per class c with n_c rows, the first ``round(n_c * test_size)`` rows in md5(key:seed) order
are test. ``ordering.rank_cuts`` finds each class's cut row from per-(class, hash-bucket)
counts and ranks only the one bucket holding it; every other row is placed by comparing its
hash with that threshold, so no row is shuffled and a class holding a third of all rows costs
no more than any other.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_hex
from ..functions.ordering import rank_cuts


def stratified_split(df: DataFrame, key: str, label_col: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split", check_min_class: bool = True) -> DataFrame:
    h = df.withColumn("_h", hash_hex(key, seed))

    def cuts():
        n = F.col("_gn")   # class size, known to the cut search anyway
        cut = F.round(n * F.lit(test_size)).cast("long")
        if check_min_class:   # sklearn refuses classes with fewer than 2 rows
            cut = F.when(n < 2, F.raise_error(F.concat(F.lit(_TOO_SMALL), F.col(label_col).cast("string")))) \
                .otherwise(cut)
        return F.array(cut)

    try:
        r = rank_cuts(h, "_h", key, cuts(), partition_by=[label_col], out="_past")
    except Exception as e:  # noqa: BLE001 - the check fails inside the Spark job
        if _TOO_SMALL in str(e):
            cls = str(e).split(_TOO_SMALL, 1)[1].split()[0].rstrip("'\".,")
            raise ValueError(f"class {cls!r} has fewer than 2 rows; cannot stratify") from None
        raise
    return r.withColumn(out, F.when(F.col("_past") == 0, F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_h", "_past")


_TOO_SMALL = "stratified split: class with fewer than 2 rows: "
