"""Cutting lineage in the folder that the cluster shares."""
from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: rows that are sent to every task at most, and their bytes as the schema lets one guess
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 1 << 26


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's ``spark.checkpoint.dir`` and go on from the files, so
    that a lost executor costs a reread. Spark's cleaner removes them when nothing refers to
    them any more (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def staged(spark: SparkSession):
    """Give a function that writes a table as Parquet beside the checkpoints and reads it back:
    for tables too large for ``cut``. At the end the files are replaced by empty ones, so all
    that follows from them has to be written by then."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid4().hex}"
    paths = []

    def stage(df: DataFrame) -> DataFrame:
        paths.append(f"{root}/{len(paths)}")
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield stage
    finally:
        for p in paths:
            spark.range(0).write.mode("overwrite").parquet(p)


def guessed_bytes(df: DataFrame) -> int:
    """Bytes of a row: 8 a number, 32 a string, 256 an array or a struct."""
    return sum({"string": 32, "binary": 32}.get(t, 256 if t.startswith(("array", "map", "struct")) else 8) for _, t in df.dtypes)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for the small side of a join: sent to every task if it has ``limit`` rows or fewer
    (counted) and no more than about ``BROADCAST_BYTES``, else left to a shuffle. Only for narrow rows that
    are cheap to count."""
    return F.broadcast(df) if df.count() <= min(limit, BROADCAST_BYTES // guessed_bytes(df)) else df
