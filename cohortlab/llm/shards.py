"""Sharding by jump consistent hashing: no ring table, and a shard appended takes only its own
share of the rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .order import bucket_of, bucket_sums, offsets, order_hash, with_before
from .ship import by_value
from .text import aside, others

by_value(__name__)

SHARDS = 8
SEED = "shard"
#: multiplier of the generator in the published algorithm
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of each 64-bit key: the last bucket below ``shards`` in the key's
    chain of jumps. All keys jump together, and those past the end drop out."""
    state = keys.astype(np.uint64)
    bucket = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    at = np.zeros(len(state), dtype=np.int64)
    while len(live):
        bucket[live] = at
        state = state * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0)
        at = ((at + 1) * step).astype(np.int64)
        on = at < shards
        live, state, at = live[on], state[on], at[on]
    return bucket


def jump_column(key, shards: int):
    @F.pandas_udf(IntegerType())
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key)


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id",
          out: str = "shard_info") -> DataFrame:
    """Add the struct ``out``: ``shard``, ``grown_shard`` (with one shard more), ``slot`` (0, 1, 2,
    ... within the shard), ``size`` (UTF-8 bytes of the text plus 1, a null text having none).

    The shard follows from ``key`` and the number of shards alone; null keys count as one empty
    key, repeated keys share a shard. Slots follow the key's hash; ties are ordered by key, text
    hash and size, and equal rows are interchangeable. An existing column called ``out`` is replaced;
    all others stay, whatever their names.
    """
    docs, named, back = aside(docs, "_sh_")
    text, key = named(text), named(key)
    n_rows = docs.count()
    d = docs.select("*", order_hash(F.col(key), SEED).alias("_sh_h"), F.xxhash64(F.col(text)).alias("_sh_text"),
                    (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_sh_size"))
    d = d.withColumn("_sh_at", jump_column(F.col("_sh_h"), shards))
    d = d.withColumn("_sh_grown", jump_column(F.col("_sh_h"), shards + 1))
    d = d.withColumn("_sh_b", bucket_of(F.col("_sh_h"), n_rows))
    one = F.lit(1).cast("long")
    table = bucket_sums(d, ["_sh_at"], "_sh_b", {"_sh_n": one})
    start = offsets(table, ["_sh_at"], "_sh_b", "_sh_n", "_sh_start")
    order = ["_sh_h", key, "_sh_text", "_sh_size"]
    d = with_before(d, one, ["_sh_at"], "_sh_b", order, table, "_sh_n", n_rows, "_sh_in").join(start, ["_sh_at", "_sh_b"])
    info = F.struct(F.col("_sh_at").alias("shard"), F.col("_sh_grown").alias("grown_shard"),
                    (F.col("_sh_start") + F.col("_sh_in")).alias("slot"), F.col("_sh_size").alias("size"))
    return back(d.select(*others(docs, out), info.alias(out)))


def write_shards(sharded: DataFrame, path: str, out: str = "shard_info") -> None:
    """Write one folder ``shard=K`` per shard, rows in slot order within each file. Rows go to
    writers by shard and slot range, so a shard may have several files but no writer a whole shard."""
    per = 100_000
    d = sharded.select("*", F.col(out)["shard"].alias("shard"))
    d = d.repartition("shard", F.floor(F.col(out)["slot"] / per))
    d.sortWithinPartitions("shard", F.col(out)["slot"]).write.partitionBy("shard").mode("errorifexists").parquet(path)
