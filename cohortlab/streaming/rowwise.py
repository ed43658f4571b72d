"""Row-wise flow preparation on a Structured Streaming source.

The reference has no streaming component; what carries over unchanged is every row-wise
operator (inf/NaN cleaning, day-first timestamp parsing, label encoding with a fixed label
map, family mapping, scoring with a fixed model). They are plain column expressions, so the
same functions apply to ``readStream`` DataFrames. Stateful operators (dedup, splits,
partitions) need whole-table ranks and are batch-only here.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import clean


def prepare_stream(stream: DataFrame, labels: Sequence[str], label_col: str = "label",
                   rate_cols: Sequence[str] = ("value",), ts_candidates=clean.TIMESTAMP_CANDIDATES) -> DataFrame:
    """Clean rate columns (inf/NaN -> NULL, drop), parse the timestamp if present, encode the
    label with a FIXED label map (a stream cannot see all labels) and add the family."""
    d = clean.remove_infinite_values(stream, list(rate_cols))
    if clean.resolve_column(d, ts_candidates) is not None:
        d = clean.parse_ts(d, ts_candidates)
    d = d.withColumn("label_id", clean.encode_expr(list(labels), label_col))
    return clean.label_family(d, label_col)


def run_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_dir: str,
               labels: Sequence[str], available_now: bool = True, **kw) -> StreamingQuery:
    """parquet files in ``source_dir`` -> prepare_stream -> parquet sink. The checkpoint
    location makes the query restartable after a driver or executor loss (exactly-once
    file sink)."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    q = (prepare_stream(src, labels, **kw).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
