"""Parquet / JSON sinks and sources (S5-S12). Plain DataFrameWriter/Reader calls; every write
is partitioned by the column readers filter on, so reads prune partitions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# S5 / S7 ------------------------------------------------------------------------------------
def write_processed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table with a ``split`` partition column instead of four X/y files."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Partition-pruned read of one split (the plan shows PartitionFilters on ``split``)."""
    return spark.read.parquet(path).where(F.col("split") == split)


# S6 / S9 / S12 ------------------------------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Small result tables (label map, metrics, summaries) as JSON lines."""
    (df.coalesce(1) if single_file else df).write.mode(mode).json(path)


def write_label_map(label_map: DataFrame, path: str, mode: str = "overwrite", single_file: bool = True) -> None:
    """(label, label_id) as a JSON line a label, in the order of ids; a row a label, so one task has them."""
    write_json(label_map.select("label", "label_id").orderBy("label_id"), path, mode, single_file)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, label_id) of a written map."""
    return spark.read.schema("label string, label_id int").json(path)


def save_metrics(metrics: DataFrame, path: str, ids: Sequence[str] = (), mode: str = "overwrite") -> None:
    """(ids..., metric, value) as a document ``{ids..., "metrics": {metric: value, ...}}`` for each of the ids."""
    docs = metrics.groupBy(*ids).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    write_json(docs, path, mode)


def read_metrics(spark: SparkSession, path: str, ids: str = "") -> DataFrame:
    """(ids..., metric, value) of saved metrics; ``ids`` are columns with types, as in a schema."""
    df = spark.read.schema(f"{ids + ', ' if ids else ''}metrics map<string,double>").json(path)
    return df.select(*[c for c in df.columns if c != "metrics"], F.explode("metrics").alias("metric", "value"))


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of results, a JSON line a row, nulls included."""
    summary.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_summary(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


# S8 -----------------------------------------------------------------------------------------
def append_round_history(history: DataFrame, path: str) -> None:
    """Append (experiment, round, kind, metric, value) rows, partitioned by experiment."""
    history.write.mode("append").partitionBy("experiment").parquet(path)


def write_rounds(rows: DataFrame, path: str) -> None:
    """Write rows that carry ``experiment`` and ``round`` in the place of those of the same experiments
    and rounds: written twice, they are there once."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "round").parquet(path)


def read_round_history(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("experiment") == experiment) if experiment else df


# S10 / S11 ----------------------------------------------------------------------------------
def save_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested experiment results (config MAP, round_history ARRAY<STRUCT>) as JSON, one folder
    (and so one document per file) per experiment, like the reference's one file per run."""
    results.write.mode(mode).partitionBy("experiment_name").json(path)


def read_results(spark: SparkSession, paths, schema=None, multi_line: bool = False) -> DataFrame:
    """Read result JSON files or folders; paths that do not exist are skipped (as the reference
    does); ``source_file`` tells which file a row came from. Whether a path exists is asked of
    the file system that Spark reads it from."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = [df for p in paths if (df := _read_json(spark, p, schema, multi_line)) is not None]
    if not found:
        return spark.createDataFrame([], schema or "source_file string")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _read_json(spark: SparkSession, path: str, schema, multi_line: bool) -> DataFrame | None:
    r = spark.read.option("multiLine", multi_line)
    try:
        df = (r.schema(schema) if schema is not None else r).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return df.withColumn("source_file", F.col("_metadata.file_path"))
