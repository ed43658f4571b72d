"""Multi-file flow CSV scan.

One distributed text pass finds, per file, its header line and whether it decodes as UTF-8
(files that do not are read as latin-1, the reference's fallback). Files are grouped by
(header, encoding); each group is one ``spark.read.csv`` with an all-STRING schema plus an
overflow column ``_extra`` so rows with too many fields can be dropped (pandas'
``on_bad_lines='skip'``) while short rows are kept and padded. Groups are unioned by
(trimmed) column name. Only per-file metadata (one row per file) reaches the driver.
"""
from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def file_headers(spark: SparkSession, paths) -> DataFrame:
    """(file_path, header, utf8_ok): header = first line of each file, in one text pass."""
    txt = spark.read.text(_as_list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_pos"))
    per_file = txt.groupBy("file_path").agg(
        F.min_by(F.when(F.col("_blk") == 0, F.col("value")), F.when(F.col("_blk") == 0, F.col("_pos"))).alias("header"),
        F.bool_and(F.expr("is_valid_utf8(value)")).alias("utf8_ok"))
    return per_file


def dedupe_names(names: Sequence[str]) -> list[str]:
    """Trim header names; repeated names get '.1', '.2' ... like pandas, skipping numbers that
    the header itself uses."""
    out: list[str] = []
    given = [n.strip() for n in names]
    for n in given:
        name, k = n, 0
        while name in out or (k and name in given):
            k += 1
            name = f"{n}.{k}"
        out.append(name)
    return out


def _parse_header(line: str) -> list[str]:
    return next(csv.reader(io.StringIO(line)))


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Outer union by column name; columns a part lacks are NULL (pandas concat)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def rows_per_file(df: DataFrame) -> DataFrame:
    """E1 per-file row counts of a file-backed DataFrame (one row per input file)."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_rows"))


def read_flow_csvs(spark: SparkSession, paths, infer_numeric: bool = True,
                   types: dict[str, str] | None = None) -> DataFrame:
    """Read every CSV under ``paths`` (files, dirs or globs) into one DataFrame.

    ``types`` (column name -> SQL type) casts those columns, NULL where a value doesn't parse, leaves
    the others text and saves the pass over all rows that ``infer_numeric`` needs to find the
    numeric columns.

    Raises FileNotFoundError when no file is found (the reference errors on an empty dir)."""
    try:
        meta = file_headers(spark, paths).collect()   # one row per file
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for missing paths
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(f"no CSV files at {paths}") from e
        raise
    meta = [m for m in meta if m["header"] is not None]
    if not meta:
        raise FileNotFoundError(f"no CSV files at {paths}")
    groups: dict[tuple[str, str], list[str]] = defaultdict(list)
    for m in sorted(meta, key=lambda r: r["file_path"]):
        groups[(m["header"], "UTF-8" if m["utf8_ok"] else "ISO-8859-1")].append(m["file_path"])
    parts = []
    for (header, enc), files in sorted(groups.items(), key=lambda kv: kv[1][0]):
        names = dedupe_names(_parse_header(header))
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))]
                              + [T.StructField("_extra", T.StringType())])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
              .option("encoding", enc).option("mode", "PERMISSIVE").csv(files))
        df = df.where(F.col("_extra").isNull()).drop("_extra")
        parts.append(df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)]))
    out = union_by_name(parts)
    if types is not None:
        return out.select(*[F.expr(f"try_cast(trim(`{c}`) AS {types[c]})").alias(c) if c in types else F.col(f"`{c}`")
                            for c in out.columns])
    return cast_numeric(out) if infer_numeric else out


def cast_numeric(df: DataFrame) -> DataFrame:
    """STRING columns whose every non-NULL value parses as a number become DOUBLE ('inf',
    'Infinity' included, via try_cast). One aggregate over all columns decides."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    q = {c: f"`{c}`" for c in cols}
    stats = df.agg(*[F.count(q[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.count(F.expr(f"try_cast(trim({q[c]}) AS DOUBLE)")).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    numeric = {c for i, c in enumerate(cols) if stats[f"n{i}"] > 0 and stats[f"n{i}"] == stats[f"d{i}"]}
    return df.select(*[F.expr(f"try_cast(trim({q[c]}) AS DOUBLE)").alias(c) if c in numeric else F.col(q.get(c, f"`{c}`"))
                       for c in df.columns])
