"""Cleaning, resolving and encoding flow rows.

All row-wise operators are column expressions. The label map is a table of K rows that encoding
joins, broadcast when it is small.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.exprs import combine_rows, is_inf
from ..functions.ordering import ranked, row_tiebreak, small, with_value_bucket
from ..session import ensure_checkpoint_dir

# Candidate column names, first present wins.
TIMESTAMP_CANDIDATES = ["Timestamp", "Flow Start Time", "Datetime"]
LABEL_CANDIDATES = ["Label", "Attack_Type", "Class"]
RATE_COLUMNS = ["Flow_Bytes/s", "Flow_Packets/s"]
DAY_FIRST_FORMAT = "d/M/yyyy H:m:s"
SEQUENTIAL_TS_START = "2017-01-01 00:00:00"

# Attack families in rule order (first family with a keyword contained in the
# lower-cased label wins); exact normal names; anything else is 'Other'.
ATTACK_FAMILIES = [
    ("DDoS", ["DDoS", "DDoS-ACK", "DDoS-UDP", "DDoS-PSHACK", "DDoS-SYN"]),
    ("Brute Force", ["SSH-Brute Force", "FTP-Brute Force", "Brute Force"]),
    ("Web Attacks", ["SQL Injection", "XSS", "Web Attack", "Infiltration"]),
    ("Botnet", ["Botnet", "Bot"]),
    ("Other", ["Heartbleed", "Infiltration", "Port Scan"]),
]
NORMAL_NAMES = ["normal", "benign", "legitimate"]


def _q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def normal_name(name: str) -> str:
    """Trimmed, with runs of white space as one underscore: ``Flow Bytes/s`` is ``Flow_Bytes/s``."""
    return "_".join(name.split())


def matching_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` whose normalised names are among ``names``; missing ones are ignored."""
    wanted = {normal_name(n) for n in names}
    return [c for c in df.columns if normal_name(c) in wanted]


# P1 -----------------------------------------------------------------------------------------
def clean_inf(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """±inf and NaN -> NULL in ``cols`` (default: every floating column)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    cols = [c for c in cols if c in df.columns]
    repl = {c: F.when(is_inf(F.col(_q(c))) | F.isnan(F.col(_q(c))), F.lit(None)).otherwise(F.col(_q(c)))
            for c in cols}
    return df.withColumns(repl) if repl else df


# P2 -----------------------------------------------------------------------------------------
def drop_null_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    return df.na.drop(subset=cols) if cols else df


def remove_infinite_values(df: DataFrame, cols: Sequence[str] = RATE_COLUMNS) -> DataFrame:
    """Reference task 2: inf/NaN -> NULL in the rate columns, then drop rows NULL there."""
    present = matching_columns(df, cols)
    return drop_null_subset(clean_inf(df, present), present)


def removed_count(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """One-row report (step, rows_before, rows_after, removed); two count aggregates."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return combine_rows(b, a).select(
        F.lit(name).alias("step"), "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("removed"))


# P3 -----------------------------------------------------------------------------------------
def dedup_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows alike in all columns become one: hash aggregate with map-side combine, so a hot
    duplicate group collapses before the shuffle. A unique row ``key`` isn't compared; of rows
    alike otherwise the one with the smallest key stays."""
    if key is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != key]
    return df.groupBy(*[_q(c) for c in rest]).agg(F.min(_q(key)).alias(key)).select(*[_q(c) for c in df.columns])


# P4 / P5 -------------------------------------------------------------------------------------
def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    for c in candidates:
        if c in df.columns:
            return c
    return None


def parse_ts(df: DataFrame, candidates: Sequence[str] = TIMESTAMP_CANDIDATES, out: str = "Timestamp",
             fmt: str = DAY_FIRST_FORMAT, order_col: str | None = None) -> DataFrame:
    """First present candidate parsed day-first; parse failures -> NULL. No candidate ->
    sequential timestamps from 2017-01-01 in ``order_col`` order (P5)."""
    src = resolve_column(df, candidates)
    if src is None:
        if order_col is None:
            raise ValueError("no timestamp column and no order column for sequential timestamps")
        return sequential_ts(df, order_col, out)
    parsed = F.try_to_timestamp(F.col(_q(src)).cast("string"), F.lit(fmt))
    res = df.withColumn("_ts_parsed", parsed).drop(src)
    if out in res.columns:
        res = res.drop(out)
    return res.withColumnRenamed("_ts_parsed", out)


def sequential_ts(df: DataFrame, order_col: str, out: str = "Timestamp",
                  start: str = SEQUENTIAL_TS_START) -> DataFrame:
    """``start + (rank-1) seconds`` with rank the global position in ``order_col`` order."""
    b = df.withColumn("_tb", row_tiebreak(df))
    b = with_value_bucket(b, order_col, "_ob", tiebreak="_tb")
    r = ranked(b, [order_col, "_tb"], F.col("_ob"), rank_col="_pos").drop("_ob", "_tb")
    return r.withColumn(out, F.timestamp_add("SECOND", F.col("_pos") - 1,
                                             F.to_timestamp(F.lit(start)))).drop("_pos")


# P6 -----------------------------------------------------------------------------------------
def resolve_label_column(df: DataFrame, candidates: Sequence[str] = LABEL_CANDIDATES) -> str:
    c = resolve_column(df, candidates)
    if c is None:
        raise ValueError(f"no label column among {list(candidates)}; columns are {df.columns}")
    return c


# P7 -----------------------------------------------------------------------------------------
def label_map(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, label_id): ids 0..K-1 in sorted label order, one row per label; written to the
    checkpoint folder once, since every use of the map needs it."""
    labels = df.select(F.col(_q(label_col)).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    ids = (F.row_number().over(Window.orderBy("label")) - 1).cast("int")   # over the K labels, not the rows
    ensure_checkpoint_dir(df.sparkSession)
    return labels.select("label", ids.alias("label_id")).checkpoint()


def sorted_labels(df: DataFrame, label_col: str = "label") -> list[str]:
    """The labels on the driver, for models that need their number of classes."""
    return [r["label"] for r in label_map(df, label_col).orderBy("label_id").collect()]


def encode_expr(labels: Sequence[str], label_col: str) -> Column:
    """The id as an expression, for a given short list of labels (streams, where no map is fitted)."""
    if not labels:
        return F.lit(None).cast("int")
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    return F.element_at(m, F.col(_q(label_col)).cast("string")).cast("int")


def label_encode(df: DataFrame, label_col: str = "label", out: str = "label_id",
                 labels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (df + ``out``, label map). The map is joined: broadcast if it is small (counted),
    else by a shuffle; labels outside the map, and NULL, get a NULL id."""
    if labels is None:
        lm = label_map(df, label_col)
    else:
        lm = df.sparkSession.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "label string, label_id int")
    ids = small(lm.select(F.col("label").alias("_lab"), F.col("label_id").alias("_lab_id")))
    joined = df.join(ids, F.col(_q(label_col)).cast("string") == F.col("_lab"), "left")
    return joined.withColumn(out, F.col("_lab_id")).drop("_lab", "_lab_id"), lm


# P9 / P10 -------------------------------------------------------------------------------------
def numeric_projection(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*[_q(c) for c in numeric_columns(df, exclude)])


def cast_features(df: DataFrame, feature_cols: Sequence[str], label_col: str,
                  keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[_q(k) for k in keep],
                     *[F.col(_q(c)).cast("float").alias(c) for c in feature_cols],
                     F.col(_q(label_col)).cast("int").alias(label_col))


# P12 ----------------------------------------------------------------------------------------
def synthetic_day(df: DataFrame, order_col: str, n_chunks: int = 8, out: str = "day") -> DataFrame:
    """No timestamp: day = (position div (N div n_chunks)) as text. N % n_chunks != 0 gives an
    extra chunk, as in the reference; N < n_chunks -> one row per chunk."""
    b = df.withColumn("_tb", row_tiebreak(df))
    b = with_value_bucket(b, order_col, "_ob", tiebreak="_tb")
    r = ranked(b, [order_col, "_tb"], F.col("_ob"), rank_col="_pos", size_col="_n").drop("_ob", "_tb")
    per = F.greatest(F.floor(F.col("_n") / F.lit(n_chunks)).cast("long"), F.lit(1))
    return r.withColumn(out, F.floor((F.col("_pos") - 1) / per).cast("long").cast("string")).drop("_pos", "_n")


# P13 / P14 ------------------------------------------------------------------------------------
def family_expr(label: Column, families=ATTACK_FAMILIES, normal_names=NORMAL_NAMES) -> Column:
    low = F.lower(label.cast("string"))
    expr = None
    for fam, kws in families:
        cond = None
        for kw in kws:
            c = low.contains(kw.lower())
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.when(low.isin(*normal_names), F.lit("Normal")).otherwise(F.lit("Other"))


def family_index_expr(family: Column, families=ATTACK_FAMILIES) -> Column:
    m = F.create_map(*[x for i, (fam, _) in enumerate(families) for x in (F.lit(fam), F.lit(i))])
    return F.element_at(m, family)


def label_family(df: DataFrame, label_col: str = "label", out: str = "family") -> DataFrame:
    return df.withColumn(out, family_expr(F.col(_q(label_col))))


def family_filter(df: DataFrame, family_col: str = "family", normal: bool = True) -> DataFrame:
    return df.where(F.col(family_col) == "Normal") if normal else df.where(F.col(family_col) != "Normal")


# P16 ----------------------------------------------------------------------------------------
def head_n(df: DataFrame, n: int = 5, order_by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Top-n preview in key order (TakeOrderedAndProject: n rows per task, no full sort)."""
    return df.orderBy(*order_by).limit(n)
