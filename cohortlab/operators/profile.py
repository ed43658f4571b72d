"""Data-quality / EDA profile.

Every per-column statistic is computed in ONE aggregate over all columns (one scan,
partial aggregation) and then unpivoted into a long (column, stat...) table. Exact
quantiles avoid ``percentile()`` (which buffers a whole column in one task): values are
unpivoted and counted by the leading bits of their order-preserving images, and only those under the
prefixes that hold the target ranks are looked at again; the 2 values per requested
probability are interpolated.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import radix
from ..functions.exprs import combine_rows, materialize
from .clean import numeric_columns


def _q(c: str) -> str:
    return f"`{c}`"


def finite(c: str):
    """The column as DOUBLE where it is a finite number, else NULL: what all statistics are taken of."""
    x = F.col(_q(c)).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _long(wide: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(_q(f"{s}__{c}")).alias(s) for s in stats]) for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# E1 -----------------------------------------------------------------------------------------
def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


# E2 -----------------------------------------------------------------------------------------
def profile_missing(df: DataFrame) -> DataFrame:
    """Columns with NULLs: count and % of rows, most missing first."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(_q(c)).isNull()).alias(f"missing__{c}") for c in cols])
    structs = [F.struct(F.lit(c).alias("column"), F.col(_q(f"missing__{c}")).alias("missing")) for c in cols]
    long = wide.select("_n", F.explode(F.array(*structs)).alias("s")).select("s.*", "_n")
    return (long.where(F.col("missing") > 0)
            .select("column", "missing", (F.col("missing") * 100.0 / F.col("_n")).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column"))


# E3 -----------------------------------------------------------------------------------------
def profile_infinite(df: DataFrame) -> DataFrame:
    cols = numeric_columns(df)
    wide = df.agg(*[F.count_if(F.abs(F.col(_q(c)).cast("double")) == float("inf")).alias(f"n_inf__{c}") for c in cols])
    return _long(wide, cols, ["n_inf"])


# E4 -----------------------------------------------------------------------------------------
def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row: count(*) - count(distinct rows); one hash aggregate."""
    g = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    t = g.agg(F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return t.select((F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"),
                    ((F.col("n_rows") - F.col("n_distinct")) * 100.0 / F.col("n_rows")).alias("duplicate_pct"))


# E5 / E11 -----------------------------------------------------------------------------------
def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, pct) with pct rounded half-even to 2 digits like pandas; most frequent first."""
    c = df.groupBy(F.col(_q(label_col)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tot = max(1, df.count())
    return c.select("label", "n", F.bround(F.col("n") * 100.0 / F.lit(tot), 2).alias("pct")).orderBy(F.desc("n"), "label")


def imbalance_ratio(df: DataFrame, label_col: str = "label") -> DataFrame:
    c = df.groupBy(_q(label_col)).agg(F.count(F.lit(1)).alias("n"))
    return c.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"), F.count(F.lit(1)).alias("n_classes"))


# E6 -----------------------------------------------------------------------------------------
def _values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long (column, v, img) of the finite values."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("v")) for c in cols])
    long = df.select(F.explode(each).alias("s")).select("s.column", "s.v").where("v is not null")
    return long.withColumn("img", radix.image(F.col("v")))


def _parts(values: DataFrame, bits: int, up=None, *more) -> DataFrame:
    """(column, up, part, n, lo, hi, more...): values by the leading ``bits`` of their images."""
    up = F.lit(0).cast("long") if up is None else up
    return values.groupBy("column", up.alias("up"), radix.leading("img", bits).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *more)


def _selected(values: DataFrame, counts: DataFrame, bits: int, probs: Sequence[float], step: int, max_rows_per_task: int) -> DataFrame:
    """(column, p, q) from the first counts: interpolated between the values at two ranks each."""
    from pyspark.sql import Window

    spark = values.sparkSession
    wanted = []
    for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect():   # one row a column
        for p in probs:
            low, share = divmod((r["n"] - 1) * p, 1)
            wanted += [(r["column"], 0, int(low), float(p), 1.0 - share)]
            wanted += [(r["column"], 0, int(low) + 1, float(p), share)] if share > 0 else []
    if not wanted:   # no finite value in any column
        return spark.createDataFrame([], "column string, p double, q double")
    at = radix.placed(counts, wanted)
    fixed, few = [], []   # values found; (column, prefix, its bits, rank inside, p, weight) in prefixes small enough to sort
    while at:
        fixed += [(r["column"], r["p"], r["weight"] * r["lo"]) for r in at if r["lo"] == r["hi"]]
        few += [(r["column"], r["part"], bits, r["rank"], r["p"], r["weight"]) for r in at if r["lo"] < r["hi"] and r["n"] <= max_rows_per_task]
        large = [r for r in at if r["lo"] < r["hi"] and r["n"] > max_rows_per_task]
        if not large:
            break
        now, bits = bits, min(radix.BITS, bits + step)
        inside = _within(values, {(r["column"], r["part"]) for r in large}, now)
        counts = materialize(_parts(inside, bits, F.col("up")))
        at = radix.placed(counts, [(r["column"], r["part"], r["rank"], r["p"], r["weight"]) for r in large])
    parts = [spark.createDataFrame(fixed, "column string, p double, wv double")] if fixed else []
    for depth in sorted({f[2] for f in few}):
        own = [f for f in few if f[2] == depth]
        v = _within(values, {(f[0], f[1]) for f in own}, depth).groupBy("column", "up", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("column", "up").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        ranks = spark.createDataFrame([(c, up, rank, p, w) for c, up, _, rank, p, w in own],
                                      "column string, up long, rank long, p double, w double")
        v = v.withColumn("upto", upto).join(F.broadcast(ranks), ["column", "up"])
        v = v.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        parts.append(v.select("column", "p", (F.col("v") * F.col("w")).alias("wv")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("column", "p").agg(F.sum("wv").alias("q"))


def _within(values: DataFrame, prefixes: set, bits: int) -> DataFrame:
    """The values under the given (column, prefix), two a probability and column at most, with the prefix as ``up``."""
    t = values.sparkSession.createDataFrame(sorted(prefixes), "column string, up long")
    return values.withColumn("up", radix.leading("img", bits)).join(F.broadcast(t), ["column", "up"])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
                    n_buckets: int = 1 << 16, max_rows_per_task: int = 4_000_000, sub_buckets: int = 1 << 16) -> DataFrame:
    """(column, p, q): linear-interpolated exact quantiles of the finite values.

    Radix selection instead of a sort: one aggregate counts the values of all columns by the leading bits of
    their order-preserving images (``n_buckets`` prefixes, a power of two); running counts tell which
    prefix holds each rank. A prefix with over ``max_rows_per_task`` values is counted again by its next bits
    (``sub_buckets``), three times at most by default. The values of the final prefixes are collapsed to (value, count), so
    a hot value is one row, and ranked."""
    values = _values(df, list(cols))
    bits = (n_buckets - 1).bit_length()
    counts = materialize(_parts(values, bits))
    return _selected(values, counts, bits, probs, (sub_buckets - 1).bit_length(), max_rows_per_task)


def profile_describe(df: DataFrame, cols: Sequence[str] | None = None, max_rows_per_task: int = 4_000_000) -> DataFrame:
    """count, mean, std (ddof 1), min, 25%, 50%, 75%, max of the finite values per numeric column,
    and beside them how many values were infinite. One aggregate by column and leading bits holds the
    moments and the counts that quantiles start from; one more scan finds the quantiles themselves."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    every = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("v"),
                               (F.abs(F.col(_q(c)).cast("double")) == float("inf")).alias("inf")) for c in cols])
    long = df.select(F.explode(every).alias("s")).select("s.*").where("v is not null or inf")
    long = long.withColumn("img", F.when(F.col("v").isNotNull(), radix.image(F.col("v"))))
    counts = long.groupBy("column", F.lit(0).cast("long").alias("up"), radix.leading("img", 16).alias("part")).agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"),
        F.var_pop("v").alias("var"), F.count_if("inf").alias("n_inf"))
    counts = materialize(counts)
    # moments of the parts put together: their own spread, and that between their means
    n = F.col("n")
    whole = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.try_divide(F.sum(n * F.col("mean")), F.sum("n")).alias("mean"), F.min("lo").alias("min"),
        F.max("hi").alias("max"), F.sum("n_inf").alias("n_inf"))
    apart = F.col("p.mean") - F.col("w.mean")
    spread = counts.alias("p").join(whole.alias("w"), "column").groupBy("column").agg(
        F.sum(F.col("p.n") * (F.col("p.var") + apart * apart)).alias("spread"))
    finite_parts = counts.where("part is not null").select("column", "up", "part", "n", "lo", "hi")
    qs = _selected(_values(df, cols), finite_parts, 16, (0.25, 0.5, 0.75), 16, max_rows_per_task)
    at = [F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    out = spark.createDataFrame([(c,) for c in cols], "column string").join(whole, "column", "left").join(spread, "column", "left").join(
        qs.groupBy("column").agg(*at), "column", "left")
    std = F.when(F.col("count") > 1, F.sqrt(F.col("spread") / (F.col("count") - 1)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("column", zero("count"), "mean", std.alias("std"), "min", "p25", "p50", "p75", "max", zero("n_inf"))


# E7 -----------------------------------------------------------------------------------------
def profile_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for c in cols:
        x = finite(c)
        aggs += [F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"), F.stddev_samp(x).alias(f"std__{c}")]
    long = _long(df.agg(*aggs), cols, ["min", "max", "std"])
    return long.select("column", F.col("min").alias("min"), F.col("max").alias("max"),
                       (F.col("max") - F.col("min")).alias("range"), F.col("std").alias("std"))


# E8 -----------------------------------------------------------------------------------------
def feature_variances(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols is not None else numeric_columns(df)
    return _long(df.agg(*[F.var_samp(finite(c)).alias(f"variance__{c}") for c in cols]),
                 cols, ["variance"])


def top_variance(df: DataFrame, k: int = 15, cols: Sequence[str] | None = None) -> DataFrame:
    """Top-k columns by sample variance (TakeOrdered over F rows)."""
    v = feature_variances(df, cols)
    return v.orderBy(F.desc("variance"), "column").limit(k).select("column", F.col("variance").alias("variance"))


# E9 / E10 -----------------------------------------------------------------------------------
def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """Pearson r for every pair a<b (column order) in ONE aggregate, over the rows where both are
    finite. All columns unless ``max_cols`` asks for those of largest variance only."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if max_cols is not None:
        keep = {r["column"] for r in top_variance(df, max_cols, cols).collect()}
        cols = [c for c in cols if c in keep]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    wide = df.agg(*[F.corr(finite(a), finite(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
               for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.col_a", "s.col_b", "s.corr")


def max_correlation(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The largest r, the largest |r| and the number of pairs with |r| above ``threshold``."""
    return pairs.agg(F.max("corr").alias("max_corr"), F.max(F.abs("corr")).alias("max_abs_corr"),
                     F.count_if(F.abs("corr") > threshold).alias("n_high_pairs"))


# E12 ----------------------------------------------------------------------------------------
def profile_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: rows, features, numeric features, missing cells, duplicate rows, inf cells, classes."""
    num = numeric_columns(df, exclude=[label_col])
    cells = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.count_if(F.col(_q(c)).isNull()) for c in df.columns), F.lit(0)).alias("n_missing"),
        sum((F.count_if(F.abs(F.col(_q(c)).cast("double")) == float("inf")) for c in num), F.lit(0)).alias("n_inf"),
        F.countDistinct(_q(label_col)).alias("n_classes"))
    dup = profile_duplicates(df).select("n_duplicates")
    return combine_rows(cells, dup).select(
        "n_rows", F.lit(len(df.columns) - 1).alias("n_features"), F.lit(len(num)).alias("n_numeric"),
        "n_missing", "n_duplicates", "n_inf", "n_classes")
