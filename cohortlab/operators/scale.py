"""Standard scaling fitted on train rows only.

Fit is one aggregate over all feature columns (partial + final hash aggregate, one row out);
the stats table has 2 doubles per feature, so applying it as literals is bounded by the
feature count, never by the data.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _q(c: str) -> str:
    return f"`{c}`"


def scaler_fit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population std; std 0 (or undefined) -> 1, as sklearn does."""
    aggs = []
    for c in features:
        x = F.col(_q(c)).cast("double")
        aggs += [F.avg(x).alias(f"m__{c}"), F.stddev_pop(x).alias(f"s__{c}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(_q(f"m__{c}")).alias("mean"),
                        F.col(_q(f"s__{c}")).alias("std")) for c in features]
    long = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return long.withColumn("std", F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0))
                           .otherwise(F.col("std")))


def collect_stats(stats: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}


def scaler_apply(df: DataFrame, stats: dict[str, tuple[float, float]] | DataFrame) -> DataFrame:
    if isinstance(stats, DataFrame):
        stats = collect_stats(stats)
    return df.withColumns({c: (F.col(_q(c)).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def scaler_check(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of per-column means and mean of per-column sample stds (should be ~0 and ~1)."""
    wide = df.agg(*[F.avg(_q(c)).alias(f"m__{c}") for c in features],
                  *[F.stddev_samp(_q(c)).alias(f"s__{c}") for c in features])
    n = float(len(features))
    mean_of_means = sum((F.col(_q(f"m__{c}")) for c in features), F.lit(0.0)) / F.lit(n)
    mean_of_stds = sum((F.col(_q(f"s__{c}")) for c in features), F.lit(0.0)) / F.lit(n)
    return wide.select((mean_of_means).alias("mean_of_means"), (mean_of_stds).alias("mean_of_stds"))
