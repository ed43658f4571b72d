"""Privacy ledger (M11): per-round and cumulative epsilon of the subsampled Gaussian
mechanism via Rényi DP at integer orders (Mironov et al. 2019), as pure Spark SQL.

rdp(α) = 1/(α−1) · ln Σ_{k=0..α} C(α,k) (1−q)^{α−k} q^k exp(k(k−1)/(2z²)); q = 1 -> α/(2z²).
ε_T = min_α [ Σ_{t≤T} rdp_t(α) + ln((α−1)/α) − (ln δ + ln α)/(α−1) ].
The inner sum is a log-sum-exp over ``sequence(0, α)`` computed row-wise with higher-order
functions; the cumulative sum is a window per (experiment, α) over that experiment's rounds.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MAX_ORDER = 64


def _log_factorials(max_order: int):
    # ln(n!) for n = 0..max_order, generated by rule (lgamma), used as a literal lookup array
    return F.array(*[F.lit(math.lgamma(n + 1)) for n in range(max_order + 1)])


def _ln_binom(lf, a, k):
    return F.element_at(lf, a + 1) - F.element_at(lf, k + 1) - F.element_at(lf, a - k + 1)


def with_rdp(df: DataFrame, alpha, q, z, max_order: int = MAX_ORDER, out: str = "rdp") -> DataFrame:
    """Add ``out`` = rdp(α) per row. The term array and its max are materialised as columns
    first so the lambdas below never re-evaluate them per element."""
    lf = _log_factorials(max_order)
    ks = F.sequence(F.lit(0), alpha)
    terms = F.transform(ks, lambda k: _ln_binom(lf, alpha, k) + (alpha - k) * F.log1p(-q) + k * F.log(q)
                        + k * (k - 1) / (F.lit(2.0) * z * z))
    d = df.withColumn("_terms", terms).withColumn("_mx", F.array_max("_terms"))
    lse = F.col("_mx") + F.log(F.aggregate("_terms", F.lit(0.0), lambda a, t: a + F.exp(t - F.col("_mx"))))
    rdp = (F.when(z <= 0, F.lit(float("inf")))
            .when(q >= 1.0, alpha / (F.lit(2.0) * z * z))
            .when(q <= 0.0, F.lit(0.0))
            .otherwise(lse / (alpha - 1)))
    return d.withColumn(out, rdp).drop("_terms", "_mx")


def privacy_ledger(rounds: DataFrame, delta: float = 1e-5, max_order: int = MAX_ORDER,
                   experiment_col: str = "experiment") -> DataFrame:
    """rounds(experiment, round, sample_rate, noise_multiplier) ->
    (experiment, round, sample_rate, noise_multiplier, epsilon_round, epsilon)."""
    a = rounds.select("*", F.explode(F.sequence(F.lit(2), F.lit(max_order))).alias("alpha"))
    q, z = F.col("sample_rate").cast("double"), F.col("noise_multiplier").cast("double")
    a = with_rdp(a, F.col("alpha"), q, z, max_order)
    w = Window.partitionBy(experiment_col, "alpha").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("cum_rdp", F.sum("rdp").over(w))
    al = F.col("alpha").cast("double")
    conv = F.log((al - 1) / al) - (F.lit(math.log(delta)) + F.log(al)) / (al - 1)
    out = a.groupBy(experiment_col, "round", "sample_rate", "noise_multiplier").agg(
        F.min(F.col("rdp") + conv).alias("epsilon_round"), F.min(F.col("cum_rdp") + conv).alias("epsilon"))
    return out.select(experiment_col, "round", "sample_rate", "noise_multiplier",
                      "epsilon_round", "epsilon")
