"""Run-history analytics (R1-R12) over a long history table
``(experiment, strategy, round, metric, value)``.

History tables have rounds x metrics rows per experiment, so every operator is a small
aggregate; joins are equi-joins on (metric) or (experiment) — never a cross join.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# metrics whose smaller values are better; all others are maximised
LOWER_IS_BETTER = ("loss", "fpr", "fnr", "epsilon", "epsilon_round")
FINAL_METRICS = ["loss", "accuracy", "macro_f1", "weighted_f1"]


def last_values(history: DataFrame) -> DataFrame:
    """(experiment, strategy, metric, value, round) at each metric's last round."""
    return history.groupBy("experiment", "strategy", "metric").agg(
        F.max_by("value", "round").alias("value"), F.max("round").alias("round"))


# R11 ----------------------------------------------------------------------------------------
def final_metrics(history: DataFrame, metrics: Sequence[str] = FINAL_METRICS) -> DataFrame:
    """Last-round value per metric, 0.0 when the metric never appears; plus n_rounds."""
    lv = last_values(history).where(F.col("metric").isin(*metrics))
    wide = lv.groupBy("experiment", "strategy").pivot("metric", list(metrics)).agg(F.first("value"))
    rounds = history.groupBy("experiment", "strategy").agg(F.countDistinct("round").alias("n_rounds"))
    return rounds.join(wide, ["experiment", "strategy"], "left").select(
        "experiment", "strategy", "n_rounds",
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(f"final_{m}") for m in metrics])


# R1 -----------------------------------------------------------------------------------------
def compare_strategies(history: DataFrame) -> DataFrame:
    """(strategy, accuracy, f1, auc_roc) from final values, 0 if a metric is absent."""
    lv = last_values(history)
    wide = lv.groupBy("strategy").pivot("metric", ["accuracy", "f1", "auc_roc"]).agg(F.first("value"))
    return wide.select("strategy", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in ["accuracy", "f1", "auc_roc"]])


# R2 -----------------------------------------------------------------------------------------
def comparison_table(history: DataFrame, metrics: Sequence[str]) -> DataFrame:
    lv = last_values(history)
    wide = lv.groupBy("strategy").pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select("strategy", *[F.col(m).alias(m) for m in metrics])


# R3 -----------------------------------------------------------------------------------------
def best_by_metric(history: DataFrame, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """Per metric the strategy with the best final value (max, or min for the metrics named);
    ties go to the first strategy name."""
    lv = last_values(history)
    key = F.when(F.col("metric").isin(*lower_is_better), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("metric").orderBy(key.desc(), F.col("strategy"))
    return lv.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "metric", F.col("strategy").alias("best_strategy"), F.col("value").alias("value"))


# R4 -----------------------------------------------------------------------------------------
def improvement_vs_baseline(history: DataFrame, baseline: str = "baseline") -> DataFrame:
    lv = last_values(history)
    base = lv.where(F.col("strategy") == baseline).select("metric", F.col("value").alias("_b"))
    return lv.where(F.col("strategy") != baseline).join(base, "metric").select(
        "strategy", "metric", (F.try_divide(F.col("value") - F.col("_b"), F.abs(F.col("_b"))) * 100.0)
        .alias("improvement_pct"))


# R5 -----------------------------------------------------------------------------------------
def history_arrays(history: DataFrame) -> DataFrame:
    """The reference's history dict: per strategy one ARRAY per metric, in round order."""
    g = history.groupBy("strategy", "metric").agg(F.array_sort(F.collect_list(F.struct("round", "value"))).alias("_s"))
    return g.select("strategy", "metric", F.transform("_s", lambda s: s["value"]).alias("values"))


def history_long(arrays: DataFrame) -> DataFrame:
    """Flatten (strategy, metric, values ARRAY) to (strategy, round, metric, value), round 1-based;
    NULL entries (missing metric) are skipped."""
    return arrays.select("strategy", "metric", F.posexplode("values").alias("pos", "value")).where(
        F.col("value").isNotNull()).select("strategy", (F.col("pos") + 1).cast("int").alias("round"), "metric",
                                           F.col("value").alias("value"))


# R6 -----------------------------------------------------------------------------------------
def convergence_stats(history: DataFrame, lower_is_better: Sequence[str] = LOWER_IS_BETTER) -> DataFrame:
    """First and last value and the improvement in percent of the first: positive when a loss
    falls or any other metric rises."""
    g = history.groupBy("strategy", "metric").agg(F.min_by("value", "round").alias("first"),
                                                  F.max_by("value", "round").alias("last"))
    gain = F.when(F.col("metric").isin(*lower_is_better), F.col("first") - F.col("last")).otherwise(
        F.col("last") - F.col("first"))
    return g.select("strategy", "metric", F.col("first").alias("first_value"), F.col("last").alias("last_value"),
                    (F.try_divide(gain, F.abs(F.col("first"))) * 100.0).alias("improvement_pct"))


# R7 -----------------------------------------------------------------------------------------
def client_performance(client_metrics: DataFrame, global_metrics: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Per round: best, worst, mean, population variance of client values and how many
    clients beat the round's global value."""
    c = client_metrics.where(F.col("metric") == metric)
    g = global_metrics.where(F.col("metric") == metric).select("round", F.col("value").alias("_g"))
    j = c.join(g, "round")
    return j.groupBy("round").agg(
        F.max("value").alias("best"), F.min("value").alias("worst"), F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"), F.count_if(F.col("value") > F.col("_g")).alias("n_above_global"))


# R8 -----------------------------------------------------------------------------------------
def radar_rows(binary_metrics_by_group: DataFrame, group_col: str) -> DataFrame:
    return binary_metrics_by_group.select(group_col, "accuracy", "precision", "recall", "f1",
                                          (F.lit(1.0) - F.col("fpr")).alias("specificity"))


# R9 -----------------------------------------------------------------------------------------
def privacy_utility(ledger: DataFrame, history: DataFrame, metric: str = "accuracy") -> DataFrame:
    eps = ledger.groupBy("experiment").agg(F.max_by("epsilon", "round").alias("epsilon"))
    acc = last_values(history).where(F.col("metric") == metric).select("experiment", F.col("value").alias(metric))
    return eps.join(acc, "experiment").select("experiment", F.col("epsilon").alias("epsilon"), F.col(metric).alias(metric)) \
        .orderBy("epsilon", "experiment")


# R10 ----------------------------------------------------------------------------------------
def last_rounds(history: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("experiment", "metric").orderBy(F.desc("round"))
    return history.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


# R12 / S10 ------------------------------------------------------------------------------------
def experiment_results(history: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """One nested row per experiment: config MAP, round_history ARRAY<STRUCT>, finals."""
    per_round = history.groupBy("experiment", "strategy", "round").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    rec = F.struct(F.col("round"), *[F.element_at("m", F.lit(k)).alias(k) for k in FINAL_METRICS])
    hist = per_round.groupBy("experiment", "strategy").agg(F.array_sort(F.collect_list(rec)).alias("round_history"))
    cfg = F.create_map(*[x for k, v in (config or {}).items() for x in (F.lit(k), F.lit(str(v)))]) if config else \
        F.create_map().cast("map<string,string>")
    return hist.select(F.col("experiment").alias("experiment_name"), "strategy",
                       F.size("round_history").alias("num_rounds"), cfg.alias("config"), "round_history")


def strategy_report(results: DataFrame) -> DataFrame:
    """Projection of the nested result rows: finals and the best round, all from the arrays."""
    last = F.element_at("round_history", -1)
    best = F.aggregate("round_history", F.struct(F.lit(-1.0).alias("acc"), F.lit(-1).alias("round")),
                       lambda acc, r: F.when(F.coalesce(r["accuracy"], F.lit(0.0)) > acc["acc"],
                                             F.struct(F.coalesce(r["accuracy"], F.lit(0.0)).alias("acc"),
                                                      r["round"].alias("round"))).otherwise(acc))
    return results.select("experiment_name", "strategy", "num_rounds",
                          F.coalesce(last["loss"], F.lit(0.0)).alias("final_loss"),
                          F.coalesce(last["accuracy"], F.lit(0.0)).alias("final_accuracy"),
                          best["round"].alias("best_round"), best["acc"].alias("best_accuracy"))
