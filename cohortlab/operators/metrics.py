"""Evaluation metrics as plain aggregates.

The only row-level work for classification metrics is ONE ``groupBy(group..., y_true,
y_pred).count()`` (partial aggregation; at most groups x K^2 rows leave the map side).
Per-class precision/recall/F1, macro and weighted averages, accuracy and the confusion
matrix are all derived from that small table. AUC groups by score and uses the bucketed
running sum, so no single task ever sees all distinct scores.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import f1_of, materialize, safe_ratio
from ..functions.ordering import running_sums, with_value_bucket


# V1 / V2 ------------------------------------------------------------------------------------
def binary_confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    t, p = F.col(y_true), F.col(y_pred)
    return df.agg(F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 0) & (t == 0)).alias("tn"),
                  F.count_if((p == 1) & (t == 0)).alias("fp"), F.count_if((p == 0) & (t == 1)).alias("fn"),
                  F.count(F.lit(1)).alias("total_samples"), F.count_if(p == t).alias("_correct"))


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    c = binary_confusion(df, y_true, y_pred)
    prec = safe_ratio("tp", F.col("tp") + F.col("fp"))
    rec = safe_ratio("tp", F.col("tp") + F.col("fn"))
    return c.select(
        safe_ratio("_correct", "total_samples").alias("accuracy"), prec.alias("precision"),
        rec.alias("recall"), safe_ratio("tn", F.col("tn") + F.col("fp")).alias("specificity"),
        f1_of(prec, rec).alias("f1"), safe_ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"),
        safe_ratio("fn", F.col("fn") + F.col("tp")).alias("fnr"),
        "tp", "tn", "fp", "fn", "total_samples")


# V3 -----------------------------------------------------------------------------------------
def auc_roc(df: DataFrame, y_true: str = "y_true", score: str = "score", n_buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties counted 1/2: Σ_s pos(s)·(neg_below(s) + neg(s)/2) / (P·N).
    NULL when only one class is present (the reference skips AUC then)."""
    g = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) != 1).alias("neg"))
    b = with_value_bucket(materialize(g), "score", "_sb", n_buckets)   # read for bounds, totals and sums
    rs = running_sums(b, "score", ["neg"], F.col("_sb"))
    agg = rs.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_num"),
                 F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(F.when(F.col("_p") * F.col("_n") > 0,
                                F.col("_num") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc_roc"))


# shared multiclass core ---------------------------------------------------------------------
def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_from_counts(counts: DataFrame, group_cols: Sequence[str] = (), classes: str = "union") -> DataFrame:
    """(group..., class, tp, predicted, support, precision, recall, f1[, ce_sum]); 0 when
    undefined. ``classes='true'``: only classes present in y_true; ``'union'``: y_true ∪ y_pred.

    One aggregate: every (y_true, y_pred, n) row contributes a true-side record for class
    y_true (support, tp, cross-entropy) and a predicted-side record for class y_pred."""
    g = list(group_cols)
    has_ce = "ce_sum" in counts.columns
    ce = F.col("ce_sum") if has_ce else F.lit(0.0)
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("predicted"), ce.cast("double").alias("ce")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("predicted"), F.lit(0.0).alias("ce")))
    e = counts.select(*g, F.explode(sides).alias("s")).select(*g, "s.*")
    j = e.groupBy(*g, "class").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"),
                                   F.sum("support").alias("support"), F.sum("ce").alias("ce_sum"))
    if classes == "true":
        j = j.where(F.col("support") > 0)
    prec = safe_ratio("tp", "predicted")
    rec = safe_ratio("tp", "support")
    out = j.select("*", prec.alias("precision"), rec.alias("recall"), f1_of(prec, rec).alias("f1"))
    return out if has_ce else out.drop("ce_sum")


def _per_class_columns(pc: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return pc.select(*group_cols, F.col("class").cast("int").alias("class"), "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


# V4 / V5 ------------------------------------------------------------------------------------
def per_class_true(df: DataFrame, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = ()) -> DataFrame:
    pc = per_class_from_counts(confusion_counts(df, y_true, y_pred, group_cols), group_cols, "true")
    return _per_class_columns(pc, group_cols)


def per_class_union(df: DataFrame, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = (),
                    label_map: DataFrame | None = None) -> DataFrame:
    pc = _per_class_columns(per_class_from_counts(confusion_counts(df, y_true, y_pred, group_cols), group_cols),
                            group_cols)
    if label_map is not None:
        pc = pc.join(label_map.select(F.col("label_id").alias("class"), F.col("label").alias("class_name")), "class", "left")
    return pc


# V6 / V7 / V8 -------------------------------------------------------------------------------
def averages_from_per_class(pc: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    sup = F.sum("support")
    return pc.groupBy(*group_cols).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("precision") * F.col("support")), sup), F.lit(0.0)).alias("weighted_precision"),
        F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), sup), F.lit(0.0)).alias("weighted_recall"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), sup), F.lit(0.0)).alias("weighted_f1"))


def macro_metrics(df, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = ()) -> DataFrame:
    a = averages_from_per_class(per_class_from_counts(confusion_counts(df, y_true, y_pred, group_cols), group_cols),
                                group_cols)
    return a.select(*group_cols, *[F.col(c).alias(c) for c in ["macro_precision", "macro_recall", "macro_f1"]])


def weighted_metrics(df, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = ()) -> DataFrame:
    a = averages_from_per_class(per_class_from_counts(confusion_counts(df, y_true, y_pred, group_cols), group_cols),
                                group_cols)
    return a.select(*group_cols, *[F.col(c).alias(c) for c in ["weighted_precision", "weighted_recall", "weighted_f1"]])


def accuracy(df, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"),
                                       F.count(F.lit(1)).alias("n"))


# V9 -----------------------------------------------------------------------------------------
def confusion_grid(counts: DataFrame) -> DataFrame:
    """K x K over the sorted union of labels, zeros included, from a table of counts. One row of
    K labels is exploded, spread over the tasks and exploded again."""
    counts = counts.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
    labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("l")).where(F.col("l").isNotNull())
    every = labels.agg(F.sort_array(F.collect_set("l")).alias("_all"))
    grid = every.select(F.explode("_all").alias("y_true"), "_all").repartition("y_true").select(
        "y_true", F.explode("_all").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_long(df, y_true="y_true", y_pred="y_pred") -> DataFrame:
    return confusion_grid(eval_counts(df, y_true, y_pred))


def confusion_pivot(df, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """One column per predicted label, so the labels come to the driver."""
    counts = eval_counts(df, y_true, y_pred)
    listed = counts.select(F.explode(F.array("y_true", "y_pred")).alias("l")).where(F.col("l").isNotNull()).distinct()
    labels = sorted(r[0] for r in listed.collect())
    return confusion_grid(counts).groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n")) \
        .select("y_true", *[F.col(f"`{x}`").alias(f"pred_{x}") for x in labels])


# V10-V13 ------------------------------------------------------------------------------------
def softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / s)


def argmax(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def logsumexp(logits: Column) -> Column:
    m = F.array_max(logits)
    return m + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, b: a + b))


def cross_entropy_col(logits: Column, y: Column) -> Column:
    return logsumexp(logits) - F.element_at(logits, y + 1)


def cross_entropy(df, logits="logits", y_true="y_true", group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg(cross_entropy_col(F.col(logits), F.col(y_true))).alias("loss"),
                                       F.count(F.lit(1)).alias("n"))


def proba_stats(df, logits="logits") -> DataFrame:
    p = softmax(F.col(logits))
    d = df.select(p.alias("p"))
    d = d.select(F.array_max("p").alias("pmax"), F.array_min("p").alias("pmin"),
                 F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("psum"), F.size("p").alias("k"))
    return d.agg(F.max("pmax").alias("max_proba"), F.min("pmin").alias("min_proba"),
                 (F.sum("psum") / F.sum("k")).alias("mean_proba"), F.avg("psum").alias("mean_row_sum"),
                 F.max(F.abs(F.col("psum") - 1.0)).alias("max_row_sum_error"),
                 F.avg("pmax").alias("mean_confidence"))


# V14 / V15 / V16 ----------------------------------------------------------------------------
EVAL_NAMES = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall",
              "weighted_f1", "n"]


def eval_counts(df, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = (), logits: str | None = None) -> DataFrame:
    """The single row-level aggregate behind every evaluation table: (group..., y_true, y_pred,
    n[, ce_sum]) — at most groups x K^2 rows, materialised so all metrics (and any coarser
    grouping, e.g. global from per-client) reuse it without rescoring the rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if logits:
        aggs.append(F.sum(cross_entropy_col(F.col(logits), F.col(y_true))).alias("ce_sum"))
    c = df.groupBy(*group_cols, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(*aggs)
    return materialize(c)


def eval_from_counts(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long (group..., metric, value) from an ``eval_counts`` table: one per-class aggregate,
    one per-group aggregate (macro/weighted averages, accuracy = Σtp/Σsupport, n, loss)."""
    g = list(group_cols)
    has_loss = "ce_sum" in counts.columns
    pc = per_class_from_counts(counts, g)
    sup = F.sum("support")
    aggs = [F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
            F.avg("f1").alias("macro_f1"),
            F.coalesce(F.try_divide(F.sum(F.col("precision") * F.col("support")), sup), F.lit(0.0)).alias("weighted_precision"),
            F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), sup), F.lit(0.0)).alias("weighted_recall"),
            F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), sup), F.lit(0.0)).alias("weighted_f1"),
            (F.sum("tp") / sup).alias("accuracy"), sup.cast("double").alias("n")]
    if has_loss:
        aggs.append((F.sum("ce_sum") / sup).alias("loss"))
    wide = pc.groupBy(*g).agg(*aggs)
    names = (["loss"] if has_loss else []) + EVAL_NAMES
    structs = [F.struct(F.lit(nm).alias("metric"), F.col(nm).cast("double").alias("value")) for nm in names]
    rows = wide.select(*g, F.explode(F.array(*structs)).alias("s")).select(*g, "s.metric", "s.value")
    per_cls = pc.select(*g, F.concat(F.lit("f1_class_"), F.col("class").cast("string")).alias("metric"),
                        F.col("f1").alias("value"))
    return rows.unionByName(per_cls).select(*g, "metric", F.col("value").alias("value"))


def eval_table(df, y_true="y_true", y_pred="y_pred", group_cols: Sequence[str] = (), logits: str | None = None) -> DataFrame:
    """Long (group..., metric, value): loss (if logits), accuracy, macro/weighted P/R/F1,
    f1_class_k and n — the per-client evaluation dictionary as rows."""
    return eval_from_counts(eval_counts(df, y_true, y_pred, group_cols, logits), group_cols)


def client_eval(df, y_true="y_true", y_pred="y_pred", client_col="client_id", logits: str | None = None) -> DataFrame:
    return eval_table(df, y_true, y_pred, [client_col], logits)


def round_eval(df, y_true="y_true", y_pred="y_pred", client_col="client_id", logits: str | None = None) -> DataFrame:
    """Global metrics (client_id NULL, scope 'global') plus one block per client; the rows are
    scored and aggregated once, the global block is re-aggregated from the per-client counts."""
    cc = eval_counts(df, y_true, y_pred, [client_col], logits)
    per_client = eval_from_counts(cc, [client_col]).withColumn("scope", F.lit("client"))
    sums = [F.sum("n").alias("n")] + ([F.sum("ce_sum").alias("ce_sum")] if "ce_sum" in cc.columns else [])
    glob = eval_from_counts(cc.groupBy("y_true", "y_pred").agg(*sums), []).select(
        F.lit(None).cast("int").alias(client_col), "metric", "value").withColumn("scope", F.lit("global"))
    return per_client.select(F.col(client_col).cast("int").alias(client_col), "metric", "value", "scope").unionByName(glob)


def eval_report(df, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Full report as one long table (section, name, value): metrics, confusion, support, all
    from one materialised table of counts."""
    counts = eval_counts(df, y_true, y_pred)
    metrics = eval_from_counts(counts).select(F.lit("metrics").alias("section"), F.col("metric").alias("name"), "value")
    cm = confusion_grid(counts).select(
        F.lit("confusion").alias("section"),
        F.concat(F.lit("cm_"), F.col("y_true").cast("string"), F.lit("_"), F.col("y_pred").cast("string")).alias("name"),
        F.col("n").cast("double").alias("value"))
    sup = per_class_from_counts(counts).select(
        F.lit("support").alias("section"), F.concat(F.lit("support_class_"), F.col("class").cast("string")).alias("name"),
        F.col("support").cast("double").alias("value"))
    return metrics.unionByName(cm).unionByName(sup)
