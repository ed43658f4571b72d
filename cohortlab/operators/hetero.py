"""Partition diagnostics (H1-H8): how different are the clients' label mixes?

Row-level work is one ``groupBy(client, label).count()`` (partial aggregation, so a hot
client collapses map-side). Everything after that runs on a clients x labels table. All pairs of
clients are the result asked for; they are made block by block with an equi-join on the pair
of blocks, so no task holds more than two blocks of clients. Labels that are NULL count for
nothing; client ids may be of any type.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import materialize

#: clients in a block of the pair join
BLOCK_CLIENTS = 512


# H1 -----------------------------------------------------------------------------------------
def client_sizes(df: DataFrame, client_col: str = "client_id") -> DataFrame:
    return df.groupBy(client_col).agg(F.count(F.lit(1)).alias("n_samples"))


# H2 -----------------------------------------------------------------------------------------
def client_label_balance(df: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    return df.groupBy(client_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label_col) == 1).alias("positive"),
        F.count_if(F.col(label_col) == 0).alias("negative"),
    ).withColumn("positive_pct", (F.col("positive") * 100.0 / F.col("total")))


# H3 -----------------------------------------------------------------------------------------
def label_counts(df: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    """(client, _lab, _cnt) without NULL labels: the ONLY row-level work of the distance operators,
    materialised once (clients x labels rows) so that labels and vectors reuse it."""
    c = df.where(F.col(label_col).isNotNull()).groupBy(F.col(client_col), F.col(label_col).cast("string").alias("_lab")).agg(
        F.count(F.lit(1)).alias("_cnt"))
    return materialize(c)


def _indexed_labels(counts: DataFrame) -> DataFrame:
    """(_lab, _lix): the K labels numbered in order (a window over K rows)."""
    return counts.select("_lab").distinct().select(
        "_lab", (F.row_number().over(Window.orderBy("_lab")) - 1).cast("int").alias("_lix"))


def client_vectors(df: DataFrame | None, client_col: str = "client_id", label_col: str = "label",
                   counts: DataFrame | None = None, k: int | None = None, ids: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """((client, p ARRAY<DOUBLE>), K) with p in sorted-label order over the union of labels,
    zeros for labels a client lacks, renormalised by ``sum + 1e-10`` as the reference does."""
    counts = counts if counts is not None else label_counts(df, client_col, label_col)
    labels = _indexed_labels(counts)
    k = counts.agg(F.count_distinct("_lab")).first()[0] if k is None else k
    per_client = counts.join(labels, "_lab").groupBy(*ids, client_col).agg(
        F.map_from_entries(F.collect_list(F.struct("_lix", "_cnt"))).alias("_m"), F.sum("_cnt").alias("_tot"))
    every = F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>")
    vec = per_client.select(*ids, client_col, F.transform(
        every, lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)) / F.col("_tot")).alias("_p"))
    vec = vec.withColumn("_s", F.aggregate("_p", F.lit(0.0), lambda a, b: a + b) + F.lit(1e-10))
    return vec.select(*ids, client_col, F.transform("_p", lambda x: x / F.col("_s")).alias("p")), k


def client_label_dist(df: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    """Long form (client, label, label_idx, share) densified with zeros; share = count / client total."""
    counts = label_counts(df, client_col, label_col)
    labels = _indexed_labels(counts)
    listed = labels.agg(F.array_sort(F.collect_list(F.struct("_lix", "_lab"))).alias("_all"))   # one row of K labels
    totals = counts.groupBy(client_col).agg(F.sum("_cnt").alias("_tot"),
                                            F.map_from_entries(F.collect_list(F.struct("_lab", "_cnt"))).alias("_m"))
    dense = totals.withColumn("_one", F.lit(1)).join(F.broadcast(listed.withColumn("_one", F.lit(1))), "_one")
    z = dense.select(client_col, "_tot", "_m", F.explode("_all").alias("_l"))
    return z.select(client_col, F.col("_l._lab").alias("label"), F.col("_l._lix").alias("label_idx"),
                    (F.coalesce(F.element_at("_m", F.col("_l._lab")), F.lit(0)) / F.col("_tot")).alias("share"))


# H4 -----------------------------------------------------------------------------------------
def _pairs(vec: DataFrame, client_col: str, n_clients: int, block: int = BLOCK_CLIENTS, ids: Sequence[str] = ()) -> DataFrame:
    """All pairs of clients i < j (of equal ``ids``): every client goes to the block pairs that its block is in."""
    blocks = max(1, math.ceil(n_clients / block))
    own = F.pmod(F.xxhash64(client_col), F.lit(blocks)).cast("int")
    v = vec.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = v.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    a = v.select(*ids, "_lo", "_hi", F.col("_own").alias("_oi"), F.col(client_col).alias("client_i"), F.col("p").alias("p_i"),
                 F.col("q").alias("q_i"))
    b = v.select(*ids, "_lo", "_hi", F.col("_own").alias("_oj"), F.col(client_col).alias("client_j"), F.col("p").alias("p_j"),
                 F.col("q").alias("q_j"))
    meets = (F.col("_lo") == F.col("_hi")) | (F.col("_oi") != F.col("_oj"))
    return a.join(b, [*ids, "_lo", "_hi"]).where(meets & (F.col("client_i") < F.col("client_j")))


def _abs_sum(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def _cdf_distance(a, b):
    """Sum of |running sum of a - b| over all labels but the last."""
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("before"), F.lit(0.0).alias("all"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x - y), start, lambda s, d: F.struct(
        (s["cum"] + d).alias("cum"), s["all"].alias("before"), (s["all"] + F.abs(s["cum"] + d)).alias("all")),
        lambda s: s["before"])


def pair_distances(df: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    """(client_i, client_j, emd_value, emd_label, tv_distance) for i < j.

    emd_value: the reference formula, 1-D Wasserstein between the *sorted share values*
    (1/K)·Σ|sort p − sort q| (label-blind). emd_label: Wasserstein on label ids, Σ|ΔCDF|.
    tv_distance: ½Σ|p − q|. Vectors are sorted once per client, and each pair costs O(K)."""
    pr, k = _all_pairs(df, client_col, label_col)
    return _distances(pr, k)


def _all_pairs(df: DataFrame, client_col: str, label_col: str) -> tuple[DataFrame, int]:
    """The pairs of clients with their vectors, and K: one aggregate over the rows, one over its counts."""
    counts = label_counts(df, client_col, label_col)
    n, k = counts.agg(F.count_distinct(client_col), F.count_distinct("_lab")).first()
    vec, k = client_vectors(df, client_col, label_col, counts, k)
    return _pairs(vec.withColumn("q", F.array_sort("p")), client_col, n), k


def _distances(pr: DataFrame, k, *ids: str) -> DataFrame:
    k = k if not isinstance(k, int) else F.lit(float(max(k, 1)))
    return pr.select(*ids, "client_i", "client_j", (_abs_sum(F.col("q_i"), F.col("q_j")) / k).alias("emd_value"),
                     _cdf_distance(F.col("p_i"), F.col("p_j")).alias("emd_label"),
                     (F.lit(0.5) * _abs_sum(F.col("p_i"), F.col("p_j"))).alias("tv_distance"))


# H5 -----------------------------------------------------------------------------------------
def emd_stats(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.avg("emd_value").alias("mean_emd"), F.max("emd_value").alias("max_emd"),
        F.min("emd_value").alias("min_emd"), F.avg("emd_label").alias("mean_emd_label"),
        F.avg("tv_distance").alias("mean_tv"), F.count(F.lit(1)).alias("n_pairs"))


# H6 -----------------------------------------------------------------------------------------
def client_imbalance(df: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    b = df.groupBy(client_col).agg(F.count_if(F.col(label_col) == 1).alias("positive"),
                                   F.count_if(F.col(label_col) == 0).alias("negative"))
    imb = F.when(F.col("negative") > 0, F.col("positive") / (F.col("negative") + F.lit(1e-10))) \
        .otherwise(F.lit(float("inf")))
    return b.select(client_col, "positive", "negative", imb.alias("imbalance"))


def imbalance_stats(imb: DataFrame) -> DataFrame:
    return imb.agg(F.avg("imbalance").alias("mean_imbalance"),
                   F.stddev_pop("imbalance").alias("std_imbalance"))


# H7 -----------------------------------------------------------------------------------------
def partition_totals(df: DataFrame, client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    t = df.agg(F.countDistinct(client_col).alias("n_clients"), F.count(F.lit(1)).alias("n_samples"),
               F.count_if(F.col(label_col) == 1).alias("positive"),
               F.count_if(F.col(label_col) == 0).alias("negative"))
    return t.select("*", (F.col("positive") * 100.0 / F.col("n_samples")).alias("positive_pct"),
                    (F.col("negative") * 100.0 / F.col("n_samples")).alias("negative_pct"))


# H8 -----------------------------------------------------------------------------------------
def compare_schemes(schemes: dict[str, DataFrame], client_col: str = "client_id", label_col: str = "label") -> DataFrame:
    """(scheme, mean_emd, mean_emd_label, mean_tv) of several assignments of rows to clients: one table of counts
    by scheme, client and label, and one join for the pairs of all schemes."""
    rows = None
    for name, df in schemes.items():
        d = df.select(F.lit(name).alias("scheme"), F.col(client_col).alias("client"), F.col(label_col).cast("string").alias("_lab"))
        rows = d if rows is None else rows.unionByName(d)
    counts = materialize(rows.where("_lab is not null").groupBy("scheme", "client", "_lab").agg(F.count(F.lit(1)).alias("_cnt")))
    sizes = counts.groupBy("scheme").agg(F.count_distinct("client").alias("n"), F.count_distinct("_lab").alias("_k"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    vec, _ = client_vectors(None, "client", counts=counts, ids=["scheme"])
    pairs = _pairs(vec.withColumn("q", F.array_sort("p")), "client", most, ids=["scheme"]).join(F.broadcast(sizes.drop("n")), "scheme")
    # labels that a scheme lacks add nothing but length
    d = _distances(pairs, F.col("_k"), "scheme")
    return emd_stats(d, ["scheme"]).select("scheme", "mean_emd", "mean_emd_label", "mean_tv").orderBy("mean_emd", "scheme")


def scheme_comparison(stats_by_scheme: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, st in stats_by_scheme.items():
        s = st.select(F.lit(name).alias("scheme"), "mean_emd", "mean_emd_label", "mean_tv")
        out = s if out is None else out.unionByName(s)
    return out.orderBy("mean_emd", "scheme")
