"""Named queries: each one a Spark job over the driver tables, most with a DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``. Queries are
registered with ``@query(name, sql)``; ``sql=None`` means not SQL-expressible (rows-only).
"""
from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, hetero, partition
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources import tables as T
from . import sqlparts as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def staging_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, so that sessions don't write over each other."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


# ---------------------------------------------------------------------------------------------
# shared Spark building blocks
def cleaned_flows(spark, sf):
    return clean.dedup_rows(clean.remove_infinite_values(T.repeated_dirty_flows(spark, sf), ["value"]), "event_id")


def iid_flows(spark, sf, n=5):
    return partition.partition_iid(cleaned_flows(spark, sf), "event_id", n_clients=n)


def day_flows(spark, sf, n=5):
    return partition.partition_by_day(T.flows(spark, sf), "ts", n_clients=n)


def family_flows(spark, sf, n=5):
    return partition.partition_by_family(T.flows(spark, sf), "event_id", "label", n_clients=n)


CLEAN = S.cleaned_flows_sql()
IID = S.iid_sql(CLEAN)
DAY = S.day_sql(S.FLOWS)
FAMILY = S.family_part_sql(S.FLOWS)


# ---------------------------------------------------------------------------------------------
# flagship: clean -> dedup -> iid clients -> pairwise label-mix distances
@query("client_pair_distances", S.dist_sql(IID))
def q_client_pair_distances(spark, sf):
    return hetero.pair_distances(iid_flows(spark, sf), "client_id", "label")


@query("emd_value", f"SELECT client_i, client_j, emd_value FROM ({S.dist_sql(FAMILY)})")
def q_emd_value(spark, sf):
    return hetero.pair_distances(family_flows(spark, sf)).select("client_i", "client_j", "emd_value")


@query("emd_label", f"SELECT client_i, client_j, emd_label FROM ({S.dist_sql(FAMILY)})")
def q_emd_label(spark, sf):
    return hetero.pair_distances(family_flows(spark, sf)).select("client_i", "client_j", "emd_label")


@query("tv_distance", f"SELECT client_i, client_j, tv_distance FROM ({S.dist_sql(FAMILY)})")
def q_tv_distance(spark, sf):
    return hetero.pair_distances(family_flows(spark, sf)).select("client_i", "client_j", "tv_distance")


@query("emd_stats", S.emd_stats_sql(S.dist_sql(DAY, digits=False)))
def q_emd_stats(spark, sf):
    return hetero.emd_stats(hetero.pair_distances(day_flows(spark, sf)))


@query("scheme_comparison",
       "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{nm}' AS scheme, mean_emd, mean_emd_label, mean_tv FROM ({S.emd_stats_sql(S.dist_sql(src, digits=False))})"
           for nm, src in [("iid", IID), ("day", DAY), ("family", FAMILY)]) + ")")
def q_scheme_comparison(spark, sf):
    return hetero.compare_schemes({"iid": iid_flows(spark, sf), "day": day_flows(spark, sf), "family": family_flows(spark, sf)})


@query("partition_iid", f"SELECT client_id, count(*) AS n_samples, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({IID}) GROUP BY 1")
def q_partition_iid(spark, sf):
    return iid_flows(spark, sf).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_samples"),
                                                          F.sum("event_id").alias("key_sum"))


def _iid_q(n):
    def fn(spark, sf):
        return iid_flows(spark, sf, n).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("event_id").alias("key_sum"))
    return fn


for _n in (20, 100, 1000):
    query(f"partition_iid_n{_n}", "SELECT client_id, count(*) AS n_samples, CAST(sum(event_id) AS BIGINT) AS key_sum "
                                  f"FROM ({S.iid_sql(CLEAN, n=_n)}) GROUP BY 1")(_iid_q(_n))


@query("pair_distances_text_ids", S.dist_sql(T.FLOWS_WITHOUT_SOME_LABELS_SQL, id_type="VARCHAR"))
def q_pair_distances_text_ids(spark, sf):
    """Clients with text ids, some labels NULL."""
    return hetero.pair_distances(T.flows_without_some_labels(spark, sf))


@query("partition_by_day", f"SELECT client_id, count(*) AS n_samples, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({DAY}) GROUP BY 1")
def q_partition_by_day(spark, sf):
    return day_flows(spark, sf).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_samples"),
                                                          F.sum("event_id").alias("key_sum"))


@query("partition_by_day_wide",
       f"SELECT client_id, count(*) AS n_samples, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({S.day_sql(S.FLOWS, n=40)}) GROUP BY 1")
def q_partition_by_day_wide(spark, sf):
    return day_flows(spark, sf, n=40).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_samples"),
                                                                F.sum("event_id").alias("key_sum"))


def _family_q(n):
    def fn(spark, sf):
        return family_flows(spark, sf, n).groupBy("client_id", "label").agg(
            F.count(F.lit(1)).alias("n_samples"), F.sum("event_id").alias("key_sum"))
    return fn


for _n, _nm in [(5, "partition_by_family"), (3, "partition_by_family_n3"), (8, "partition_by_family_n8"), (20, "partition_by_family_n20")]:
    query(_nm, f"SELECT client_id, label, count(*) AS n_samples, CAST(sum(event_id) AS BIGINT) AS key_sum "
               f"FROM ({S.family_part_sql(S.FLOWS, n=_n)}) GROUP BY 1, 2")(_family_q(_n))


# ---------------------------------------------------------------------------------------------
# cleaning / resolving / encoding
from ..operators import split as split_ops  # noqa: E402


@query("clean_inf", "SELECT event_id, CASE WHEN isinf(value) OR isnan(value) THEN NULL ELSE value END AS value "
                    f"FROM ({T.DIRTY_FLOWS_SQL})")
def q_clean_inf(spark, sf):
    return clean.clean_inf(T.dirty_flows(spark, sf), ["value"]).select("event_id", "value")


@query("drop_null_subset", "SELECT event_id, value FROM (SELECT event_id, CASE WHEN isinf(value) OR isnan(value) "
                           f"THEN NULL ELSE value END AS value FROM ({T.DIRTY_FLOWS_SQL})) WHERE value IS NOT NULL")
def q_drop_null_subset(spark, sf):
    return clean.remove_infinite_values(T.dirty_flows(spark, sf), ["value"]).select("event_id", "value")


@query("dedup_rows", f"SELECT label, count(*) AS n_rows, round(sum(value) + 1e-9, 6) + 0.0 AS value_sum "
                     f"FROM (SELECT DISTINCT * FROM ({T.DUP_FLOWS_SQL})) GROUP BY label")
def q_dedup_rows(spark, sf):
    from ..functions.exprs import r6
    return clean.dedup_rows(T.dup_flows(spark, sf)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.sum("value")).alias("value_sum"))


@query("dedup_report", f"SELECT 'dedup' AS step, rows_before, rows_after, rows_before - rows_after AS removed FROM "
                       f"(SELECT count(*) AS rows_before FROM ({T.DUP_FLOWS_SQL})), "
                       f"(SELECT count(*) AS rows_after FROM (SELECT DISTINCT * FROM ({T.DUP_FLOWS_SQL})))")
def q_dedup_report(spark, sf):
    d = T.dup_flows(spark, sf)
    return clean.removed_count(d, clean.dedup_rows(d), "dedup")


@query("parse_ts", "SELECT event_id, CAST(epoch(try_strptime(\"Timestamp\", '%d/%m/%Y %H:%M:%S')) AS BIGINT) AS ts_epoch "
                   f"FROM ({T.TS_TEXT_SQL})")
def q_parse_ts(spark, sf):
    p = clean.parse_ts(T.ts_text_flows(spark, sf))
    return p.select("event_id", F.unix_seconds(F.col("Timestamp")).alias("ts_epoch"))


@query("sequential_ts", "SELECT event_id, CAST(epoch(TIMESTAMP '2017-01-01 00:00:00') AS BIGINT) + "
                        f"row_number() OVER (ORDER BY event_id) - 1 AS ts_epoch FROM ({S.FLOWS})")
def q_sequential_ts(spark, sf):
    f = T.flows(spark, sf).drop("ts")
    p = clean.parse_ts(f, order_col="event_id")
    return p.select("event_id", F.unix_seconds(F.col("Timestamp")).alias("ts_epoch"))


@query("sequential_ts_null_order", "SELECT event_id, CAST(epoch(TIMESTAMP '2017-01-01 00:00:00') AS BIGINT) + pos - 1 AS ts_epoch, n_rows FROM "
       "(SELECT event_id, o, count(*) OVER () AS n_rows, row_number() OVER (ORDER BY o NULLS FIRST) AS pos FROM "
       f"(SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id END AS o FROM ({S.FLOWS}))) WHERE o IS NOT NULL")
def q_sequential_ts_null_order(spark, sf):
    """Rows without an order value come first and aren't lost: n_rows counts them, and the others'
    positions follow theirs."""
    f = T.flows(spark, sf).select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("o"))
    p = clean.sequential_ts(f, "o")
    n = p.count()
    return p.where("o is not null").select("event_id", F.unix_seconds(F.col("Timestamp")).alias("ts_epoch"),
                                           F.lit(n).cast("long").alias("n_rows"))


@query("label_encode", f"SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, "
                       f"count(*) AS n FROM ({S.FLOWS}) GROUP BY label")
def q_label_encode(spark, sf):
    enc, _ = clean.label_encode(T.flows(spark, sf), "label")
    return enc.groupBy("label", "label_id").agg(F.count(F.lit(1)).alias("n"))


@query("numeric_projection", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                             "l_discount, l_tax FROM lineitem")
def q_numeric_projection(spark, sf):
    return clean.numeric_projection(T.wide_numeric(spark, sf))


@query("cast_features", "SELECT l_orderkey, l_partkey, l_suppkey, "
                        "CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_extendedprice AS FLOAT) AS l_extendedprice, "
                        "CAST(l_discount AS FLOAT) AS l_discount, CAST(l_tax AS FLOAT) AS l_tax, "
                        "CAST(l_linenumber AS FLOAT) AS l_linenumber, "
                        "CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label FROM lineitem")
def q_cast_features(spark, sf):
    w = T.wide_numeric(spark, sf)
    enc, _ = clean.label_encode(w, "l_returnflag", "label")
    return clean.cast_features(enc, T.WIDE_FEATURES, "label", keep=["l_orderkey", "l_partkey", "l_suppkey"])


@query("synthetic_day", f"SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // greatest(count(*) OVER () // 8, 1) "
                        f"AS VARCHAR) AS day, event_id FROM ({S.FLOWS})")
def q_synthetic_day_rows(spark, sf):
    return clean.synthetic_day(T.flows(spark, sf).select("event_id"), "event_id")


ORACLE["synthetic_day"] = (f"SELECT day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({ORACLE['synthetic_day']}) "
                           "GROUP BY day")
QUERIES["synthetic_day"] = lambda spark, sf: q_synthetic_day_rows(spark, sf).groupBy("day").agg(
    F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


@query("label_family", f"SELECT label, {S.family_sql('label')} AS family, count(*) AS n FROM ({S.FLOWS}) GROUP BY ALL")
def q_label_family(spark, sf):
    return clean.label_family(T.flows(spark, sf)).groupBy("label", "family").agg(F.count(F.lit(1)).alias("n"))


@query("family_filter", f"SELECT family, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM (SELECT *, {S.family_sql('label')} "
                        f"AS family FROM ({S.FLOWS})) WHERE family <> 'Normal' GROUP BY family")
def q_family_filter(spark, sf):
    fam = clean.family_filter(clean.label_family(T.flows(spark, sf)), normal=False)
    return fam.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


@query("head_n", f"SELECT event_id, label, value FROM ({S.FLOWS}) ORDER BY event_id LIMIT 5")
def q_head_n(spark, sf):
    return clean.head_n(T.flows(spark, sf).select("event_id", "label", "value"), 5, ["event_id"])


# ---------------------------------------------------------------------------------------------
# splits and partitioners
STRAT = (f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {S.h('event_id')}, event_id) <= "
         f"round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM ({S.FLOWS})")


@query("stratified_split", f"SELECT label, split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({STRAT}) GROUP BY ALL")
def q_stratified_split(spark, sf):
    s = split_ops.stratified_split(T.flows(spark, sf), "event_id", "label", 0.2)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


TRAINVAL = (f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY {S.h('event_id')}, event_id) <= "
            f"floor(count(*) OVER (PARTITION BY client_id) * 0.8) THEN 'train' ELSE 'val' END AS split FROM ({IID})")


@query("client_train_val", f"SELECT client_id, split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({TRAINVAL}) GROUP BY ALL")
def q_client_train_val(spark, sf):
    s = partition.client_train_val(iid_flows(spark, sf), "event_id")
    return s.groupBy("client_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


DIRICHLET_TH = partition.dirichlet_thresholds(5, 10, 0.5, seed=42)


def _dirichlet_sql():
    rows = ", ".join("[" + ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in r) + "]" for r in DIRICHLET_TH)
    u = f"((('0x' || substr({S.h('event_id')}, 1, 8))::UBIGINT + 0.5) / 4294967296.0)"
    return (f"SELECT CAST(list_position(list_transform(([{rows}])[label_id + 1], lambda t: t > {u}), true) - 1 AS INTEGER) "
            f"AS client_id, label, event_id FROM (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS label_id "
            f"FROM ({S.FLOWS}))")


@query("partition_dirichlet", f"SELECT client_id, label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({_dirichlet_sql()}) "
                              "GROUP BY ALL")
def q_partition_dirichlet(spark, sf):
    enc, lm = clean.label_encode(T.flows(spark, sf), "label")
    d = partition.partition_dirichlet(enc, "event_id", "label_id", n_labels=5, n_clients=10,
                                      thresholds=DIRICHLET_TH)
    return d.groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


def _keyed_dirichlet_sql(n: int, alpha: float) -> str:
    """Clients by keyed gamma variates of each label and client, as ``partition.keyed_gamma`` draws them."""
    unit = lambda i: f"((('0x' || substr(hh, {i}, 8))::UBIGINT + 0.5) / 4294967296.0)"
    d = alpha + 1.0 - 1.0 / 3.0
    u = f"((('0x' || substr({S.h('event_id')}, 1, 8))::UBIGINT + 0.5) / 4294967296.0)"
    return f"""
WITH f AS ({S.FLOWS}), l AS (SELECT DISTINCT label FROM f WHERE label IS NOT NULL),
h AS (SELECT label, client, t, md5(label || ':' || client || ':42:' || t) AS hh
      FROM l, range(0, {n}) c(client), range(0, {partition.GAMMA_DRAWS}) a(t)),
x AS (SELECT *, sqrt(-2 * ln({unit(1)})) * cos(2 * pi() * {unit(9)}) AS x FROM h),
v AS (SELECT *, pow(1 + x * {1.0 / (9.0 * d) ** 0.5!r}, 3) AS v FROM x),
g AS (SELECT label, client, arg_min({d!r} * v * pow({unit(25)}, {1.0 / alpha!r}), t) AS g FROM v
      WHERE v > 0 AND ln({unit(17)}) < 0.5 * x * x + {d!r} - {d!r} * v + {d!r} * ln(greatest(v, 1e-300)) GROUP BY ALL),
cuts AS (SELECT label, client, CASE WHEN client = {n - 1} THEN 1.0 ELSE round(sum(g) OVER (PARTITION BY label ORDER BY client)
                / sum(g) OVER (PARTITION BY label), 12) END AS cut FROM g),
r AS (SELECT f.event_id, f.label, {u} AS u FROM f)
SELECT CAST(min(c.client) AS INTEGER) AS client_id, r.label, r.event_id FROM r LEFT JOIN cuts c ON c.label = r.label AND c.cut > r.u
GROUP BY r.label, r.event_id"""


@query("partition_dirichlet_n1000", "SELECT client_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM "
                                    f"({_keyed_dirichlet_sql(1000, 0.1)}) GROUP BY ALL")
def q_partition_dirichlet_n1000(spark, sf):
    """A thousand clients and text labels; shares drawn by keys that Spark and SQL share."""
    d = partition.partition_dirichlet(T.flows(spark, sf), "event_id", "label", n_clients=1000, alpha=0.1)
    return d.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


@query("assign_clients", "SELECT method, client_id, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, client_id FROM ({sql})" for m, sql in (("IID", IID), ("Day", DAY), ("family", FAMILY))) + ") GROUP BY ALL")
def q_assign_clients(spark, sf):
    """Assignments by name, in any case."""
    flows, out = {"IID": cleaned_flows, "Day": T.flows, "family": T.flows}, None
    for m, rows in flows.items():
        a = partition.assign_clients(rows(spark, sf), m, "event_id", n_clients=5).select(F.lit(m).alias("method"), "client_id")
        out = a if out is None else out.unionByName(a)
    return out.groupBy("method", "client_id").agg(F.count(F.lit(1)).alias("n"))


CLIENT_ROUNDS = "SELECT DISTINCT CAST(dayofmonth(ts) AS INTEGER) AS round, CAST(user_id % 5 AS INTEGER) AS client_id FROM events"


def client_rounds(spark, sf):
    ev = T.table(spark, sf, "events")
    return ev.select(F.dayofmonth("ts").cast("int").alias("round"),
                     (F.col("user_id") % 5).cast("int").alias("client_id")).distinct()


@query("sample_clients", "SELECT round, client_id FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY "
                         "md5(CAST(client_id AS VARCHAR) || ':42:' || CAST(round AS VARCHAR)), client_id) AS _r, "
                         f"count(*) OVER (PARTITION BY round) AS _n FROM ({CLIENT_ROUNDS})) "
                         "WHERE _r <= greatest(floor(_n * 0.6), 2)")
def q_sample_clients(spark, sf):
    return partition.sample_clients(client_rounds(spark, sf), fraction=0.6, min_fit=2, min_available=2)


@query("client_rows", f"SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({IID}) WHERE client_id = 2")
def q_client_rows(spark, sf):
    return partition.client_rows(iid_flows(spark, sf), 2).agg(F.count(F.lit(1)).alias("n"),
                                                               F.sum("event_id").alias("key_sum"))


BIN = ("SELECT event_id, ts, CAST(event_type = 'error' AS INTEGER) AS label_bin, value, user_id FROM events")
INJECT = (
    f"WITH d AS (SELECT *, isodow(ts) - 1 AS _dow, label_bin = 0 AS _neg FROM ({BIN})), "
    "t AS (SELECT _dow, count(*) AS _n, CAST(count_if(NOT _neg) AS BIGINT) AS _p FROM d GROUP BY _dow), "
    f"r AS (SELECT d.*, row_number() OVER (PARTITION BY d._dow, d._neg ORDER BY {S.h('event_id')}, event_id) AS _pos, "
    "t._n, t._p FROM d JOIN t USING (_dow)) "
    "SELECT event_id, _dow, CAST(CASE WHEN _neg AND _pos <= greatest(floor(_n * (0.1 + 0.05 * _dow)) - _p, 0) "
    "THEN 1 ELSE label_bin END AS INTEGER) AS label_bin FROM r")


@query("inject_label_rate", f"SELECT CAST(_dow AS INTEGER) AS dow, count(*) AS n, CAST(sum(label_bin) AS BIGINT) AS positives, "
                            f"CAST(sum(event_id * label_bin) AS BIGINT) AS key_sum FROM ({INJECT}) GROUP BY 1")
def q_inject_label_rate(spark, sf):
    b = T.binary_flows(spark, sf)
    inj = partition.inject_label_rate(b, "event_id", "ts", "label_bin")
    return inj.groupBy(F.weekday("ts").cast("int").alias("dow")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_bin").alias("positives"),
        F.sum(F.col("event_id") * F.col("label_bin")).alias("key_sum"))


# ---------------------------------------------------------------------------------------------
# scaling (F1-F4)
from ..operators import profile, scale  # noqa: E402
from .prep import prep_pipeline  # noqa: E402

FEATS = ["value", "user_id", "k"]
TRAIN_SQL = f"SELECT * FROM ({STRAT}) WHERE split = 'train'"
FIT_SQL = ("SELECT feature, mean, CASE WHEN std = 0 OR std IS NULL THEN 1.0 ELSE std END AS std FROM (" +
           " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM ({TRAIN_SQL})"
                              for c in FEATS) + ")")


def _strat_flows(spark, sf):
    return split_ops.stratified_split(T.flows(spark, sf), "event_id", "label", 0.2)


@query("scaler_fit", f"SELECT feature, round(mean + 1e-9, 6) + 0.0 AS mean, round(std + 1e-9, 6) + 0.0 AS std FROM ({FIT_SQL})")
def q_scaler_fit(spark, sf):
    from ..functions.exprs import r6
    st = scale.scaler_fit(_strat_flows(spark, sf).where("split = 'train'"), FEATS)
    return st.select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


def _scaled_sql(src, fit):
    cols = ", ".join(f"({c} - (SELECT mean FROM ({fit}) WHERE feature = '{c}')) / "
                     f"(SELECT std FROM ({fit}) WHERE feature = '{c}') AS {c}" for c in FEATS)
    return f"SELECT event_id, split, label, {cols} FROM ({src})"


SCALED_SQL = _scaled_sql(STRAT, FIT_SQL)


def _scaled_flows(spark, sf):
    sp = _strat_flows(spark, sf)
    st = scale.scaler_fit(sp.where("split = 'train'"), FEATS)
    return scale.scaler_apply(sp, st)


@query("scaler_apply", "SELECT event_id, split, " + ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in FEATS) +
       f" FROM ({SCALED_SQL})")
def q_scaler_apply(spark, sf):
    from ..functions.exprs import r6
    return _scaled_flows(spark, sf).select("event_id", "split", *[r6(c).alias(c) for c in FEATS])


@query("scaler_check", "SELECT round((" + " + ".join(f"avg({c})" for c in FEATS) + f") / {len(FEATS)} + 1e-9, 6) + 0.0 "
       "AS mean_of_means, round((" + " + ".join(f"stddev_samp({c})" for c in FEATS) + f") / {len(FEATS)} + 1e-9, 6) + 0.0 "
       f"AS mean_of_stds FROM ({SCALED_SQL}) WHERE split = 'train'")
def q_scaler_check(spark, sf):
    return scale.scaler_check(_scaled_flows(spark, sf).where("split = 'train'"), FEATS)


PREP_BASE = (f"SELECT *, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM ({CLEAN})")
PREP_SPLIT = (f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY label_id ORDER BY {S.h('event_id')}, event_id) <= "
              f"round(count(*) OVER (PARTITION BY label_id) * 0.2) THEN 'test' ELSE 'train' END AS split FROM ({PREP_BASE})")
PREP_FIT = ("SELECT feature, mean, CASE WHEN std = 0 OR std IS NULL THEN 1.0 ELSE std END AS std FROM (" +
            " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM ({PREP_SPLIT}) "
                               "WHERE split = 'train'" for c in FEATS) + ")")


@query("prep_pipeline", "SELECT event_id, split, label_id, " + ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in FEATS) +
       " FROM (SELECT event_id, split, label_id, " + ", ".join(
           f"({c} - (SELECT mean FROM ({PREP_FIT}) WHERE feature = '{c}')) / "
           f"(SELECT std FROM ({PREP_FIT}) WHERE feature = '{c}') AS {c}" for c in FEATS) + f" FROM ({PREP_SPLIT}))")
def q_prep_pipeline(spark, sf):
    from ..functions.exprs import r6
    res = prep_pipeline(T.repeated_dirty_flows(spark, sf), "event_id", "label", rate_cols=["value"])
    return res.data.select("event_id", "split", "label_id", *[r6(c).alias(c) for c in res.features])


@query("load_split", f"SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({STRAT}) WHERE split = 'test'")
def q_load_split(spark, sf):
    """Written partitioned by split; only the 'test' partition is read back."""
    path = staging_dir(spark, "processed")
    sinks.write_processed(_strat_flows(spark, sf), path)
    return sinks.load_split(spark, path, "test").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


@query("processed_roundtrip", f"SELECT split, label_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM ({PREP_SPLIT}) GROUP BY ALL")
def q_processed_roundtrip(spark, sf):
    """The whole preprocessing written partitioned by split, and both splits read back."""
    path = staging_dir(spark, "prep")
    prep_pipeline(T.repeated_dirty_flows(spark, sf), "event_id", "label", rate_cols=["value"], output_dir=path)
    back = sinks.load_split(spark, f"{path}/data", "train").unionByName(sinks.load_split(spark, f"{path}/data", "test"))
    return back.groupBy("split", "label_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("key_sum"))


@query("round_history_roundtrip", f"SELECT experiment, kind, metric, count(*) AS n, round(sum(value) + 1e-9, 6) + 0.0 AS total FROM "
       f"(SELECT experiment, 'eval' AS kind, metric, value FROM ({T.RUN_HISTORY_SQL}) WHERE metric <> 'n' UNION ALL "
       f"SELECT experiment, 'fit', metric, value FROM ({T.RUN_HISTORY_SQL}) WHERE metric = 'n') WHERE experiment <> 'click' GROUP BY ALL")
def q_round_history_roundtrip(spark, sf):
    """Two appends of round rows, read back by experiment."""
    path, h = staging_dir(spark, "rounds"), T.run_history(spark, sf)
    kind = F.when(F.col("metric") == "n", "fit").otherwise("eval")
    for rounds in ("round % 2 = 0", "round % 2 <> 0"):
        sinks.append_round_history(h.where(rounds).withColumn("kind", kind), path)
    back = sinks.read_round_history(spark, path).where("experiment <> 'click'")
    return back.groupBy("experiment", "kind", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# ---------------------------------------------------------------------------------------------
# profiling
WIDE_COLS = T.WIDE_FEATURES


@query("profile_shape", f"SELECT count(*) AS n_rows, 6 AS n_columns FROM ({T.DIRTY_FLOWS_SQL})")
def q_profile_shape(spark, sf):
    return profile.profile_shape(T.dirty_flows(spark, sf))


@query("profile_missing", "SELECT 'value' AS \"column\", CAST(count_if(value IS NULL) AS BIGINT) AS missing, "
       f"round(count_if(value IS NULL) * 100.0 / count(*) + 1e-9, 6) + 0.0 AS missing_pct FROM ({T.DIRTY_FLOWS_SQL})")
def q_profile_missing(spark, sf):
    return profile.profile_missing(T.dirty_flows(spark, sf))


@query("profile_infinite", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if(abs(CAST({c} AS DOUBLE)) = CAST('inf' AS DOUBLE)) AS BIGINT) AS n_inf FROM ({T.DIRTY_FLOWS_SQL})"
    for c in ["event_id", "value", "user_id", "k"]))
def q_profile_infinite(spark, sf):
    return profile.profile_infinite(T.dirty_flows(spark, sf))


@query("profile_duplicates", f"SELECT n_rows - n_distinct AS n_duplicates, round((n_rows - n_distinct) * 100.0 / n_rows "
       f"+ 1e-9, 6) + 0.0 AS duplicate_pct FROM (SELECT count(*) AS n_rows FROM ({T.DUP_FLOWS_SQL})), "
       f"(SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM ({T.DUP_FLOWS_SQL})))")
def q_profile_duplicates(spark, sf):
    return profile.profile_duplicates(T.dup_flows(spark, sf))


@query("class_distribution", f"SELECT label, count(*) AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct "
                             f"FROM ({S.FLOWS}) GROUP BY label")
def q_class_distribution(spark, sf):
    return profile.class_distribution(T.flows(spark, sf), "label")


@query("imbalance_ratio", f"SELECT round(max(n) * 1.0 / min(n) + 1e-9, 6) + 0.0 AS imbalance_ratio, count(*) AS n_classes "
                          f"FROM (SELECT label, count(*) AS n FROM ({S.FLOWS}) GROUP BY label)")
def q_imbalance_ratio(spark, sf):
    return profile.imbalance_ratio(T.flows(spark, sf), "label")


@query("profile_describe", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}) + 1e-9, 6) + 0.0 AS mean, "
    f"round(stddev_samp({c}) + 1e-9, 6) + 0.0 AS std, round(min({c}) + 1e-9, 6) + 0.0 AS min, "
    f"round(quantile_cont({c}, 0.25) + 1e-9, 6) + 0.0 AS p25, round(quantile_cont({c}, 0.5) + 1e-9, 6) + 0.0 AS p50, "
    f"round(quantile_cont({c}, 0.75) + 1e-9, 6) + 0.0 AS p75, round(max({c}) + 1e-9, 6) + 0.0 AS max, CAST(0 AS BIGINT) AS n_inf FROM lineitem"
    for c in WIDE_COLS))
def q_profile_describe(spark, sf):
    return profile.profile_describe(T.wide_numeric(spark, sf), WIDE_COLS)


DIRTY_COLS = ["value", "user_id", "k"]
DIRTY_FINITE = ("SELECT CASE WHEN isfinite(value) THEN value END AS value, CAST(user_id AS DOUBLE) AS user_id, CAST(k AS DOUBLE) AS k, "
                f"CAST(coalesce(isinf(value), false) AS INTEGER) AS inf_value, 0 AS inf_user_id, 0 AS inf_k FROM ({T.DIRTY_FLOWS_SQL})")


@query("profile_describe_dirty", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}) + 1e-9, 6) + 0.0 AS mean, "
    f"round(stddev_samp({c}) + 1e-9, 6) + 0.0 AS std, round(min({c}) + 1e-9, 6) + 0.0 AS min, "
    f"round(quantile_cont({c}, 0.25) + 1e-9, 6) + 0.0 AS p25, round(quantile_cont({c}, 0.5) + 1e-9, 6) + 0.0 AS p50, "
    f"round(quantile_cont({c}, 0.75) + 1e-9, 6) + 0.0 AS p75, round(max({c}) + 1e-9, 6) + 0.0 AS max, "
    f"CAST(sum(inf_{c}) AS BIGINT) AS n_inf FROM ({DIRTY_FINITE})" for c in DIRTY_COLS))
def q_profile_describe_dirty(spark, sf):
    """Infinite and missing values are left out and counted."""
    return profile.profile_describe(T.dirty_flows(spark, sf), DIRTY_COLS)


@query("profile_ranges_dirty", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(min({c}) + 1e-9, 6) + 0.0 AS min, round(max({c}) + 1e-9, 6) + 0.0 AS max, "
    f"round(max({c}) - min({c}) + 1e-9, 6) + 0.0 AS range, round(stddev_samp({c}) + 1e-9, 6) + 0.0 AS std FROM ({DIRTY_FINITE})"
    for c in DIRTY_COLS))
def q_profile_ranges_dirty(spark, sf):
    return profile.profile_ranges(T.dirty_flows(spark, sf), DIRTY_COLS)


@query("correlation_dirty", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}) + 1e-9, 6) + 0.0 AS corr FROM ({DIRTY_FINITE})"
    for i, a in enumerate(DIRTY_COLS) for b in DIRTY_COLS[i + 1:]))
def q_correlation_dirty(spark, sf):
    return profile.correlation_pairs(T.dirty_flows(spark, sf), DIRTY_COLS)


@query("profile_ranges", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(min({c}) + 1e-9, 6) + 0.0 AS min, round(max({c}) + 1e-9, 6) + 0.0 AS max, "
    f"round(max({c}) - min({c}) + 1e-9, 6) + 0.0 AS range, round(stddev_samp({c}) + 1e-9, 6) + 0.0 AS std FROM lineitem"
    for c in WIDE_COLS))
def q_profile_ranges(spark, sf):
    return profile.profile_ranges(T.wide_numeric(spark, sf), WIDE_COLS)


@query("top_variance", "SELECT \"column\", round(variance + 1e-9, 6) + 0.0 AS variance FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM lineitem" for c in WIDE_COLS) +
    ") ORDER BY variance DESC, \"column\" LIMIT 3")
def q_top_variance(spark, sf):
    return profile.top_variance(T.wide_numeric(spark, sf), 3, WIDE_COLS)


CORR_RAW = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM lineitem"
                              for i, a in enumerate(WIDE_COLS) for b in WIDE_COLS[i + 1:])


@query("correlation_pairs", f"SELECT col_a, col_b, round(corr + 1e-9, 6) + 0.0 AS corr FROM ({CORR_RAW})")
def q_correlation_pairs(spark, sf):
    return profile.correlation_pairs(T.wide_numeric(spark, sf), WIDE_COLS)


@query("max_correlation", "SELECT round(max(corr) + 1e-9, 6) + 0.0 AS max_corr, round(max(abs(corr)) + 1e-9, 6) + 0.0 AS max_abs_corr, "
                          f"CAST(count_if(abs(corr) > 0.9) AS BIGINT) AS n_high_pairs FROM ({CORR_RAW})")
def q_max_correlation(spark, sf):
    return profile.max_correlation(profile.correlation_pairs(T.wide_numeric(spark, sf), WIDE_COLS))


@query("profile_summary", f"SELECT n_rows, 4 AS n_features, 3 AS n_numeric, CAST(n_missing AS BIGINT) AS n_missing, n_duplicates, n_inf, n_classes FROM "
       f"(SELECT count(*) AS n_rows, count_if(ts IS NULL) + count_if(label IS NULL) + count_if(value IS NULL) + "
       f"count_if(user_id IS NULL) + CAST(count_if(k IS NULL) AS BIGINT) AS n_missing, CAST(count_if(abs(value) = CAST('inf' AS DOUBLE)) AS BIGINT) AS n_inf, "
       f"count(DISTINCT label) AS n_classes FROM ({T.DIRTY_DUP_SQL})), "
       f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({T.DIRTY_DUP_SQL}))) AS n_duplicates "
       f"FROM ({T.DIRTY_DUP_SQL}))")
def q_profile_summary(spark, sf):
    return profile.profile_summary(T.dirty_dup_flows(spark, sf), "label")


# ---------------------------------------------------------------------------------------------
# remaining partition diagnostics (H1-H3, H6, H7) on binary-labelled IID clients
BIN_IID = S.iid_sql(BIN)


def bin_iid(spark, sf):
    return partition.partition_iid(T.binary_flows(spark, sf), "event_id", n_clients=5)


@query("client_sizes", f"SELECT client_id, count(*) AS n_samples FROM ({FAMILY}) GROUP BY 1")
def q_client_sizes(spark, sf):
    return hetero.client_sizes(family_flows(spark, sf))


@query("client_label_balance", "SELECT client_id, count(*) AS total, CAST(count_if(label_bin = 1) AS BIGINT) AS positive, "
       "CAST(count_if(label_bin = 0) AS BIGINT) AS negative, round(count_if(label_bin = 1) * 100.0 / count(*) + 1e-9, 6) + 0.0 AS positive_pct "
       f"FROM ({BIN_IID}) GROUP BY 1")
def q_client_label_balance(spark, sf):
    return hetero.client_label_balance(bin_iid(spark, sf), "client_id", "label_bin")


@query("client_label_dist", "WITH c AS (SELECT client_id, label, count(*) AS n FROM (" + FAMILY + ") GROUP BY ALL), "
       "labs AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM "
       "(SELECT DISTINCT label FROM c)), cl AS (SELECT client_id, sum(n) AS tot FROM c GROUP BY 1) "
       "SELECT cl.client_id, labs.label, labs.label_idx, round(coalesce(c.n, 0) * 1.0 / cl.tot + 1e-9, 6) + 0.0 AS share "
       "FROM cl CROSS JOIN labs LEFT JOIN c ON c.client_id = cl.client_id AND c.label = labs.label")
def q_client_label_dist(spark, sf):
    return hetero.client_label_dist(family_flows(spark, sf))


IMB_RAW = ("SELECT client_id, CAST(count_if(label_bin = 1) AS BIGINT) AS positive, CAST(count_if(label_bin = 0) AS BIGINT) AS negative, "
           "CASE WHEN count_if(label_bin = 0) > 0 THEN count_if(label_bin = 1) / (count_if(label_bin = 0) + 1e-10) "
           f"ELSE CAST('inf' AS DOUBLE) END AS imbalance FROM ({BIN_IID}) GROUP BY 1")


@query("client_imbalance", f"SELECT client_id, positive, negative, round(imbalance + 1e-9, 6) + 0.0 AS imbalance FROM ({IMB_RAW})")
def q_client_imbalance(spark, sf):
    return hetero.client_imbalance(bin_iid(spark, sf), "client_id", "label_bin")


@query("imbalance_stats", f"SELECT round(avg(imbalance) + 1e-9, 6) + 0.0 AS mean_imbalance, "
                          f"round(stddev_pop(imbalance) + 1e-9, 6) + 0.0 AS std_imbalance FROM ({IMB_RAW})")
def q_imbalance_stats(spark, sf):
    return hetero.imbalance_stats(hetero.client_imbalance(bin_iid(spark, sf), "client_id", "label_bin"))


@query("partition_totals", "SELECT count(DISTINCT client_id) AS n_clients, count(*) AS n_samples, "
       "CAST(count_if(label_bin = 1) AS BIGINT) AS positive, CAST(count_if(label_bin = 0) AS BIGINT) AS negative, "
       "round(count_if(label_bin = 1) * 100.0 / count(*) + 1e-9, 6) + 0.0 AS positive_pct, "
       f"round(count_if(label_bin = 0) * 100.0 / count(*) + 1e-9, 6) + 0.0 AS negative_pct FROM ({BIN_IID})")
def q_partition_totals(spark, sf):
    return hetero.partition_totals(bin_iid(spark, sf), "client_id", "label_bin")


# ---------------------------------------------------------------------------------------------
# evaluation
from ..operators import metrics as M  # noqa: E402

MC = T.MC_PRED_SQL
BP = T.binary_predictions_sql(True)
BPU = T.binary_predictions_sql(False)
LG = T.LOGITS_SQL
LG_PRED = (f"SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS y_pred, "
           f"{S.lse_sql('logits')} - logits[y_true + 1] AS ce FROM ({LG})")


@query("binary_confusion", f"SELECT CAST(count_if(y_pred = 1 AND y_true = 1) AS BIGINT) AS tp, CAST(count_if(y_pred = 0 AND y_true = 0) AS BIGINT) AS tn, "
       f"CAST(count_if(y_pred = 1 AND y_true = 0) AS BIGINT) AS fp, CAST(count_if(y_pred = 0 AND y_true = 1) AS BIGINT) AS fn, count(*) AS total_samples "
       f"FROM ({BP})")
def q_binary_confusion(spark, sf):
    return M.binary_confusion(T.binary_predictions(spark, sf)).drop("_correct")


@query("binary_metrics", f"""
WITH c AS (SELECT CAST(count_if(y_pred = 1 AND y_true = 1) AS BIGINT) AS tp, CAST(count_if(y_pred = 0 AND y_true = 0) AS BIGINT) AS tn,
  CAST(count_if(y_pred = 1 AND y_true = 0) AS BIGINT) AS fp, CAST(count_if(y_pred = 0 AND y_true = 1) AS BIGINT) AS fn, count(*) AS total_samples,
  CAST(count_if(y_pred = y_true) AS BIGINT) AS correct FROM ({BP})),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT round(correct / total_samples + 1e-9, 6) + 0.0 AS accuracy, round(p + 1e-9, 6) + 0.0 AS precision, round(r + 1e-9, 6) + 0.0 AS recall,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END + 1e-9, 6) + 0.0 AS specificity,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END + 1e-9, 6) + 0.0 AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END + 1e-9, 6) + 0.0 AS fpr,
  round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END + 1e-9, 6) + 0.0 AS fnr, tp, tn, fp, fn, total_samples FROM m""")
def q_binary_metrics(spark, sf):
    return M.binary_metrics(T.binary_predictions(spark, sf))


@query("auc_roc_ties", S.auc_sql(BP))
def q_auc_roc_ties(spark, sf):
    return M.auc_roc(T.binary_predictions(spark, sf, tied=True))


@query("auc_roc", S.auc_sql(BPU))
def q_auc_roc(spark, sf):
    return M.auc_roc(T.binary_predictions(spark, sf, tied=False))


def _pc_out(sql, group=None):
    g = f"{group}, " if group else ""
    return (f"SELECT {g}CAST(class AS INTEGER) AS class, round(precision + 1e-9, 6) + 0.0 AS precision, "
            f"round(recall + 1e-9, 6) + 0.0 AS recall, round(f1 + 1e-9, 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM ({sql})")


@query("per_class_true", _pc_out(S.pc_sql(MC, union=False)))
def q_per_class_true(spark, sf):
    return M.per_class_true(T.multiclass_predictions(spark, sf))


@query("per_class_union", f"SELECT x.*, l.label AS class_name FROM ({_pc_out(S.pc_sql(MC))}) x LEFT JOIN "
       f"(SELECT DISTINCT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM ({S.FLOWS})) l "
       "ON l.label_id = x.class")
def q_per_class_union(spark, sf):
    _, lm = clean.label_encode(T.flows(spark, sf), "label")
    return M.per_class_union(T.multiclass_predictions(spark, sf), label_map=lm)


@query("macro_metrics", "SELECT round(macro_precision + 1e-9, 6) + 0.0 AS macro_precision, round(macro_recall + 1e-9, 6) + 0.0 AS "
       f"macro_recall, round(macro_f1 + 1e-9, 6) + 0.0 AS macro_f1 FROM ({S.av_sql(S.pc_sql(MC))})")
def q_macro_metrics(spark, sf):
    return M.macro_metrics(T.multiclass_predictions(spark, sf))


@query("weighted_metrics", "SELECT round(weighted_precision + 1e-9, 6) + 0.0 AS weighted_precision, round(weighted_recall + 1e-9, 6) + 0.0 "
       f"AS weighted_recall, round(weighted_f1 + 1e-9, 6) + 0.0 AS weighted_f1 FROM ({S.av_sql(S.pc_sql(MC))})")
def q_weighted_metrics(spark, sf):
    return M.weighted_metrics(T.multiclass_predictions(spark, sf))


@query("accuracy", f"SELECT round(avg(CAST(y_true = y_pred AS DOUBLE)) + 1e-9, 6) + 0.0 AS accuracy, count(*) AS n FROM ({MC})")
def q_accuracy(spark, sf):
    return M.accuracy(T.multiclass_predictions(spark, sf))


CM_SQL = (f"WITH c AS (SELECT y_true, y_pred, count(*) AS n FROM ({MC}) GROUP BY ALL), "
          "l AS (SELECT y_true AS v FROM c UNION SELECT y_pred FROM c) "
          "SELECT CAST(a.v AS INTEGER) AS y_true, CAST(b.v AS INTEGER) AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n "
          "FROM l a CROSS JOIN l b LEFT JOIN c ON c.y_true = a.v AND c.y_pred = b.v")


@query("confusion_long", CM_SQL)
def q_confusion_long(spark, sf):
    return M.confusion_long(T.multiclass_predictions(spark, sf))


@query("confusion_pivot", "SELECT y_true, " + ", ".join(f"CAST(sum(CASE WHEN y_pred = {k} THEN n END) AS BIGINT) AS pred_{k}" for k in range(5))
       + f" FROM ({CM_SQL}) GROUP BY y_true")
def q_confusion_pivot(spark, sf):
    return M.confusion_pivot(T.multiclass_predictions(spark, sf))


@query("softmax", f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, round(exp(logits[i] - list_max(logits)) / "
       f"list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) + 1e-9, 6) + 0.0 AS proba "
       f"FROM (SELECT *, unnest(range(1, len(logits) + 1)) AS i FROM ({LG}))")
def q_softmax(spark, sf):
    lg = T.logits(spark, sf)
    return lg.select("vec_id", F.posexplode(M.softmax(F.col("logits"))).alias("idx", "proba")).select(
        "vec_id", F.col("idx").cast("int").alias("idx"), S_r6("proba").alias("proba"))


def S_r6(c):
    from ..functions.exprs import r6
    return r6(c)


@query("argmax_class", f"SELECT vec_id, y_pred FROM ({LG_PRED})")
def q_argmax_class(spark, sf):
    return T.logits(spark, sf).select("vec_id", M.argmax(F.col("logits")).alias("y_pred"))


@query("cross_entropy", f"SELECT round(avg(ce) + 1e-9, 6) + 0.0 AS loss, count(*) AS n FROM ({LG_PRED})")
def q_cross_entropy(spark, sf):
    return M.cross_entropy(T.logits(spark, sf))


PROBA = (f"SELECT list_transform(logits, lambda x: exp(x - list_max(logits)) / "
         f"list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) AS p FROM ({LG})")


@query("proba_stats", "SELECT round(max(list_max(p)) + 1e-9, 6) + 0.0 AS max_proba, round(min(list_min(p)) + 1e-9, 6) + 0.0 AS min_proba, "
       "round(sum(list_sum(p)) / sum(len(p)) + 1e-9, 6) + 0.0 AS mean_proba, round(avg(list_sum(p)) + 1e-9, 6) + 0.0 AS mean_row_sum, "
       "round(max(abs(list_sum(p) - 1.0)) + 1e-9, 6) + 0.0 AS max_row_sum_error, round(avg(list_max(p)) + 1e-9, 6) + 0.0 AS mean_confidence "
       f"FROM ({PROBA})")
def q_proba_stats(spark, sf):
    return M.proba_stats(T.logits(spark, sf))


def _scored_logits(spark, sf):
    lg = T.logits(spark, sf)
    return lg.withColumn("y_pred", M.argmax(F.col("logits")))


@query("client_eval", S.eval_sql(LG_PRED, "client_id", loss=True))
def q_client_eval(spark, sf):
    return M.client_eval(_scored_logits(spark, sf), logits="logits")


@query("round_eval", f"SELECT CAST(client_id AS INTEGER) AS client_id, metric, value, 'client' AS scope FROM "
       f"({S.eval_sql(LG_PRED, 'client_id', loss=True)}) UNION ALL SELECT CAST(NULL AS INTEGER) AS client_id, metric, value, "
       f"'global' AS scope FROM ({S.eval_sql(LG_PRED, None, loss=True)})")
def q_round_eval(spark, sf):
    return M.round_eval(_scored_logits(spark, sf), logits="logits")


@query("eval_report", f"SELECT 'metrics' AS section, metric AS name, value FROM ({S.eval_sql(MC)}) UNION ALL "
       f"SELECT 'confusion' AS section, 'cm_' || CAST(y_true AS VARCHAR) || '_' || CAST(y_pred AS VARCHAR) AS name, "
       f"CAST(n AS DOUBLE) AS value FROM ({CM_SQL}) UNION ALL SELECT 'support' AS section, "
       f"'support_class_' || CAST(class AS VARCHAR) AS name, CAST(support AS DOUBLE) AS value FROM ({S.pc_sql(MC)})")
def q_eval_report(spark, sf):
    return M.eval_report(T.multiclass_predictions(spark, sf))


# ---------------------------------------------------------------------------------------------
# parameter aggregation (M5-M10, M12, M13) and privacy ledger
from ..functions.exprs import r6  # noqa: E402
from ..functions.exprs import materialize  # noqa: E402
from ..operators import blocks  # noqa: E402
from ..operators import params as PM  # noqa: E402
from ..operators import privacy  # noqa: E402

UPD = T.UPDATES_SQL
FEDAVG_SQL = f"SELECT round, tensor, idx, sum(num_examples * value) / sum(num_examples) AS value FROM ({UPD}) GROUP BY ALL"
GLOBAL_SQL = (f"SELECT c.round, c.tensor, c.idx, coalesce(p.value, 0.0) AS value FROM (SELECT DISTINCT round, tensor, idx "
              f"FROM ({UPD})) c LEFT JOIN (SELECT round + 1 AS round, tensor, idx, value FROM ({FEDAVG_SQL})) p "
              "USING (round, tensor, idx)")
UG_SQL = f"SELECT u.*, g.value AS w_g FROM ({UPD}) u JOIN ({GLOBAL_SQL}) g USING (round, tensor, idx)"


def _r6_value(df, col="value"):
    return df.withColumn(col, r6(col))


@query("param_explode", f"SELECT round, client_id, tensor, idx, value FROM ({UPD})")
def q_param_explode(spark, sf):
    return T.client_updates(spark, sf).select("round", "client_id", "tensor", "idx", "value")


@query("param_count", f"SELECT tensor, count(DISTINCT idx) AS numel, count(*) AS n_values FROM ({UPD}) GROUP BY tensor")
def q_param_count(spark, sf):
    return PM.param_count(T.client_updates(spark, sf))


@query("fedavg", f"SELECT round, tensor, idx, round(value + 1e-9, 6) + 0.0 AS value FROM ({FEDAVG_SQL})")
def q_fedavg(spark, sf):
    return _r6_value(blocks.exploded(PM.fedavg(T.client_updates(spark, sf, blocked=True)), PM.BY))


def _upd_global(spark, sf):
    u = T.client_updates(spark, sf, blocked=True)
    return u, PM.previous_round_global(u)


@query("fedprox_penalty", f"SELECT round, client_id, round(0.005 * sum(pow(value - w_g, 2)) + 1e-9, 6) + 0.0 AS penalty "
                          f"FROM ({UG_SQL}) GROUP BY ALL")
def q_fedprox_penalty(spark, sf):
    u, g = _upd_global(spark, sf)
    return _r6_value(PM.fedprox_penalty(u, g, mu=0.01), "penalty")


@query("fednova", f"""
WITH r AS (SELECT round, CAST(sum(num_examples) AS DOUBLE) AS nn, CAST(sum(num_examples * tau) AS DOUBLE) AS nt
           FROM (SELECT DISTINCT round, client_id, num_examples, tau FROM ({UPD})) GROUP BY round),
s AS (SELECT round, tensor, idx, first(w_g) AS w_g, sum(num_examples * (w_g - value) / tau) AS ss FROM ({UG_SQL}) GROUP BY ALL)
SELECT round, tensor, idx, round(w_g - (nt / nn) * (ss / nn) + 1e-9, 6) + 0.0 AS value FROM s JOIN r USING (round)""")
def q_fednova(spark, sf):
    u, g = _upd_global(spark, sf)
    return _r6_value(blocks.exploded(PM.fednova(u, g), PM.BY))


DELTA_SQL = (f"SELECT a.round, a.tensor, a.idx, a.value - g.value AS value FROM ({FEDAVG_SQL}) a "
             f"JOIN ({GLOBAL_SQL}) g USING (round, tensor, idx)")


@query("server_momentum", f"SELECT t.round, t.tensor, t.idx, round(sum(pow(0.9, t.round - s.round) * s.value) + 1e-9, 6) + 0.0 "
       f"AS velocity FROM ({DELTA_SQL}) t JOIN ({DELTA_SQL}) s ON s.tensor = t.tensor AND s.idx = t.idx AND s.round <= t.round "
       "GROUP BY ALL")
def q_server_momentum(spark, sf):
    u, g = _upd_global(spark, sf)
    key = ["round", "tensor", "block"]
    d = PM.fedavg(u).join(g.withColumnRenamed("values", "_g"), key).select(*key, blocks.plus("values", "_g", -1.0).alias("values"))
    v = PM.server_momentum(d, 0.9).withColumnRenamed("velocity", "values")
    return _r6_value(blocks.exploded(v, PM.BY, value="velocity"), "velocity")


def _clip_sql(per_tensor: bool, C: float = 0.5):
    grp = "round, client_id" + (", tensor" if per_tensor else "")
    return (f"WITH u AS (SELECT *, value - w_g AS delta FROM ({UG_SQL})), "
            f"nrm AS (SELECT {grp}, sqrt(sum(delta * delta)) AS nm FROM u GROUP BY ALL) "
            f"SELECT u.round, u.client_id, u.num_examples, u.tensor, u.idx, u.w_g, "
            f"u.delta * least(1.0, {C} / (nrm.nm + 1e-10)) AS delta FROM u JOIN nrm USING ({grp})")


for _pt, _nm in [(False, "dp_clip_flat"), (True, "dp_clip_per_tensor")]:
    def _mk(pt):
        def fn(spark, sf):
            u, g = _upd_global(spark, sf)
            c = PM.dp_clip(u, g, 0.5, "per_tensor" if pt else "flat").withColumnRenamed("delta", "values")
            return _r6_value(blocks.exploded(c, ["round", "client_id"], value="delta"), "delta")
        return fn
    query(_nm, f"SELECT round, client_id, tensor, idx, round(delta + 1e-9, 6) + 0.0 AS delta FROM ({_clip_sql(_pt)})")(_mk(_pt))


GAUSS_SQL = ("sqrt(-2 * ln(((('0x' || substr(hh, 1, 8))::UBIGINT + 0.5) / 4294967296.0))) * "
             "cos(2 * pi() * ((('0x' || substr(hh, 9, 8))::UBIGINT + 0.5) / 4294967296.0))")


@query("dp_noise_fixed_seed", f"""
WITH c AS ({_clip_sql(False)}), m AS (SELECT round, count(DISTINCT client_id) AS mm FROM c GROUP BY round),
s AS (SELECT round, tensor, idx, first(w_g) AS w_g, sum(delta) AS sd,
      md5(concat_ws(':', '7', CAST(round AS VARCHAR), tensor, CAST(idx AS VARCHAR))) AS hh FROM c GROUP BY round, tensor, idx)
SELECT round, tensor, idx, round(w_g + (sd + 0.5 * {GAUSS_SQL}) / mm + 1e-9, 6) + 0.0 AS value FROM s JOIN m USING (round)""")
def q_dp_noise_fixed_seed(spark, sf):
    u, g = _upd_global(spark, sf)
    return _r6_value(blocks.exploded(PM.dp_fedavg(u, g, clip_norm=0.5, noise_multiplier=1.0, secret=7), PM.BY))


CM_ = T.CLIENT_METRICS_SQL


@query("weighted_client_metrics", f"SELECT s.round, s.metric, round(s.sv / t.tot + 1e-9, 6) + 0.0 AS value FROM "
       f"(SELECT round, metric, sum(n * value) AS sv FROM ({CM_}) GROUP BY ALL) s JOIN "
       f"(SELECT round, CAST(sum(n) AS DOUBLE) AS tot FROM (SELECT DISTINCT round, client_id, n FROM ({CM_})) GROUP BY round) t "
       "USING (round)")
def q_weighted_client_metrics(spark, sf):
    return _r6_value(PM.weighted_client_metrics(T.client_metrics(spark, sf), "zero"))


@query("weighted_client_metrics_skip_missing", f"SELECT round, metric, round(sum(n * value) / sum(n) + 1e-9, 6) + 0.0 AS value "
       f"FROM ({CM_}) GROUP BY ALL")
def q_weighted_client_metrics_skip(spark, sf):
    return _r6_value(PM.weighted_client_metrics(T.client_metrics(spark, sf), "skip"))


LEDGER_SQL = f"""
WITH r AS ({T.PRIVACY_ROUNDS_SQL}),
a AS (SELECT r.*, alpha FROM r, range(2, {privacy.MAX_ORDER + 1}) t(alpha)),
k AS (SELECT a.*, unnest(range(0, alpha + 1)) AS kk FROM a),
t AS (SELECT *, lgamma(alpha + 1) - lgamma(kk + 1) - lgamma(alpha - kk + 1) + (alpha - kk) * ln(1 - sample_rate)
        + kk * ln(sample_rate) + kk * (kk - 1) / (2.0 * noise_multiplier * noise_multiplier) AS term FROM k),
m AS (SELECT *, max(term) OVER (PARTITION BY experiment, round, alpha) AS mx FROM t),
rd AS (SELECT experiment, round, sample_rate, noise_multiplier, alpha,
        (max(mx) + ln(sum(exp(term - mx)))) / (alpha - 1) AS rdp FROM m
        GROUP BY experiment, round, sample_rate, noise_multiplier, alpha),
c AS (SELECT *, sum(rdp) OVER (PARTITION BY experiment, alpha ORDER BY round ROWS UNBOUNDED PRECEDING) AS cum,
        ln((alpha - 1.0) / alpha) - (ln(1e-5) + ln(alpha)) / (alpha - 1) AS conv FROM rd)
SELECT experiment, round, sample_rate, noise_multiplier, min(rdp + conv) AS epsilon_round, min(cum + conv) AS epsilon
FROM c GROUP BY ALL"""


@query("privacy_ledger", "SELECT experiment, round, sample_rate, noise_multiplier, round(epsilon_round + 1e-9, 6) + 0.0 AS epsilon_round, "
                         f"round(epsilon + 1e-9, 6) + 0.0 AS epsilon FROM ({LEDGER_SQL})")
def q_privacy_ledger(spark, sf):
    return privacy.privacy_ledger(T.privacy_rounds(spark, sf))


# ---------------------------------------------------------------------------------------------
# run-history analytics
from ..operators import history as H  # noqa: E402

RH = T.RUN_HISTORY_SQL
LV = f"SELECT experiment, strategy, metric, arg_max(value, round) AS value, max(round) AS round FROM ({RH}) GROUP BY ALL"


@query("final_metrics", None)
def q_final_metrics(spark, sf):
    return H.final_metrics(T.run_history(spark, sf))


ORACLE["final_metrics"] = (
    f"WITH lv AS ({LV}), r AS (SELECT experiment, strategy, count(DISTINCT round) AS n_rounds FROM ({RH}) GROUP BY ALL) "
    "SELECT r.experiment, r.strategy, r.n_rounds, " + ", ".join(
        f"round(coalesce(max(CASE WHEN lv.metric = '{m}' THEN lv.value END), 0.0) + 1e-9, 6) + 0.0 AS final_{m}"
        for m in H.FINAL_METRICS) +
    " FROM r LEFT JOIN lv USING (experiment) GROUP BY r.experiment, r.strategy, r.n_rounds")


@query("compare_strategies", f"SELECT strategy, " + ", ".join(
    f"round(coalesce(max(CASE WHEN metric = '{m}' THEN value END), 0.0) + 1e-9, 6) + 0.0 AS {m}"
    for m in ["accuracy", "f1", "auc_roc"]) + f" FROM ({LV}) GROUP BY strategy")
def q_compare_strategies(spark, sf):
    return H.compare_strategies(T.run_history(spark, sf))


CMP_METRICS = ["accuracy", "loss", "n"]


@query("comparison_table", "SELECT strategy, " + ", ".join(
    f"round(max(CASE WHEN metric = '{m}' THEN value END) + 1e-9, 6) + 0.0 AS {m}" for m in CMP_METRICS) +
    f" FROM ({LV}) GROUP BY strategy")
def q_comparison_table(spark, sf):
    return H.comparison_table(T.run_history(spark, sf), CMP_METRICS)


@query("best_by_metric", "SELECT metric, strategy AS best_strategy, round(value + 1e-9, 6) + 0.0 AS value FROM (SELECT *, "
       "row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('loss', 'fpr', 'fnr', 'epsilon') THEN value ELSE -value END, "
       f"strategy) AS rk FROM ({LV})) WHERE rk = 1")
def q_best_by_metric(spark, sf):
    return H.best_by_metric(T.run_history(spark, sf))


@query("improvement_vs_baseline", f"SELECT l.strategy, l.metric, round((l.value - b.value) / nullif(abs(b.value), 0) * 100.0 + 1e-9, 6) + 0.0 "
       f"AS improvement_pct FROM ({LV}) l JOIN (SELECT metric, value FROM ({LV}) WHERE strategy = 'baseline') b USING (metric) "
       "WHERE l.strategy <> 'baseline'")
def q_improvement_vs_baseline(spark, sf):
    return H.improvement_vs_baseline(T.run_history(spark, sf))


@query("history_long", f"SELECT strategy, CAST(rk AS INTEGER) AS round, metric, round(value + 1e-9, 6) + 0.0 AS value FROM "
       f"(SELECT strategy, metric, value, row_number() OVER (PARTITION BY strategy, metric ORDER BY round) AS rk FROM ({RH}))")
def q_history_long(spark, sf):
    return H.history_long(H.history_arrays(T.run_history(spark, sf)))


@query("convergence_stats", "SELECT strategy, metric, round(a + 1e-9, 6) + 0.0 AS first_value, round(z + 1e-9, 6) + 0.0 AS last_value, "
       "round(CASE WHEN metric IN ('loss', 'fpr') THEN a - z ELSE z - a END / nullif(abs(a), 0) * 100.0 + 1e-9, 6) + 0.0 AS improvement_pct "
       f"FROM (SELECT strategy, metric, arg_min(value, round) AS a, arg_max(value, round) AS z FROM ({RH}) GROUP BY ALL)")
def q_convergence_stats(spark, sf):
    return H.convergence_stats(T.run_history(spark, sf))


WCM_SQL = ORACLE["weighted_client_metrics"]


@query("client_performance", f"SELECT c.round, round(max(c.value) + 1e-9, 6) + 0.0 AS best, round(min(c.value) + 1e-9, 6) + 0.0 AS worst, "
       "round(avg(c.value) + 1e-9, 6) + 0.0 AS mean, round(var_pop(c.value) + 1e-9, 6) + 0.0 AS variance, "
       f"CAST(count_if(c.value > g.value) AS BIGINT) AS n_above_global FROM ({CM_}) c JOIN (SELECT round, value FROM "
       f"(SELECT s.round, s.metric, s.sv / t.tot AS value FROM (SELECT round, metric, sum(n * value) AS sv FROM ({CM_}) "
       f"GROUP BY ALL) s JOIN (SELECT round, CAST(sum(n) AS DOUBLE) AS tot FROM (SELECT DISTINCT round, client_id, n "
       f"FROM ({CM_})) GROUP BY round) t USING (round)) WHERE metric = 'accuracy') g USING (round) "
       "WHERE c.metric = 'accuracy' GROUP BY c.round")
def q_client_performance(spark, sf):
    cm = T.client_metrics(spark, sf)
    return H.client_performance(cm, PM.weighted_client_metrics(cm, "zero"))


@query("radar_rows", f"""
WITH c AS (SELECT l_linestatus AS grp, CAST(count_if(y_pred = 1 AND y_true = 1) AS BIGINT) AS tp, CAST(count_if(y_pred = 0 AND y_true = 0) AS BIGINT) AS tn,
  CAST(count_if(y_pred = 1 AND y_true = 0) AS BIGINT) AS fp, CAST(count_if(y_pred = 0 AND y_true = 1) AS BIGINT) AS fn, count(*) AS total,
  CAST(count_if(y_pred = y_true) AS BIGINT) AS correct FROM (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
  CAST(l_discount * 10 > 0.5 AS INTEGER) AS y_pred FROM lineitem) GROUP BY ALL),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT grp AS l_linestatus, round(correct / total + 1e-9, 6) + 0.0 AS accuracy, round(p + 1e-9, 6) + 0.0 AS precision, round(r + 1e-9, 6) + 0.0 AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END + 1e-9, 6) + 0.0 AS f1,
  round(1.0 - CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END + 1e-9, 6) + 0.0 AS specificity FROM m""")
def q_radar_rows(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_discount") * 10 > 0.5).cast("int").alias("y_pred"))
    return H.radar_rows(binary_metrics_by(li, "l_linestatus"), "l_linestatus")


def binary_metrics_by(df, group_col):
    """binary_metrics per group value (one aggregate grouped by ``group_col``)."""
    from ..functions.exprs import f1_of, safe_ratio
    t, p = F.col("y_true"), F.col("y_pred")
    c = df.groupBy(group_col).agg(F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 0) & (t == 0)).alias("tn"),
                                  F.count_if((p == 1) & (t == 0)).alias("fp"), F.count_if((p == 0) & (t == 1)).alias("fn"),
                                  F.count(F.lit(1)).alias("total"), F.count_if(p == t).alias("correct"))
    prec = safe_ratio("tp", F.col("tp") + F.col("fp"))
    rec = safe_ratio("tp", F.col("tp") + F.col("fn"))
    return c.select(group_col, safe_ratio("correct", "total").alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1_of(prec, rec).alias("f1"),
                    safe_ratio("fp", F.col("fp") + F.col("tn")).alias("fpr"))


@query("privacy_utility", f"SELECT e.experiment, round(e.epsilon + 1e-9, 6) + 0.0 AS epsilon, round(a.value + 1e-9, 6) + 0.0 AS accuracy "
       f"FROM (SELECT experiment, arg_max(epsilon, round) AS epsilon FROM ({LEDGER_SQL}) GROUP BY ALL) e JOIN "
       f"(SELECT experiment, value FROM ({LV}) WHERE metric = 'accuracy') a USING (experiment)")
def q_privacy_utility(spark, sf):
    return H.privacy_utility(privacy.privacy_ledger(T.privacy_rounds(spark, sf)), T.run_history(spark, sf))


@query("last_rounds", f"SELECT experiment, strategy, round, metric, round(value + 1e-9, 6) + 0.0 AS value FROM (SELECT *, "
       f"row_number() OVER (PARTITION BY experiment, metric ORDER BY round DESC) AS rk FROM ({RH})) WHERE rk <= 5")
def q_last_rounds(spark, sf):
    return H.last_rounds(T.run_history(spark, sf), 5)


@query("label_map_roundtrip", f"SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM "
                              f"(SELECT DISTINCT label FROM ({S.FLOWS}))")
def q_label_map_roundtrip(spark, sf):
    """The map of the labels, found under another name of their column, written as a document and read again."""
    df = T.flows(spark, sf).withColumnRenamed("label", "Attack_Type")
    path = staging_dir(spark, "label-map")
    sinks.write_label_map(clean.label_map(df, clean.resolve_label_column(df)), path)
    return sinks.read_label_map(spark, path)


@query("metrics_roundtrip", f"SELECT experiment, metric, round(value + 1e-9, 6) + 0.0 AS value FROM ({LV})")
def q_metrics_roundtrip(spark, sf):
    """The last metrics of every experiment, a document each, read again."""
    path, h = staging_dir(spark, "metrics"), T.run_history(spark, sf)
    last = h.groupBy("experiment", "metric").agg(F.max_by("value", "round").alias("value"))
    sinks.save_metrics(last, path, ["experiment"])
    return sinks.read_metrics(spark, path, "experiment string")


@query("summary_roundtrip", "")
def q_summary_roundtrip(spark, sf):
    """The comparison table, with what strategies lack, written and read again."""
    path, t = staging_dir(spark, "summary"), H.comparison_table(T.run_history(spark, sf), CMP_METRICS)
    sinks.write_summary(t, path)
    return sinks.read_summary(spark, path, t.schema)


ORACLE["summary_roundtrip"] = ORACLE["comparison_table"]


@query("results_roundtrip", "")
def q_results_roundtrip(spark, sf):
    """Nested results written as JSON, one folder a run, and read again with their schema."""
    path, res = staging_dir(spark, "results"), H.experiment_results(T.run_history(spark, sf), {"num_clients": 5})
    sinks.save_results(res, path)
    return H.strategy_report(sinks.read_results(spark, [path, path + "-not-there"], res.schema))


@query("strategy_report", f"""
WITH per AS (SELECT experiment, strategy, round, max(CASE WHEN metric = 'loss' THEN value END) AS loss,
  max(CASE WHEN metric = 'accuracy' THEN value END) AS accuracy FROM ({RH}) GROUP BY ALL),
b AS (SELECT experiment, arg_max(round, coalesce(accuracy, 0.0)) AS best_round, max(coalesce(accuracy, 0.0)) AS best_accuracy,
  min(round) AS first_round FROM per GROUP BY experiment)
SELECT p.experiment AS experiment_name, p.strategy, CAST(count(*) AS INTEGER) AS num_rounds,
  round(coalesce(arg_max(p.loss, p.round), 0.0) + 1e-9, 6) + 0.0 AS final_loss,
  round(coalesce(arg_max(p.accuracy, p.round), 0.0) + 1e-9, 6) + 0.0 AS final_accuracy,
  min(CASE WHEN coalesce(p.accuracy, 0.0) = b.best_accuracy THEN p.round END) AS best_round,
  round(max(b.best_accuracy) + 1e-9, 6) + 0.0 AS best_accuracy
FROM per p JOIN b USING (experiment) GROUP BY p.experiment, p.strategy""")
def q_strategy_report(spark, sf):
    return H.strategy_report(H.experiment_results(T.run_history(spark, sf), {"num_clients": 5}))


ORACLE["results_roundtrip"] = ORACLE["strategy_report"]


# ---------------------------------------------------------------------------------------------
# training (M1-M4, M14-M17): rows-only except the linear scoring / closed-form step
from ..operators import train as TR  # noqa: E402
from . import federated as FED  # noqa: E402


def emb_clients(spark, sf, n=5):
    e = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"),
                                                F.col("label").cast("int").alias("label"))
    c = partition.partition_iid(e, "vec_id", n_clients=n)
    return partition.client_train_val(c, "vec_id")


@query("local_train", None)
def q_local_train(spark, sf):
    d = emb_clients(spark, sf)
    model = TR.init_model(TR.layer_dims(64, 10, ()), 42)
    p = TR.local_train(d.where("split = 'train'"), model, "vec_id", epochs=2, batch_size=32, lr=0.01)
    return TR.combine_shards(p)


# first Adam step from zero weights on all rows of a client: W -= lr * g / (|g| + 1e-8)
FIRST_STEP_SQL = """
WITH x AS (SELECT vec_id % 5 AS c, label, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
kk AS (SELECT DISTINCT label AS k FROM embeddings),
n AS (SELECT vec_id % 5 AS c, count(*) AS n FROM embeddings GROUP BY 1),
nk AS (SELECT vec_id % 5 AS c, label AS k, count(*) AS nk FROM embeddings GROUP BY ALL),
s AS (SELECT c, j, sum(v) AS s FROM x GROUP BY ALL),
sk AS (SELECT c, label AS k, j, sum(v) AS sk FROM x GROUP BY ALL),
g AS (SELECT s.c, 'W0' AS tensor, kk.k * (SELECT max(j) + 1 FROM s) + s.j AS idx,
             (s.s / (SELECT count(*) FROM kk) - coalesce(sk.sk, 0)) / n.n AS g
      FROM s CROSS JOIN kk JOIN n USING (c) LEFT JOIN sk ON sk.c = s.c AND sk.k = kk.k AND sk.j = s.j
      UNION ALL
      SELECT n.c, 'b0', kk.k, 1.0 / (SELECT count(*) FROM kk) - coalesce(nk.nk, 0) / n.n
      FROM n CROSS JOIN kk LEFT JOIN nk ON nk.c = n.c AND nk.k = kk.k)
SELECT CAST(c AS INTEGER) AS client_id, tensor, CAST(idx AS INTEGER) AS idx, round(-0.1 * g / (abs(g) + 1e-8) + 1e-9, 6) + 0.0 AS value FROM g"""


@query("local_train_first_step", FIRST_STEP_SQL)
def q_local_train_first_step(spark, sf):
    """Local training itself, one step over all of a client's rows from a zero linear model."""
    import numpy as np

    e = T.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 5).cast("int").alias("client_id"),
                                                F.col("embedding").alias("features"), F.col("label").cast("int").alias("label"))
    meta = e.agg(F.max(F.size("features")).alias("f"), F.max("label").alias("k")).first()
    zero = [("W0", np.zeros((meta["k"] + 1, meta["f"]))), ("b0", np.zeros(meta["k"] + 1))]
    p = TR.full_batch_train(e, zero, epochs=1, lr=0.1)
    return TR.combine_shards(p).select("client_id", "tensor", "idx", "value")


@query("federated_train", None)
def q_federated_train(spark, sf):
    cfg = FED.FedConfig(strategy="fedavg", n_rounds=3, local_epochs=2, batch_size=32, lr=0.01)
    return FED.federated_train(emb_clients(spark, sf), "vec_id", cfg).history


@query("federated_published", None)
def q_federated_published(spark, sf):
    """The published network, normalised and with dropout, at its stated settings but for two rounds."""
    return FED.federated_train(emb_clients(spark, sf), "vec_id", FED.published(n_rounds=2, batch_size=64)).history


def emb_split(spark, sf):
    """Embeddings as client rows by id: client = vec_id % 5, every fourth for evaluation."""
    v = F.col("vec_id")
    return T.table(spark, sf, "embeddings").select(
        "vec_id", (v % 5).cast("int").alias("client_id"), F.col("embedding").alias("features"), F.col("label").cast("int").alias("label"),
        F.when(F.floor(v / 5) % 4 == 0, "val").otherwise("train").alias("split"))


def first_round_sql(runs: dict) -> str:
    """Global loss, accuracy and rows before and after one round from zero weights: each client makes one Adam
    step over all of its rows (W -= lr * g / (|g| + 1e-8)), models are averaged by rows. ``runs``: lr by experiment."""
    listed = ", ".join(f"('{e}', CAST({lr} AS DOUBLE))" for e, lr in runs.items())
    return f"""
WITH cfg(experiment, lr) AS (VALUES {listed}),
e AS (SELECT vec_id, vec_id % 5 AS c, label, embedding, (vec_id // 5) % 4 = 0 AS val FROM embeddings),
tr AS (SELECT * FROM e WHERE NOT val), kk AS (SELECT DISTINCT CAST(unnest(range(0, (SELECT max(label) + 1 FROM embeddings))) AS BIGINT) AS k),
x AS (SELECT c, label, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM tr
      UNION ALL SELECT c, label, -1, 1.0 FROM tr),
n AS (SELECT c, count(*) AS n FROM tr GROUP BY 1),
s AS (SELECT c, j, sum(v) AS s FROM x GROUP BY ALL), sk AS (SELECT c, label AS k, j, sum(v) AS sk FROM x GROUP BY ALL),
g AS (SELECT s.c, kk.k, s.j, n.n, (s.s / (SELECT count(*) FROM kk) - coalesce(sk.sk, 0)) / n.n AS g
      FROM s CROSS JOIN kk JOIN n USING (c) LEFT JOIN sk ON sk.c = s.c AND sk.k = kk.k AND sk.j = s.j),
w AS (SELECT experiment, k, j, sum(n * (-lr * g / (abs(g) + 1e-8))) / sum(n) AS w FROM g CROSS JOIN cfg GROUP BY ALL),
ev AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM e WHERE val
       UNION ALL SELECT vec_id, label, -1, 1.0 FROM e WHERE val),
z AS (SELECT experiment, 1 AS round, vec_id, label, k, sum(v * w) AS z FROM ev JOIN w USING (j) GROUP BY ALL
      UNION ALL SELECT experiment, 0, vec_id, label, k, 0.0 FROM e CROSS JOIN kk CROSS JOIN cfg WHERE val),
r AS (SELECT experiment, round, vec_id, max(z) + ln(sum(exp(z - mz))) - max(CASE WHEN k = label THEN z END) AS loss,
             arg_max(k, (z, -k)) = any_value(label) AS hit
      FROM (SELECT *, max(z) OVER (PARTITION BY experiment, round, vec_id) AS mz FROM z) GROUP BY ALL)
SELECT experiment, CAST(round AS INTEGER) AS round, metric, round(value + 1e-9, 6) + 0.0 AS value FROM (
  SELECT experiment, round, unnest(['loss', 'accuracy', 'n']) AS metric, unnest([loss, accuracy, n]) AS value FROM (
    SELECT experiment, round, avg(loss) AS loss, avg(CAST(hit AS DOUBLE)) AS accuracy, CAST(count(*) AS DOUBLE) AS n
    FROM r GROUP BY experiment, round))"""


def first_rounds(history):
    return FED.global_history(history).where(F.col("metric").isin("loss", "accuracy", "n")).select("experiment", "round", "metric", "value")


def first_config(experiment, lr, **kw):
    return FED.FedConfig(experiment=experiment, lr=lr, zero_init=True, batch_size=None, **{"n_rounds": 1, **kw})


@query("federated_first_round", first_round_sql({"one": 0.1}))
def q_federated_first_round(spark, sf):
    """The round loop itself, against the closed form of its first round."""
    return first_rounds(FED.federated_train(emb_split(spark, sf), "vec_id", first_config("one", 0.1)).history)


@query("sweep", first_round_sql({"slow": 0.01, "middle": 0.1, "fast": 0.5, "override": 0.1}))
def q_sweep(spark, sf):
    """Four configurations side by side; an override of the round takes one's epochs from three to one."""
    runs = [first_config("slow", 0.01), first_config("middle", 0.1), first_config("fast", 0.5),
            first_config("override", 0.1, local_epochs=3, round_overrides={1: {"local_epochs": 1}})]
    return first_rounds(FED.sweep(emb_split(spark, sf), "vec_id", runs))


@query("resume", first_round_sql({"again": 0.1}))
def q_resume(spark, sf):
    """A run that ends after its first evaluation, goes on from its folder, and is then started once more."""
    d, root = emb_split(spark, sf), staging_dir(spark, "rounds")
    for n in (0, 1, 1):
        h = FED.federated_train(d, "vec_id", first_config("again", 0.1, n_rounds=n), run_dir=root).history
    return first_rounds(h)


@query("merged_moments", """
SELECT tensor, CAST(idx AS INTEGER) AS idx, round(unnest(v) + 1e-9, 6) + 0.0 AS value FROM (
  SELECT unnest(['mean0', 'spread0']) AS tensor, idx, unnest([[avg(v)], [sum(v * v) - count(*) * avg(v) * avg(v)]]) AS v
  FROM (SELECT unnest(range(0, len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY idx)
UNION ALL SELECT 'count0', 0, round(CAST(count(*) AS DOUBLE) + 1e-9, 6) + 0.0 FROM embeddings""")
def q_merged_moments(spark, sf):
    """What normalised layers keep, client by client, merged into the moments of all rows."""
    import numpy as np

    e = emb_split(spark, sf)
    dim = e.agg(F.max(F.size("features"))).first()[0]
    # an identity layer, so that what is normalised are the features
    model = [(nm, np.eye(dim) if nm == "W0" else a) for nm, a in TR.init_model([dim, dim, 2], norm=True, zero=True)]
    parts = TR.local_train(e.withColumn("label", F.lit(0)), model, "vec_id", epochs=1, batch_size=50, lr=0.0)
    parts = materialize(parts.where(TR.is_moment()))
    return blocks.exploded(TR.merged_moment_blocks(parts, ["config_id"]), [])


DP_ROUNDS = ("SELECT 'dp' AS experiment, CAST(r AS INTEGER) AS round, greatest(floor(5 * 0.6), 1) / 5.0 AS sample_rate, "
             "CAST(1.5 AS DOUBLE) AS noise_multiplier FROM range(1, 4) t(r), (SELECT count(*) FROM embeddings)")


@query("federated_dp", "SELECT round, metric, round(value + 1e-9, 6) + 0.0 AS value FROM (SELECT round, unnest(['epsilon', 'epsilon_round', 'delta']) "
       f"AS metric, unnest([epsilon, epsilon_round, 1e-5]) AS value FROM ({LEDGER_SQL.replace(T.PRIVACY_ROUNDS_SQL, DP_ROUNDS)}))")
def q_federated_dp(spark, sf):
    """What private training spends, round by round, as its history records it."""
    cfg = FED.FedConfig(strategy="dp", n_rounds=3, local_epochs=1, batch_size=64, noise_multiplier=1.5, fraction_fit=0.6,
                        experiment="dp", n_shards=2, dp_secret=3)
    h = FED.federated_train(emb_clients(spark, sf), "vec_id", cfg).history
    return h.where("kind = 'privacy'").select("round", "metric", "value")


@query("baseline_mlp", None)
def q_baseline_mlp(spark, sf):
    """The centralised baseline with a hidden layer."""
    return _baseline_eval(emb_clients(spark, sf), hidden=(16,), max_iter=30)


def _baseline_eval(d, **how):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = TR.baseline_train(d.where("split = 'train'"), **how)
    ev = d.where("split = 'val'").select(array_to_vector(F.col("features").cast("array<double>")).alias("fv"),
                                         F.col("label").alias("y_true"), "client_id")
    pred = model.transform(ev).withColumn("y_pred", F.col("prediction").cast("int"))
    # log probabilities are logits whose loss is the model's own
    logits = F.transform(vector_to_array("probability"), lambda x: F.log(F.greatest(x, F.lit(1e-300))))
    return M.eval_table(pred.withColumn("logits", logits), "y_true", "y_pred", logits="logits")


@query("baseline_gradient", "SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, CAST(0.0 AS DOUBLE) AS gradient FROM "
                            "(SELECT DISTINCT label AS k FROM embeddings), (SELECT unnest(range(-1, max(len(embedding)))) AS j FROM embeddings)")
def q_baseline_gradient(spark, sf):
    """The fitted linear baseline is a minimum: its mean gradient by class and feature, -1 being the intercept, to two digits."""
    import numpy as np

    e = emb_split(spark, sf)
    fitted = TR.baseline_train(e, max_iter=200)
    model = [("W0", fitted.coefficientMatrix.toArray()), ("b0", np.array(fitted.interceptVector.toArray()))]
    sums = TR.gradients(TR.usable(e, "features", "label", model[0][1].shape[1]).withColumn("config_id", F.lit(0)).withColumn("client_id", F.lit(0)),
                        TR.shipped(spark, {0: model}), "features", "label")
    sums = materialize(sums)
    n = sums.where("tensor = ''").select(F.col("values")[0].alias("_n"), F.lit(0).alias("client_id"))
    long = blocks.exploded(sums.where("tensor <> ''"), ["client_id"]).join(F.broadcast(n), "client_id")
    dim, w = model[0][1].shape[1], F.col("tensor") == "W0"
    return long.select(F.when(w, F.floor(F.col("idx") / dim)).otherwise(F.col("idx")).cast("int").alias("k"),
                       F.when(w, F.col("idx") % dim).otherwise(F.lit(-1)).cast("int").alias("j"),
                       (F.round(F.col("value") / F.col("_n"), 2) + 0.0).alias("gradient"))


@query("baseline_train", None)
def q_baseline_train(spark, sf):
    return _baseline_eval(emb_clients(spark, sf), max_iter=50)


@query("score", """
WITH x AS (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
h AS (SELECT vec_id, u, greatest(sum(v * ((j * 7 + u * 11) % 13 - 6) / 10.0) + any_value(u - 2) / 4.0, 0.0) AS h
      FROM x, range(0, 6) t(u) GROUP BY vec_id, u),
z AS (SELECT vec_id, k, sum(h * ((u * 5 + k * 3) % 11 - 5) / 8.0) + any_value(k) / 16.0 AS z FROM h, range(0, 4) t(k) GROUP BY vec_id, k)
SELECT vec_id, CAST(arg_max(k, z) AS INTEGER) AS y_pred, round(max(z) + 1e-9, 6) + 0.0 AS max_logit, round(min(z) + 1e-9, 6) + 0.0 AS min_logit
FROM z GROUP BY vec_id""")
def q_score(spark, sf):
    """Batch scoring with a hidden layer of fixed weights."""
    import numpy as np

    e = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    dim = e.agg(F.max(F.size("features"))).first()[0]
    j, u, k = np.arange(dim), np.arange(6), np.arange(4)
    model = [("W0", ((j[None, :] * 7 + u[:, None] * 11) % 13 - 6) / 10.0), ("b0", (u - 2) / 4.0),
             ("W1", ((u[None, :] * 5 + k[:, None] * 3) % 11 - 5) / 8.0), ("b1", k / 16.0)]
    z = TR.score(e, model)
    return z.select("vec_id", M.argmax(F.col("logits")).cast("int").alias("y_pred"), F.array_max("logits").alias("max_logit"),
                    F.array_min("logits").alias("min_logit"))


@query("score_linear", """
WITH x AS (SELECT vec_id, label, j, CAST(embedding[j] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(j)),
c AS (SELECT label AS k, j, avg(v) AS w FROM x GROUP BY ALL),
d AS (SELECT x.vec_id, c.k, sum(x.v * c.w) AS logit FROM x JOIN c USING (j) GROUP BY ALL)
SELECT vec_id, CAST(arg_max(k, logit) AS INTEGER) AS y_pred, round(max(logit) + 1e-9, 6) + 0.0 AS max_logit FROM d GROUP BY vec_id""")
def q_score_linear(spark, sf):
    labels, W = T.class_centroids(spark, sf)
    e = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    s = TR.score_linear(e, W)
    lab = F.array(*[F.lit(int(x)) for x in labels])
    return s.select("vec_id", F.element_at(lab, M.argmax(F.col("logits")) + 1).cast("int").alias("y_pred"),
                    r6(F.array_max("logits")).alias("max_logit"))


@query("sgd_step_zero_init", f"""
WITH x AS (SELECT CAST(vec_id % 5 AS INTEGER) AS client_id, label, j - 1 AS j, CAST(embedding[j] AS DOUBLE) AS v
           FROM embeddings, range(1, 65) t(j)),
n AS (SELECT client_id, count(*) AS nc FROM embeddings_c GROUP BY client_id),
s AS (SELECT client_id, j, sum(v) AS sj FROM x GROUP BY ALL),
sk AS (SELECT client_id, label AS k, j, sum(v) AS skj FROM x GROUP BY ALL),
kk AS (SELECT DISTINCT label AS k FROM embeddings),
g AS (SELECT s.client_id, kk.k, s.j, (s.sj / (SELECT count(*) FROM kk) - coalesce(sk.skj, 0)) / n.nc AS grad, n.nc
      FROM s JOIN n USING (client_id) CROSS JOIN kk LEFT JOIN sk ON sk.client_id = s.client_id AND sk.k = kk.k AND sk.j = s.j)
SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, round(sum(nc * (-0.1 * grad)) / sum(nc) + 1e-9, 6) + 0.0 AS value
FROM g GROUP BY k, j""".replace("embeddings_c", "(SELECT CAST(vec_id % 5 AS INTEGER) AS client_id FROM embeddings)"))
def q_sgd_step_zero_init(spark, sf):
    """One full-batch SGD step (lr 0.1) of linear softmax from zero weights per client
    (client = vec_id % 5), then FedAvg: W[k][j] = −lr·(S_j/K − S_kj)/n_c averaged by n_c."""
    e = T.table(spark, sf, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("client_id"), "label",
                                                F.posexplode("embedding").alias("j", "v"))
    labels = clean.sorted_labels(e, "label")   # classes of the model
    labels = sorted(int(x) for x in labels)
    K = len(labels)
    n = T.table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 5).cast("int").alias("client_id")).agg(
        F.count(F.lit(1)).alias("nc"))
    sk = e.groupBy("client_id", "label", "j").agg(F.sum("v").alias("skj"))
    s = sk.groupBy("client_id", "j").agg(F.sum("skj").alias("sj"),
                                         F.map_from_entries(F.collect_list(F.struct("label", "skj"))).alias("_m"))
    g = s.join(n, "client_id").select("client_id", "j", "nc", F.explode(F.array(*[F.lit(k) for k in labels])).alias("k"),
                                      "sj", "_m")
    g = g.withColumn("grad", (F.col("sj") / K - F.coalesce(F.element_at("_m", F.col("k")), F.lit(0.0))) / F.col("nc"))
    return g.groupBy(F.col("k").cast("int").alias("k"), F.col("j").cast("int").alias("j")).agg(
        r6(F.sum(F.col("nc") * (F.lit(-0.1) * F.col("grad"))) / F.sum("nc")).alias("value"))


# ---------------------------------------------------------------------------------------------
# Outer union by name of two differently shaped sources
from ..sources import csv as CSV  # noqa: E402


@query("union_by_name", "SELECT id, value, event_type, l_returnflag FROM (SELECT event_id AS id, value, event_type FROM events "
                        "UNION ALL BY NAME SELECT l_orderkey AS id, l_extendedprice AS value, l_returnflag FROM lineitem)")
def q_union_by_name(spark, sf):
    ev = T.table(spark, sf, "events").select(F.col("event_id").alias("id"), "value", "event_type")
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("value"),
                                               "l_returnflag")
    return CSV.union_by_name([ev, li])


def staged_event_csvs(spark, sf):
    """S1-S4 fixture derived from the whole ``events`` table: written as CSV part files into the
    shared checkpoint folder in two header layouts — padded names (S3), and click/view rows
    without ``user_id`` (S4 fills NULL). Returns the two folders."""
    base = staging_dir(spark, "csv")
    ev = T.table(spark, sf, "events")
    short = F.col("event_type").isin("click", "view")
    ev.where(short).select(F.col("event_id").alias(" event_id"), F.col("value").alias("value "),
                           F.col("event_type").alias(" event_type ")) \
        .write.mode("overwrite").option("header", True).csv(f"{base}/a")
    ev.where(~short).select("event_id", "event_type", F.col("value").alias(" value"), "user_id") \
        .write.mode("overwrite").option("header", True).csv(f"{base}/b")
    return [f"{base}/a", f"{base}/b"]


@query("csv_scan_encodings", "SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN 'Café ' ELSE 'Web ' END || event_type AS label, "
                             "CASE event_id % 3 WHEN 1 THEN user_id END AS user_id FROM events")
def q_csv_scan_encodings(spark, sf):
    """The whole ``events`` as files of three kinds: latin-1 text; short rows; rows of which each is written once
    more with a field too many, which has to go."""
    base, ev = staging_dir(spark, "csv"), T.table(spark, sf, "events")
    kind = F.col("event_id") % 3
    name = F.concat(F.when(kind == 0, "Café ").otherwise("Web "), "event_type")
    latin = ev.where(kind == 0).select("event_id", F.col("value").alias(" value"), name.alias("label "))
    latin.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{base}/latin")
    ev.where(kind == 1).select(name.alias("label"), "event_id", "user_id", "value").write.option("header", True).csv(f"{base}/plain")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string"), name)
    body = ev.where(kind == 2).select(F.explode(F.array(line, F.concat(line, F.lit(",,more")))).alias("line"))
    # each file begins with a header: its first line
    head = spark.range(0, 4, 1, 4).select(F.lit(-1).cast("long").alias("at"), F.col("id").alias("part"), F.lit("event_id,value,label,user_id").alias("line"))
    body = body.select(F.xxhash64("line").alias("h"), "line").select(
        F.abs(F.col("h") / 2).cast("long").alias("at"), F.pmod("h", F.lit(4)).alias("part"), "line").unionByName(head)
    body = body.repartition(4, "part").sortWithinPartitions("part", "at")
    body.select("part", F.col("line").alias("value")).write.partitionBy("part").text(f"{base}/long")
    files = [f"{base}/latin", f"{base}/plain", f"{base}/long/*"]
    df = CSV.read_flow_csvs(spark, files, types={"event_id": "bigint", "value": "double", "user_id": "bigint"})
    return df.select("event_id", "value", "label", "user_id")


@query("csv_scan", "SELECT event_id, value, event_type, CASE WHEN event_type IN ('click', 'view') THEN NULL "
                   "ELSE user_id END AS user_id FROM events")
def q_csv_scan(spark, sf):
    df = CSV.read_flow_csvs(spark, staged_event_csvs(spark, sf), types={"event_id": "bigint", "value": "double", "user_id": "bigint"})
    return df.select(F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"),
                     "event_type", F.col("user_id").cast("long").alias("user_id"))


# ---------------------------------------------------------------------------------------------
# Operators return full precision; a query rounds the columns that its oracle rounds.
ROUNDED = re.compile(r"1e-9, 6\)\s*\+ 0\.0\s+AS\s+\"?(\w+)")


def _rounded(fn, names: set):
    def run(spark, sf):
        df = fn(spark, sf)
        return df.select(*[r6(F.col(f"`{c}`")).alias(c) if c in names and t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
    run.__doc__, run.__name__ = fn.__doc__, getattr(fn, "__name__", "query")
    return run


for _name, _sql in ORACLE.items():
    if _found := set(ROUNDED.findall(_sql)):
        QUERIES[_name] = _rounded(QUERIES[_name], _found)
