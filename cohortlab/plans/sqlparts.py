"""DuckDB SQL fragments for the oracle side of the catalog.

They restate the same definitions as the Spark operators in plain SQL (global windows are
fine for an oracle at sf0.01); nothing here runs on Spark.
"""
from __future__ import annotations

from ..operators.clean import ATTACK_FAMILIES, NORMAL_NAMES
from ..sources.tables import FLOWS_SQL, REPEATED_DIRTY_SQL


def family_sql(label: str = "label") -> str:
    parts = []
    for fam, kws in ATTACK_FAMILIES:
        cond = " OR ".join(f"contains(lower({label}), '{kw.lower()}')" for kw in kws)
        parts.append(f"WHEN {cond} THEN '{fam}'")
    normal = ", ".join(f"'{n}'" for n in NORMAL_NAMES)
    return f"CASE {' '.join(parts)} WHEN lower({label}) IN ({normal}) THEN 'Normal' ELSE 'Other' END"


def family_index_sql(fam: str) -> str:
    whens = " ".join(f"WHEN '{f}' THEN {i}" for i, (f, _) in enumerate(ATTACK_FAMILIES))
    return f"CASE {fam} {whens} END"


def h(key: str, seed: int = 42) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def cleaned_flows_sql() -> str:
    """Dirty, repeated flows -> inf/NaN to NULL in value -> drop NULL value -> rows alike but for
    the key become the one with the smallest key."""
    return ("SELECT min(event_id) AS event_id, ts, label, value, user_id, k FROM ("
            "SELECT event_id, ts, label, CASE WHEN isinf(value) OR isnan(value) THEN NULL ELSE value END AS value, "
            f"user_id, k FROM ({REPEATED_DIRTY_SQL})) WHERE value IS NOT NULL GROUP BY ts, label, value, user_id, k")


def iid_sql(src: str, key: str = "event_id", n: int = 5, seed: int = 42) -> str:
    return (f"SELECT * EXCLUDE (_h, _pos, _n), CAST(CASE WHEN _n // {n} = 0 THEN {n - 1} "
            f"ELSE least((_pos - 1) // (_n // {n}), {n - 1}) END AS INTEGER) AS client_id FROM ("
            f"SELECT *, row_number() OVER (ORDER BY _h, {key}) AS _pos, count(*) OVER () AS _n FROM ("
            f"SELECT *, {h(key, seed)} AS _h FROM ({src})))")


def day_sql(src: str, ts: str = "ts", n: int = 5) -> str:
    return (f"SELECT * EXCLUDE (_dix, _ndays), CAST(CASE WHEN {n} >= _ndays THEN _dix ELSE "
            f"least(((_dix + 1) * {n} - 1) // _ndays, {n - 1}) END AS INTEGER) AS client_id FROM ("
            f"SELECT *, dense_rank() OVER (ORDER BY CAST({ts} AS DATE)) - 1 AS _dix, "
            f"count(DISTINCT CAST({ts} AS DATE)) OVER () AS _ndays FROM ({src}))")


def family_part_sql(src: str, key: str = "event_id", label: str = "label", n: int = 5, seed: int = 42) -> str:
    return (
        f"WITH b AS (SELECT *, {family_sql(label)} AS _fam FROM ({src})), "
        f"a AS (SELECT * EXCLUDE (_fam), CAST(({family_index_sql('_fam')}) % {n} AS INTEGER) AS client_id "
        f"FROM b WHERE _fam <> 'Normal'), "
        f"nr AS (SELECT *, row_number() OVER (ORDER BY {h(key, seed)}, {key}) AS _pos, count(*) OVER () AS _m "
        f"FROM b WHERE _fam = 'Normal') "
        f"SELECT * FROM a UNION ALL SELECT * EXCLUDE (_fam, _pos, _m), "
        f"CAST(least((_pos * {n} - 1) // _m, {n - 1}) AS INTEGER) AS client_id FROM nr")


def dist_sql(assign: str, client: str = "client_id", label: str = "label", digits: bool = True, id_type: str = "INTEGER") -> str:
    """(client_i, client_j, emd_value, emd_label, tv_distance) from an assignment relation; NULL
    labels count for nothing. ``digits=False``: unrounded, for what is computed from them."""
    def shown(x):
        return f"round({x} + 1e-9, 6) + 0.0" if digits else x

    return f"""
WITH A AS (SELECT {client} AS cid, CAST({label} AS VARCHAR) AS lab FROM ({assign}) WHERE {label} IS NOT NULL),
c AS (SELECT cid, lab, count(*) AS cnt FROM A GROUP BY cid, lab),
labs AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS li FROM (SELECT DISTINCT lab FROM A)),
kk AS (SELECT count(*) AS k FROM labs),
cl AS (SELECT DISTINCT cid FROM A),
dense AS (SELECT cl.cid, labs.lab, labs.li, coalesce(c.cnt, 0) AS cnt FROM cl CROSS JOIN labs
          LEFT JOIN c ON c.cid = cl.cid AND c.lab = labs.lab),
p0 AS (SELECT cid, li, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY cid) AS p FROM dense),
p AS (SELECT cid, li, p / (sum(p) OVER (PARTITION BY cid) + 1e-10) AS p FROM p0),
ps AS (SELECT cid, li, p, row_number() OVER (PARTITION BY cid ORDER BY p, li) AS sr,
       sum(p) OVER (PARTITION BY cid ORDER BY li ROWS UNBOUNDED PRECEDING) AS cdf FROM p),
byli AS (SELECT x.cid AS ci, y.cid AS cj, sum(abs(x.p - y.p)) AS l1,
         sum(CASE WHEN x.li < (SELECT k FROM kk) - 1 THEN abs(x.cdf - y.cdf) ELSE 0 END) AS dcdf
         FROM ps x JOIN ps y ON x.li = y.li AND x.cid < y.cid GROUP BY x.cid, y.cid),
bysr AS (SELECT x.cid AS ci, y.cid AS cj, sum(abs(x.p - y.p)) AS ls
         FROM ps x JOIN ps y ON x.sr = y.sr AND x.cid < y.cid GROUP BY x.cid, y.cid)
SELECT CAST(byli.ci AS {id_type}) AS client_i, CAST(byli.cj AS {id_type}) AS client_j,
       {shown("bysr.ls / (SELECT k FROM kk)")} AS emd_value,
       {shown("byli.dcdf")} AS emd_label,
       {shown("0.5 * byli.l1")} AS tv_distance
FROM byli JOIN bysr ON byli.ci = bysr.ci AND byli.cj = bysr.cj
"""


def emd_stats_sql(pairs: str) -> str:
    return (f"SELECT round(avg(emd_value) + 1e-9, 6) + 0.0 AS mean_emd, round(max(emd_value) + 1e-9, 6) + 0.0 AS max_emd, "
            f"round(min(emd_value) + 1e-9, 6) + 0.0 AS min_emd, round(avg(emd_label) + 1e-9, 6) + 0.0 AS mean_emd_label, "
            f"round(avg(tv_distance) + 1e-9, 6) + 0.0 AS mean_tv, count(*) AS n_pairs FROM ({pairs})")


FLOWS = FLOWS_SQL


def pc_sql(P: str, group: str | None = None, union: bool = True) -> str:
    """Per-class tp/predicted/support/precision/recall/f1 over prediction relation P."""
    g = f"{group}, " if group else ""
    on = f"t.{group} = p.{group} AND " if group else ""
    gsel = f"coalesce(t.{group}, p.{group}) AS {group}, " if group else ""
    how = "FULL OUTER JOIN" if union else "LEFT JOIN"
    return f"""
WITH c AS (SELECT {g}y_true, y_pred, count(*) AS n FROM ({P}) GROUP BY ALL),
t AS (SELECT {g}y_true AS class, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
      FROM c GROUP BY ALL),
p AS (SELECT {g}y_pred AS class, sum(n) AS predicted FROM c GROUP BY ALL),
j AS (SELECT {gsel}coalesce(t.class, p.class) AS class, coalesce(t.tp, 0) AS tp, coalesce(p.predicted, 0) AS predicted,
      coalesce(t.support, 0) AS support FROM t {how} p ON {on}t.class = p.class),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
      CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM j)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m
"""


def av_sql(pc: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, "
            "coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0) AS weighted_precision, "
            "coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0) AS weighted_recall, "
            f"coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0) AS weighted_f1 FROM ({pc}) GROUP BY ALL")


EVAL_NAMES = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall",
              "weighted_f1", "n"]


def eval_sql(P: str, group: str | None = None, loss: bool = False) -> str:
    """Long (group, metric, value) table: same rows as metrics.eval_table."""
    g = f"{group}, " if group else ""
    pc = pc_sql(P, group)
    names = (["loss"] if loss else []) + EVAL_NAMES
    ce = ", avg(ce) AS loss" if loss else ""
    join = f"JOIN av USING ({group})" if group else "CROSS JOIN av"
    body = " UNION ALL ".join(f"SELECT {g}'{nm}' AS metric, CAST({nm} AS DOUBLE) AS value FROM w" for nm in names)
    return f"""
WITH pcs AS ({pc}), av AS ({av_sql('SELECT * FROM pcs', group)}),
acc AS (SELECT {g}avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy, CAST(count(*) AS DOUBLE) AS n{ce}
        FROM ({P}) GROUP BY ALL),
w AS (SELECT * FROM acc {join})
SELECT {g}metric, round(value + 1e-9, 6) + 0.0 AS value FROM ({body}
  UNION ALL SELECT {g}'f1_class_' || CAST(class AS VARCHAR) AS metric, f1 AS value FROM pcs)
"""


def lse_sql(l: str) -> str:
    return f"(list_max({l}) + ln(list_sum(list_transform({l}, lambda x: exp(x - list_max({l}))))))"


def auc_sql(P: str) -> str:
    return f"""
WITH g AS (SELECT score, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg FROM ({P}) GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM g)
SELECT round(CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (neg_below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))
       END + 1e-9, 6) + 0.0 AS auc_roc FROM r
"""
