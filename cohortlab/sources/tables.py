"""Driver tables and the roles they play (FIXTURES.md part B).

Each function reads whole parquet tables with only the columns it needs (the scan's
``ReadSchema`` shows the pruning) and derives the role with column expressions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import safe_ratio

# The event_type -> flow-label rule used by every flow fixture (first match wins).
EVENT_LABELS = [
    ("error", "DDoS"),
    ("purchase", "FTP-Brute Force"),
    ("signup", "Infiltration"),
    ("click", "Botnet"),
]
DEFAULT_FLOW_LABEL = "BENIGN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flow_label(event_type: str = "event_type"):
    expr = None
    for et, lab in EVENT_LABELS:
        expr = (F.when(F.col(event_type) == et, F.lit(lab)) if expr is None
                else expr.when(F.col(event_type) == et, F.lit(lab)))
    return expr.otherwise(F.lit(DEFAULT_FLOW_LABEL))


def flow_label_sql(event_type: str = "event_type") -> str:
    whens = " ".join(f"WHEN '{et}' THEN '{lab}'" for et, lab in EVENT_LABELS)
    return f"CASE {event_type} {whens} ELSE '{DEFAULT_FLOW_LABEL}' END"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow table: key ``event_id``, ``ts``, string ``label``, features value, user_id, k."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", flow_label().alias("label"), "value", "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FLOWS_SQL = (f"SELECT event_id, ts, {flow_label_sql()} AS label, value, user_id, "
             "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with +inf injected where event_id % 97 = 0 and NULL where event_id % 89 = 0."""
    f = flows(spark, sf_dir)
    return f.withColumn(
        "value",
        F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("double"))
        .when(F.col("event_id") % 97 == 0, F.lit(float("inf")))
        .otherwise(F.col("value")),
    )


DIRTY_FLOWS_SQL = (
    "SELECT event_id, ts, label, CASE WHEN event_id % 89 = 0 THEN NULL "
    "WHEN event_id % 97 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS value, user_id, k "
    f"FROM ({FLOWS_SQL})"
)


def dup_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyless flows plus an exact copy of every row whose event_id % 10 = 0."""
    f = flows(spark, sf_dir)
    base = f.drop("event_id")
    return base.unionByName(f.where(F.col("event_id") % 10 == 0).drop("event_id"))


DUP_FLOWS_SQL = (f"SELECT ts, label, value, user_id, k FROM ({FLOWS_SQL}) UNION ALL "
                 f"SELECT ts, label, value, user_id, k FROM ({FLOWS_SQL}) WHERE event_id % 10 = 0")


def ts_text_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows whose timestamp is day-first text ``d/M/yyyy H:m:s``; every 50th row is 'bad'."""
    f = flows(spark, sf_dir)
    txt = F.date_format(F.date_trunc("second", F.col("ts")), "d/M/yyyy H:m:s")
    return f.select(
        "event_id", F.when(F.col("event_id") % 50 == 0, F.lit("bad")).otherwise(txt).alias("Timestamp"),
        "label", "value")


TS_TEXT_SQL = (
    "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE "
    "strftime(date_trunc('second', ts), '%-d/%-m/%Y %-H:%-M:%-S') END AS \"Timestamp\", label, value "
    f"FROM ({FLOWS_SQL})"
)


def binary_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", (F.col("event_type") == "error").cast("int").alias("label_bin"),
        "value", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def wide_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


WIDE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


# added to the key of a repeated row, so that keys stay unique
REPEAT_KEY = 1_000_000_000_000


def repeated_dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty flows, and every row with event_id % 10 = 0 once more under another key."""
    d = dirty_flows(spark, sf_dir)
    again = d.where(F.col("event_id") % 10 == 0).withColumn("event_id", F.col("event_id") + F.lit(REPEAT_KEY))
    return d.unionByName(again)


REPEATED_DIRTY_SQL = (f"SELECT * FROM ({DIRTY_FLOWS_SQL}) UNION ALL SELECT event_id + {REPEAT_KEY}, ts, label, value, user_id, k "
                      f"FROM ({DIRTY_FLOWS_SQL}) WHERE event_id % 10 = 0")


def flows_without_some_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows on clients with text ids; the label is NULL where event_id % 7 = 0."""
    f = flows(spark, sf_dir)
    return f.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("client_id"),
                    F.when(F.col("event_id") % 7 != 0, F.col("label")).alias("label"))


FLOWS_WITHOUT_SOME_LABELS_SQL = ("SELECT event_id, 'c' || CAST(user_id % 7 AS VARCHAR) AS client_id, "
                                 f"CASE WHEN event_id % 7 <> 0 THEN label END AS label FROM ({FLOWS_SQL})")


def dirty_dup_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyless dirty flows plus a copy of every row whose event_id % 10 = 0 (profile input)."""
    d = dirty_flows(spark, sf_dir)
    return d.drop("event_id").unionByName(d.where(F.col("event_id") % 10 == 0).drop("event_id"))


DIRTY_DUP_SQL = (f"SELECT ts, label, value, user_id, k FROM ({DIRTY_FLOWS_SQL}) UNION ALL "
                 f"SELECT ts, label, value, user_id, k FROM ({DIRTY_FLOWS_SQL}) WHERE event_id % 10 = 0")


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: y_true = label id (sorted names), y_pred = (y_true+1) % 5 when event_id % 3 = 0,
    client_id = user_id % 5."""
    from ..operators.clean import label_encode

    enc, _ = label_encode(flows(spark, sf_dir), "label", "y_true")
    return enc.select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("client_id"), "y_true",
        F.when(F.col("event_id") % 3 == 0, (F.col("y_true") + 1) % 5).otherwise(F.col("y_true")).cast("int").alias("y_pred"))


MC_PRED_SQL = (
    "SELECT event_id, CAST(user_id % 5 AS INTEGER) AS client_id, y_true, "
    "CAST(CASE WHEN event_id % 3 = 0 THEN (y_true + 1) % 5 ELSE y_true END AS INTEGER) AS y_pred FROM "
    "(SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y_true "
    f"FROM ({FLOWS_SQL}))")


def binary_predictions(spark: SparkSession, sf_dir: str, tied: bool = True) -> DataFrame:
    """lineitem: y_true = returnflag 'R'; score = l_discount*10 (ties) or l_extendedprice."""
    li = table(spark, sf_dir, "lineitem")
    score = F.col("l_discount") * 10 if tied else F.col("l_extendedprice")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), score.alias("score"),
                     (F.col("l_discount") * 10 > 0.5).cast("int").alias("y_pred"))


def binary_predictions_sql(tied: bool = True) -> str:
    score = "l_discount * 10" if tied else "l_extendedprice"
    return (f"SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y_true, {score} AS score, "
            "CAST(l_discount * 10 > 0.5 AS INTEGER) AS y_pred FROM lineitem")


def class_centroids(spark: SparkSession, sf_dir: str) -> tuple[list, list]:
    """(labels, mean vector of each): K x F doubles, the weights of a linear model."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("j", "v"))
    g = e.groupBy("label", "j").agg(F.avg("v").alias("w")).groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("j", "w"))).alias("ws"))
    rows = sorted(g.collect(), key=lambda r: r["label"])
    return [r["label"] for r in rows], [[x["w"] for x in r["ws"]] for r in rows]


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings scored by the linear model of the class centroids, over all dimensions:
    (vec_id, client_id = vec_id % 5, logits by class, y_true = label)."""
    from ..operators.train import score_linear

    _, weights = class_centroids(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    return score_linear(e, weights, features="embedding").select(
        "vec_id", (F.col("vec_id") % 5).cast("int").alias("client_id"), "logits", F.col("label").cast("int").alias("y_true"))


LOGITS_SQL = (
    "WITH x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), "
    "c AS (SELECT label AS k, j, avg(v) AS w FROM x GROUP BY ALL), "
    "d AS (SELECT x.vec_id, any_value(x.label) AS label, c.k, sum(x.v * c.w) AS logit FROM x JOIN c USING (j) GROUP BY x.vec_id, c.k) "
    "SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS client_id, list(logit ORDER BY k) AS logits, "
    "CAST(any_value(label) AS INTEGER) AS y_true FROM d GROUP BY vec_id")


# Parameter layout of the embedding-backed client updates (flat order).
UPDATE_TENSORS = [("w", 48), ("b", 16)]


def client_updates(spark: SparkSession, sf_dir: str, blocked: bool = False) -> DataFrame:
    """embeddings as client updates: round = vec_id div 5, client_id = vec_id % 5,
    num_examples = label + 1, tau = 1 + label % 3; vectors as blocks, or exploded to (tensor, idx, value)."""
    from ..operators.blocks import from_arrays
    from ..operators.params import explode_params

    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).cast("int").alias("round"), (F.col("vec_id") % 5).cast("int").alias("client_id"),
        (F.col("label") + 1).cast("int").alias("num_examples"), (F.col("label") % 3 + 1).cast("int").alias("tau"),
        "embedding")
    return (from_arrays if blocked else explode_params)(e, "embedding", ["round", "client_id", "num_examples", "tau"], UPDATE_TENSORS)


UPDATES_SQL = (
    "SELECT round, client_id, num_examples, tau, CASE WHEN i < 48 THEN 'w' ELSE 'b' END AS tensor, "
    "CAST(CASE WHEN i < 48 THEN i ELSE i - 48 END AS INTEGER) AS idx, CAST(embedding[i + 1] AS DOUBLE) AS value FROM "
    "(SELECT CAST(vec_id // 5 AS INTEGER) AS round, CAST(vec_id % 5 AS INTEGER) AS client_id, "
    "CAST(label + 1 AS INTEGER) AS num_examples, CAST(label % 3 + 1 AS INTEGER) AS tau, embedding, "
    "unnest(range(0, len(embedding))) AS i FROM embeddings)")


def client_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round = day of month, client_id = user_id % 5, n, metric, value) with loss = avg(value),
    accuracy = avg(value < 100); 'accuracy' is missing for client 3 in odd rounds."""
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy(F.dayofmonth("ts").cast("int").alias("round"), (F.col("user_id") % 5).cast("int").alias("client_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("loss"), F.avg((F.col("value") < 100).cast("double")).alias("accuracy"))
    loss = g.select("round", "client_id", "n", F.lit("loss").alias("metric"), F.col("loss").alias("value"))
    acc = g.where(~((F.col("client_id") == 3) & (F.col("round") % 2 == 1))).select(
        "round", "client_id", "n", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return loss.unionByName(acc)


CLIENT_METRICS_SQL = (
    "WITH g AS (SELECT CAST(dayofmonth(ts) AS INTEGER) AS round, CAST(user_id % 5 AS INTEGER) AS client_id, count(*) AS n, "
    "avg(value) AS loss, avg(CAST(value < 100 AS DOUBLE)) AS accuracy FROM events GROUP BY ALL) "
    "SELECT round, client_id, n, 'loss' AS metric, loss AS value FROM g UNION ALL "
    "SELECT round, client_id, n, 'accuracy' AS metric, accuracy AS value FROM g WHERE NOT (client_id = 3 AND round % 2 = 1)")


def strategy_col():
    return F.when(F.col("event_type") == "view", F.lit("baseline")).otherwise(F.col("event_type"))


STRATEGY_SQL = "CASE WHEN event_type = 'view' THEN 'baseline' ELSE event_type END"


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, strategy, round, metric, value): strategy = event_type ('view' is the
    baseline), round = day of month, loss = avg(value), accuracy = avg(value < 100), n; f1 and fpr
    of the prediction value < 100 for an even user_id."""
    ev = table(spark, sf_dir, "events")
    even, low = F.col("user_id") % 2 == 0, F.col("value") < 100
    g = ev.groupBy(strategy_col().alias("strategy"), F.dayofmonth("ts").cast("int").alias("round")).agg(
        F.avg("value").alias("loss"), F.avg(low.cast("double")).alias("accuracy"), F.count(F.lit(1)).cast("double").alias("n"),
        F.count_if(even & low).alias("tp"), F.count_if(~even & low).alias("fp"), F.count_if(even & ~low).alias("fn"),
        F.count_if(~even & ~low).alias("tn"))
    g = g.withColumn("f1", safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn(
        "fpr", safe_ratio("fp", F.col("fp") + F.col("tn")))
    structs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in HISTORY_METRICS]
    return g.select(F.col("strategy").alias("experiment"), "strategy", "round",
                    F.explode(F.array(*structs)).alias("s")).select("experiment", "strategy", "round", "s.metric", "s.value")


HISTORY_METRICS = ("loss", "accuracy", "n", "f1", "fpr")
RUN_HISTORY_SQL = (
    f"WITH h AS (SELECT {STRATEGY_SQL} AS strategy, CAST(dayofmonth(ts) AS INTEGER) AS round, value, user_id % 2 = 0 AS even, "
    "value < 100 AS low FROM events), "
    "g AS (SELECT strategy, round, avg(value) AS loss, avg(CAST(low AS DOUBLE)) AS accuracy, CAST(count(*) AS DOUBLE) AS n, "
    "coalesce(2.0 * count_if(even AND low) / nullif(2 * count_if(even AND low) + count_if(NOT even AND low) + count_if(even AND NOT low), 0), 0.0) AS f1, "
    "coalesce(1.0 * count_if(NOT even AND low) / nullif(count_if(NOT even), 0), 0.0) AS fpr FROM h GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT strategy AS experiment, strategy, round, '{m}' AS metric, {m} AS value FROM g"
                         for m in HISTORY_METRICS))

# Noise multiplier per experiment of the privacy fixture.
NOISE_BY_STRATEGY = [("baseline", 0.5), ("click", 1.0), ("error", 2.0), ("purchase", 1.0), ("signup", 2.0)]


def privacy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, round, sample_rate, noise_multiplier): sample_rate = the experiment's share
    of that day's events (2 digits), multiplier from NOISE_BY_STRATEGY."""
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy(strategy_col().alias("experiment"), F.dayofmonth("ts").cast("int").alias("round")).agg(
        F.count(F.lit(1)).alias("_c"))
    day = ev.groupBy(F.dayofmonth("ts").cast("int").alias("round")).agg(F.count(F.lit(1)).alias("_d"))
    z = F.create_map(*[x for s, v in NOISE_BY_STRATEGY for x in (F.lit(s), F.lit(v))])
    return g.join(day, "round").select(
        "experiment", "round", F.round(F.col("_c") / F.col("_d"), 2).alias("sample_rate"),
        F.element_at(z, F.col("experiment")).alias("noise_multiplier"))


PRIVACY_ROUNDS_SQL = (
    f"SELECT g.experiment, g.round, round(g.c / d.d, 2) AS sample_rate, CASE g.experiment "
    + " ".join(f"WHEN '{s}' THEN CAST({v} AS DOUBLE)" for s, v in NOISE_BY_STRATEGY) + " END AS noise_multiplier FROM "
    f"(SELECT {STRATEGY_SQL} AS experiment, CAST(dayofmonth(ts) AS INTEGER) AS round, count(*) AS c FROM events GROUP BY ALL) g "
    "JOIN (SELECT CAST(dayofmonth(ts) AS INTEGER) AS round, count(*) AS d FROM events GROUP BY ALL) d USING (round)")
