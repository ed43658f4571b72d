"""Client-update aggregation on a blocked parameter table.

``updates(round, client_id, num_examples, tau, tensor, block, values)`` holds a client's weights as
arrays of up to 1,024 (see ``blocks``). Every strategy is one element-wise aggregate by (round,
tensor, block), combined before the shuffle, plus joins with per-round or per-client tables that are
orders of magnitude smaller. All operators also take the long form (``idx``, ``value``) and then
return it. ``by`` names what keeps models apart: the round, or (config_id, round) in sweeps.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import gaussian_from_hash
from . import blocks as B

KEY = ["round", "tensor", "idx"]
BY = ("round",)
CLIENT = ["client_id", "num_examples", "tau"]


def _blocked(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df if B.is_blocked(df) else B.to_blocks(df, [c for c in ids if c in df.columns])


def _as(df: DataFrame, like: DataFrame, ids: Sequence[str], value: str = "value", others: Sequence[str] = ()) -> DataFrame:
    """Blocks as they are if ``like`` is blocked, else in the long form."""
    return df if B.is_blocked(like) else B.exploded(df, ids, value=value, others=others)


def _key(by: Sequence[str]) -> list:
    return [*by, "tensor", "block"]


# M13 ----------------------------------------------------------------------------------------
def explode_params(df: DataFrame, array_col: str, id_cols, splits: list[tuple[str, int]]) -> DataFrame:
    """ARRAY<float> weights -> long (id..., tensor, idx, value). ``splits`` = [(tensor, size), ...]
    in flat order; idx restarts at 0 inside each tensor."""
    pe = df.select(*id_cols, F.posexplode(array_col).alias("_pos", "value"))
    tensor, idx, start = None, None, 0
    for name, size in splits:
        cond = F.col("_pos") < start + size
        tensor = F.when(cond, F.lit(name)) if tensor is None else tensor.when(cond, F.lit(name))
        idx = F.when(cond, F.col("_pos") - start) if idx is None else idx.when(cond, F.col("_pos") - start)
        start += size
    return pe.select(*id_cols, tensor.alias("tensor"), idx.cast("int").alias("idx"), F.col("value").cast("double").alias("value"))


def implode_params(params: DataFrame, group_cols) -> DataFrame:
    """Long -> one ARRAY<DOUBLE> per (group..., tensor) in idx order (a model's tensors are
    bounded by the model size, not by the data)."""
    g = params.groupBy(*group_cols, "tensor").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    return g.select(*group_cols, "tensor", F.transform("_s", lambda s: s["value"]).alias("values"))


def param_count(params: DataFrame) -> DataFrame:
    return params.groupBy("tensor").agg(F.countDistinct("idx").alias("numel"), F.count(F.lit(1)).alias("n_values"))


# M5 -----------------------------------------------------------------------------------------
def fedavg(updates: DataFrame, weighted: bool = True, by: Sequence[str] = BY) -> DataFrame:
    """Σ n_i·w_i / Σ n_i per (round, tensor, element); ``weighted=False`` -> plain mean."""
    u = _blocked(updates, [*by, *CLIENT])
    n = F.col("num_examples").cast("double") if weighted else None
    return _as(u.groupBy(*_key(by)).agg(B.averaged(n).alias("values")), updates, by)


def previous_round_global(updates: DataFrame, init: float = 0.0) -> DataFrame:
    """Global model entering round r = FedAvg of round r-1; coordinates of the first round
    start at ``init``. One model for every round in ``updates``."""
    u = _blocked(updates, ["round", *CLIENT])
    prev = fedavg(u).withColumn("round", F.col("round") + 1)
    coords = u.groupBy(*_key(BY)).agg(F.max(F.size("values")).alias("_n"))
    full = coords.join(prev, _key(BY), "left").select(
        *_key(BY), F.coalesce("values", F.array_repeat(F.lit(float(init)), F.col("_n"))).alias("values"))
    return _as(full, updates, BY)


def _with_global(u: DataFrame, global_model: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of the updates with those of the model they started from (``w_g``)."""
    g = _blocked(global_model, by).select(*_key(by), F.col("values").alias("w_g"))
    return u.join(g, _key(by))


# M6 -----------------------------------------------------------------------------------------
def fedprox_penalty(updates: DataFrame, global_model: DataFrame, mu: float = 0.01, by: Sequence[str] = BY) -> DataFrame:
    """(round, client_id, penalty) = mu/2 · ‖w_i − w_g‖²."""
    u = _with_global(_blocked(updates, [*by, *CLIENT]), global_model, by)
    return u.groupBy(*by, "client_id").agg(
        (F.lit(mu / 2.0) * F.sum(B.squares(B.plus("values", "w_g", -1.0)))).alias("penalty"))


# M7 -----------------------------------------------------------------------------------------
def client_table(updates: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per (round, client): n_i and tau_i."""
    return updates.groupBy(*by, "client_id").agg(F.first("num_examples").alias("num_examples"),
                                                 F.first("tau").alias("tau"))


def fednova(updates: DataFrame, global_model: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Normalised averaging (Wang et al. 2020): d_i = (w_g − w_i)/τ_i, p_i = n_i/Σn,
    w = w_g − (Σ p_i τ_i) · Σ p_i d_i."""
    u = _blocked(updates, [*by, *CLIENT])
    rounds = client_table(u, by).groupBy(*by).agg(
        F.sum("num_examples").cast("double").alias("_N"),
        F.sum(F.col("num_examples") * F.col("tau")).cast("double").alias("_NT"))
    u = _with_global(u, global_model, by).withColumn("_d", B.plus("w_g", "values", -1.0))
    s = u.groupBy(*_key(by)).agg(F.first("w_g").alias("w_g"), B.summed(F.col("num_examples") / F.col("tau"), "_d").alias("_S"))
    j = s.join(rounds, list(by))
    step = F.col("_NT") / F.col("_N") / F.col("_N")
    return _as(j.select(*_key(by), B.plus("w_g", "_S", -step).alias("values")), updates, by)


# M8 -----------------------------------------------------------------------------------------
def server_momentum(deltas: DataFrame, momentum: float) -> DataFrame:
    """v_t = m·v_{t−1} + Δ_t over rounds, for histories of any length (``velocity``).

    Rounds are cut into stretches after which a velocity has faded below what a double shows. Within a
    stretch the blocks are added up in order; the velocity at its start is what the stretch before
    ends with. Momentum of 1 or more, which never fades, is a running sum for each element."""
    u = _blocked(deltas, BY)
    if momentum == 0.0:
        return _as(u, deltas, BY, "velocity") if not B.is_blocked(deltas) else u.withColumnRenamed("values", "velocity")
    if momentum >= 1.0:
        w = Window.partitionBy("tensor", "idx").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
        m, long = F.lit(float(momentum)), B.exploded(u, BY)
        long = long.select(*KEY, (F.pow(m, "round") * F.sum(F.col("value") * F.pow(m, -F.col("round"))).over(w)).alias("value"))
        return long.withColumnRenamed("value", "velocity") if not B.is_blocked(deltas) else B.to_blocks(long, BY).withColumnRenamed("values", "velocity")
    length = max(1, math.ceil(46 / math.log(1.0 / momentum)))
    m = F.lit(float(momentum))
    part = F.floor(F.col("round") / F.lit(length)).cast("long")
    g = u.groupBy("tensor", "block", part.alias("_p")).agg(F.array_sort(F.collect_list(F.struct("round", "values"))).alias("_s"))

    def add(done, x):
        last = F.element_at(done, -1)
        faded = F.pow(m, x["round"] - last["round"])
        v = F.when(F.size(done) == 0, x["values"]).otherwise(B.plus(x["values"], last["values"], faded))
        return F.concat(done, F.array(F.struct(x["round"].alias("round"), v.alias("values"))))

    first = F.array().cast(g.schema["_s"].dataType)
    g = g.select("tensor", "block", "_p", F.aggregate("_s", first, add).alias("_v"))
    last = g.select("tensor", "block", (F.col("_p") + 1).alias("_p"), F.element_at("_v", -1).alias("_before"))
    out = g.join(last, ["tensor", "block", "_p"], "left").select("tensor", "block", "_before", F.explode("_v").alias("_x"))
    v, before = F.col("_x")["values"], F.col("_before")
    whole = F.when(before.isNull(), v).otherwise(B.plus(v, before["values"], F.pow(m, F.col("_x")["round"] - before["round"])))
    out = out.select(F.col("_x")["round"].alias("round"), "tensor", "block", whole.alias("values"))
    return out.withColumnRenamed("values", "velocity") if B.is_blocked(deltas) else B.exploded(out, BY, value="velocity")


# M9 -----------------------------------------------------------------------------------------
def _clipped(u: DataFrame, global_model: DataFrame, clip_norm, scope: str, by: Sequence[str]) -> DataFrame:
    u = _with_global(u, global_model, by).withColumn("_d", B.plus("values", "w_g", -1.0))
    grp = [*by, "client_id"] + (["tensor"] if scope == "per_tensor" else [])
    norms = u.groupBy(*grp).agg(F.sqrt(F.sum(B.squares("_d"))).alias("_norm"))
    c = clip_norm if not isinstance(clip_norm, (int, float)) else F.lit(float(clip_norm))
    j = u.join(norms, grp).withColumn("_f", F.least(F.lit(1.0), c / (F.col("_norm") + F.lit(1e-10))))
    return j.select(*by, "client_id", "num_examples", "tensor", "block", "w_g",
                    F.transform("_d", lambda x: x * F.col("_f")).alias("values"))


def dp_clip(updates: DataFrame, global_model: DataFrame, clip_norm: float, scope: str = "flat",
            by: Sequence[str] = BY) -> DataFrame:
    """Clip each client's update Δ_i = w_i − w_g to L2 norm C: Δ·min(1, C/(‖Δ‖+1e-10)), as ``delta``
    beside ``w_g``. ``scope='flat'`` clips the whole update, ``'per_tensor'`` each tensor separately."""
    c = _clipped(_blocked(updates, [*by, *CLIENT]), global_model, clip_norm, scope, by)
    ids = [*by, "client_id", "num_examples"]
    return c.withColumnRenamed("values", "delta") if B.is_blocked(updates) else B.exploded(c, ids, value="delta", others=["w_g"])


# M10 ----------------------------------------------------------------------------------------
def noise_hash(secret, round_col="round", tensor_col="tensor", idx_col="idx"):
    idx = F.col(idx_col) if isinstance(idx_col, str) else idx_col
    return F.md5(F.concat_ws(":", secret, F.col(round_col).cast("string"), F.col(tensor_col), idx.cast("string")))


def dp_fedavg(updates: DataFrame, global_model: DataFrame, clip_norm, noise_multiplier,
              secret: int | None = None, scope: str = "flat", by: Sequence[str] = BY) -> DataFrame:
    """DP-FedAvg (McMahan et al. 2018): w = w_g + (Σ_i clip(Δ_i) + N(0, (z·C)²)) / m with m the
    round's participants (uniform weighting). Noise is a hash-keyed Gaussian per
    (secret, round, tensor, idx): identical under any repartitioning or task retry. The secret
    is a value in a one-row table, not a literal, so neither plans nor event logs show it. A
    fixed one is for tests only; by default a fresh one is drawn from the OS RNG. ``clip_norm`` and
    ``noise_multiplier`` are numbers, or columns of ``updates`` named by ``by``'s configurations."""
    import secrets

    if isinstance(secret, dict):   # by configuration
        secret = {c: secrets.randbits(63) if x is None else x for c, x in secret.items()}
    elif secret is None:
        secret = secrets.randbits(63)
    u = _blocked(updates, [*by, *CLIENT])
    number = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else F.first(x)
    c = _clipped(u, global_model, clip_norm, scope, by)
    m = u.groupBy(*by).agg(F.count_distinct("client_id").alias("_m"), (number(noise_multiplier) * number(clip_norm)).alias("_std"))
    s = c.groupBy(*_key(by)).agg(F.first("w_g").alias("w_g"), B.summed().alias("_sum"))
    return _as(_noised(s.join(m, list(by)), secret, updates.sparkSession, by), updates, by)


def _noised(s: DataFrame, secret, spark, by: Sequence[str]) -> DataFrame:
    own = secret if isinstance(secret, dict) else {0: secret}
    hidden = spark.createDataFrame(spark.sparkContext.parallelize([(c, str(x)) for c, x in own.items()], 1), "_zero int, _secret string")
    s = s.withColumn("_zero", F.col("config_id") if isinstance(secret, dict) else F.lit(0)).join(F.broadcast(hidden), "_zero")
    at = F.sequence(F.lit(0), F.size("_sum") - 1)
    noise = F.transform(at, lambda i: F.col("_std") * gaussian_from_hash(
        noise_hash(F.col("_secret"), idx_col=F.col("block") * B.BLOCK + i)))
    s = s.withColumn("_sum", B.plus("_sum", noise))
    return s.select(*_key(by), B.plus("w_g", "_sum", F.lit(1.0) / F.col("_m")).alias("values"))


# M12 ----------------------------------------------------------------------------------------
def weighted_client_metrics(client_metrics: DataFrame, missing: str = "zero") -> DataFrame:
    """(round, metric, value) = Σ n_i·m_i / Σ n_i. ``missing='zero'`` (reference): a client
    that did not report a metric still counts in the denominator; ``'skip'``: it does not."""
    if missing == "zero":
        tot = client_metrics.select("round", "client_id", "n").distinct().groupBy("round").agg(
            F.sum("n").cast("double").alias("_tot"))
        s = client_metrics.groupBy("round", "metric").agg(F.sum(F.col("n") * F.col("value")).alias("_s"))
        return s.join(tot, "round").select("round", "metric", (F.col("_s") / F.col("_tot")).alias("value"))
    if missing == "skip":
        return client_metrics.groupBy("round", "metric").agg(
            (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))
    raise ValueError(f"missing must be 'zero' or 'skip', got {missing!r}")


STRATEGIES = {"fedavg", "fedprox", "fednova", "dp"}


def aggregate_round(strategy: str, updates: DataFrame, global_model: DataFrame, by: Sequence[str] = BY, **kw) -> DataFrame:
    """M15 registry: case-insensitive strategy name -> aggregated model of each round."""
    s = strategy.lower()
    if s in ("fedavg", "fedprox"):   # the proximal term acts inside local training
        return fedavg(updates, by=by)
    if s == "fednova":
        return fednova(updates, global_model, by)
    if s in ("dp", "feddp", "dp-fedavg"):
        return dp_fedavg(updates, global_model, kw.get("clip_norm", 1.0), kw.get("noise_multiplier", 1.0),
                         kw.get("secret"), kw.get("scope", "flat"), by)
    raise ValueError(f"unknown strategy {strategy!r}; expected one of {sorted(STRATEGIES)}")
