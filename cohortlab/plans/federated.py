"""Federated round loop (M14-M17): sample -> local fit (executors) -> aggregate (executors)
-> collect the models (driver, model-sized) -> evaluate (executors) -> commit the round.

All configurations of a sweep go through a round together: ``config_id`` is a grouping key, so a round
is the same few jobs however many configurations there are. A round's models and history are written
by (experiment, round) and then committed by a row of their own; a run that is started again goes on
behind its last commit. Models travel as a broadcast (bounded by the architecture), so lineage
does not grow from round to round.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import materialize
from ..functions.ordering import rank_cuts, small
from ..operators import metrics as M
from ..operators import params as PM
from ..operators import privacy
from ..operators import train as TR
from ..session import ensure_checkpoint_dir
from ..sources.sinks import write_rounds


@dataclass
class FedConfig:
    strategy: str = "fedavg"
    n_rounds: int = 5
    hidden: tuple = ()
    norm: bool = False              # normalise hidden layers over their batch
    dropout: float = 0.0
    zero_init: bool = False
    local_epochs: int = 1
    batch_size: int | None = 64     # None: each epoch is one step over all of a client's rows
    lr: float = 0.01
    mu: float = 0.0                 # FedProx proximal weight (strategy "fedprox")
    fraction_fit: float = 1.0
    min_fit_clients: int = 1
    min_available_clients: int = 1
    server_momentum: float = 0.0
    clip_norm: float = 1.0          # DP
    noise_multiplier: float = 1.0   # DP; 0 is refused, it would give no privacy
    clip_scope: str = "flat"        # DP: "flat" or "per_tensor"
    delta: float = 1e-5             # DP
    max_order: int = privacy.MAX_ORDER   # DP: highest Rényi order of the ledger
    dp_secret: int | None = None
    n_shards: int = 1               # parts that a client's rows are trained in
    seed: int = 42
    experiment: str = "run"
    round_overrides: dict = field(default_factory=dict)   # M16: {round: {"local_epochs": .., "mu": ..}}


def published(**changes) -> FedConfig:
    """The stated defaults: three normalised hidden layers with dropout, 50 rounds of 3 local epochs in
    batches of 512."""
    return FedConfig(**{**dict(hidden=(128, 64, 32), norm=True, dropout=0.3, n_rounds=50, local_epochs=3, batch_size=512,
                               lr=0.001), **changes})


@dataclass
class FedResult:
    model: list
    history: DataFrame   # (experiment, strategy, round, kind, scope, client_id, metric, value)
    models: dict = field(default_factory=dict)   # by experiment


HISTORY = ["experiment", "strategy", "round", "kind", "scope", "client_id", "metric", "value"]
HISTORY_SCHEMA = ("strategy string, kind string, scope string, client_id int, metric string, value double, "
                  "experiment string, round int")
MODEL_SCHEMA = "role string, tensor string, block int, values array<double>, experiment string, round int"
COMMIT_SCHEMA = "digest string, sample_rate double, experiment string, round int"


def _stored(spark, path: str, schema: str) -> DataFrame:
    """A table of the run, empty before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _digest(cfg: FedConfig, n_features: int, n_classes: int) -> str:
    """What a run must have in common with the one it goes on from: all settings but the number of rounds."""
    own = {k: v for k, v in asdict(cfg).items() if k not in ("n_rounds", "dp_secret")}
    return hashlib.sha256(repr((sorted(own.items()), n_features, n_classes)).encode()).hexdigest()


def _evaluated(evald: DataFrame, models: dict, features, label, client_col) -> DataFrame:
    """(config_id, kind, scope, client_id, metric, value) from one scan and one aggregate of all models."""
    rows = TR.score_configs(evald, models, client_col, features, label)
    counts = materialize(rows.groupBy("config_id", "client_id", "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("ce_sum")))
    # every count stands for its client and for all of them
    scopes = F.array(F.struct(F.lit("client").alias("scope"), F.col("client_id")),
                     F.struct(F.lit("global").alias("scope"), F.lit(None).cast("int").alias("client_id")))
    both = counts.select("config_id", F.explode(scopes).alias("s"), "y_true", "y_pred", "n", "ce_sum").select(
        "config_id", "s.scope", "s.client_id", "y_true", "y_pred", "n", "ce_sum")
    return M.eval_from_counts(both, ["config_id", "scope", "client_id"]).withColumn("kind", F.lit("eval"))


def _fitted(updates: DataFrame) -> DataFrame:
    """Training loss and examples of each client, and over all of them."""
    per = updates.groupBy("config_id", "client_id").agg(F.first("num_examples").cast("double").alias("n"), F.first("loss").alias("loss"))
    whole = per.groupBy("config_id").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("loss")) / F.sum("n")).alias("loss"))
    both = per.withColumn("scope", F.lit("client")).unionByName(
        whole.withColumn("scope", F.lit("global")).withColumn("client_id", F.lit(None).cast("int")))
    pairs = F.array(F.struct(F.lit("loss").alias("metric"), F.col("loss").alias("value")),
                    F.struct(F.lit("n").alias("metric"), F.col("n").alias("value")))
    return both.select("config_id", F.lit("fit").alias("kind"), "scope", "client_id", F.explode(pairs).alias("s")).select(
        "config_id", "kind", "scope", "client_id", "s.metric", "s.value")


def _ledger_rows(spark, cfg: FedConfig, rates: list) -> DataFrame:
    """epsilon, epsilon_round and delta of every round so far, from the rounds' sample rates."""
    rounds = spark.createDataFrame([(cfg.experiment, r, q, float(cfg.noise_multiplier)) for r, q in rates],
                                   "experiment string, round int, sample_rate double, noise_multiplier double")
    led = privacy.privacy_ledger(rounds, cfg.delta, cfg.max_order)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in (
        ("epsilon", F.col("epsilon")), ("epsilon_round", F.col("epsilon_round")), ("delta", F.lit(float(cfg.delta))))])
    return led.select(F.lit(cfg.experiment).alias("experiment"), F.lit(cfg.strategy.lower()).alias("strategy"), "round",
                      F.lit("privacy").alias("kind"), F.lit("global").alias("scope"),
                      F.lit(None).cast("int").alias("client_id"), F.explode(pairs).alias("s")).select(
        "experiment", "strategy", "round", "kind", "scope", "client_id", "s.metric", "s.value")


def _sampled(clients: DataFrame, configs: dict, rnd: int) -> DataFrame:
    """(config_id, client_id) of a round: each configuration's share of the clients, as ``sample_clients`` draws
    it, all in one cut."""
    spark = clients.sparkSession
    share = spark.createDataFrame([(c, float(cfg.fraction_fit), cfg.min_fit_clients, str(cfg.seed)) for c, cfg in configs.items()],
                                  "config_id int, _fraction double, _least int, _seed string")
    # a row for each configuration, times the clients: what is trained
    each = clients.withColumn("config_id", F.explode(F.array(*[F.lit(c) for c in configs])))
    if all(cfg.fraction_fit >= 1.0 for cfg in configs.values()):
        return each.select("config_id", "client_id")
    drawn = F.md5(F.concat_ws(":", F.col("client_id").cast("string"), "_seed", F.lit(str(rnd))))
    d = each.join(F.broadcast(share), "config_id").withColumn("_h", drawn)
    whole = F.col("_fraction") >= 1.0
    quota = F.when(whole, F.col("_gn")).otherwise(
        F.greatest(F.floor(F.col("_gn") * F.col("_fraction")).cast("long"), F.col("_least").cast("long")))
    cut = rank_cuts(d.select("config_id", "client_id", "_h"), "_h", "client_id", F.array(quota), partition_by=["config_id"],
                    group_info=F.broadcast(share), out="_past")
    return cut.where("_past = 0").select("config_id", "client_id")


def _aggregated(updates: DataFrame, models: dict, configs: dict, rnd: int) -> dict:
    """The configurations' next models. Those of one strategy are one aggregate; what their settings
    differ in are columns."""
    spark, by = updates.sparkSession, ("config_id", "round")
    glob = spark.createDataFrame([(c, rnd, *b) for c, m in models.items() for b in TR.model_blocks(m)],
                                 "config_id int, round int, tensor string, block int, values array<double>")
    weights, parts = updates.where(~TR.is_moment()), []
    groups: dict = {}
    for c, cfg in configs.items():
        s = cfg.strategy.lower()
        kind = (("dp", cfg.clip_scope) if s in ("dp", "feddp", "dp-fedavg") else ("fednova", "") if s == "fednova" else ("fedavg", ""))
        groups.setdefault(kind, []).append(c)
    for (kind, scope), own in groups.items():
        u, kw = weights.where(F.col("config_id").isin(own)), {}
        if kind == "dp":
            setting = spark.createDataFrame([(c, float(configs[c].clip_norm), float(configs[c].noise_multiplier)) for c in own],
                                            "config_id int, _clip double, _noise double")
            u = u.join(F.broadcast(setting), "config_id")
            secrets = {c: configs[c].dp_secret for c in own}
            kw = {"clip_norm": F.col("_clip"), "noise_multiplier": F.col("_noise"), "scope": scope, "secret": secrets}
        parts.append(PM.aggregate_round(kind, u, glob, by, **kw).select("config_id", "tensor", "block", "values"))
    if any(cfg.norm for cfg in configs.values()):
        parts.append(TR.merged_moment_blocks(updates, ["config_id"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rows, found = out.collect(), {}
    for c, m in models.items():
        found.update(TR.models_from_blocks([r for r in rows if r["config_id"] == c], m))
    return found


def federated_sweep(data: DataFrame, key: str, configs: Sequence[FedConfig], features: str = "features", label: str = "label",
                    client_col: str = "client_id", split_col: str = "split", materialize_as: str = "persist",
                    run_dir: str | None = None) -> FedResult:
    """Train all configurations, named apart by ``experiment``, side by side on rows that carry
    ``client_id`` and ``split`` ('train' / 'val'); one history of all of them, as separate runs give.

    ``run_dir``: folder that all executors share, where models, history and commits are kept. A run
    that finds commits of its experiments there goes on behind the last one, and ends at once if there is nothing left
    to do; settings may differ from the stored run's in the number of rounds only. Without it the
    run has a folder of its own beside the checkpoints. ``materialize_as``: 'persist'
    (memory and disk) or 'checkpoint' (copy in spark.checkpoint.dir).
    """
    spark = data.sparkSession
    root = run_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds-{uuid4().hex}"
    cfgs = dict(enumerate(configs))
    for cfg in cfgs.values():
        if cfg.strategy.lower() not in PM.STRATEGIES:
            raise ValueError(f"unknown strategy {cfg.strategy!r}; expected one of {sorted(PM.STRATEGIES)}")
        if cfg.strategy.lower() == "dp" and cfg.noise_multiplier <= 0:
            raise ValueError("strategy 'dp' needs a noise_multiplier above 0")
        if cfg.strategy.lower() == "dp" and cfg.norm:
            raise ValueError("strategy 'dp' doesn't cover the moments of normalised layers")
    if len({cfg.experiment for cfg in cfgs.values()}) != len(cfgs):
        raise ValueError("configurations need experiment names of their own")
    data = data.persist(StorageLevel.MEMORY_AND_DISK)   # read by the size probes below and both splits
    meta = data.agg(F.max(F.size(features)).alias("f"), F.max(label).alias("k")).first()
    n_features, n_classes = int(meta["f"]), int(meta["k"]) + 1
    train = data.where(F.col(split_col) == "train").withColumn("client_id", F.col(client_col).cast("int"))
    evald = data.where(F.col(split_col) != "train").select(client_col, features, label)
    keep = (lambda df: df.checkpoint(eager=True)) if materialize_as == "checkpoint" else (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK))
    train, evald = keep(train), keep(evald)
    clients = materialize(train.select("client_id").distinct())
    n_clients = clients.count()
    if any(n_clients < cfg.min_available_clients for cfg in cfgs.values()):
        raise ValueError(f"{n_clients} clients are fewer than min_available_clients")

    digests = {c: _digest(cfg, n_features, n_classes) for c, cfg in cfgs.items()}
    models = {c: TR.init_model(TR.layer_dims(n_features, n_classes, cfg.hidden), cfg.seed, cfg.norm, cfg.zero_init)
              for c, cfg in cfgs.items()}
    velocity: dict = {}
    done = _resumed(spark, root, cfgs, digests, models, velocity) if run_dir else {c: -1 for c in cfgs}
    last = max((cfg.n_rounds for cfg in cfgs.values()), default=0)
    for rnd in range(min(done.values(), default=-1) + 1, last + 1):
        own = {c: cfg for c, cfg in cfgs.items() if done[c] < rnd <= cfg.n_rounds}
        if own:
            _round(rnd, own, train, evald, clients, n_clients, models, velocity, digests, root, key, features, label, client_col)
    for df in (train, evald, data):
        df.unpersist()
    names = [cfg.experiment for cfg in cfgs.values()]
    commits = [r for r in _stored(spark, f"{root}/commits", COMMIT_SCHEMA).collect() if r["experiment"] in names]
    upto = spark.createDataFrame([(cfg.experiment, cfg.n_rounds) for cfg in cfgs.values()], "experiment string, _last int")
    hist = _stored(spark, f"{root}/history", HISTORY_SCHEMA).join(F.broadcast(upto), "experiment").where("round <= _last").select(*HISTORY)
    for cfg in cfgs.values():
        rates = sorted((r["round"], r["sample_rate"]) for r in commits if r["experiment"] == cfg.experiment and 0 < r["round"] <= cfg.n_rounds)
        if cfg.strategy.lower() == "dp" and rates:
            hist = hist.unionByName(materialize(_ledger_rows(spark, cfg, rates)))
    return FedResult(models.get(0), hist, {cfg.experiment: models[c] for c, cfg in cfgs.items()})


def _resumed(spark, root: str, cfgs: dict, digests: dict, models: dict, velocity: dict) -> dict:
    """The last committed round of each configuration, -1 if there is none; its model and velocity are
    put in the place of the first ones."""
    names = {cfg.experiment: c for c, cfg in cfgs.items()}
    done = {c: -1 for c in cfgs}
    for r in _stored(spark, f"{root}/commits", COMMIT_SCHEMA).collect():
        c = names.get(r["experiment"])
        if c is not None:
            if r["digest"] != digests[c]:
                raise ValueError(f"{root} holds a run of {r['experiment']!r} with other settings")
            done[c] = max(done[c], min(r["round"], cfgs[c].n_rounds))
    at = [(cfgs[c].experiment, r) for c, r in done.items() if r >= 0]
    if at:
        wanted = spark.createDataFrame(at, "experiment string, round int")
        rows = _stored(spark, f"{root}/models", MODEL_SCHEMA).join(F.broadcast(wanted), ["experiment", "round"]).collect()
        for c, template in list(models.items()):
            for role, out in (("model", models), ("velocity", velocity)):
                own = [{**r.asDict(), "config_id": c} for r in rows if r["role"] == role and names[r["experiment"]] == c]
                if own:
                    out.update(TR.models_from_blocks(own, template))
    return done


def _round(rnd, cfgs, train, evald, clients, n_clients, models, velocity, digests, root, key, features, label, client_col) -> None:
    """One round of the given configurations, 0 being the evaluation of the first models, up to its commit."""
    spark, rates = train.sparkSession, {c: 1.0 for c in cfgs}
    updates = None
    if rnd:
        sampled = materialize(_sampled(clients, cfgs, rnd))
        rates.update({r["config_id"]: r["count"] / n_clients for r in sampled.groupBy("config_id").count().collect()})
        how, shards = {}, {}
        for c, cfg in cfgs.items():
            ov = cfg.round_overrides.get(rnd, {})
            how[c] = {"epochs": ov.get("local_epochs", cfg.local_epochs), "mu": ov.get("mu", cfg.mu if cfg.strategy.lower() == "fedprox" else 0.0),
                      "batch_size": cfg.batch_size, "lr": cfg.lr, "dropout": cfg.dropout, "seed": cfg.seed}
            shards[c] = cfg.n_shards, cfg.seed
        part = train.join(small(sampled), "client_id")
        now = {c: models[c] for c in cfgs}
        whole = {c: now[c] for c, h in how.items() if h["batch_size"] is None and shards[c][0] == 1}
        some = {c: now[c] for c in now if c not in whole}
        fitted = []
        if some:
            number = F.lit(0)
            for own in set(shards.values()):
                of = [c for c in some if shards[c] == own]
                number = F.when(F.col("config_id").isin(of), TR.shard_number(key, *own)).otherwise(number) if of else number
            fitted.append(TR.local_train(part.withColumn("shard_id", number), some, key, features, label, "client_id",
                                         seed=0, round_no=rnd, configs={c: how[c] for c in some}))
        if whole:
            fitted.append(TR.full_batch_train(part, whole, features, label, "client_id", configs={c: how[c] for c in whole}))
        updates = fitted[0]
        for f in fitted[1:]:
            updates = updates.unionByName(f)
        norm = any(cfg.norm for cfg in cfgs.values())
        updates = materialize(TR.combine_shard_blocks(updates, norm).withColumn("round", F.lit(rnd)))
        new = _aggregated(updates, now, cfgs, rnd)
        for c, cfg in cfgs.items():
            model = new.get(c, now[c])
            if cfg.server_momentum:
                step = [(nm, a - b) for (nm, a), (_, b) in zip(model, now[c])]
                if c in velocity:
                    step = [(nm, cfg.server_momentum * v + d) for (nm, v), (_, d) in zip(velocity[c], step)]
                velocity[c] = step
                moved = {nm: b + v for (nm, b), (_, v) in zip(now[c], step)}
                model = [(nm, moved[nm] if TR.is_trained(nm) else a) for nm, a in model]
            models[c] = model
    rows = _evaluated(evald, {c: models[c] for c in cfgs}, features, label, client_col)
    if updates is not None:
        rows = rows.unionByName(_fitted(updates))
    named = spark.createDataFrame([(c, cfg.experiment, cfg.strategy.lower()) for c, cfg in cfgs.items()],
                                  "config_id int, experiment string, strategy string")
    rows = rows.join(F.broadcast(named), "config_id").withColumn("round", F.lit(rnd)).select(*HISTORY)
    kept = [(cfgs[c].experiment, rnd, role, *b) for c in cfgs for role, m in (("model", models[c]), ("velocity", velocity.get(c)))
            if m is not None for b in TR.model_blocks(m)]
    write_rounds(spark.createDataFrame(kept, "experiment string, round int, role string, tensor string, block int, values array<double>"),
                 f"{root}/models")
    write_rounds(rows, f"{root}/history")
    write_rounds(spark.createDataFrame([(cfg.experiment, rnd, digests[c], float(rates[c])) for c, cfg in cfgs.items()],
                                       "experiment string, round int, digest string, sample_rate double"), f"{root}/commits")


def federated_train(data: DataFrame, key: str, cfg: FedConfig, features: str = "features", label: str = "label",
                    client_col: str = "client_id", split_col: str = "split", materialize: str = "persist",
                    run_dir: str | None = None) -> FedResult:
    """One configuration's run; see ``federated_sweep``."""
    return federated_sweep(data, key, [cfg], features, label, client_col, split_col, materialize, run_dir)


def sweep(data: DataFrame, key: str, configs: Sequence[FedConfig], **kw) -> DataFrame:
    """Several configurations in one run; one history table keyed by experiment."""
    return federated_sweep(data, key, configs, **kw).history


def global_history(history: DataFrame) -> DataFrame:
    """Evaluation rows of the global scope in the (experiment, strategy, round, metric, value)
    shape that the history operators take."""
    return history.where("scope = 'global' AND kind = 'eval'").select("experiment", "strategy", "round", "metric", "value")
