"""Local training and scoring (M2-M4, M6 proximal term) as Spark tasks.

The model is a small list of numpy tensors (bounded by the architecture, never by the data); models
travel as a broadcast of checked size and come back as blocks of the parameter table (``blocks``).

Mini-batches: rows are dealt out by (configuration, client, shard) and sorted by epoch and a hash of
their key outside memory. A task reads them as a stream and holds one mini-batch, or ``MICRO`` rows
of a larger one, whatever the size of a client. Steps over all of a client's rows
(``full_batch_train``) are aggregates: each task sums the gradients of its rows, the sums are
combined before the shuffle, and the optimizer is arithmetic on the parameter table.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_hex, materialize
from . import blocks as B
from .blocks import BLOCK   # for the workers, which can't import this package


def _ship_by_value() -> None:
    # the numpy helpers below run inside Python workers; pickling this module by value means
    # executors need only numpy/pyarrow, not this package on their PYTHONPATH
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()

#: rows of a mini-batch whose activations are held at a time
MICRO = 8192
#: bytes of all models that are sent to every task at most
MODEL_BYTES = 1 << 28
#: clients whose gradients a task holds before it hands on their sums
HELD = 64
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
NORM_EPS = 1e-5
BLOCKS = ("config_id int, client_id int, shard_id int, tensor string, block int, values array<double>, "
          "num_examples long, tau long, loss double")


# M3: model ----------------------------------------------------------------------------------
def layer_dims(n_features: int, n_classes: int, hidden: Sequence[int] = (128, 64, 32)) -> list[int]:
    return [n_features, *hidden, n_classes]


def init_model(dims: Sequence[int], seed: int = 42, norm: bool = False, zero: bool = False) -> list[tuple[str, np.ndarray]]:
    """Linear layers, uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) like the usual Linear default, or
    zeros. ``norm``: each hidden layer is normalised over its batch (``scale``, ``shift``), and keeps the
    moments of what it has seen: ``count``, ``mean`` and ``spread`` (sum of squared deviations)."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(len(dims) - 1):
        bound = 0.0 if zero else 1.0 / math.sqrt(dims[i])
        out.append((f"W{i}", rng.uniform(-bound, bound, size=(dims[i + 1], dims[i]))))
        out.append((f"b{i}", rng.uniform(-bound, bound, size=(dims[i + 1],))))
        if norm and i < len(dims) - 2:
            k = dims[i + 1]
            out += [(f"scale{i}", np.ones(k)), (f"shift{i}", np.zeros(k)), (f"count{i}", np.zeros(1)),
                    (f"mean{i}", np.zeros(k)), (f"spread{i}", np.zeros(k))]
    return out


def is_trained(name: str) -> bool:
    """Whether a tensor is a weight, and not one of the moments."""
    return not name.startswith(("count", "mean", "spread"))


def n_params(model) -> int:
    return int(sum(a.size for nm, a in model if is_trained(nm)))


def n_layers(model) -> int:
    return sum(nm.startswith("W") for nm, _ in model)


def forward(model, X: np.ndarray) -> np.ndarray:
    """Logits in evaluation mode: layers are normalised by the moments kept, and nothing is dropped."""
    t, h, last = dict(model), X, n_layers(model) - 1
    for i in range(last + 1):
        h = h @ t[f"W{i}"].T + t[f"b{i}"]
        if i < last:
            if f"scale{i}" in t:
                n = t[f"count{i}"][0]
                var = t[f"spread{i}"] / n if n else np.ones(h.shape[1])
                h = (h - t[f"mean{i}"]) / np.sqrt(var + NORM_EPS) * t[f"scale{i}"] + t[f"shift{i}"]
            h = np.maximum(h, 0.0)
    return h


def _softmax(z):
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def backprop(model, X, y, dropout: float = 0.0, rng=None):
    """(sum of the losses, its gradient by tensor, moments (count, mean, spread) by layer) in training
    mode: layers are normalised over these rows, and ``rng`` draws what is dropped."""
    t, h, last, n = dict(model), X, n_layers(model) - 1, len(X)
    kept, moments = [], {}
    for i in range(last):
        z, inputs, hat, root, mask = h @ t[f"W{i}"].T + t[f"b{i}"], h, None, None, None
        if f"scale{i}" in t:
            mean, var = z.mean(axis=0), z.var(axis=0)
            moments[i] = n, mean, var * n
            root = 1.0 / np.sqrt(var + NORM_EPS)
            hat = (z - mean) * root
            z = hat * t[f"scale{i}"] + t[f"shift{i}"]
        h = np.maximum(z, 0.0)
        if dropout:
            mask = (rng.random(h.shape) >= dropout) / (1.0 - dropout)
            h = h * mask
        kept.append((inputs, z > 0, hat, root, mask))
    p = _softmax(h @ t[f"W{last}"].T + t[f"b{last}"])
    loss = float(-np.log(np.clip(p[np.arange(n), y], 1e-12, None)).sum())
    d = p
    d[np.arange(n), y] -= 1.0
    grads = {f"W{last}": d.T @ h, f"b{last}": d.sum(axis=0)}
    for i in reversed(range(last)):
        inputs, on, hat, root, mask = kept[i]
        d = (d @ t[f"W{i + 1}"]) * on
        if mask is not None:
            d *= mask
        if hat is not None:
            grads[f"scale{i}"], grads[f"shift{i}"] = (d * hat).sum(axis=0), d.sum(axis=0)
            d = t[f"scale{i}"] * root * (d - d.mean(axis=0) - hat * (d * hat).mean(axis=0))
        grads[f"W{i}"], grads[f"b{i}"] = d.T @ inputs, d.sum(axis=0)
    return loss, grads, moments


def _grads(model, X, y):
    """Mean loss and its gradients in the model's order (None for moments)."""
    loss, grads, _ = backprop(model, X, y)
    return loss / len(X), [grads[nm] / len(X) if nm in grads else None for nm, _ in model]


def merged_moments(a, b):
    """Moments (count, mean, sum of squared deviations) of two sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


class Learner:
    """Mini-batch Adam on cross-entropy (+ mu/2·‖w − w_g‖² when mu > 0, FedProx), fed with rows in order.

    A batch larger than ``MICRO`` rows is taken in parts whose gradients are added up. Layers that are
    normalised or dropped from need their batch at once, so it is kept until it is full."""

    def __init__(self, model, batch_size: int | None = 512, lr: float = 1e-3, mu: float = 0.0, start=None,
                 dropout: float = 0.0, key: Sequence[int] = (42,)):
        self.names = [nm for nm, _ in model]
        self.params = {nm: a.astype(np.float64).copy() for nm, a in model}
        self.start = dict(start or model)
        self.first, self.second = ({nm: np.zeros_like(a) for nm, a in self.params.items() if is_trained(nm)} for _ in range(2))
        self.size, self.lr, self.mu, self.dropout, self.key = batch_size, lr, mu, dropout, [x % (1 << 63) for x in key]
        self.at_once = bool(dropout) or any(nm.startswith("scale") for nm in self.names)
        if self.at_once and (batch_size is None or batch_size > MICRO):
            raise ValueError(f"normalised or dropped layers need batches of {MICRO} rows or fewer")
        self.steps = self.examples = 0
        self._reset()
        self._epoch()

    def _reset(self):
        self.sums, self.have, self.held = {}, 0, []

    def _epoch(self):
        self.total, self.rows, self.moments = 0.0, 0, {}

    @property
    def model(self):
        return [(nm, self.params[nm]) for nm in self.names]

    def feed(self, X: np.ndarray, y: np.ndarray) -> None:
        at = 0
        while at < len(X):
            room = len(X) if self.size is None else self.size - self.have
            take = min(room, len(X) - at, MICRO)
            part, at = (X[at:at + take].astype(np.float64), y[at:at + take]), at + take
            self.have += take
            if self.at_once:
                self.held.append(part)
            else:
                self._add(*part)
            if self.have == self.size:
                self._step()

    def _add(self, X, y):
        rng = np.random.default_rng([*self.key, self.steps]) if self.dropout else None
        loss, grads, moments = backprop(self.model, X, y, self.dropout, rng)
        self.total, self.rows = self.total + loss, self.rows + len(X)
        for nm, g in grads.items():
            self.sums[nm] = self.sums[nm] + g if nm in self.sums else g
        for i, m in moments.items():
            self.moments[i] = merged_moments(self.moments[i], m) if i in self.moments else m

    def _step(self):
        if self.held:
            self._add(*(np.concatenate([p[k] for p in self.held]) for k in (0, 1)))
        self.steps += 1
        for nm, total in self.sums.items():
            g = total / self.have + (self.mu * (self.params[nm] - self.start[nm]) if self.mu else 0.0)
            self.first[nm] = BETA1 * self.first[nm] + (1 - BETA1) * g
            self.second[nm] = BETA2 * self.second[nm] + (1 - BETA2) * g * g
            first, second = self.first[nm] / (1 - BETA1 ** self.steps), self.second[nm] / (1 - BETA2 ** self.steps)
            self.params[nm] = self.params[nm] - self.lr * first / (np.sqrt(second) + TINY)
        self._reset()

    def end_epoch(self) -> None:
        """What is left is a batch. The loss and the moments are those of the last epoch."""
        if self.have:
            self._step()
        self.loss, self.examples = self.total / max(self.rows, 1), self.rows
        for i, (n, mean, spread) in self.moments.items():
            self.params[f"count{i}"], self.params[f"mean{i}"], self.params[f"spread{i}"] = np.array([float(n)]), mean, spread
        self._epoch()


def train_local(model, X, y, epochs=3, batch_size=512, lr=1e-3, mu=0.0, global_model=None, seed=42, dropout=0.0):
    """Training on rows in memory. Returns (model, steps, mean loss of the last epoch)."""
    own, rng = Learner(model, batch_size, lr, mu, global_model or model, dropout, (seed,)), np.random.default_rng(seed)
    own.loss = 0.0
    for _ in range(epochs):
        order = rng.permutation(len(X))
        own.feed(X[order], y[order])
        own.end_epoch()
    return own.model, own.steps, own.loss


def model_blocks(model) -> list[tuple[str, int, list]]:
    """(tensor, block, values) of a model."""
    return [(nm, b // BLOCK, flat[b:b + BLOCK].tolist())
            for nm, a in model for flat in [a.ravel().astype(np.float64)] for b in range(0, len(flat), BLOCK)]


def model_to_rows(model) -> list[tuple[str, int, float]]:
    return [(nm, i, float(x)) for nm, a in model for i, x in enumerate(a.ravel())]


def models_from_blocks(rows, template) -> dict:
    """Models by configuration from collected rows (config_id, tensor, block, values). Tensors that no
    row speaks of are the template's."""
    out = {}
    for r in rows:
        model = out.setdefault(r["config_id"], {nm: a.astype(np.float64).ravel().copy() for nm, a in template})
        model[r["tensor"]][r["block"] * BLOCK:r["block"] * BLOCK + len(r["values"])] = r["values"]
    return {c: [(nm, m[nm].reshape(a.shape)) for nm, a in template] for c, m in out.items()}


def model_from_table(params: DataFrame, template) -> list[tuple[str, np.ndarray]]:
    """Collect a model-sized parameter table (blocks, or tensor, idx, value) into numpy tensors."""
    b = params if B.is_blocked(params) else B.to_blocks(params, [])
    rows = b.select(F.lit(0).alias("config_id"), "tensor", "block", "values").collect()
    return models_from_blocks(rows, template).get(0, [(nm, a.copy()) for nm, a in template])


def shipped(spark, models: dict):
    """Broadcast models by configuration, if they are of a size for that."""
    size = sum(a.nbytes for m in models.values() for _, a in m)
    if size > MODEL_BYTES:
        raise ValueError(f"models of {size} bytes; at most {MODEL_BYTES} are sent to every task")
    return spark.sparkContext.broadcast(models)


# M2 -----------------------------------------------------------------------------------------
def with_shards(df: DataFrame, key: str, n_shards: int = 1, seed: int = 42) -> DataFrame:
    """shard_id = hash(key) mod n_shards. One shard per client reproduces the reference's single
    local run; with more, each trains on its part and the models are averaged, which is another
    algorithm. So the number is a parameter of the run, never derived from the data's size."""
    return df.withColumn("shard_id", shard_number(key, n_shards, seed))


def shard_number(key: str, n_shards: int = 1, seed: int = 42):
    h = F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("long")
    return (h % F.lit(n_shards)).cast("int")


def _matrix(column, rows: int) -> np.ndarray:
    """The buffer behind a column of equally long lists, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def usable(df: DataFrame, features: str, label: str, n_features: int) -> DataFrame:
    """Rows that a model can be fed with: a label, and as many features as it takes, none of them null."""
    x = F.col(features)
    return df.where(F.col(label).isNotNull() & (F.size(x) == n_features) & F.forall(x, lambda v: v.isNotNull()))


def local_train(df: DataFrame, model, key: str, features: str = "features", label: str = "label",
                client_col: str = "client_id", epochs: int = 3, batch_size: int | None = 512, lr: float = 1e-3,
                mu: float = 0.0, seed: int = 42, round_no: int = 0, dropout: float = 0.0, configs: dict | None = None) -> DataFrame:
    """Train every (client, shard) and return blocks of its parameters with ``num_examples``, ``tau`` (local
    steps) and the last epoch's ``loss``.

    ``model`` is one model; or models by configuration, with ``configs`` {config_id: settings} and rows that
    carry ``config_id``: all configurations then train side by side in one job. A configuration's
    settings are the parameters of the same names. ``batch_size=None``: each epoch is one step. Batches
    follow a hash of key, seed, round and epoch, so reruns agree. A task holds a mini-batch (``MICRO`` rows
    of a larger one), the model with its optimizer state, and one Arrow batch.
    """
    models = model if isinstance(model, dict) else {0: model}
    plain = {"epochs": epochs, "batch_size": batch_size, "lr": lr, "mu": mu, "dropout": dropout, "seed": seed}
    how = {c: {**plain, **(configs or {}).get(c, {})} for c in models}
    n_features = dict(next(iter(models.values())))["W0"].shape[1]
    sent = shipped(df.sparkSession, models)
    d = usable(df, features, label, n_features)
    for name in ("shard_id", "config_id"):
        if name not in d.columns:
            d = d.withColumn(name, F.lit(0))
    d = d.where(F.col("config_id").isin(list(models)))
    per = F.create_map(*[F.lit(x) for c in how for x in (c, max(0, how[c]["epochs"]))])
    seeds = F.create_map(*[F.lit(x) for c in how for x in (c, str(how[c]["seed"]))])
    d = d.select("config_id", F.col(client_col).cast("int").alias("client_id"), "shard_id", F.col(features).alias("x"),
                 F.col(label).cast("int").alias("y"), F.col(key).cast("string").alias("_key"),
                 F.explode(F.sequence(F.lit(1), per[F.col("config_id")])).alias("epoch"))
    order = F.md5(F.concat_ws(":", "_key", seeds[F.col("config_id")], F.lit(str(round_no)), F.col("epoch").cast("string")))
    group = ["config_id", "client_id", "shard_id"]
    d = d.select(*group, "epoch", order.alias("order"), "y", "x")
    d = d.repartition(*group).sortWithinPartitions(*group, "epoch", "order").drop("order")

    def fit(batches):
        import pyarrow as pa

        now, own = None, None

        def rows():
            own.end_epoch()
            found = model_blocks(own.model)
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([x] * n, pa.int32()) for x in now[:3]] + [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array([own.examples] * n, pa.int64()),
                 pa.array([own.steps] * n, pa.int64()), pa.array([own.loss] * n, pa.float64())],
                names=["config_id", "client_id", "shard_id", "tensor", "block", "values", "num_examples", "tau", "loss"])

        for batch in batches:
            ids = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            X, y = _matrix(batch.column(5), batch.num_rows), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                this = tuple(ids[a].tolist())
                if now is None or this[:3] != now[:3]:
                    if now is not None:
                        yield rows()
                    h, (c, client, shard) = how[this[0]], this[:3]
                    own = Learner(sent.value[c], h["batch_size"], h["lr"], h["mu"], None, h["dropout"],
                                  (h["seed"], round_no, client, shard))
                elif this[3] != now[3]:
                    own.end_epoch()
                now = this
                own.feed(X[a:b], y[a:b])
        if now is not None:
            yield rows()

    return d.mapInArrow(fit, BLOCKS)


def combine_shard_blocks(shards: DataFrame, moments: bool = True) -> DataFrame:
    """Client update = n-weighted mean over its shards; tau = n-weighted mean of shard steps. The shards'
    ``moments``, if models have some, are put together as those of all their rows; the shards are written
    for that, since they are read more than once."""
    ids, n = ["config_id", "client_id"], F.col("num_examples").cast("double")
    shards = materialize(shards) if moments else shards
    g = shards.groupBy(*ids, "tensor", "block").agg(
        B.averaged(n).alias("values"), F.sum("num_examples").alias("num_examples"),
        F.round(F.sum(n * F.col("tau")) / F.sum(n)).cast("long").alias("tau"), (F.sum(n * F.col("loss")) / F.sum(n)).alias("loss"))
    return _with_moments(g, shards, ids) if moments else g


def is_moment(tensor: str = "tensor"):
    return F.col(tensor).rlike("^(count|mean|spread)[0-9]+$")


def merged_moment_blocks(parts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Moments of ``parts`` (``count``, ``mean``, ``spread`` tensors of each shard or client) as those of all their rows, by
    ``ids``: (ids..., tensor, block, values). Counts add up, the mean is weighted by them, and the spread is the
    parts' spreads plus that between their means."""
    part = [c for c in parts.columns if c in ("config_id", "round", "client_id", "shard_id")]
    p = parts.where(is_moment()).select(
        *part, F.regexp_replace("tensor", "[0-9]+$", "").alias("kind"), F.regexp_extract("tensor", "([0-9]+)$", 1).alias("layer"),
        "block", "values")
    n = p.where("kind = 'count'").select(*part, "layer", F.col("values")[0].alias("_n"))
    p = p.where("kind <> 'count'").join(n, [*part, "layer"]).where("_n > 0")
    by = [*ids, "layer", "block"]
    whole = p.where("kind = 'mean'").groupBy(*by).agg(B.averaged(F.col("_n")).alias("_mean"))
    # the deviation of each part's mean, squared, counts once a row
    apart = p.where("kind = 'mean'").join(whole, by).select(
        *by, "_n", F.zip_with("values", "_mean", lambda a, b: (a - b) * (a - b)).alias("values"))
    spread = p.where("kind = 'spread'").select(*by, F.lit(1.0).alias("_n"), "values").unionByName(apart)
    spread = spread.groupBy(*by).agg(B.summed(F.col("_n")).alias("values"))
    named = lambda kind: F.concat(F.lit(kind), F.col("layer")).alias("tensor")
    counts = n.groupBy(*ids, "layer").agg(F.sum("_n").alias("_all"))
    return whole.select(*ids, named("mean"), "block", F.col("_mean").alias("values")).unionByName(
        spread.select(*ids, named("spread"), "block", "values")).unionByName(
        counts.select(*ids, named("count"), F.lit(0).alias("block"), F.array("_all").alias("values")))


def _with_moments(means: DataFrame, parts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``means`` with the moments among its tensors replaced by merged ones. Models without moments give
    no row to the merging."""
    new = merged_moment_blocks(parts, ids).withColumnRenamed("values", "_new")
    cols = [c for c in means.columns if c != "values"]
    return means.where(~is_moment()).unionByName(
        means.where(is_moment()).join(new, [*ids, "tensor", "block"], "left").select(*cols, F.coalesce("_new", "values").alias("values")))


def combine_shards(shard_params: DataFrame) -> DataFrame:
    """``combine_shard_blocks``, one row a weight: (client_id, tensor, idx, value, num_examples, tau, loss)."""
    c = combine_shard_blocks(shard_params)
    ids = ["client_id", "num_examples", "tau", "loss"]
    return B.exploded(c, ids).select("client_id", "tensor", "idx", "value", "num_examples", "tau", "loss")


def gradients(df: DataFrame, models, features: str, label: str) -> DataFrame:
    """Sums over the rows of each (config_id, client_id): (tensor, block, values), of the gradients; ``_n`` and ``_loss``
    in the tensor ``''``. ``models`` is a broadcast of models by (config_id, client_id), or by config_id. A task holds the
    sums of ``HELD`` clients and hands them on; they meet in an aggregate combined before the shuffle."""
    def add(batches):
        import pyarrow as pa

        def out(sums):
            rows = [(*k, nm, b, v) for k, g in sums.items() for nm, b, v in model_blocks(g.items())]
            cols = list(zip(*rows))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                              names=["config_id", "client_id", "tensor", "block", "values"])

        sums = {}
        for batch in batches:
            X, y = _matrix(batch.column(3), batch.num_rows), batch.column(2).to_numpy()
            ids = np.column_stack([batch.column(i).to_numpy() for i in range(2)])
            keys, of = np.unique(ids, axis=0, return_inverse=True)
            for k, key in enumerate(map(tuple, keys.tolist())):
                own = np.flatnonzero(of.reshape(-1) == k)
                model = models.value[key] if key in models.value else models.value[key[0]]
                for a in range(0, len(own), MICRO):
                    at = own[a:a + MICRO]
                    loss, grads, _ = backprop(model, X[at].astype(np.float64), y[at])
                    grads[""] = np.array([len(at), loss])
                    if key in sums:
                        for nm, g in grads.items():
                            sums[key][nm] += g
                    else:
                        sums[key] = grads
            if len(sums) >= HELD:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    d = df.select("config_id", "client_id", F.col(label).cast("int").alias("y"), F.col(features).alias("x"))
    parts = d.mapInArrow(add, "config_id int, client_id int, tensor string, block int, values array<double>")
    return parts.groupBy("config_id", "client_id", "tensor", "block").agg(B.summed().alias("values"))


def full_batch_train(df: DataFrame, model, features: str = "features", label: str = "label", client_col: str = "client_id",
                     epochs: int = 1, lr: float = 1e-3, mu: float = 0.0, configs: dict | None = None) -> DataFrame:
    """Local training whose steps take all of a client's rows: as ``local_train`` with ``batch_size=None`` and one
    shard, but no task sees a client. Each step is one aggregate of gradients and one update of the
    parameter table, which holds weights and optimizer state by (config_id, client_id, tensor, block). Later
    steps send all clients' models to every task, as far as ``MODEL_BYTES`` allows; beyond that the clients
    train by ``local_train``, with the same result. Layers that are normalised need it as well."""
    spark, models = df.sparkSession, model if isinstance(model, dict) else {0: model}
    how = {c: {"epochs": epochs, "lr": lr, "mu": mu, **(configs or {}).get(c, {})} for c in models}
    template = next(iter(models.values()))
    if any(nm.startswith("scale") for nm, _ in template):
        raise ValueError("normalised layers need mini-batches: use local_train")
    d = usable(df, features, label, dict(template)["W0"].shape[1])
    d = d.where(F.col("config_id").isin(list(models))) if "config_id" in d.columns else d.withColumn("config_id", F.lit(0))
    d = d.withColumn("client_id", F.col(client_col).cast("int"))
    key = ["config_id", "client_id", "tensor", "block"]
    start = spark.createDataFrame([(c, *b) for c, m in models.items() for b in model_blocks(m)],
                                  "config_id int, tensor string, block int, w_g array<double>")
    setting = spark.createDataFrame([(c, h["epochs"], float(h["lr"]), float(h["mu"])) for c, h in how.items()],
                                    "config_id int, epochs int, lr double, mu double")
    sent, state, done = shipped(spark, models), None, []
    for step in range(1, max(h["epochs"] for h in how.values()) + 1):
        g = gradients(d, sent, features, label)
        seen = g.where("tensor = ''").select("config_id", "client_id", F.col("values")[0].alias("_n"), F.col("values")[1].alias("_loss"))
        g = g.where("tensor <> ''").join(seen, ["config_id", "client_id"]).join(
            start, ["config_id", "tensor", "block"]).join(F.broadcast(setting), "config_id")
        zeros = F.transform("w_g", lambda x: F.lit(0.0))
        g = g.join(state, key) if state is not None else g.select("*", F.col("w_g").alias("w"), zeros.alias("m"), zeros.alias("v"))
        grad = F.zip_with(F.transform("values", lambda x: x / F.col("_n")), B.plus("w", "w_g", -1.0), lambda x, y: x + F.col("mu") * y)
        g = g.withColumn("_g", grad)
        g = g.withColumn("m", F.zip_with("m", "_g", lambda m, x: m * BETA1 + x * (1 - BETA1)))
        g = g.withColumn("v", F.zip_with("v", "_g", lambda v, x: v * BETA2 + x * x * (1 - BETA2)))
        moved = F.zip_with("m", "v", lambda m, v: m / (1 - BETA1 ** step) / (F.sqrt(v / (1 - BETA2 ** step)) + TINY))
        g = g.withColumn("w", F.zip_with("w", moved, lambda w, x: w - F.col("lr") * x))
        state = materialize(g.select(*key, "w", "m", "v", F.col("_n").cast("long").alias("num_examples"),
                                     (F.col("_loss") / F.col("_n")).alias("loss"), "epochs"))
        done.append(state.where(F.col("epochs") == step).select(
            "config_id", "client_id", F.lit(0).alias("shard_id"), "tensor", "block", F.col("w").alias("values"), "num_examples",
            F.lit(step).cast("long").alias("tau"), "loss"))
        state = state.where(F.col("epochs") > step)
        if step < max(h["epochs"] for h in how.values()):
            n = state.select("config_id", "client_id").distinct().count()
            if n * sum(a.nbytes for _, a in template) > MODEL_BYTES:
                return local_train(d.withColumn("shard_id", F.lit(0)), models, "client_id", features, label, "client_id", configs={
                    c: {**h, "batch_size": None} for c, h in how.items()})
            sent.unpersist()
            sent = _client_models(state, template, spark)
            d = d.join(F.broadcast(setting.where(F.col("epochs") > step).select("config_id")), "config_id", "left_semi")
            state = state.drop("num_examples", "loss", "epochs")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _client_models(state: DataFrame, template, spark):
    """Broadcast the current models by (config_id, client_id)."""
    rows = state.select("config_id", "client_id", "tensor", "block", F.col("w").alias("values")).toArrow()
    out: dict = {}
    for c, k, nm, b, v in zip(*[rows[n].to_pylist() for n in ("config_id", "client_id", "tensor", "block")],
                              rows["values"].to_pylist()):
        model = out.setdefault((c, k), {n: a.astype(np.float64).ravel().copy() for n, a in template})
        model[nm][b * BLOCK:b * BLOCK + len(v)] = v
    return shipped(spark, {k: [(nm, m[nm].reshape(a.shape)) for nm, a in template] for k, m in out.items()})


# M4 -----------------------------------------------------------------------------------------
def score(df: DataFrame, model, features: str = "features", out: str = "logits") -> DataFrame:
    """Add ``out``, the logits of every row, by one matrix product a layer and Arrow batch. Rows whose
    features are null, too few or too many, or hold a null get null."""
    sent = shipped(df.sparkSession, {0: model})
    n_features = dict(model)["W0"].shape[1]

    def _logits(column):
        import pyarrow as pa
        import pyarrow.compute as pc

        fine = pc.is_valid(column).to_numpy(zero_copy_only=False)
        own = column.filter(pa.array(fine))
        found = forward(sent.value[0], _matrix(own, len(own)).astype(np.float64)) if len(own) else np.zeros((0, 1))
        offs = np.concatenate([[0], np.cumsum(np.where(fine, found.shape[1], 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(found.ravel()), mask=pa.array(~fine))

    import pyarrow as pa

    _logits.__annotations__ = {"column": pa.Array, "return": pa.Array}
    x = F.col(features)
    whole = F.when((F.size(x) == n_features) & F.forall(x, lambda v: v.isNotNull()), x)
    return df.withColumn(out, F.arrow_udf(_logits, "array<double>")(whole))


def score_configs(df: DataFrame, models: dict, client_col: str = "client_id", features: str = "features",
                  label: str = "label") -> DataFrame:
    """(config_id, client_id, y_true, y_pred, loss) of every row under every configuration's model, in one scan."""
    sent = shipped(df.sparkSession, models)
    n_features = dict(next(iter(models.values())))["W0"].shape[1]
    d = usable(df, features, label, n_features).select(F.col(client_col).cast("int").alias("client_id"),
                                                       F.col(label).cast("int").alias("y"), F.col(features).alias("x"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            y, X = batch.column(1).to_numpy(), _matrix(batch.column(2), batch.num_rows).astype(np.float64)
            for c, model in sent.value.items() if batch.num_rows else ():
                z = forward(model, X)
                top = z.max(axis=1)
                loss = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(y)), y]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), c, np.int32)), batch.column(0), batch.column(1),
                                                  pa.array(z.argmax(axis=1).astype(np.int32)), pa.array(loss)],
                                                 names=["config_id", "client_id", "y_true", "y_pred", "loss"])

    return d.mapInArrow(run, "config_id int, client_id int, y_true int, y_pred int, loss double")


def score_linear(df: DataFrame, weights: list[list[float]], bias: list[float] | None = None,
                 features: str = "features", out: str = "logits") -> DataFrame:
    """Linear layer as JVM expressions: logits_k = Σ_j x_j·W[k][j] + b_k (small K·F literals)."""
    W = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
    b = bias or [0.0] * len(weights)
    x = F.col(features).cast("array<double>")
    dots = F.transform(W, lambda w, k: F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(0.0), lambda s, t: s + t)
                       + F.element_at(F.array(*[F.lit(float(v)) for v in b]), k + 1))
    return df.withColumn(out, dots)


# M1 -----------------------------------------------------------------------------------------
def baseline_train(train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 100,
                   hidden: Sequence[int] | None = None, seed: int = 42):
    """Centralised baseline on all rows with Spark ML (distributed treeAggregate inside):
    multinomial LogisticRegression, or MultilayerPerceptronClassifier when ``hidden`` is given."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    d = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("fv"), F.col(label).cast("double").alias("y"))
    if hidden:
        n_f = len(train.select(features).first()[0])
        n_c = int(train.agg(F.max(label)).first()[0]) + 1
        est = MultilayerPerceptronClassifier(featuresCol="fv", labelCol="y", layers=[n_f, *hidden, n_c],
                                             maxIter=max_iter, seed=seed)
    else:
        est = LogisticRegression(featuresCol="fv", labelCol="y", maxIter=max_iter, family="multinomial")
    return est.fit(d)
