"""Training: closed-form first step, sharding, federated loss decrease."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import train as TR
from cohortlab.plans import federated as FED
from cohortlab.plans.catalog import QUERIES, emb_clients

from .conftest import SF_SMALL


def test_closed_form_first_step_matches_numpy_gradient(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas()
    X = np.stack(e.embedding.to_numpy()).astype(np.float64)
    y = e.label.to_numpy()
    K = int(y.max()) + 1
    zero = [("W0", np.zeros((K, X.shape[1]))), ("b0", np.zeros(K))]
    clients = e.vec_id.to_numpy() % 5
    W, n_tot = np.zeros((K, X.shape[1])), 0
    for c in range(5):
        m = clients == c
        _, g = TR._grads(zero, X[m], y[m])
        W += m.sum() * (-0.1 * g[0])
        n_tot += m.sum()
    W /= n_tot
    got = {(r.k, r.j): r.value for r in QUERIES["sgd_step_zero_init"](spark, SF_SMALL).collect()}
    for (k, j), v in got.items():
        assert v == pytest.approx(W[k, j], abs=2e-6)


def test_shards_cover_client_and_combine(spark):
    d = emb_clients(spark, SF_SMALL).where("split = 'train'")
    sh = TR.with_shards(d, "vec_id", n_shards=3)
    assert sh.select("shard_id").distinct().count() > 1
    model = TR.init_model([64, 10])
    p = TR.combine_shards(TR.local_train(sh, model, "vec_id", epochs=1, batch_size=16, lr=0.01))
    sizes = {r.client_id: r["count"] for r in d.groupBy("client_id").count().collect()}
    got = {r.client_id: r.num_examples for r in p.select("client_id", "num_examples").distinct().collect()}
    assert got == sizes
    assert p.count() == 650 * len(sizes)


def test_federated_loss_decreases(spark):
    cfg = FED.FedConfig(strategy="fedavg", n_rounds=4, local_epochs=3, batch_size=32, lr=0.02)
    h = FED.federated_train(emb_clients(spark, SF_SMALL), "vec_id", cfg).history
    loss = {r["round"]: r.value for r in h.where("scope = 'global' AND metric = 'loss'").collect()}
    assert loss[4] < loss[0]


@pytest.mark.parametrize("strategy", ["fedprox", "fednova", "dp"])
def test_other_strategies_run(spark, strategy):
    cfg = FED.FedConfig(strategy=strategy, n_rounds=1, local_epochs=1, batch_size=64, lr=0.01, mu=0.1,
                        noise_multiplier=0.1, clip_norm=5.0, dp_secret=1, server_momentum=0.5)
    h = FED.federated_train(emb_clients(spark, SF_SMALL), "vec_id", cfg).history
    assert h.where("round = 1 AND scope = 'global'").count() > 0


def test_score_matches_linear_expression(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", F.col("embedding").alias("features"))
    model = TR.init_model([64, 10], seed=3)
    a = {r.vec_id: r.logits for r in TR.score(e, model).collect()}
    b = {r.vec_id: r.logits for r in TR.score_linear(e, model[0][1].tolist(), model[1][1].tolist()).collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-5)


def test_round_overrides_and_sweep(spark):
    data = emb_clients(spark, SF_SMALL)
    cfgs = [FED.FedConfig(strategy="fedavg", n_rounds=1, experiment="a", round_overrides={1: {"local_epochs": 2}}),
            FED.FedConfig(strategy="FedNova", n_rounds=1, experiment="b")]
    h = FED.sweep(data, "vec_id", cfgs)
    assert {r.experiment for r in h.select("experiment").distinct().collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        FED.federated_train(data, "vec_id", FED.FedConfig(strategy="nope"))


@pytest.mark.parametrize("strategy", ["fedavg", "fednova", "dp"])
def test_each_round_trains_once(spark, strategy, monkeypatch):
    """One training call per (client, shard) and round, however many branches read the updates."""
    calls = spark.sparkContext.accumulator(0)
    plain = TR.local_train

    def counted(*a, **kw):
        def count(batches):
            for pdf in batches:
                calls.add(pdf[["client_id", "shard_id"]].drop_duplicates().shape[0])
                yield pdf
        out = plain(*a, **kw)
        return out.repartition("client_id", "shard_id").mapInPandas(count, out.schema)

    monkeypatch.setattr(TR, "local_train", counted)
    cfg = FED.FedConfig(strategy=strategy, n_rounds=2, n_shards=2, dp_secret=1)
    h = FED.federated_train(emb_clients(spark, SF_SMALL), "vec_id", cfg).history
    h.count()
    assert calls.value == 2 * 5 * 2
    kinds = {r.kind for r in h.select("kind").distinct().collect()}
    assert kinds == {"eval", "fit"} | ({"privacy"} if strategy == "dp" else set())


def test_private_training_needs_noise_and_hides_its_secret(spark, capsys):
    from cohortlab.operators import params as PM
    from cohortlab.sources import tables as T

    with pytest.raises(ValueError, match="noise_multiplier"):
        FED.federated_train(emb_clients(spark, SF_SMALL), "vec_id", FED.FedConfig(strategy="dp", noise_multiplier=0.0))
    u = T.client_updates(spark, SF_SMALL)
    capsys.readouterr()
    PM.dp_fedavg(u, PM.previous_round_global(u), 0.5, 1.0, secret=987654321987).explain(True)
    assert "987654321987" not in capsys.readouterr().out


def test_momentum_over_ten_thousand_rounds(spark):
    from cohortlab.operators import params as PM

    n = 10_000
    r = np.random.default_rng(0).normal(size=n)
    df = spark.createDataFrame([(i, "w", 0, float(x)) for i, x in enumerate(r)], "round int, tensor string, idx int, value double")
    got = {x["round"]: x["velocity"] for x in PM.server_momentum(df, 0.9).collect()}
    v = 0.0
    for i, x in enumerate(r):
        v = 0.9 * v + x
        assert got[i] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_params_to_arrays_and_back(spark):
    from cohortlab.operators import params as PM

    df = spark.createDataFrame([(1, [float(i) for i in range(6)])], "round int, w array<double>")
    long = PM.explode_params(df, "w", ["round"], [("a", 4), ("b", 2)])
    back = {x["tensor"]: x["values"] for x in PM.implode_params(long, ["round"]).collect()}
    assert back == {"a": [0.0, 1.0, 2.0, 3.0], "b": [4.0, 5.0]}


def test_proximal_term_over_several_steps():
    """Three full-batch steps with the proximal term, against a plain restatement."""
    r = np.random.default_rng(5)
    X, y = r.normal(size=(40, 6)), r.integers(0, 3, 40)
    W, b = r.normal(size=(3, 6)), r.normal(size=3)
    got, steps, _ = TR.train_local([("W0", W), ("b0", b)], X, y, epochs=3, batch_size=100, lr=0.05, mu=0.7)
    assert steps == 3
    w = np.concatenate([W, b[:, None]], axis=1)
    start, first, second = w.copy(), np.zeros_like(w), np.zeros_like(w)
    Z = np.concatenate([X, np.ones((40, 1))], axis=1)
    for t in (1, 2, 3):
        e = np.exp(Z @ w.T)
        p = e / e.sum(axis=1, keepdims=True)
        g = (p - np.eye(3)[y]).T @ Z / 40 + 0.7 * (w - start)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.05 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(got[0][1], w[:, :6], atol=1e-10) and np.allclose(got[1][1], w[:, 6], atol=1e-10)
    free, _, _ = TR.train_local([("W0", W), ("b0", b)], X, y, epochs=3, batch_size=100, lr=0.05, mu=0.0)
    assert not np.allclose(free[0][1], got[0][1])


def test_a_stream_is_trained_like_rows_in_memory():
    """However rows are cut into Arrow batches, and whether a batch fits at once, the steps are the same."""
    r = np.random.default_rng(1)
    X, y = r.normal(size=(1000, 7)), r.integers(0, 4, 1000)
    for norm, dropout, size in ((False, 0.0, 64), (False, 0.0, None), (True, 0.3, 64), (False, 0.5, 100)):
        model, got = TR.init_model([7, 9, 5, 4], norm=norm), []
        for step in (1000, 17, 301):
            own = TR.Learner(model, size, 0.01, 0.1, None, dropout, (1, 2))
            for _ in range(2):
                for a in range(0, 1000, step):
                    own.feed(X[a:a + step], y[a:a + step])
                own.end_epoch()
            got.append((own.steps, own.examples, own.loss, own.model))
        for steps, n, loss, m in got[1:]:
            assert (steps, n) == got[0][:2] == ((2 * -(-1000 // size) if size else 2), 1000) and loss == pytest.approx(got[0][2])
            assert all(np.allclose(a, b, atol=1e-12) for (_, a), (_, b) in zip(m, got[0][3]))


def test_a_long_stream_takes_bounded_memory():
    """Two million rows in one batch: what is held doesn't grow with them."""
    import tracemalloc

    r, peak = np.random.default_rng(2), []
    X, y = r.normal(size=(10_000, 16)).astype(np.float32), r.integers(0, 3, 10_000)
    for n in (20, 200):
        own = TR.Learner(TR.init_model([16, 32, 3]), None, 0.01)
        tracemalloc.start()
        for _ in range(n):
            own.feed(X, y)
        own.end_epoch()
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert own.examples == n * 10_000 and own.steps == 1
    assert peak[1] < 1.1 * peak[0] and peak[1] < 30e6


def numeric(f, a, eps=1e-5):
    out = np.zeros_like(a)
    for i in np.ndindex(a.shape):
        a[i] += eps
        up = f()
        a[i] -= 2 * eps
        out[i] = (up - f()) / (2 * eps)
        a[i] += eps
    return out


@pytest.mark.parametrize("norm,dropout", [(False, 0.0), (True, 0.0), (True, 0.4)])
def test_gradients_match_differences(norm, dropout):
    r = np.random.default_rng(3)
    model = TR.init_model([5, 6, 4, 3], norm=norm)
    for nm, a in model:
        if nm.startswith(("scale", "shift")):
            a += r.normal(size=a.shape) * 0.3
    X, y = r.normal(size=(20, 5)), r.integers(0, 3, 20)
    run = lambda: TR.backprop(model, X, y, dropout, np.random.default_rng(4))
    _, grads, _ = run()
    assert set(grads) == {nm for nm, _ in model if TR.is_trained(nm)}
    for nm, a in model:
        if TR.is_trained(nm):
            assert np.allclose(grads[nm], numeric(lambda: run()[0], a), atol=1e-4), nm


def test_the_published_network():
    """77 features and 15 classes: the stated number of parameters; evaluation is by moments and drops nothing."""
    cfg = FED.published()
    model = TR.init_model(TR.layer_dims(77, 15, cfg.hidden), norm=cfg.norm)
    assert TR.n_params(model) == 21_263 and (cfg.n_rounds, cfg.local_epochs, cfg.batch_size, cfg.dropout) == (50, 3, 512, 0.3)
    r = np.random.default_rng(5)
    X, y = r.normal(size=(600, 77)) * 3 + 1, r.integers(0, 15, 600)
    trained, _, _ = TR.train_local(model, X, y, epochs=1, batch_size=600, lr=0.0)
    z = X @ dict(model)["W0"].T + dict(model)["b0"]
    assert np.allclose(dict(trained)["mean0"], z.mean(axis=0)) and np.allclose(dict(trained)["spread0"] / 600, z.var(axis=0))
    assert np.allclose(TR.forward(trained, X[:7]), TR.forward(trained, X)[:7])


def test_moments_merge_in_any_order(spark):
    r = np.random.default_rng(6)
    parts = [r.normal(size=(n, 3)) * 5 + 100 for n in (1, 7, 40, 2)]
    own = [(float(len(p)), p.mean(axis=0), ((p - p.mean(axis=0)) ** 2).sum(axis=0)) for p in parts]
    whole = np.concatenate(parts)
    merged = own[0]
    for m in own[1:]:
        merged = TR.merged_moments(merged, m)
    assert merged[0] == 50 and np.allclose(merged[1], whole.mean(axis=0)) and np.allclose(merged[2] / 50, whole.var(axis=0))
    rows = [(0, c, f"{nm}{layer}", 0, [float(x) for x in np.atleast_1d(v)])
            for c, m in enumerate(own) for layer in (0, 1) for nm, v in zip(("count", "mean", "spread"), m)]
    df = spark.createDataFrame(rows, "config_id int, client_id int, tensor string, block int, values array<double>")
    got = {x["tensor"]: x["values"] for x in TR.merged_moment_blocks(df, ["config_id"]).collect()}
    assert len(got) == 6 and got["count1"] == [50.0]
    assert np.allclose(got["mean0"], whole.mean(axis=0)) and np.allclose(got["spread1"], merged[2])


def test_full_batch_steps_are_aggregates(spark):
    """Several steps, two layers, a proximal term: as one stream a client gives them."""
    d = emb_clients(spark, SF_SMALL).where("split = 'train'")
    model = TR.init_model([64, 8, 10], seed=4)
    a = TR.combine_shards(TR.full_batch_train(d, model, epochs=3, lr=0.05, mu=0.3))
    b = TR.combine_shards(TR.local_train(d, model, "vec_id", epochs=3, batch_size=None, lr=0.05, mu=0.3))
    key = lambda r: (r["client_id"], r["tensor"], r["idx"])
    a, b = ({key(r): r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and len(a) == 5 * TR.n_params(model)
    for k, r in a.items():
        assert r["value"] == pytest.approx(b[k]["value"], abs=1e-7)
        assert (r["num_examples"], r["tau"]) == (b[k]["num_examples"], b[k]["tau"]) and r["loss"] == pytest.approx(b[k]["loss"])


def history(h):
    return {(r["experiment"], r["strategy"], r["round"], r["kind"], r["scope"], r["client_id"], r["metric"]): r["value"] for r in h.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9), k


SWEPT = [FED.FedConfig(strategy="fedavg", n_rounds=2, experiment="a", hidden=(6,), norm=True, dropout=0.2, n_shards=2),
         FED.FedConfig(strategy="fedprox", mu=0.5, n_rounds=1, experiment="b", fraction_fit=0.6, batch_size=None),
         FED.FedConfig(strategy="fednova", n_rounds=2, experiment="c", server_momentum=0.5, round_overrides={2: {"local_epochs": 2}}),
         FED.FedConfig(strategy="dp", n_rounds=2, experiment="d", dp_secret=5, noise_multiplier=0.5, seed=1)]


def test_a_sweep_is_its_runs(spark):
    data = emb_clients(spark, SF_SMALL)
    got = history(FED.sweep(data, "vec_id", SWEPT))
    want = {}
    for c in SWEPT:
        want.update(history(FED.federated_train(data, "vec_id", c).history))
    same(got, want)


def test_jobs_of_a_sweep_do_not_grow_with_it(spark):
    data, seen = emb_clients(spark, SF_SMALL), []
    for n in (1, 6):
        sc = spark.sparkContext
        sc.setJobGroup(f"sweep-{n}", "")
        FED.sweep(data, "vec_id", [FED.FedConfig(n_rounds=1, lr=0.01 * (i + 1), experiment=f"e{i}") for i in range(n)])
        seen.append(len(sc.statusTracker().getJobIdsForGroup(f"sweep-{n}")))
        sc.setJobGroup("", "")
    assert 0 < seen[1] <= seen[0] + 6   # adaptive joins differ by a job or two


def test_a_run_goes_on_behind_its_last_commit(spark, tmp_path, monkeypatch):
    """Killed in round 3, with its model already written: the same history as without, and no row twice."""
    data = emb_clients(spark, SF_SMALL)
    cfg = FED.FedConfig(strategy="fednova", n_rounds=3, server_momentum=0.5, experiment="7")
    whole = history(FED.federated_train(data, "vec_id", cfg).history)
    root, calls, plain = str(tmp_path / "run"), [], FED.write_rounds

    def failing(rows, path):
        calls.append(path)
        if len(calls) == 11:    # round 0, 1 and 2 have three tables each; the model of round 3 is written, its history is not
            raise RuntimeError("lost")
        plain(rows, path)

    monkeypatch.setattr(FED, "write_rounds", failing)
    with pytest.raises(RuntimeError, match="lost"):
        FED.federated_train(data, "vec_id", cfg, run_dir=root)
    assert len(calls) == 11
    monkeypatch.setattr(FED, "write_rounds", plain)
    h = FED.federated_train(data, "vec_id", cfg, run_dir=root).history
    assert h.count() == len(whole)
    same(history(h), whole)
    again = FED.federated_train(data, "vec_id", cfg, run_dir=root)
    same(history(again.history), whole)
    with pytest.raises(ValueError, match="other settings"):
        FED.federated_train(data, "vec_id", FED.FedConfig(strategy="fednova", n_rounds=3, lr=0.5, experiment="7"), run_dir=root)


def test_rows_that_cannot_be_used(spark):
    rows = [(1, 0, [1.0, 2.0], 0), (2, 0, [2.0, 1.0], 1), (3, 0, None, 1), (4, 0, [1.0], 0), (5, 0, [None, 1.0], 0), (6, 0, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id long, client_id int, features array<double>, label int")
    model = TR.init_model([2, 2])
    p = TR.combine_shards(TR.local_train(df, model, "id", epochs=1))
    assert {r["num_examples"] for r in p.collect()} == {2}
    logits = {r["id"]: r["logits"] for r in TR.score(df, model).collect()}
    assert [logits[i] is None for i in range(1, 7)] == [False, False, True, True, True, False]
    assert TR.score(df.limit(0), model).count() == 0 and TR.local_train(df.limit(0), model, "id").count() == 0


def test_workers_need_no_package(tmp_path):
    """Training and scoring in a session whose workers can't import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from cohortlab.session import get_session
from cohortlab.operators import train as TR
spark = get_session("local[2]", 2)
df = spark.createDataFrame([(i, i % 2, [float(i), 1.0], i % 3) for i in range(20)], "id long, client_id int, features array<double>, label int")
model = TR.init_model([2, 4, 3], norm=True)
p = TR.combine_shards(TR.local_train(df, model, "id", epochs=1))
assert p.select("client_id").distinct().count() == 2
assert TR.full_batch_train(df, TR.init_model([2, 3]), epochs=2).count() == 4
assert TR.score(df, model).where("logits is not null").count() == 20
assert TR.score_configs(df, {{0: model, 1: model}}).count() == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
