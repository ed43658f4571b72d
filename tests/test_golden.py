"""Hand-derived golden values through the operators."""
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import clean, metrics, partition, privacy
from cohortlab.operators import train as TR

Y_TRUE = [0, 0, 1, 1, 0, 1, 1, 0, 1, 0]
Y_PRED = [0, 0, 1, 0, 0, 1, 1, 0, 1, 1]
PROBA = [0.1, 0.2, 0.9, 0.4, 0.3, 0.8, 0.7, 0.2, 0.95, 0.6]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(list(zip(Y_TRUE, Y_PRED, PROBA)), "y_true int, y_pred int, score double")


def test_binary_metrics_golden(preds):
    r = metrics.binary_metrics(preds).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (4, 4, 1, 1)
    for m in ("accuracy", "precision", "recall", "specificity", "f1"):
        assert r[m] == pytest.approx(0.8)
    assert r.fpr == pytest.approx(0.2) and r.fnr == pytest.approx(0.2)


def test_auc_golden(preds):
    assert metrics.auc_roc(preds).first()[0] == pytest.approx(0.96)


def test_auc_one_class_is_null(spark):
    d = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y_true int, score double")
    assert metrics.auc_roc(d).first()[0] is None


def test_zero_division_gives_zero(spark):
    d = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = metrics.binary_metrics(d).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0


FAMILY_CASES = [
    ("DDoS", "DDoS"), ("DoS Hulk", "Other"), ("PortScan", "Other"), ("FTP-Patator", "Other"),
    ("Web Attack – Brute Force", "Brute Force"), ("Web Attack – XSS", "Web Attacks"),
    ("Infiltration", "Web Attacks"), ("Bot", "Botnet"), ("Heartbleed", "Other"), ("BENIGN", "Normal"),
    ("normal", "Normal"), ("Legitimate", "Normal"), ("SQL Injection", "Web Attacks"), ("FTP-Brute Force", "Brute Force"),
]


def test_family_rule_first_match_wins(spark):
    d = spark.createDataFrame([(a,) for a, _ in FAMILY_CASES], "label string")
    got = {r.label: r.family for r in clean.label_family(d).collect()}
    assert got == dict(FAMILY_CASES)


def _sizes(df):
    return sorted((r.client_id, r["count"]) for r in df.groupBy("client_id").count().collect())


def test_iid_remainder_to_last_client(spark):
    d = spark.range(12).withColumnRenamed("id", "k")
    assert _sizes(partition.partition_iid(d, "k", 5)) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 4)]


def test_iid_fewer_rows_than_clients(spark):
    d = spark.range(3).withColumnRenamed("id", "k")
    assert _sizes(partition.partition_iid(d, "k", 5)) == [(4, 3)]


def test_day_bounds(spark):
    d = spark.range(7).select(F.col("id").alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
                              .alias("day"))
    got = {r.k: r.client_id for r in partition.partition_by_day(d, None, 3, day_col="day").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}
    wide = {r.k: r.client_id for r in partition.partition_by_day(d, None, 9, day_col="day").collect()}
    assert wide == {i: i for i in range(7)}


def test_synthetic_day_extra_chunk(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    days = sorted({r.day for r in clean.synthetic_day(d, "k", 8).collect()})
    assert days == [str(i) for i in range(10)]   # 10 div 8 = 1 row per chunk -> 10 chunks
    d2 = spark.range(17).withColumnRenamed("id", "k")
    assert sorted({r.day for r in clean.synthetic_day(d2, "k", 8).collect()}) == [str(i) for i in range(9)]


def test_ledger_golden(spark):
    rows = [("e", t, 0.2, 1.0) for t in range(1, 11)] + [("q1", 1, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "experiment string, round int, sample_rate double, noise_multiplier double")
    led = {(r.experiment, r.round): r.epsilon for r in privacy.privacy_ledger(d).collect()}
    assert led[("e", 10)] == pytest.approx(6.001092, abs=1e-6)
    assert led[("q1", 1)] == pytest.approx(4.752728, abs=1e-6)


def test_ledger_monotone(spark):
    rows = [(f"z{z}", t, 0.2, z) for z in (0.5, 1.0, 2.0) for t in range(1, 6)]
    d = spark.createDataFrame(rows, "experiment string, round int, sample_rate double, noise_multiplier double")
    led = {(r.experiment, r.round): r.epsilon for r in privacy.privacy_ledger(d).collect()}
    for z in (0.5, 1.0, 2.0):
        seq = [led[(f"z{z}", t)] for t in range(1, 6)]
        assert seq == sorted(seq)
    assert led[("z0.5", 5)] > led[("z1.0", 5)] > led[("z2.0", 5)]   # higher multiplier = smaller epsilon


def test_reference_model_parameter_count():
    # linear layers only (no BatchNorm by design); the reference's 21,263 also counts the
    # 2 x (128 + 64 + 32) BatchNorm affine parameters
    n = TR.n_params(TR.init_model(TR.layer_dims(77, 15)))
    assert n == 20815
    assert n + 2 * (128 + 64 + 32) == 21263
    assert TR.n_params(TR.init_model([64, 10])) == 650


def test_exact_quantiles_with_a_hot_value(spark):
    import numpy as np

    from cohortlab.operators import profile
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.full(5000, 0.05), rng.normal(size=5000)])
    d = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r.p: r.q for r in profile.exact_quantiles(d, ["x"], (0.1, 0.25, 0.5, 0.75, 0.9)).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.percentile(vals, p * 100), abs=1e-12)


def test_exact_quantiles_refined_intervals(spark):
    """Tiny max_rows_per_task forces the equal-width refinement loop; still exact."""
    import numpy as np

    from cohortlab.operators import profile
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.full(3000, 2.5), rng.lognormal(0.0, 3.0, size=4000), rng.normal(size=3001)])
    d = spark.createDataFrame([(float(v), float(-v)) for v in vals], "x double, y double")
    probs = (0.1, 0.25, 0.5, 0.75, 0.9, 0.999)
    got = profile.exact_quantiles(d, ["x", "y"], probs, n_buckets=4, max_rows_per_task=40,
                                  sub_buckets=8).collect()
    for r in got:
        src = vals if r.column == "x" else -vals
        # relative: the heavy tail reaches ~10^4, where interpolation rounding is ~10^-9
        assert r.q == pytest.approx(np.percentile(src, r.p * 100), rel=1e-12, abs=1e-12)
    assert len(got) == 2 * len(probs)
