"""rank_cuts (threshold selection) must equal counting cut ranks over a plain row_number()."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.functions.exprs import hash_hex
from cohortlab.functions.ordering import rank_cuts


def _frame(spark, n=300):
    rows = [(i, None if i % 37 == 0 else f"g{i % 4}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, grp string")
    return df.withColumn("_h", hash_hex("id", 7))


def _expected(df, partition_by, cuts):
    w = Window.partitionBy(*partition_by).orderBy("_h", "id")
    r = df.withColumn("_rn", F.row_number().over(w)).withColumn("_gn", F.count(F.lit(1)).over(Window.partitionBy(*partition_by)))
    passed = F.lit(0)
    for c in cuts():
        passed = passed + F.when(F.col("_rn") > c, 1).otherwise(0)
    return {r["id"]: r["p"] for r in r.select("id", passed.alias("p")).collect()}


def _got(df, partition_by, cuts, digits):
    out = rank_cuts(df, "_h", "id", F.array(*[c.cast("long") for c in cuts()]), partition_by=partition_by, out="p", digits=digits)
    return {r["id"]: r["p"] for r in out.select("id", "p").collect()}


def test_rank_cuts_no_groups(spark):
    df = _frame(spark)

    def cuts():
        n = F.col("_gn")
        # equal blocks, a cut at 0, a cut at n, a repeated cut and one past the end
        return [F.floor(n / 5) * c for c in range(1, 5)] + [F.lit(0), n, F.lit(60), F.lit(60), n + 3]

    for digits in (1, 2, 4):
        assert _got(df, [], cuts, digits) == _expected(df, [], cuts)


def test_rank_cuts_groups_with_null_key(spark):
    df = _frame(spark)

    def cuts():
        n = F.col("_gn")
        return [F.floor(n * 0.8).cast("long"), F.round(n * 0.2).cast("long"), F.lit(-1)]

    for digits in (1, 3):
        got = _got(df, ["grp"], cuts, digits)
        assert got == _expected(df, ["grp"], cuts)
        assert len(got) == 300   # the NULL group keeps its rows


def test_rank_cuts_group_info(spark):
    df = _frame(spark).withColumn("par", (F.col("id") % 2).cast("int"))
    info = spark.createDataFrame([(0, 10), (1, 25)], "par int, quota long")
    out = rank_cuts(df, "_h", "id", F.array(F.col("quota")), partition_by=["par"], out="p",
                    group_info=info, digits=1)
    got = {r["id"]: r["p"] for r in out.select("id", "p").collect()}
    w = Window.partitionBy("par").orderBy("_h", "id")
    exp = df.withColumn("_rn", F.row_number().over(w)).select(
        "id", F.when(F.col("_rn") > F.when(F.col("par") == 0, 10).otherwise(25), 1).otherwise(0).alias("p"))
    assert got == {r["id"]: r["p"] for r in exp.collect()}


def test_sequential_ts_with_hot_order_value(spark):
    """40 % of rows share one order value: the value gets its own bucket split by a row hash,
    ranks stay a permutation consistent with the order, and do not depend on partitioning."""
    from cohortlab.operators import clean

    rows = [(5 if i % 5 < 2 else i, float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "o long, payload double")
    a = clean.sequential_ts(df, "o", "ts")
    b = clean.sequential_ts(df.repartition(7), "o", "ts")
    secs = {r["payload"]: r["s"] for r in a.select("payload", F.unix_timestamp("ts").alias("s")).collect()}
    secs_b = {r["payload"]: r["s"] for r in b.select("payload", F.unix_timestamp("ts").alias("s")).collect()}
    assert secs == secs_b
    start = min(secs.values())
    ranks = {p: s - start + 1 for p, s in secs.items()}
    assert sorted(ranks.values()) == list(range(1, 5001))
    import bisect

    order = {pay: o for o, pay in rows}
    vals = sorted(order.values())
    for p, r in ranks.items():
        assert bisect.bisect_left(vals, order[p]) < r <= bisect.bisect_right(vals, order[p])


def test_rank_cuts_by_shuffle(spark, monkeypatch):
    """Past the broadcast limit the tables are joined by a shuffle; same answers."""
    import cohortlab.functions.ordering as O

    monkeypatch.setattr(O, "MAX_BROADCAST_ROWS", -1)
    df = _frame(spark)

    def cuts():
        n = F.col("_gn")
        return [F.floor(n / 3) * c for c in range(1, 3)] + [F.lit(0), n]

    for digits in (1, 2):
        assert _got(df, [], cuts, digits) == _expected(df, [], cuts)
        assert _got(df, ["grp"], cuts, digits) == _expected(df, ["grp"], cuts)


def test_plan_does_not_grow_with_the_clients(spark):
    """1,000 clients are planned and placed like 5."""
    import time

    from cohortlab.operators import partition

    df = spark.range(3000).withColumnRenamed("id", "event_id")
    seconds = []
    for n in (5, 1000):
        t = time.time()
        sizes = [r["count"] for r in partition.partition_iid(df, "event_id", n_clients=n).groupBy("client_id").count().collect()]
        assert sorted(sizes) == [3000 // n] * n
        seconds.append(time.time() - t)
    assert seconds[1] < 3 * seconds[0] + 5


def test_stratified_split_rejects_singleton_class(spark):
    import pytest

    from cohortlab.operators.split import stratified_split

    df = spark.createDataFrame([(i, "a" if i < 9 else "lonely") for i in range(10)], "id long, label string")
    with pytest.raises(ValueError, match="lonely"):
        stratified_split(df, "id", "label")
    ok = stratified_split(df.where("label = 'a'"), "id", "label").groupBy("split").count()
    assert {r["split"]: r["count"] for r in ok.collect()} == {"test": 2, "train": 7}


def test_cut_plans_do_not_shuffle_rows(spark, capsys):
    """After the threshold search the returned plan is the scan and a broadcast join of the small
    table of thresholds: no row-side exchange."""
    from cohortlab.operators import partition

    from .conftest import SF_SMALL

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "value")
    iid = partition.partition_iid(ev, "event_id")
    tv = partition.client_train_val(iid, "event_id")
    for df in (iid, tv):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan, plan
        assert "BroadcastExchange" in plan, plan


def test_images_order_as_doubles_do(spark):
    import math
    import random
    import struct

    from cohortlab.functions import radix

    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf]
    xs += [2.0 ** k for k in range(-1074, 1024)] + [-math.nextafter(2.0 ** k, 0) for k in range(-1073, 1024)]
    xs += [math.nextafter(2.0 ** k, math.inf) for k in range(-1074, 1023)]
    xs += [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)]
    xs = [x for x in xs if x == x]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (math.nan,)], "x double")
    got = df.select("x", radix.image(F.col("x")).alias("i")).collect()
    for row in got[:len(xs)]:
        bits = struct.unpack("<q", struct.pack("<d", abs(row["x"])))[0]
        assert row["i"] == (-bits if row["x"] < 0 else bits), row
    assert got[-2]["i"] == radix.NULL_IMAGE and got[-1]["i"] == radix.NAN_IMAGE


def test_value_buckets_are_monotone_and_small(spark, monkeypatch):
    import random

    from cohortlab.functions import ordering

    monkeypatch.setattr(ordering, "BUCKET_ROWS", 50)
    monkeypatch.setattr(ordering, "MAX_BUCKETS", 1 << 20)
    r = random.Random(2)
    xs = [7.25] * 900 + [None] * 300 + [r.gauss(0, 1) for _ in range(1500)] + [1e9 + i * 1e-6 for i in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double").withColumn("t", hash_hex("id", 1))
    b = ordering.with_value_bucket(df, "x", "b", tiebreak="t").select("x", "t", "b").collect()
    rows = sorted(b, key=lambda row: (row["x"] is not None, row["x"] or 0.0, row["t"]))
    assert [row["b"] for row in rows] == sorted(row["b"] for row in rows)
    sizes = {}
    for row in rows:
        sizes[row["b"]] = sizes.get(row["b"], 0) + 1
    assert max(sizes.values()) <= 90 and len(sizes) > 40
    plain = {row["x"]: row["b"] for row in ordering.with_value_bucket(df, "x", "b").select("x", "b").collect()}
    assert len({plain[7.25]}) == 1
