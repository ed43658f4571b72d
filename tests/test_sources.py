"""CSV ingest edge cases, sinks round trips, streaming row-wise prep."""
import math

import pytest
from pyspark.sql import functions as F

from cohortlab.sources import csv as C
from cohortlab.sources import sinks
from cohortlab.sources import tables as T

from .conftest import SF_SMALL


def _write(path, text, enc="utf-8"):
    path.write_bytes(text.encode(enc))


def test_csv_multi_file_union_and_edge_rows(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    _write(d / "a.csv", " Flow_Bytes/s , Label ,x\n1.5,BENIGN,1\ninf,DDoS,2\n3,BENIGN,3,EXTRA\n4,Bot\n")
    _write(d / "b.csv", "Label,Flow_Bytes/s,y\nWeb Attack – XSS,7,9\nCafé,8,10\n")
    _write(d / "c.csv", "Label,Flow_Bytes/s\nCaf\xe9 latin,5\n", enc="latin-1")
    df = C.read_flow_csvs(spark, str(d))
    assert set(df.columns) == {"Flow_Bytes/s", "Label", "x", "y"}
    rows = {r.Label: r for r in df.collect()}
    assert "BENIGN" in rows and rows["DDoS"]["Flow_Bytes/s"] == math.inf      # 'inf' text -> +inf
    assert 3.0 not in [r["Flow_Bytes/s"] for r in df.collect()]               # over-long row skipped
    assert rows["Bot"]["x"] is None                                            # short row kept, padded
    assert "Café latin" in rows                                          # latin-1 fallback decoded
    assert df.count() == 6


def test_csv_repeated_header_names(spark, tmp_path):
    d = tmp_path / "rep"
    d.mkdir()
    _write(d / "r.csv", "a,b,a\n1,2,3\n")
    df = C.read_flow_csvs(spark, str(d))
    assert df.columns == ["a", "b", "a.1"]
    assert tuple(df.first()) == (1.0, 2.0, 3.0)


def test_csv_names_that_collide():
    assert C.dedupe_names(["a", " a ", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]


def test_csv_types_are_cast_without_a_pass(spark, tmp_path):
    d = tmp_path / "typed"
    d.mkdir()
    _write(d / "t.csv", "k,v,s\n1,2.5,x\nbad, 3 ,y\n")
    df = C.read_flow_csvs(spark, str(d), types={"k": "int", "v": "double"})
    assert [tuple(r) for r in df.orderBy("s").collect()] == [(1, 2.5, "x"), (None, 3.0, "y")]


def test_rate_columns_are_found_by_normalised_name(spark):
    from cohortlab.operators import clean

    df = spark.createDataFrame([(1.0, 2.0), (math.inf, 2.0), (3.0, None)], "` Flow Bytes/s` double, `Flow_Packets/s` double")
    assert clean.remove_infinite_values(df).count() == 1


def test_csv_missing_dir_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        C.read_flow_csvs(spark, str(tmp_path / "nothing"))


def test_processed_round_trip_prunes_split(spark, tmp_path):
    f = T.flows(spark, SF_SMALL).withColumn("split", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train"))
    p = str(tmp_path / "processed")
    sinks.write_processed(f, p)
    test = sinks.load_split(spark, p, "test")
    assert test.count() == f.where("split = 'test'").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan


def test_results_json_round_trip_and_missing_paths(spark, tmp_path):
    from cohortlab.operators import history as H
    res = H.experiment_results(T.run_history(spark, SF_SMALL), {"num_clients": 5})
    p = str(tmp_path / "results")
    sinks.save_results(res, p)
    back = sinks.read_results(spark, [p, str(tmp_path / "absent")])
    assert back.count() == res.count()
    assert "round_history" in back.columns and "source_file" in back.columns


def test_round_history_append(spark, tmp_path):
    h = spark.createDataFrame([("e1", 1, "eval", "loss", 0.5)], "experiment string, round int, kind string, metric string, value double")
    p = str(tmp_path / "hist")
    sinks.append_round_history(h, p)
    sinks.append_round_history(h.withColumn("round", F.lit(2)), p)
    assert sinks.read_round_history(spark, p, "e1").count() == 2


def test_stream_rowwise_prep(spark, tmp_path):
    from cohortlab.streaming.rowwise import run_stream
    src = tmp_path / "src"
    T.dirty_flows(spark, SF_SMALL).drop("ts").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    q = run_stream(spark, str(src), schema, str(tmp_path / "sink"), str(tmp_path / "ckpt"),
                   labels=["BENIGN", "Botnet", "DDoS", "FTP-Brute Force", "Infiltration"])
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "sink"))
    expected = T.dirty_flows(spark, SF_SMALL).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) != 'Infinity'")
    assert out.count() == expected.count()
    assert out.where("label_id IS NULL").count() == 0


def test_label_column_resolution(spark):
    from cohortlab.operators import clean
    d = spark.createDataFrame([(1, "x")], "a int, Attack_Type string")
    assert clean.resolve_label_column(d) == "Attack_Type"
    with pytest.raises(ValueError, match="no label column"):
        clean.resolve_label_column(d.drop("Attack_Type"))


def test_json_sinks_and_rows_per_file(spark, tmp_path):
    from cohortlab.operators import clean
    _, lm = clean.label_encode(T.flows(spark, SF_SMALL), "label")
    sinks.write_label_map(lm, str(tmp_path / "lm"), single_file=True)
    back = spark.read.json(str(tmp_path / "lm"))
    assert sorted((r.label, r.label_id) for r in back.collect()) == sorted((r.label, r.label_id) for r in lm.collect())
    d = tmp_path / "two"
    d.mkdir()
    _write(d / "a.csv", "x,Label\n1,A\n2,B\n")
    _write(d / "b.csv", "x,Label\n3,A\n")
    counts = {r.file_path.rsplit("/", 1)[-1]: r.n_rows for r in C.rows_per_file(spark.read.option("header", True).csv(str(d))).collect()}
    assert counts == {"a.csv": 2, "b.csv": 1}
