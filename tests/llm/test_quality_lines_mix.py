"""Quality rules, line dedup and mixing against plain Python on an odd table."""
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import curriculum, line_runs, quality

from . import brute, odd


def key(row):
    return tuple((x is None, x) for x in row)


def test_quality(spark):
    df = quality.quality_rules(odd.table(spark))
    m = F.col("quality")["measures"]
    got = df.select("doc_id", "text", *[m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    m["base_failed"], F.col("quality")["kept"]).collect()
    assert len(got) == len(odd.rows()) and "a.b" in df.columns
    for row in got:
        assert tuple(row)[2:8] == brute.quality(row["text"]), row["text"][:80]
        assert not (row[7] and row[8])


def test_quality_keeps_prose_and_drops_junk(spark):
    prose = "The house by the river was green and the people of the town would walk over there each day. "
    good = " ".join(f"{prose} number{i}" for i in range(0, 1)) + " ".join(f"word{i} and" for i in range(60))
    rows = [(1, good, None, None), (2, " ".join(f"sym{i}###" for i in range(90)), None, None),
            (3, " ".join(f"THIS{i}!!" for i in range(90)), None, None), (4, None, None, None)]
    kept = quality.quality_rules(odd.table(spark, rows)).select("doc_id", "quality.kept", "quality.failed_rule").collect()
    assert {r[0]: r[1] for r in kept} == {1: True, 2: False, 3: False, 4: False}
    assert {r[0]: r[2] for r in kept}[2] == "symbols_per_word"


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines(spark, batches, fanout):
    df = line_runs.dedup_lines(odd.table(spark), batches=batches, fanout=fanout)
    x = F.col("lines")
    got = df.select("doc_id", x["n_lines"], x["n_dropped"], F.sha2(x["text"], 256)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.line_dedup([r[:2] for r in odd.rows()]), key=key)
    assert "a.b" in df.columns and sum(r[2] for r in got) >= 10


def test_runs_are_compacted(spark):
    runs = line_runs.LineRuns(min_docs=2, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b * 10 + i, i, i) for i in range(3)], "_ln_doc long, _ln_h1 long, _ln_h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["_ln_h1r"], r["max_doc"]) for r in runs.settled().collect()} == {(0, 40), (1, 41), (2, 42)}


def test_mix(spark):
    df = curriculum.mix_sources(odd.table(spark))
    got = df.select("doc_id", "source", "text", "mix.*", F.col("size").alias("own_size"), F.col("target").alias("own_target")).collect()
    sizes = defaultdict(int)
    for _, t, _, s in odd.rows():
        sizes[s] += len(brute.words(t))
    want, taken = brute.targets(dict(sizes)), defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r["own_size"] == 1 and r["own_target"] == "w"
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * len(r["positions"]) <= 3 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = curriculum.mix_sources(odd.table(spark).repartition(7)).select("doc_id", "mix").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in df.select("doc_id", "mix").collect())
    rows = curriculum.training_rows(df)
    assert rows.count() == sum(len(r["positions"]) for r in got) and "mix" not in rows.columns
    assert curriculum.by_position(df).count() == len(got)


def test_due_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
    rows = spark.range(11).select((F.col("id") / 10).alias("q")).select("q", curriculum.due(F.col("q"), knots).alias("t")).collect()
    for r in rows:
        area = 0.5 * r["t"] + r["t"] ** 2 / 2  # weight 0.5 + t
        assert area / 1.0 == pytest.approx(r["q"], abs=1e-9)


@pytest.mark.parametrize("operator", [quality.quality_rules, line_runs.dedup_lines, curriculum.mix_sources])
def test_empty_table(spark, operator):
    assert operator(odd.table(spark, [])).count() == 0
