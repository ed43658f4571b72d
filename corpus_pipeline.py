"""From raw documents to training pieces: each stage is one operator of ``cohortlab.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import curriculum, line_runs, parity_join, pieces, quality
from cohortlab.llm.text import free_name, quoted
from cohortlab.session import ensure_checkpoint_dir


def _columns(docs: DataFrame) -> list:
    return [quoted(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = free_name(docs, "quality")
    return quality.quality_rules(docs, out=judged).where(F.col(judged)["kept"]).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; ``n_chars``, if there, follows the text."""
    lines = free_name(docs, "lines")
    found = F.col(lines)
    changed = found["n_dropped"] > 0
    new = {"text": F.when(changed, found["text"]).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(found["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return line_runs.dedup_lines(docs, out=lines).select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return parity_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in training order: documents that it takes, once per repeat."""
    mixed = free_name(docs, "mix")
    return curriculum.training_rows(curriculum.mix_sources(docs, out=mixed), out=mixed).select(*_columns(docs))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text, and whether they decode to it."""
    out = free_name(docs, "pieces")
    p = F.col(out)
    return pieces.encode(docs, out=out).select("doc_id", p["n"].alias("n_pieces"), p["lossless"].alias("lossless"),
                                               p["ids"].alias("ids"))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: sampling pieces can't be said in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the cluster's shared folder for the next; what
    a stage has read is emptied when its own result is there."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    root, before = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
        if before:
            spark.range(0).write.mode("overwrite").parquet(before)
        before = f"{root}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {}
