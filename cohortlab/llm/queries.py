"""Registered queries of the corpus operators and, where SQL can express them, their oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (curriculum, embed_cells, exact_dedup, fill_middle, lang_gru, line_runs, parity_join, pieces, quality,
               secret_scan, shards, turn_repair, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- 3: quality rules ------------------------------------------------------------------------
def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(set(values)))


def _sql_rules() -> str:
    tests = []
    for r in quality.RULES:
        tests += [f"{r.measure} >= {float(r.low)}"] if r.low is not None else []
        tests += [f"{r.measure} <= {float(r.high)}"] if r.high is not None else []
    return " AND ".join(tests)


OP3_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(txt, '[\x09-\x0D ]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS ls FROM t),
tri AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n >= 2),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(ws) AS n_words,
         length(regexp_replace(txt, '[\x09-\x0D ]+', '', 'g')) AS word_chars,
         length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_in(quality.STOP_WORDS)}))) AS n_stop,
         len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_exclaimed
  FROM w LEFT JOIN rep USING (rid)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word,
         CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END AS stop_word_share,
         CASE WHEN n_words > 0 THEN n_exclaimed::DOUBLE / n_words ELSE 0 END AS exclaimed_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
         (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) AS base_failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed AND {_sql_rules()}) AS kept
FROM r"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark, sf_dir):
    q = F.col("quality")
    m = q["measures"]
    return quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        q["base_failed"].alias("base_failed"), q["kept"].alias("kept"))


# --- 4: mixing sources -----------------------------------------------------------------------
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'),
                                               lambda x: x <> '')) AS size,
         substr(md5('curriculum:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (
  SELECT *, 3.0 * source_size / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS cs,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS cw FROM s),
levels AS (
  SELECT CAST(any_value(total) AS DOUBLE) / CAST(any_value(all_w) AS DOUBLE) AS lv, 0.0 AS least_ratio FROM r
  UNION ALL SELECT CAST(total - cs AS DOUBLE) / CAST(all_w - cw AS DOUBLE), ratio FROM r WHERE all_w > cw),
lv AS (
  SELECT lv FROM levels l
  WHERE l.lv >= l.least_ratio
    AND abs((SELECT sum(least(3.0 * source_size, l.lv * w)) FROM s) - (SELECT sum(source_size) FROM s))
        <= 1e-9 * (SELECT sum(source_size) FROM s) + 1e-6
  ORDER BY lv LIMIT 1),
t AS (SELECT source, source_size, least(3.0 * source_size, lv * w) AS target FROM s, lv),
c AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * ((mid <= target)::INT + (mid + source_size <= target)::INT + (mid + 2 * source_size <= target)::INT)
            AS BIGINT) AS taken
FROM c"""


@query("op4_curriculum_mix", OP4_SQL)
def op4_curriculum_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = F.col("mix")
    mixed = curriculum.mix_sources(docs).select("doc_id", "mix")
    return curriculum.by_position(mixed).select(
        "doc_id", *[m[c].alias(c) for c in ("size", "source_size", "target", "taken")])


# --- 9: sharding -----------------------------------------------------------------------------
@query("op9_jump_shards")
def op9_jump_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("shard_info")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return shards.shard(docs.withColumn("text_crc32", crc)).select(
        "doc_id", s["size"].alias("size"), "text_crc32", F.lit("key").alias("law"), s["shard"].alias("shard"),
        s["slot"].cast("long").alias("slot"), s["grown_shard"].alias("grown_shard"))


# --- 5: line dedup ---------------------------------------------------------------------------
OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
l AS (
  SELECT doc_id, i, line, lower_ascii AS k FROM (
    SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
          FROM (SELECT doc_id, string_split(txt, chr(10)) AS ls FROM d)))),
heavy AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, keeper IS NOT NULL AND doc_id < keeper AS gone FROM l LEFT JOIN heavy USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@query("op5_line_runs", OP5_SQL)
def op5_line_runs(spark, sf_dir):
    x = F.col("lines")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.dedup_lines(docs).select(
        "doc_id", x["n_lines"].alias("n_lines"), x["n_dropped"].alias("n_dropped"),
        F.sha2(x["text"], 256).alias("kept_sha256"))


# --- 1: URL filters --------------------------------------------------------------------------
@query("op1_url_rules")
def op1_url_rules(spark, sf_dir):
    """A page's URL ends in the id of the document that it shows; its labels teach the rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.try_to_number(F.regexp_extract(F.col("url"), "://[^?#]*/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("shown"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    labelled = pages.select("url", shown.alias("shown")).join(labels, "shown").select("url", "verdict")
    v = F.col("url_verdict")
    return url_rules.judge_urls(pages, labelled).select(
        "page_id", v["host"].alias("host"), v["path"].alias("path"), v["rule"].alias("rule"),
        v["verdict"].alias("verdict"), F.array_join(v["mined"], " ").alias("mined_rule"))


# --- 10: n-gram Jaccard join -----------------------------------------------------------------
@query("op10_parity_join")
def op10_parity_join(spark, sf_dir):
    return parity_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 8: secret scans -------------------------------------------------------------------------
@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("doc_id", "spans")
    kinds = [r.kind for r in secret_scan.BASE]

    def listed(spans):
        each = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(each, ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in kinds],
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


# --- 6: embedding near-dedup -----------------------------------------------------------------
@query("op6_embedding_cells")
def op6_embedding_cells(spark, sf_dir):
    return embed_cells.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# --- 2: language identification --------------------------------------------------------------
@query("op2_language_gru")
def op2_language_gru(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found, x = lang_gru.identify_language(docs), F.col("language")
    return found.select("doc_id", lang_gru.held_out(F.col("doc_id")).alias("held_out"),
                        x["lang_pred"].alias("lang_pred"), x["score"].alias("score"))


# --- 7: SentencePiece ------------------------------------------------------------------------
@query("op7_sampled_pieces")
def op7_sampled_pieces(spark, sf_dir):
    p = F.col("pieces")
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", p["n"].alias("n_pieces"), p["lossless"].alias("lossless"), p["ids"].alias("ids"))


# --- 11: fill-in-middle ----------------------------------------------------------------------
@query("op11_fill_middle")
def op11_fill_middle(spark, sf_dir):
    x = F.col("fim")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle.fill_in_middle(docs).select(
        "doc_id", *[x[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(x["output"], 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(x["output"], x["form"]), 256).alias("restored_sha256"))


# --- 12: exact dedup -------------------------------------------------------------------------
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x09-\x0D ]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


@query("op12_heavy_hitters", OP12_SQL)
def op12_heavy_hitters(spark, sf_dir):
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


# --- 13: conversation structure repair -------------------------------------------------------
@query("op13_turn_grammar")
def op13_turn_grammar(spark, sf_dir):
    return turn_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))
