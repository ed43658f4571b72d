"""URL filters: fixed rules by host and path, and rules mined from labelled pages.

A URL is a set of tokens. Tokens that stand on the same labelled URLs are one item, since a
combination of them says what each says alone; items with a single label are rules by themselves and
say all that their combinations could. FP-growth over what is left finds combinations that go with
a label; rules below the support or confidence wanted, and rules that say no more than a shorter
one, are pruned. An inverted index keyed by each rule's rarest item matches them: a URL is tested
only against the rules under its own items, and equal token sets are tested once.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, sized
from .text import free_name, let, others, quoted

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its path
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.1
LABEL = "label="


def host_and_path(url: Column) -> Column:
    """Struct (host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path then up to ``?``, ``#`` or the end. Both empty if null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    return let(F.coalesce(rest, F.lit("")), lambda r: F.struct(
        F.translate(F.regexp_extract(r, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase).alias("host"),
        F.regexp_extract(r, "^[^/?#]*([^?#]*)", 1).alias("path")))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Of equally long ones the
    longer host wins, then block."""
    order = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), reverse=True)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: the host, its labels, folders of the path (numbers as ``#``),
    file suffix, names of query arguments, presence of a fragment."""
    def tagged(tag, arr):
        return F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    folders = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    suffix = F.regexp_extract(path, "\\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    marks = F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("fragment")))
    return F.array_sort(F.array_distinct(F.concat(
        tagged("host:", F.array(host)), tagged("label:", F.split(host, "\\.")), tagged("folder:", folders),
        tagged("suffix:", F.array(suffix)), tagged("arg:", names),
        F.coalesce(marks, F.array().cast("array<string>")))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """Rules (items, verdict, confidence, support, anchor) mined from rows (tokens, verdict), and the
    members (token, item) of their items.

    A rule needs ``min_support`` of the labelled URLs, ``min_confidence`` and ``min_lift``, and
    goes if some of its items alone give the same verdict with as much confidence. An item stands for
    all tokens on the same labelled URLs, and is named after the least; a URL has it if it has
    one of them. ``anchor`` is a rule's rarest item. No labelled row gives no rule.
    """
    spark = labelled.sparkSession
    both = cut(labelled.where(F.col("verdict").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "verdict"))
    base = {r["verdict"]: r["n"] for r in both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(base.values())
    if not n:
        return (spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double, anchor string"),
                spark.createDataFrame([], "token string, item string"))
    least = max(1, math.ceil(min_support * n))
    # the rows of a token, as their number and two sums of hashes, and whether they have a single label
    rows = both.select(F.explode("tokens").alias("token"), "verdict", *[
        F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)").alias(f"s{seed}") for seed in (1, 2)])
    cover = rows.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
                                      F.min("verdict").alias("verdict"), (F.min("verdict") == F.max("verdict")).alias("pure"))
    cover = cut(cover.where(F.col("freq") >= least))
    # as many tokens as a URL has, at most
    items = cut(cover.groupBy("freq", "s1", "s2").agg(F.min("token").alias("item"), F.first("verdict").alias("verdict"),
                                                      F.first("pure").alias("pure")))
    members = cut(cover.join(items.select("freq", "s1", "s2", "item", F.col("pure").alias("alone")), ["freq", "s1", "s2"]).select(
        "token", "item", "alone"))
    share = F.lit(None).cast("double")
    for verdict, k in base.items():
        share = F.when(F.col("verdict") == verdict, F.lit(k / n)).otherwise(share)

    def strong(df):
        return df.where((F.col("confidence") >= min_confidence) & (F.col("confidence") / share >= min_lift))

    single = strong(items.where("pure").select(F.array("item").alias("items"), "verdict", F.lit(1.0).alias("confidence"),
                                               (F.col("freq") / F.lit(n)).alias("support")))
    mixed = both.select("row", "verdict", F.explode("tokens").alias("token")).join(
        sized(members.where("not alone").select("token", "item")), "token")
    mixed = mixed.groupBy("row", "verdict").agg(F.collect_set("item").alias("items"))
    mixed = mixed.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    mixed = cut(mixed)
    left = mixed.count()
    # of the rows that have an item left, so that the least number of rows stays what it was
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / left), minConfidence=min_confidence).fit(
        mixed).freqItemsets if left else spark.createDataFrame([], "items array<string>, freq long")
    found = cut(found)
    marked = lambda x: x.startswith(LABEL)
    known = F.exists("items", marked)
    parts = found.where(known & (F.size("items") > 1)).select(
        F.array_sort(F.filter("items", lambda x: ~marked(x))).alias("items"),
        F.substring(F.filter("items", marked)[0], len(LABEL) + 1, 1 << 30).alias("verdict"), F.col("freq").alias("both"))
    alone = found.where(~known).select(F.array_sort("items").alias("items"), "freq")
    rules = strong(parts.join(alone, "items").select(
        "items", "verdict", (F.col("both").cast("double") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(n)).alias("support")))
    rules = rules.unionByName(single)
    rarest = rules.select("items", "verdict", F.explode("items").alias("item")).join(items.select("item", "freq"), "item").groupBy(
        "items", "verdict").agg(F.min(F.struct("freq", "item"))["item"].alias("anchor"))
    rules = cut(rules.join(rarest, ["items", "verdict"]))
    # rules on part of a rule's items are found under their anchors
    shorter = rules.select("anchor", "verdict", F.col("items").alias("part"), F.col("confidence").alias("at_least"))
    longer = rules.where(F.size("items") > 1).select("items", "verdict", "confidence", F.explode("items").alias("anchor"))
    idle = longer.join(shorter, ["anchor", "verdict"]).where(
        (F.size("part") < F.size("items")) & (F.col("at_least") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
    kept = cut(rules.join(idle.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti"))
    used = kept.select(F.explode("items").alias("item")).distinct()
    return kept, cut(members.select("token", "item").join(used, "item", "left_semi"))


def match_rules(sets: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """For distinct token sets (``tokens``): the best rule that fits each, if any: the highest
    confidence, then support, then block, then the order of the tokens that fit it."""
    index = rules.select("anchor", F.col("items").alias("_i"), F.struct("confidence", "support", (F.col("verdict") == "block").alias("block"),
                                                                        "verdict").alias("_r"))
    # the set's items, each with the last of its tokens
    own = sets.select("tokens", F.explode("tokens").alias("token")).join(sized(members), "token").groupBy("tokens", "item").agg(
        F.max("token").alias("token"))
    own = own.groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("_m"))
    seen = own.select("tokens", "_m", F.explode(F.map_keys("_m")).alias("anchor"))
    fits = F.forall("_i", lambda x: F.map_contains_key("_m", x))
    r = F.col("_r")
    best = F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), r["block"].alias("block"),
                    F.array_sort(F.transform("_i", lambda x: F.element_at("_m", x))).alias("rule"), r["verdict"].alias("verdict"))
    return seen.join(index, "anchor").where(fits).select("tokens", best.alias("_b")).groupBy("tokens").agg(F.max("_b").alias("mined"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url",
               rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", out: str = "url_verdict",
               **mining) -> DataFrame:
    """Add the struct ``out``: ``host``, ``path``, ``rule`` (fixed rule that fits, or null), ``mined``
    (tokens of the mined rule that decided, or null) and ``verdict``: the fixed rule's, else the
    mined rule's, else ``default``.

    ``labelled`` has the columns ``url`` and ``verdict``. A null URL, or one without ``://``, has no
    tokens, so only ``default`` can hold. Repeated rows are judged alike; an empty table gives an
    empty table. An existing column called ``out`` is replaced; all others stay, whatever their names.
    """
    def parsed(df, parts, tokens):
        hp = F.col(parts)
        d = df.withColumn(parts, host_and_path(quoted(url)))
        found = F.when(hp["host"] != "", url_tokens(quoted(url), hp["host"], hp["path"]))
        return d.withColumn(tokens, F.coalesce(found, F.array().cast("array<string>")))

    parts, tokens, decided, mined, key = (free_name(pages, x) for x in ("url_parts", "url_tokens", "url_fixed", "url_mined", "url_set"))
    d = parsed(pages, parts, tokens)
    hp, fixed, m = F.col(parts), F.col(decided), F.col(mined)
    d = d.withColumn(decided, fixed_rule(hp["host"], hp["path"], rules))
    if labelled is None:
        d = d.withColumn(mined, F.lit(None).cast("struct<rule:array<string>,verdict:string>"))
    else:
        known = parsed(labelled.select(quoted(url), "verdict"), "_url_parts", "_url_tokens")
        found, members = mine_rules(known.select(F.col("_url_tokens").alias("tokens"), "verdict"), **mining)
        sets = d.where(fixed.isNull()).select(F.col(tokens).alias("tokens")).distinct()
        best = match_rules(sets, found, members).select(F.array_join("tokens", " ").alias(key), F.col("mined").alias(mined))
        d = d.withColumn(key, F.when(fixed.isNull(), F.array_join(tokens, " "))).join(best, key, "left")
    return d.select(*others(pages, out), F.struct(
        hp["host"].alias("host"), hp["path"].alias("path"), fixed["rule"].alias("rule"), m["rule"].alias("mined"),
        F.coalesce(fixed["verdict"], m["verdict"], F.lit(default)).alias("verdict")).alias(out))
