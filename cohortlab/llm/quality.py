"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression on the row's own text, so the operator is a map over
the scan: no shuffle, no Python, and a row of any length costs time in proportion to
``n log n`` of its words.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITE_RUN, let, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: percent of the words that may stand in repeated three-word windows
MAX_REPEATED = 50

#: Common function words of the languages served; lower case.
STOP_WORDS = (
    "a about after all also an and are as at be been but by can for from had has have he her his if in is it its "
    "more no not of on one or other our she so some than that the their them then there these they this to up was "
    "we were what when which who will with would you "
    "aber als am an auch auf aus bei das dass dem den der des die du durch ein eine einem einen einer er es für "
    "hat ich ihr im in ist man mit nach nicht noch nur oder sein sich sie sind so über um und von vor war wenn "
    "werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou "
    "par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "al como con cuando de del desde el ella en entre era es esta este ha hay la las le lo los más me mi no o para "
    "pero por que se ser si sin sobre son su sus también un una y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The table of the verdict; a document fails on the first measure outside its range.
RULES = (
    Rule("mean_word_chars", low=1.5, high=25.0),
    Rule("symbols_per_word", high=0.2),
    Rule("stop_word_share", low=0.005),
    Rule("dup_line_share", high=0.5),
    Rule("exclaimed_share", high=0.5),
)


def repeated_words(ws: Column) -> Column:
    """Number of words in three-word windows that occur twice or more in the array ``ws``.

    Windows are compared by 64-bit hash. Most texts repeat few: a plain sort of the hashes gives
    the repeated ones, a 64-bit mask of these leaves few candidate positions, and sorting the
    candidates' (hash, position) puts equal windows side by side. The positions that have an
    equal neighbour, sorted again, cover ``min(3, distance to the next such position)`` words each.
    """
    def bit(h):
        return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    def same(s, i, j):
        return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))

    def mask(h):
        twice = let(F.array_sort(h), lambda s: F.filter(s, lambda x, k: x == F.get(s, k - 1)))
        return F.aggregate(twice, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))

    def candidates(h, m):
        at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: m.bitwiseAND(bit(F.get(h, i))) != 0)
        return F.array_sort(F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))

    def starts(s):
        hits = F.filter(s, lambda x, k: same(s, k, k - 1) | same(s, k, k + 1))
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                           F.lit(0), lambda a, x: a + x)

    def of_hashes(h):
        some = let(mask(h), lambda m: let(candidates(h, m), lambda s: let(starts(s), covered)))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - 2),
                         lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)))
    return F.when(F.size(ws) >= 4, let(hashes, of_hashes)).otherwise(F.lit(0)).cast("long")


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Struct of the base counts and the ratios; words and lines are split once a row."""
    t = F.coalesce(text, F.lit(""))
    stops = sorted(set(stop_words))

    def count(arr, test):
        return F.size(F.filter(arr, test)).cast("long")

    def of_words(ws):
        return F.struct(
            F.size(ws).cast("long").alias("n"),
            repeated_words(ws).alias("repeated"),
            count(ws, lambda w: F.lower(w).isin(*stops)).alias("stops"),
            count(ws, lambda w: w.endswith("!!")).alias("exclaimed"),
        )

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    filled = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\t-\\r ]"))
    raw = F.struct(
        let(words(t), of_words).alias("w"),
        let(filled, of_lines).alias("l"),
        F.length(F.regexp_replace(t, WHITE_RUN, "")).cast("long").alias("chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("symbols"),
    )

    def share(a, b):
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    return let(raw, lambda m: F.struct(
        m["w"]["n"].alias("n_words"), m["chars"].alias("word_chars"), m["symbols"].alias("n_symbols"),
        m["l"]["dup"].alias("n_dup_lines"), m["w"]["repeated"].alias("n_repeat_words"),
        share(m["chars"], m["w"]["n"]).alias("mean_word_chars"),
        share(m["symbols"], m["w"]["n"]).alias("symbols_per_word"),
        share(m["w"]["stops"], m["w"]["n"]).alias("stop_word_share"),
        share(m["w"]["exclaimed"], m["w"]["n"]).alias("exclaimed_share"),
        share(m["l"]["dup"], m["l"]["n"]).alias("dup_line_share"),
        ((m["w"]["n"] < MIN_WORDS)
         | (100 * m["w"]["repeated"] > MAX_REPEATED * m["w"]["n"])).alias("base_failed"),
    ))


def broken_rule(m: Column, rules: Sequence[Rule]) -> Column:
    """Measure of the first rule in the table that the struct ``m`` breaks, else null."""
    first = F.lit(None).cast("string")
    for r in reversed(list(rules)):
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m[r.measure] < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (m[r.measure] > F.lit(float(r.high)))
        first = F.when(bad, F.lit(r.measure)).otherwise(first)
    return first


def quality_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES,
                  out: str = "quality") -> DataFrame:
    """Add the struct column ``out``: ``measures`` (base counts, ratios, ``base_failed``),
    ``failed_rule`` (first rule of the table that the document breaks, or null) and ``kept``.

    A null or empty text has no words and so fails the base rule. Repeated rows are judged each
    for itself and alike; an empty table gives an empty table. An existing column called
    ``out`` is replaced; all others stay.
    """
    def judged(m):
        return F.struct(m.alias("measures"), m["base_failed"].alias("base_failed"),
                        broken_rule(m, rules).alias("failed_rule"),
                        (~m["base_failed"] & broken_rule(m, rules).isNull()).alias("kept"))

    return docs.withColumn(out, let(measures(F.col(text)), judged))
