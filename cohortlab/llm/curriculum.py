"""Mixing sources to target weights along a curriculum.

Every source has a share of the training words and a schedule that says how its weight moves
between the start (0) and the end (1) of training. The integral of the schedule is the share of
the source's words wanted by then; inverting it gives the training position at which a document
is due: its words follow those of the documents before it in the source's fixed order, once per
repeat. Sorting by position yields the training order.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import bucket_of, bucket_sums, offsets, order_hash, positions, with_before
from .storage import cut
from .text import aside, free_name, let, n_words, others, quoted

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: (time, weight) knots by the source's place in the cycle of WEIGHTS, joined by straight lines:
#: fading out, even, growing. Only their shape counts.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SEED = "curriculum"
#: sources up to this many are sent to every task; more are joined by a shuffle
BROADCAST_SOURCES = 10_000


def due(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time in [0, 1] at which the integral of the schedule reaches ``share`` of its whole."""
    spans = [(t0, w0, t1 - t0, (w1 - w0) / (t1 - t0)) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    areas = [d * (w + s * d / 2) for _, w, d, s in spans]
    whole, out, reached = sum(areas), None, sum(areas)
    for (t0, w, d, slope), area in reversed(list(zip(spans, areas))):
        reached -= area
        rest = F.greatest(share * F.lit(whole) - F.lit(reached), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.lit(t0) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(w) + root)).otherwise(F.lit(0.0))
        out = at if out is None else F.when(share * F.lit(whole) < F.lit(reached + area), at).otherwise(out)
    return F.least(out, F.lit(1.0))


def share_out(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to one row per source (``source_size``, ``weight``): the sum of all sizes
    by weight, at most ``max_repeats`` times the source's size, the excess reshared by weight
    until none is above. Each round is one sum over the sources still in play."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights, full, out = int(total or 0), int(weights or 0), 0, 0
    while True:
        level = (total - max_repeats * full) / (weights - out) if weights > out else 0.0
        above = max_repeats * F.col("source_size") < F.lit(level) * F.col("weight")
        s, w = sources.where(above).agg(F.sum("source_size"), F.sum("weight")).first() if weights > out else (full, out)
        if (s or 0, w or 0) == (full, out):
            break
        full, out = int(s), int(w)
        if out == weights:
            break
    most = (max_repeats * F.col("source_size")).cast("double")
    if out == weights:
        return sources.withColumn("target", most)
    return sources.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
                weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS,
                out: str = "mix") -> DataFrame:
    """Add the struct ``out``: ``size`` (words), ``source_size``, ``target`` (of the source),
    ``positions`` (training times of the document's repeats, none if it isn't taken) and ``taken``
    (words: size times repeats).

    Within a source documents stand in md5 order of ``key``; repeat e of a document is taken if
    its middle word, counted from e times the source's size, lies within the target, so a
    source's words miss the target by half a document at most. Ties (repeated or null keys) are
    ordered by the text's hash; equal rows are interchangeable. Null sources form one source,
    last in order. Documents without words take nothing. An existing column called ``out`` is
    replaced; all others stay, whatever their names.
    """
    docs, named, back = aside(docs, "_mix_")
    text, source, key = named(text), named(source), named(key)
    n_rows = docs.count()
    d = docs.select("*", n_words(text).alias("_mix_size"), F.xxhash64(F.col(text)).alias("_mix_text"),
                    order_hash(F.col(key), SEED).alias("_mix_h"),
                    F.col(source).isNull().alias("_mix_none"),
                    F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_mix_source"))
    d = d.withColumn("_mix_b", bucket_of(F.col("_mix_h"), n_rows))
    group = ["_mix_none", "_mix_source"]
    table = bucket_sums(d, group, "_mix_b", {"_mix_words": F.col("_mix_size"), "_mix_n": F.lit(1)})
    sources = positions(table.groupBy(*group).agg(F.sum("_mix_words").alias("source_size")),
                        [F.col(c).asc() for c in group], "_mix_at")
    turn = F.col("_mix_at") % len(weights)
    by_turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    sources = cut(share_out(sources.withColumn("weight", by_turn.cast("long")), max_repeats))
    start = offsets(table, group, "_mix_b", "_mix_words", "_mix_start")
    few = sources.count() <= BROADCAST_SOURCES
    sources = sources.select(*group, "_mix_at", F.col("source_size").alias("_mix_all"), F.col("target").alias("_mix_target"))
    start = start.join(F.broadcast(sources) if few else sources, group)
    d = with_before(d, F.col("_mix_size"), group, "_mix_b", ["_mix_h", key, "_mix_text", "_mix_size"], table, "_mix_n", n_rows, "_mix_in")
    d = d.join(start, [*group, "_mix_b"])
    middle = F.col("_mix_start") + F.col("_mix_in") + F.col("_mix_size") / F.lit(2.0)
    size, target, whole = F.col("_mix_size"), F.col("_mix_target"), F.col("_mix_all")

    def repeats(m):
        due_by_turn = lambda share: F.element_at(F.array(*[due(share, s) for s in schedules]), (
            F.col("_mix_at") % len(schedules) + 1).cast("int"))
        shares = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: m + e * whole)
        taken = F.filter(shares, lambda x: (x <= target) & (size > 0))
        return F.transform(taken, lambda x: due_by_turn(x / target))

    mixed = let(let(middle, repeats), lambda p: F.struct(
        size.alias("size"), whole.alias("source_size"), target.alias("target"), p.alias("positions"),
        (size * F.size(p)).cast("long").alias("taken")))
    return back(d.select(*others(docs, out), mixed.alias(out)))


def by_position(mixed: DataFrame, out: str = "mix", key: str = "doc_id") -> DataFrame:
    """Range-sort one row per document by its first training time. Documents that aren't taken
    follow, spread evenly by their hash, as a reserve."""
    reserve = F.lit(1.0) + order_hash(F.col(key), SEED) / F.lit(float(1 << 60))
    at = F.coalesce(F.get(quoted(out)["positions"], F.lit(0)), reserve)
    pos = free_name(mixed, "mix_pos")
    return mixed.withColumn(pos, at).repartitionByRange(F.col(pos)).sortWithinPartitions(pos, quoted(key)).drop(pos)


def training_rows(mixed: DataFrame, out: str = "mix", key: str = "doc_id") -> DataFrame:
    """The mix itself: one row per document and repeat, range-sorted by training time."""
    pos = free_name(mixed, "mix_pos")
    d = mixed.select(*others(mixed, out), F.explode(quoted(out)["positions"]).alias(pos))
    return d.repartitionByRange(F.col(pos)).sortWithinPartitions(pos, quoted(key)).drop(pos)
