"""Line dedup over levelled sorted runs.

What is known about lines lives in runs: one row per line key with the number of documents
that hold it and the largest of their ids, sorted by the key's hash. A new batch of documents
merge-anti-joins the runs, which drops the lines already known to be settled, and adds its own
run at level 0; when a level has ``fanout`` runs they are compacted into one of the next level.
Counts only grow and the largest id only rises, so what a step drops stays dropped; a last
anti-join against the compacted runs drops the rest.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .text import WHITE_SPACE, ascii_lower, aside, hash128, let, others

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 2
BATCHES = 4
KEY = ["_ln_h1", "_ln_h2"]


class LineRuns:
    """The store: ``levels[i]`` holds the runs of level i, each a checkpointed table of
    (hash, n_docs, max_doc). Batches must not share documents."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, lines: DataFrame) -> None:
        """Add the run of a batch of lines (``_ln_doc`` and the hash), then compact full levels."""
        once = lines.select("_ln_doc", *KEY).distinct()
        run = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("_ln_doc").alias("max_doc"))
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(cut(run.sortWithinPartitions(*KEY)))
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = self._merged(self.levels[level]), []
            level += 1

    def settled(self) -> DataFrame | None:
        """Keys held by enough documents so far, with the largest id."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        heavy = self._merged(runs).where(F.col("n_docs") >= self.min_docs)
        return cut(heavy.select(*[F.col(k).alias(f"{k}r") for k in KEY], "max_doc"))

    def surviving(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join: the lines that aren't yet known to be dropped."""
        heavy = self.settled()
        if heavy is None:
            return lines
        same = [F.col(k) == F.col(f"{k}r") for k in KEY]
        return lines.join(heavy.hint("merge"), [*same, F.col("_ln_doc") < F.col("max_doc")], "left_anti")

    def step(self, lines: DataFrame) -> DataFrame:
        """A batch's lines that survive the runs so far, written, and added as its run. Written, so
        that the join that comes last has an exchange of its own, whose hot keys can be split."""
        mine = cut(self.surviving(lines)) if self.levels else lines
        self.add(mine)
        return mine


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _long(line: Column, min_chars: int) -> Column:
    return F.length(F.btrim(line, F.lit(WHITE_SPACE))) >= min_chars


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT,
                out: str = "lines") -> DataFrame:
    """Add the struct ``out``: ``n_lines``, ``n_dropped`` and ``text`` (the lines that stay,
    joined by \\n).

    A line's key is the line without white space at its ends, A-Z lower-cased. Lines whose key
    has ``min_chars`` code points or more and stands in ``min_docs`` documents or more go from
    all but the document with the largest id. Rows with one id are one document; a null id is
    one document, smaller than all others. A null or empty text is one empty line. Keys are
    compared by 128-bit hash. An existing column called ``out`` is replaced; all others stay,
    whatever their names.
    """
    docs, named, back = aside(docs, "_ln_")
    text, key = named(text), named(key)
    least = F.lit(-(1 << 63)).cast("long")
    d = docs.select("*", F.coalesce(F.col(key).cast("long"), least).alias("_ln_doc"),
                    F.xxhash64(F.col(text)).alias("_ln_text"))
    hashed = let(_lines(F.col(text)), lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(
        _long(x, min_chars), let(line_key(x), lambda k: F.struct(
            i.alias("at"), *[h.alias(n) for h, n in zip(hash128(k), KEY)])))), lambda x: x.isNotNull()))
    lines = d.select("_ln_doc", "_ln_text", F.inline(hashed))
    lines = cut(lines.withColumn("_ln_batch", F.pmod(F.xxhash64("_ln_doc"), F.lit(batches)).cast("int")))
    runs, left = LineRuns(min_docs, fanout), None
    for b in range(batches):
        mine = runs.step(lines.where(F.col("_ln_batch") == b))
        left = mine if left is None else left.unionByName(mine)
    kept = runs.surviving(left).groupBy("_ln_doc", "_ln_text").agg(F.collect_list("at").alias("_ln_kept"))
    d = d.join(kept, ["_ln_doc", "_ln_text"], "left")

    def rebuilt(ls):
        at = F.sequence(F.lit(0), F.size(ls) - 1)
        candidates = F.filter(at, lambda i: _long(F.get(ls, i), min_chars))
        gone = F.array_except(candidates, F.coalesce(F.col("_ln_kept"), F.array().cast("array<int>")))
        return let(F.array_except(at, gone), lambda stay: F.struct(
            F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(stay)).cast("long").alias("n_dropped"),
            F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n").alias("text")))

    return back(d.select(*others(docs, out), let(_lines(F.col(text)), rebuilt).alias(out)))
