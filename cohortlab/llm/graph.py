"""Connected components of an edge table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: rows of a task, of which there are FEW at least
TASK_ROWS, FEW = 50_000, 8


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest id reachable.

    Each round hangs the larger neighbours of a node under its smallest one (large star), then
    the smaller neighbours (small star), until every component is a star around its smallest
    id. A round is two sums by node and two joins; minima are combined before the shuffle, and
    the rounds grow with the logarithm of the longest path. Null ids are left out. What a round
    shuffles is in proportion to its edges, which are counted: so is the number of its tasks, where
    that is below the session's, for a few edges in many partitions are mostly files.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, state = cut(e), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(now)
        tasks = max(FEW, -(-now[0] // TASK_ROWS))
        e = e.coalesce(tasks)
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")).coalesce(tasks))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u > v").coalesce(tasks).distinct().coalesce(tasks))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        pairs = large.join(low, "u").coalesce(tasks)
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v")))
        e = cut(small.where("u > v").distinct().coalesce(tasks))
