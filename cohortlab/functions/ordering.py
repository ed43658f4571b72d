"""Global ranks and running sums without a single-partition window.

``row_number() OVER (ORDER BY h)`` moves every row into one task. Instead the order key is
cut into buckets that are monotone in the order (a hash prefix, or quantile bounds of a
value); per-bucket counts form a tiny table whose running sum gives each bucket's offset;
rows are ranked inside ``(group, bucket)`` and the offset is added. Only the tiny table is
ever ordered as a whole. When ``partition_by`` is given the same happens per group, so a
group holding a third of all rows is still spread over all of its buckets.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import radix

# Hex digits of the md5 prefix used as bucket; 4 digits = 65,536 buckets, i.e. about
# 1.5 M rows per ranking task at 10^11 rows.
HASH_BUCKET_DIGITS = 4
# per-group tables of up to this many rows (counted) are broadcast; larger ones are shuffled
MAX_BROADCAST_ROWS = 1_000_000


def hash_bucket(h: Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    return F.substring(h, 1, digits)


#: rows that a value bucket may hold, and the most buckets
BUCKET_ROWS, MAX_BUCKETS = 100_000, 65_536


def with_value_bucket(df: DataFrame, col: str, out: str = "_vb", n_buckets: int | None = None,
                      tiebreak: str | None = None) -> DataFrame:
    """Add ``out`` = a bucket (a struct) monotone in ``col``, of ``BUCKET_ROWS`` rows or fewer.

    Buckets are prefixes of the values' order-preserving images (``radix``): 16 bits, or 16 more where a prefix
    holds too many rows, up to single values; ``n_buckets`` asks for about so many buckets instead. The
    prefixes split are joined as small tables, as many rows at most as there are buckets. A single value
    with too many rows is split again by ``tiebreak`` (a hex string column; order ties by it): ``prefix * c //
    65536`` of its first 4 digits, c being the buckets that it should fill. Without ``tiebreak`` equal
    values share one bucket, which running sums over ties rely on. ``out`` is never null: nulls come
    first, in buckets by the tiebreak."""
    img, prefix = f"{out}_img", F.lit(0).cast("long")
    if tiebreak is not None:
        prefix = F.conv(F.substring(F.col(tiebreak), 1, 4), 16, 10).cast("long")
    d = df.withColumn(img, radix.image(F.col(col)))
    images = d.select(F.col(img).alias("_img"))
    n = df.count()
    most = max(1, n // n_buckets) if n_buckets else max(BUCKET_ROWS, n // MAX_BUCKETS)
    part, sub = radix.leading(img, 16) * F.lit(1 << 48), F.lit(0).cast("long")
    hot = radix.hot_prefixes(images, most) if n > most else []
    for bits, table in hot:
        name = f"{out}_n{bits}"
        t = F.broadcast(table.select(F.col("part").alias(f"{out}_p"), F.col("n").alias(name)))
        d = d.join(t, radix.leading(img, bits) == F.col(f"{out}_p"), "left").drop(f"{out}_p")
        if bits < radix.BITS:
            finer = radix.leading(img, bits + 16) * F.lit(1 << (48 - bits)) if bits < 48 else F.col(img)
            part = F.when(F.col(name).isNotNull(), finer).otherwise(part)
        elif tiebreak is not None:
            span = F.ceil(F.col(name) / F.lit(most))
            sub = F.when(F.col(name).isNotNull(), F.floor(prefix * span / F.lit(65536))).otherwise(sub).cast("long")
    return d.withColumn(out, F.struct(part.alias("part"), sub.alias("sub"))).drop(img, *[f"{out}_n{bits}" for bits, _ in hot])


def row_tiebreak(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """Deterministic hex tiebreak from the row's values (xxhash64, 16 hex digits): rows that
    tie on the order key are ordered the same way on every run and every partitioning;
    fully identical rows are interchangeable."""
    from pyspark.sql.types import MapType

    if cols is None:   # hashing cannot take MAP columns
        cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    return F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in cols])), 16, "0")


def ranked(df: DataFrame, order_by: Sequence[Column | str], bucket: Column,
           partition_by: Sequence[str] = (), rank_col: str = "rn", size_col: str | None = None,
           broadcast_offsets: bool | None = None) -> DataFrame:
    """Add a 1-based ``rank_col`` = row_number over (partition_by, order by order_by).

    ``bucket`` must be non-decreasing in ``order_by``. Optionally add ``size_col`` = group size.
    """
    keys = list(partition_by) + ["_bkt"]
    df = df.withColumn("_bkt", bucket)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*partition_by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*partition_by)))
    offsets = offsets.drop("_cnt")
    inner = Window.partitionBy(*keys).orderBy(*order_by)
    out = df.withColumn("_r", F.row_number().over(inner))
    if broadcast_offsets is None:
        # without groups the offset table is bounded by the bucket count
        broadcast_offsets = not partition_by
    out = out.join(F.broadcast(offsets) if broadcast_offsets else offsets, keys)
    return out.withColumn(rank_col, F.col("_r") + F.col("_off")).drop("_bkt", "_r", "_off")


def rank_cuts(df: DataFrame, h: str, key: str, targets: Column, partition_by: Sequence[str] = (),
              out: str = "_passed", group_info: DataFrame | None = None, digits: int = HASH_BUCKET_DIGITS) -> DataFrame:
    """Add ``out`` = #{t in targets : rank > t}, rank = row_number() OVER (PARTITION BY
    partition_by ORDER BY h, key), WITHOUT ranking (or shuffling) the rows.

    Positional cuts (equal blocks, a test fraction, the first n of a group) need only the
    rows sitting AT the cut ranks. So: (1) count rows per (group, hash-prefix bucket), a
    partial aggregate; (2) explode the cut ranks, one row each, and sort them among the
    buckets' offsets: a running ``last`` places every cut in its bucket, a running count tells how
    many cuts lie before a bucket; (3) only the buckets that hold a cut are ranked, to find
    the threshold rows; (4) every row takes its bucket's (without groups: 16^digits rows) or
    group's (with groups: one row each) count and short list of thresholds by a join, and
    compares its (h, key) with them. The plan's size doesn't depend on the number of cuts.

    Steps 1-3 run once; what they find is written to the checkpoint folder, so reading the
    result again (training passes, evaluation) never replays the search. The side joined in
    step 4 is broadcast if it has ``MAX_BROADCAST_ROWS`` rows or fewer (counted), else left to a
    shuffle join.

    ``h``: hex hash string column (its prefix is the bucket); (h, key) must be unique.
    ``targets``: ARRAY<BIGINT> of cut ranks, evaluated per group; it may use ``_gn`` (the group's
    row count), the group keys, and columns of ``group_info`` (a small table joined on the
    group keys it shares). Cuts <= 0 are passed by every row, cuts beyond the group by none.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    g = list(partition_by)
    d = df.withColumn("_bkt", F.substring(F.col(h), 1, digits))
    cnt = d.groupBy(*g, "_bkt").agg(F.count(F.lit(1)).alias("_c")).checkpoint()
    before = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(*g, "_bkt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    sizes = cnt.groupBy(*g).agg(F.sum("_c").alias("_gn"))
    if group_info is not None:
        sizes = _join_null_safe(sizes, group_info, [c for c in g if c in group_info.columns])
    cuts = sizes.select(*g, F.explode(targets.cast("array<long>")).alias("_t"), "_gn").where("_t <= _gn").drop("_gn")
    # buckets start at rank off + 1; a cut at the same rank lies inside, so buckets sort first
    marks = off.select(*g, (F.col("_off") + 1).alias("_at"), F.lit(0).alias("_cut"), "_bkt", "_off").unionByName(
        cuts.select(*g, F.col("_t").alias("_at"), F.lit(1).alias("_cut"), F.lit(None).cast("string").alias("_bkt"),
                    F.lit(None).cast("long").alias("_off")))
    upto = Window.partitionBy(*g).orderBy("_at", "_cut").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select(*g, "_at", "_cut", F.last("_bkt", ignorenulls=True).over(upto).alias("_bkt"),
                         F.last("_off", ignorenulls=True).over(upto).alias("_off"),
                         F.sum("_cut").over(upto).alias("_base")).checkpoint()
    hits = marks.where("_cut = 1 and _bkt is not null").groupBy(*g, "_bkt").agg(
        F.collect_list((F.col("_at") - F.col("_off")).cast("int")).alias("_ranks"))
    # neither the buckets hit nor the groups with cuts are more than the cuts
    few = marks.where("_cut = 1").count() <= MAX_BROADCAST_ROWS
    sel = _join_null_safe(d.select(*g, "_bkt", F.col(h).alias("_xh"), F.col(key).alias("_xk")), hits, [*g, "_bkt"], broadcast=few)
    sel = sel.withColumn("_r", F.row_number().over(Window.partitionBy(*g, "_bkt").orderBy("_xh", "_xk")))
    at = sel.select(*g, "_bkt", F.struct("_xh", "_xk").alias("_x"),
                    F.size(F.filter("_ranks", lambda x: x == F.col("_r"))).alias("_times")).where("_times > 0")
    at = at.select(*g, "_bkt", F.explode(F.array_repeat("_x", F.col("_times"))).alias("_x"))
    if not g:
        found = at.groupBy("_bkt").agg(F.collect_list("_x").alias("_xs"))
        per = marks.where("_cut = 0").select("_bkt", F.col("_base").cast("int").alias("_base")).join(found, "_bkt", "left").checkpoint()
        res = d.join(F.broadcast(per), "_bkt")
    else:
        found = at.groupBy(*g).agg(F.collect_list("_x").alias("_xs"))
        base = cuts.groupBy(*g).agg(F.count_if(F.col("_t") <= 0).cast("int").alias("_base"))
        per = _join_null_safe(base, found, g, "left").checkpoint()
        res = _join_null_safe(d, per, g, "left", broadcast=few)
    beyond = F.filter("_xs", lambda x: (F.col(h) > x["_xh"]) | ((F.col(h) == x["_xh"]) & (F.col(key) > x["_xk"])))
    passed = F.coalesce(F.col("_base"), F.lit(0)) + F.coalesce(F.size(beyond), F.lit(0))
    passed = F.when(F.col("_xs").isNull(), F.coalesce(F.col("_base"), F.lit(0))).otherwise(passed)
    return res.withColumn(out, passed.cast("int")).drop("_bkt", "_base", "_xs")


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a count; beyond the limit the planner joins by a shuffle."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                    broadcast: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a NULL label is still a group); the
    result keeps the left side's key columns only."""
    r = right.select(*[F.col(c).alias(f"_rk_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    r = F.broadcast(r) if broadcast else r
    cond = None
    for c in keys:
        e = left[c].eqNullSafe(r[f"_rk_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_rk_{c}" for c in keys])


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], bucket: Column,
                 partition_by: Sequence[str] = (), suffix: str = "_below") -> DataFrame:
    """For each row add ``<c><suffix>`` = sum of ``c`` over rows strictly before it in the order.

    Rows must already be unique per (partition_by, order_col) — e.g. grouped by score first.
    """
    keys = list(partition_by) + ["_bkt"]
    df = df.withColumn("_bkt", bucket)
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*partition_by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                     for c in sum_cols])
    inner = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_i_{c}") for c in sum_cols])
    out = out.join(F.broadcast(offsets) if not partition_by else offsets, keys)
    return out.select(
        *[c for c in df.columns if c != "_bkt"],
        *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"{c}{suffix}") for c in sum_cols],
    )
