"""Row -> client assignment (X3-X10) and per-client train/val split.

Every scheme is one ``client_id INT`` column on the same DataFrame (never a list of
DataFrames). Shuffle order is ``md5(key:seed)``: deterministic and independent of how the
input is partitioned. Exact cut points use ``ordering.rank_cuts``: only the rows at the cut
ranks are ranked; every other row is assigned by comparing its hash with the thresholds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import gaussian_from_hash, hash_hex, hex8_to_unit, materialize
from ..functions.ordering import MAX_BROADCAST_ROWS, rank_cuts, small
from ..session import ensure_checkpoint_dir
from .clean import family_expr, family_index_expr


def _with_hash(df: DataFrame, key: str, seed: int, *salt) -> DataFrame:
    return df.withColumn("_h", hash_hex(key, seed, *salt))


def _block_ends(n: int, end) -> Column:
    """The n - 1 inner block ends as one array column, so the plan doesn't grow with n."""
    if n < 2:
        return F.array().cast("array<long>")
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(n - 1).cast("long")), end)


# X3 -----------------------------------------------------------------------------------------
def partition_iid(df: DataFrame, key: str, n_clients: int = 5, seed: int = 42,
                  out: str = "client_id", exact: bool = True) -> DataFrame:
    """Shuffle, then equal blocks of ``N div n``; the last client takes the remainder;
    N < n puts every row on the last client. ``exact=False``: client = hash mod n, sizes
    only approximately equal, but a pure projection (no shuffle, no rank)."""
    if not exact:
        u = F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("long")
        return df.withColumn(out, (u % F.lit(n_clients)).cast("int"))
    # client = #{c in 1..n-1 : pos > c * (N div n)} = least((pos - 1) div size, n - 1);
    # size 0 makes every cut 0, so every row passes all n - 1 of them (last client)
    size = F.floor(F.col("_gn") / F.lit(n_clients)).cast("long")
    r = rank_cuts(_with_hash(df, key, seed), "_h", key,
                  _block_ends(n_clients, lambda c: size * c), out=out)
    return r.drop("_h")


# X4 -----------------------------------------------------------------------------------------
def partition_by_day(df: DataFrame, ts_col: str | None = "ts", n_clients: int = 5,
                     day_col: str | None = None, out: str = "client_id") -> DataFrame:
    """D sorted days; n >= D: one client per day; else client i gets day indices
    [i*D div n, (i+1)*D div n), the last one to the end. Closed form per day index d:
    ``least(n-1, ((d+1)*n - 1) div D)``. The days (one row each) are joined, broadcast when few.
    Rows without a day go to the last client."""
    day = F.to_date(F.col(ts_col)) if day_col is None else F.col(day_col)
    df = df.withColumn("_day", day)
    ensure_checkpoint_dir(df.sparkSession)
    days = df.select(F.col("_day").alias("_dd")).where(F.col("_dd").isNotNull()).distinct()
    # over the D days, not the rows
    days = days.select("_dd", (F.row_number().over(Window.orderBy("_dd")) - 1).alias("_dix")).checkpoint()
    n_days = days.count()
    if n_days == 0:
        return df.withColumn(out, F.lit(None).cast("int")).drop("_day")
    last = min(n_clients, n_days) - 1
    client = F.col("_dix") if n_clients >= n_days else F.least(
        F.floor(((F.col("_dix") + 1) * n_clients - 1) / F.lit(n_days)).cast("int"), F.lit(last))
    res = df.join(small(days), F.col("_day") == F.col("_dd"), "left")
    return res.withColumn(out, F.coalesce(client, F.lit(last)).cast("int")).drop("_day", "_dd", "_dix")


# X5 -----------------------------------------------------------------------------------------
def partition_by_family(df: DataFrame, key: str, label_col: str = "label", n_clients: int = 5,
                        seed: int = 42, out: str = "client_id") -> DataFrame:
    """Attack rows: ``family_index mod n`` (row-wise, never shuffled). Normal rows: shuffled,
    client i gets positions [i*M div n, (i+1)*M div n) of the M normal rows."""
    base = df.withColumn("_fam", family_expr(F.col(label_col)))
    normal = F.col("_fam") == "Normal"
    base = _with_hash(base.withColumn("_normal", normal), key, seed)
    # client i's last position is (i+1)*M div n, so client = #{c in 1..n-1 : pos > c*M div n};
    # attack rows are a group of their own without cuts, so one pass places both
    ends = _block_ends(n_clients, lambda c: F.call_function("div", F.col("_gn") * c, F.lit(n_clients).cast("long")))
    r = rank_cuts(base, "_h", key, F.when(F.col("_normal"), ends), partition_by=["_normal"], out="_block")
    attack = (family_index_expr(F.col("_fam")) % F.lit(n_clients)).cast("int")
    return r.withColumn(out, F.when(F.col("_normal"), F.col("_block")).otherwise(attack)).drop(
        "_fam", "_h", "_normal", "_block")


# X6 -----------------------------------------------------------------------------------------
def dirichlet_thresholds(n_labels: int, n_clients: int, alpha: float, seed: int = 42) -> list[list[float]]:
    """Per class, cumulative client shares from Gamma(alpha, 1) draws (driver, K x n numbers)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_labels):
        g = rng.gamma(alpha, 1.0, size=n_clients)
        if g.sum() <= 0:
            g = np.ones(n_clients)
        cum = np.cumsum(g / g.sum())
        cum[-1] = 1.0
        out.append([round(float(x), 12) for x in cum])
    return out


#: draws of which a gamma variate is the first accepted; all are refused less than once in 10^20 times
GAMMA_DRAWS = 16


def keyed_gamma(text: Column, alpha: float) -> Column:
    """Gamma(alpha, 1) variate that follows from ``text`` alone (Marsaglia and Tsang 2000, of alpha + 1, brought down
    by a power of a uniform number). Draw t takes a normal and two uniform numbers from md5(``text:t``)."""
    d = alpha + 1.0 - 1.0 / 3.0
    c = 1.0 / (9.0 * d) ** 0.5

    def draw(t):
        h = F.md5(F.concat(text, F.lit(":"), t.cast("string")))
        x = gaussian_from_hash(h)
        v = F.pow(F.lit(1.0) + x * c, 3)
        right = 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300)))
        fits = (v > 0) & (F.log(hex8_to_unit(h, 17)) < right)
        return F.struct(fits.alias("fits"), (F.lit(d) * v * F.pow(hex8_to_unit(h, 25), F.lit(1.0 / alpha))).alias("g"))

    drawn = F.transform(F.sequence(F.lit(0), F.lit(GAMMA_DRAWS - 1)), draw)
    return F.get(F.filter(drawn, lambda x: x["fits"]), F.lit(0))["g"]


def dirichlet_table(labels: DataFrame, n_clients: int, alpha: float, seed: int = 42) -> DataFrame:
    """(label, cuts): for each distinct non-null label, of any type, its clients' cumulative shares, drawn from a
    symmetric Dirichlet distribution by keyed gamma variates. One row a label, ``n_clients`` numbers a row."""
    label = labels.columns[0]
    each = labels.select(F.col(label).alias("label")).where("label is not null").distinct().select(
        "label", F.explode(F.sequence(F.lit(0), F.lit(n_clients - 1))).alias("client"))
    g = each.withColumn("g", keyed_gamma(F.concat_ws(":", F.col("label").cast("string"), F.col("client").cast("string"), F.lit(str(seed))), alpha))
    g = g.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("client", "g"))), lambda x: x["g"]).alias("gs"),
                               F.sum("g").alias("all"))
    even = F.transform("gs", lambda x: F.lit(1.0 / n_clients))
    shares = F.when(F.col("all") > 0, F.transform("gs", lambda x: x / F.col("all"))).otherwise(even)
    total = F.aggregate(shares, F.array().cast("array<double>"), lambda done, x: F.concat(
        done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + x)))
    cuts = F.transform(total, lambda x, i: F.when(i == n_clients - 1, F.lit(1.0)).otherwise(F.round(x, 12)))
    return g.select("label", cuts.alias("cuts"))


def first_beyond(cuts: Column, u: Column, n: int) -> Column:
    """Index of the first of ``n`` sorted numbers that is larger than ``u``, by bisection; n if none is."""
    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        beyond = F.element_at(cuts, F.least(mid + 1, F.lit(n))) > u
        go = at["lo"] < at["hi"]
        return F.struct(F.when(go & ~beyond, mid + 1).otherwise(at["lo"]).cast("int").alias("lo"),
                        F.when(go & beyond, mid).otherwise(at["hi"]).cast("int").alias("hi"))

    start = F.struct(F.lit(0).cast("int").alias("lo"), F.lit(n).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve, lambda at: at["lo"])


def partition_dirichlet(df: DataFrame, key: str, label_id_col: str, n_labels: int | None = None, n_clients: int = 10,
                        alpha: float = 0.1, seed: int = 42, thresholds=None, out: str = "client_id") -> DataFrame:
    """Non-IID label skew: row of class c goes to the first client whose cumulative share
    exceeds u = uniform(md5(key:seed)).

    The shares are rows: a table (label, cuts) as ``dirichlet_table`` makes it from the labels that occur, or
    ``thresholds``, such a table or a list of lists by label id; ``n_labels`` is no longer needed. A row whose label is null or has no shares gets a
    null client; ``without_client`` counts them. The table is sent to every task if it is small, else joined by
    a shuffle, and searched by bisection, so plans don't grow with labels or clients."""
    if thresholds is None:
        thresholds = dirichlet_table(df.select(label_id_col), n_clients, alpha, seed)
    elif not isinstance(thresholds, DataFrame):
        kind = df.schema[label_id_col].dataType.simpleString()
        thresholds = df.sparkSession.createDataFrame([(c, [float(x) for x in row]) for c, row in enumerate(thresholds)],
                                                     "label long, cuts array<double>").withColumn("label", F.col("label").cast(kind))
    table = materialize(thresholds.select(F.col("label").alias("_dl"), F.col("cuts").alias("_dc")))
    table = F.broadcast(table) if table.count() * n_clients <= MAX_BROADCAST_ROWS else table
    u = hex8_to_unit(hash_hex(key, seed))
    at = F.when(F.col("_dc").isNotNull(), first_beyond(F.col("_dc"), u, n_clients))
    return df.join(table, F.col(label_id_col) == F.col("_dl"), "left").withColumn(
        out, F.least(at, F.lit(n_clients - 1)).cast("int")).drop("_dl", "_dc")


def without_client(df: DataFrame, label_col: str, client_col: str = "client_id") -> DataFrame:
    """(label, n): rows that got no client, by label."""
    return df.where(F.col(client_col).isNull()).groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# X2 -----------------------------------------------------------------------------------------
def client_train_val(df: DataFrame, key: str, client_col: str = "client_id", train_frac: float = 0.8,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """First ``int(n_c * 0.8)`` rows of each client's shuffled order are train."""
    r = rank_cuts(_with_hash(df, key, seed), "_h", key,
                  F.array(F.floor(F.col("_gn") * F.lit(train_frac)).cast("long")),
                  partition_by=[client_col], out="_past")
    return r.withColumn(out, F.when(F.col("_past") == 0, "train").otherwise("val")).drop("_h", "_past")


# X8 -----------------------------------------------------------------------------------------
def sample_clients(clients: DataFrame, round_col: str = "round", client_col: str = "client_id",
                   fraction: float = 1.0, min_fit: int = 2, min_available: int = 2, seed: int = 42,
                   check: bool = True) -> DataFrame:
    """Per round keep ``max(int(n*fraction), min_fit)`` clients in md5(client:seed:round) order.
    Error if a round has fewer than ``min_available`` clients (one small job; ``check=False``
    skips it when the caller already checked the same clients table). The quota is a cut in hash
    order, so no task ranks a round's clients."""
    if check and clients.groupBy(round_col).count().where(F.col("count") < min_available).limit(1).count():
        raise ValueError(f"a round has fewer than min_available={min_available} clients")
    if fraction >= 1.0:
        return clients
    quota = F.greatest(F.floor(F.col("_gn") * F.lit(fraction)).cast("long"), F.lit(min_fit).cast("long"))
    d = _with_hash(clients, client_col, seed, F.col(round_col))
    return rank_cuts(d, "_h", client_col, F.array(quota), partition_by=[round_col], out="_past").where("_past = 0").drop("_h", "_past")


# X9 -----------------------------------------------------------------------------------------
def client_rows(df: DataFrame, client_id: int, client_col: str = "client_id") -> DataFrame:
    return df.where(F.col(client_col) == client_id)


# X10 ----------------------------------------------------------------------------------------
def inject_label_rate(df: DataFrame, key: str, ts_col: str, label_col: str, base: float = 0.10,
                      step: float = 0.05, seed: int = 42) -> DataFrame:
    """Raise each weekday's positive rate to ``base + step*dow`` by flipping 0 -> 1 on the
    first negatives of that day in hash order (dow Monday=0). Rows already positive stay."""
    dow = F.weekday(F.col(ts_col))
    d = df.withColumn("_dow", dow).withColumn("_h", hash_hex(key, seed))
    d = d.withColumn("_neg", (F.col(label_col) == 0))
    # per-weekday totals: at most 7 rows, so the broadcast is bounded by construction
    per_day = d.groupBy("_dow").agg(F.count(F.lit(1)).alias("_n"),
                                    F.count_if(~F.col("_neg")).alias("_p"))
    need = F.greatest(F.floor(F.col("_n") * (F.lit(base) + F.lit(step) * F.col("_dow"))).cast("long")
                      - F.col("_p"), F.lit(0))
    r = rank_cuts(d, "_h", key, F.array(need), partition_by=["_dow", "_neg"],
                  group_info=F.broadcast(per_day), out="_past")
    flip = F.col("_neg") & (F.col("_past") == 0)
    return r.withColumn(label_col, F.when(flip, F.lit(1)).otherwise(F.col(label_col)).cast("int")) \
            .drop("_dow", "_h", "_neg", "_past")


REGISTRY = {"iid", "day", "family", "dirichlet"}


def assign_clients(df: DataFrame, method: str, key: str, **kw) -> DataFrame:
    """X7 dispatch; unknown methods are an error."""
    m = method.lower()
    if m == "iid":
        return partition_iid(df, key, **kw)
    if m == "day":
        return partition_by_day(df, **kw)
    if m == "family":
        return partition_by_family(df, key, **kw)
    if m == "dirichlet":
        return partition_dirichlet(df, key, **kw)
    raise ValueError(f"unknown partition method {method!r}; expected one of {sorted(REGISTRY)}")
