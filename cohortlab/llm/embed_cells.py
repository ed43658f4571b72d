"""Near-duplicate vectors by spherical k-means cells.

Cells are trained on a bounded sample. Every vector lives in the cell of its nearest centroid
and also visits the cells whose boundary with its own is near, so that pairs on either side of a
boundary meet. The number of cells is the one that costs least on the sample, down to a single
cell, so it bears on the work and not on the result. Within a cell, blocks of rows are multiplied
pairwise: first their heads, a few coordinates in the directions that matter most, which rule out
most pairs for certain, then what is left. Each block returns how many links every vector has and
a forest that spans them, never the pairs.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ship import by_value
from .storage import cut, sized
from .text import hash128

by_value(__name__)

THRESHOLD = 0.9
#: vectors that the cells are trained on, of all lengths, and their bytes at most; a cell has some of them
SAMPLE = 8192
SAMPLE_BYTES = 1 << 25
ROWS_A_CELL = 20
MAX_CELLS = 4096
ROUNDS = 8
#: lengths with fewer vectors have one cell, which takes no training
LEAST = 4096
#: rows and bytes of a block on either side of a task at most; a cell is taken apart into SHARES blocks
#: or more, each in products of CHUNK rows
BLOCK = 1 << 16
BLOCK_BYTES = 1 << 25
SHARES = 8
CHUNK = 1024
#: directions of a head at most
HEAD = 64
#: sending a row to a task costs about as much as so many products
ROW_COST = 1000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; zero and non-finite rows become nan."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        v = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of the unit rows of ``x``; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def places(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell, and for all visits the row and the cell). The distance of a row to the boundary
    between its home a and cell b is (x.a - x.b) / |a - b|."""
    s = x @ c.T
    home = np.argmax(s, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 1e-12))
    near = (s[np.arange(len(x)), home][:, None] - s) <= margin * apart
    near[np.arange(len(x)), home] = False
    row, cell = np.nonzero(near)
    return home, row, cell


def reach(threshold: float) -> float:
    """The margin that no link escapes: two unit vectors with cosine t are sqrt(2 - 2t) apart, so
    of two on either side of a boundary one is within half of that, whatever the data."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) / 2 + 1e-9


def fitted(x: np.ndarray, n: int, margin: float, block: int) -> np.ndarray:
    """Centroids for ``n`` vectors of which the unit rows ``x`` are a sample: as many as cost
    least in products and rows sent, from the square root of ``n`` down to one. They are trained on
    three quarters of the sample, and judged on the rest."""
    train, held = x[:len(x) * 3 // 4], x[len(x) * 3 // 4:]
    best, least = x[:1], n * (n / 2 + ROW_COST * np.ceil(n / block))
    k = min(len(train) // ROWS_A_CELL, MAX_CELLS, int(np.sqrt(n)))
    while k > 1:
        c, lives, out = spherical_kmeans(train, k), np.zeros(k), np.zeros(k)
        for a in range(0, len(held), 2048):
            home, _, cell = places(held[a:a + 2048], c, margin)
            lives += np.bincount(home, minlength=k)
            out += np.bincount(cell, minlength=k)
        lives, out = lives * (n / len(held)), out * (n / len(held))
        b_in, b_out = np.ceil(lives / block), np.ceil(out / block)
        cost = (lives * (lives / 2 + out) + ROW_COST * (lives * (1 + b_in + b_out) + out * (1 + b_in))).sum()
        if cost < least:
            best, least = c, cost
        k //= 4
    return best


def directions(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns that hold most of the unit rows ``x``: an eighth of the dimensions, 16 at
    least, ``HEAD`` at most, by two rounds of subspace iteration."""
    dim = x.shape[1]
    q = np.random.default_rng(11).normal(size=(dim, min(dim, HEAD, max(16, dim // 8))))
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q) + 1e-9 * q)[0]
    return q


def heads(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of the unit rows along the basis, and the length of what is left. The product of
    two heads is no less than that of the vectors."""
    h = x @ basis
    return np.column_stack([h, np.sqrt(np.maximum(0.0, 1 - (h * h).sum(axis=1)))]).astype(np.float32)


def block_rows(n: int, dim: int) -> int:
    """Rows of a block for ``n`` vectors: an even share of them, as far as a task can hold it."""
    return max(1, min(max(1024, -(-n // SHARES)), BLOCK, BLOCK_BYTES // (8 * dim)))


def linked(x: np.ndarray, y: np.ndarray, threshold: float, hx: np.ndarray | None = None,
           hy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the unit rows with cosine ``threshold`` or more in double precision. Products
    are taken in single precision; those that its rounding leaves open are taken again. Pairs whose
    ``heads`` fall short are left out before, unless too many don't."""
    unsure, fits = (x.shape[1] + 8) * 2.0 ** -23, None
    if hx is not None:
        a, b = np.nonzero(hx @ hy.T >= threshold - (hx.shape[1] + 8) * 2.0 ** -22)
        if 16 * len(a) <= len(x) * len(y):
            some, fits = np.arange(len(a)), np.ones(len(a), bool)
    if fits is None:
        s = x.astype(np.float32) @ y.astype(np.float32).T
        a, b = np.nonzero(s >= threshold - unsure)
        some, fits = np.flatnonzero(s[a, b] < threshold + unsure), np.ones(len(a), bool)
    step = max(1, (1 << 20) // x.shape[1])
    for k in range(0, len(some), step):
        i = some[k:k + step]
        fits[i] = (x[a[i]] * y[b[i]]).sum(axis=1) >= threshold
    return a[fits], b[fits]


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the smallest index that each index is tied to, after the further ties (a, b)."""
    a, b = root[a], root[b]
    if (a == b).all():
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(ids, home, x, weight, visits, left, right, cell, threshold, head=None):
    """Link counts and spanning ties between the rows ``left`` and ``right`` (index arrays) of one
    block, the same array or disjoint ones. A pair of a resident and a visitor that meets in both
    homes counts in the lower one."""
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    by_id = np.argsort(ids, kind="stable")
    spot = np.empty(len(ids), np.int64)
    spot[by_id] = root
    # a visitor whose home comes first meets there the residents that visit its home
    lower = np.unique(home[home < cell])
    met = np.zeros((len(ids), len(lower)), bool)
    if len(lower):
        row, to = np.repeat(left, [len(visits[i]) for i in left]), np.concatenate([visits[i] for i in left])
        at = np.minimum(np.searchsorted(lower, to), len(lower) - 1)
        met[row[lower[at] == to], at[lower[at] == to]] = True
    for i in range(0, len(left), CHUNK):
        for j in range(i if left is right else 0, len(right), CHUNK):
            own, other = left[i:i + CHUNK], right[j:j + CHUNK]
            a, b = linked(x[own], x[other], threshold, *([head[own], head[other]] if head is not None else []))
            if left is right and i == j:
                a, b = a[a < b], b[a < b]
            a, b = own[a], other[b]
            if len(lower):
                at = np.minimum(np.searchsorted(lower, home[b]), len(lower) - 1)
                here = ~((home[b] < cell) & met[a, at])
                a, b = a[here], b[here]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            root = _roots(root, spot[a], spot[b])
    return by_id, count[by_id], ids[by_id[root]]


def _samples(once: DataFrame, classes: DataFrame, large: dict[int, int], sample: int) -> dict[int, np.ndarray]:
    """Unit rows drawn from the distinct vectors of each length by a hash of their ids: as many rows
    of a length as its share, and no more bytes than ``SAMPLE_BYTES``. The draw is a condition on each
    row, so no task gives more than its part, and the sample is the same at every run."""
    spark, total = once.sparkSession, sum(large.values())
    rows = {dim: sample * n / total for dim, n in large.items()}
    fits = min(1.0, SAMPLE_BYTES / sum(4 * dim * k for dim, k in rows.items()))
    cuts = spark.createDataFrame([(dim, min(1.0, fits * rows[dim] / n)) for dim, n in large.items()], "dim int, share double")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "rep", "h1"), F.lit(1 << 40)) / float(1 << 40)
    drawn = classes.join(sized(cuts), "dim").where(draw < F.col("share")).select("dim", "h1", "h2", F.col("rep").alias("id"))
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    found = once.join(F.broadcast(drawn), ["dim", "h1", "h2", "id"]).select(
        "dim", "id", "h1", F.transform("v", lambda x: x / most).cast("array<float>").alias("v")).toArrow()
    size, key = found["dim"].to_numpy(), np.column_stack([found["id"].to_numpy(), found["h1"].to_numpy()])
    out = {}
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        _, one = np.unique(key[own], axis=0, return_index=True)
        flat = found["v"].combine_chunks().take(own[one]).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        # ids may follow the data's order: take the rows in another one
        out[dim] = unit(flat.astype(np.float64))[np.random.default_rng(3).permutation(len(one))]
    return out


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                 margin: float | None = None, sample: int = SAMPLE, cells: int | None = None,
                 block: int | None = None) -> DataFrame:
    """One row per vector: ``key``, ``n_links`` (other vectors found at cosine ``threshold`` or more),
    ``component_id`` (smallest id reachable over links, its own included) and ``kept``
    (``key`` = ``component_id``).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of different lengths don't link; each length has cells of its own. Equal vectors are
    collapsed first and count as links of each other. Every link is found, however many ``cells`` there are
    of a length (``fitted`` unless given); only a ``margin`` below ``reach(threshold)`` can miss some. The driver
    gets a sample of about ``sample`` vectors, ``SAMPLE_BYTES`` at most. Rows with
    a null id link with nothing and aren't kept; rows with one id and different vectors are linked
    through that id. ``vectors`` may have any other columns.
    """
    spark = vectors.sparkSession
    margin = reach(threshold) if margin is None else margin
    single = dict(vectors.dtypes)[vector] == "array<float>"   # travels as it is; cosines are in double precision
    v = F.col(vector).cast("array<double>")
    whole = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull(), F.lit(False))
    d = vectors.select(F.col(key).cast("long").alias("id"), F.when(whole, F.col(vector) if single else v).alias("v"))
    h1, h2 = hash128(F.col("v"))
    fine = F.col("v").isNotNull()
    rows = cut(d.select("id", F.size("v").alias("dim"), h1.alias("h1"), h2.alias("h2"), fine.alias("fine")))
    dims = {r["dim"]: r["count"] for r in rows.where("fine").groupBy("dim").count().orderBy("dim").collect()}
    if not dims:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias(
            "component_id"), F.col("id").isNotNull().alias("kept"))
    same = rows.where("fine")
    classes = cut(same.groupBy("dim", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")))
    of_class = rows.join(classes, ["dim", "h1", "h2"], "left").withColumn("rep", F.when(F.col("fine"), F.col("rep")))
    once = d.where(fine).withColumn("dim", F.size("v")).withColumn("h1", h1).withColumn("h2", h2)
    reps = once.join(classes, ["dim", "h1", "h2"]).where("id = rep").dropDuplicates(["id", "dim", "h1", "h2"]).select("id", "v", "w")
    large = {dim: n for dim, n in dims.items() if cells or n > LEAST}
    samples = _samples(once, classes, large, sample) if large else {}
    models, first = {}, 0
    sizes_of = {dim: block or block_rows(n, dim) for dim, n in dims.items()}
    for dim, n in dims.items():
        model, basis, x = None, None, samples.get(dim)
        if x is not None and len(x):
            model = spherical_kmeans(x, min(len(x), MAX_CELLS, cells)) if cells else fitted(x, n, margin, sizes_of[dim])
            basis = directions(x) if dim > 16 else None
        models[dim] = first, model if model is not None and len(model) > 1 else None, basis
        first += 1 if model is None else len(model)
    models = spark.sparkContext.broadcast(models)
    kind = "float" if single else "double"

    def assign(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                first, model, _ = models.value[dim]
                own = np.flatnonzero(size == dim)
                for part in range(0, len(own), 2048):
                    b = batch.take(pa.array(own[part:part + 2048]))
                    flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    if model is None:
                        home, row, cell = np.zeros(len(flat), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    else:
                        home, row, cell = places(unit(flat.astype(np.float64)), model, margin)
                    home, cell = home + first, cell + first
                    to = np.split(cell, np.searchsorted(row, np.arange(1, len(flat))))
                    rows, cells_of = np.concatenate([np.arange(len(flat)), row]), np.concatenate([home, cell])
                    step = max(1, (1 << 22) // dim)   # a row of many visits is many rows
                    for k in range(0, len(rows), step):
                        who = rows[k:k + step]
                        flat_x = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * dim),
                                                          pa.array(flat[who].reshape(-1)))
                        visits = pa.array([to[i].tolist() for i in who.tolist()], type=pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([
                            b.column(0).take(pa.array(who)), b.column(2).take(pa.array(who)),
                            pa.array(home[who].astype(np.int32)), pa.array(cells_of[k:k + step].astype(np.int32)),
                            visits, flat_x], names=["id", "w", "home", "cell", "visits", "x"])

    placed = reps.mapInArrow(assign, f"id long, w long, home int, cell int, visits array<int>, x array<{kind}>")
    placed = cut(placed)
    lives = F.col("cell") == F.col("home")
    sizes = placed.groupBy("cell").agg(F.sum(lives.cast("int")).alias("n_in"), F.sum((~lives).cast("int")).alias("n_out"),
                                       F.first(F.size("x")).alias("dim"))
    # a row a length
    sizes = sizes.join(sized(spark.createDataFrame(list(sizes_of.items()), "dim int, block int")), "dim")
    sizes = sizes.select("cell", F.ceil(F.col("n_in") / F.col("block")).cast("int").alias("b_in"),
                         F.greatest(F.lit(1), F.ceil(F.col("n_out") / F.col("block")).cast("int")).alias("b_out"))
    # one row a cell, MAX_CELLS a length at most
    p = placed.join(sized(cut(sizes)), "cell").where("b_in > 0")
    own = F.pmod(F.xxhash64("id"), F.when(lives, F.col("b_in")).otherwise(F.col("b_out"))).cast("int")
    p = p.withColumn("own", own)
    blocks = F.sequence(F.lit(0), F.col("b_in") - 1)
    with_in = F.transform(blocks, lambda i: F.struct(F.least("own", i).alias("i"), F.greatest("own", i).alias("j"),
                                                     F.lit(False).alias("visit")))
    residents = F.concat(with_in, F.transform(F.sequence(F.lit(0), F.col("b_out") - 1), lambda i: F.struct(
        i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("visit"))))
    visitors = F.transform(blocks, lambda i: F.struct(F.col("own").alias("i"), i.alias("j"), F.lit(True).alias("visit")))
    p = p.withColumn("task", F.explode(F.when(lives, residents).otherwise(visitors)))
    p = p.select("cell", "task.*", "own", "id", "w", "home", "visits", "x")

    def compare(pdf):
        import pandas as pd

        ids, home, w = pdf["id"].to_numpy(), pdf["home"].to_numpy(), pdf["w"].to_numpy().astype(np.int64)
        x, visits, cell = unit(np.stack(pdf["x"].to_numpy()).astype(np.float64)), pdf["visits"].tolist(), int(pdf["cell"].iloc[0])
        i, j, visit = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), bool(pdf["visit"].iloc[0])
        at = np.arange(len(ids))
        if visit:
            left, right = at[home == cell], at[home != cell]
        elif i == j:
            left = right = at
        else:
            own = pdf["own"].to_numpy()
            left, right = at[own == i], at[own == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": ids[:0], "n": w[:0], "root": ids[:0]})
        basis = models.value[x.shape[1]][2]
        head = heads(x, basis) if basis is not None else None
        rows, n, root = _compare(ids, home, x, w, visits, left, right, cell, threshold, head)
        some = (n > 0) | (root != ids[rows])
        return pd.DataFrame({"id": ids[rows][some], "n": n[some], "root": root[some]})

    found = cut(p.groupBy("cell", "i", "j", "visit").applyInPandas(compare, "id long, n long, root long"))
    several = same.select("id", "dim", "h1", "h2").distinct().groupBy("id").count().where("count > 1").select("id")
    ties = of_class.where("rep is not null").join(several, "id", "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    edges = found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(ties)
    groups = cut(components(edges))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    out = of_class.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        groups.withColumnRenamed("node", "rep"), "rep", "left")
    n_links = F.when(F.col("rep").isNotNull(), F.coalesce("n", F.lit(0)) + F.col("w") - 1).otherwise(F.lit(0))
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(key), n_links.cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
