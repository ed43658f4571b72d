"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Shingles are dealt into the words of a sketch by
one hash and XORed into them by another, so the sketches of two sets differ in at most as many
words, and their bit sketches in at most as many bits, as the sets have elements that only one
of them holds. Jaccard similarity t bounds these by (1 - t) / (1 + t) of the sizes' sum; in a
band of sizes that is some D. With more than D words one has to be equal (pigeonhole), and the
first such word stands among the first D + 1 filled words of either set: only those are joined.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shingles import each_slice, folded, mix
from .ship import by_value
from .storage import cut, sized, staged
from .text import aside, quoted

by_value(__name__)

#: similar from 100 * intersection >= PERCENT * union
PERCENT = 80
BAND = 1.5
BITS = 512
#: large buckets are looked for on one document of LOOK: those with over HOT rows there, HOT_BUCKETS at most;
#: their rows are spread over SPREAD places
LOOK, HOT, HOT_BUCKETS, SPREAD = 64, 32, 100_000, 1024


class Bands:
    """Size bands [edges[k], edges[k + 1]); pairs lie in one band or in neighbours, and are
    joined under the larger document's scheme."""

    def __init__(self, largest: int, percent: int = PERCENT):
        self.percent, self.edges = percent, [1]
        ratio = max(BAND, 100 / percent)
        while self.edges[-1] <= largest or len(self.edges) < 4:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))
        self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))
        edges = np.array(self.edges, dtype=np.int64)
        most = self.apart(2 * (edges[1:] - 1))
        self.words = np.ceil(1.15 * (most + 1)).astype(np.int64) + 1
        self.edges = edges

    def apart(self, sizes_sum):
        """Elements that only one of two similar sets holds, at most."""
        return sizes_sum * (100 - self.percent) // (100 + self.percent)

    def schemes(self, n: np.ndarray):
        """For sizes n: (scheme, D) of the own band and of the next, -1 where no partner is there."""
        own = np.searchsorted(self.edges, n, side="right") - 1
        widest = n * 100 // self.percent
        d_own = self.apart(n + np.minimum(widest, self.edges[own + 1] - 1))
        above = np.where(widest >= self.edges[own + 1], own + 1, -1)
        return (own, d_own), (above, self.apart(n + widest))


def signatures(flat: np.ndarray, offs: np.ndarray, scheme: np.ndarray, d: np.ndarray, bands: Bands):
    """(signature, index of the text): for every text with a scheme the first ``d + 1`` filled
    words of its sketch, or all words, empty ones too, if fewer are filled."""
    n = np.diff(offs)
    on = (scheme >= 0) & (n > 0)
    width = np.where(on, bands.words[np.maximum(scheme, 0)], 0)
    base = np.concatenate([[0], np.cumsum(width)])
    text = np.repeat(np.arange(len(n)), n)
    used = on[text]
    text, tokens = text[used], flat[used]
    word = ((tokens >> np.uint64(32)) * width[text].astype(np.uint64)) >> np.uint64(32)
    cell = base[text] + word.astype(np.int64)
    sketch = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(sketch, cell, mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    filled = np.bincount(cell, minlength=base[-1]) > 0
    owner = np.repeat(np.arange(len(n)), width)
    rank = np.cumsum(filled)
    before = np.concatenate([[0], rank])[base[:-1]]
    total = np.concatenate([[0], rank])[base[1:]] - before
    sent = np.where((total > d)[owner], filled & (rank - before[owner] <= (d + 1)[owner]), True)
    at = np.flatnonzero(sent)
    own = owner[at]
    tag = scheme[own].astype(np.uint64) * np.uint64(1 << 32) + (at - base[own]).astype(np.uint64)
    return mix(sketch[at] + mix(tag + np.uint64(1))), own


def bit_sketch(flat: np.ndarray, offs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity sketch of each text as rows of 64-bit words: every shingle flips one bit."""
    words = bits // 64
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    bit = (flat >> np.uint64(20)) % np.uint64(bits)
    out = np.zeros((len(offs) - 1) * words, np.uint64)
    np.bitwise_xor.at(out, text * words + (bit >> np.uint64(6)).astype(np.int64),
                      np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(-1, words)


SKETCH = [f"k{k}" for k in range(BITS // 64)]


def _profiles(docs: DataFrame) -> DataFrame:
    """One row a document: id, n_shingles, a 128-bit hash of the set, the bit sketch, and for a
    larger set a sketch of its own size."""
    def run(batches):
        import pyarrow as pa

        for rows, flat, offs, _ in each_slice(batches, "text"):
            bits = bit_sketch(flat, offs).view(np.int64)
            long = [None] * rows.num_rows
            for i in np.flatnonzero(np.diff(offs) > BITS).tolist():
                own = flat[offs[i]:offs[i + 1]]
                wide = BITS << int(np.ceil(np.log2(len(own) / BITS)))
                long[i] = bit_sketch(own, np.array([0, len(own)]), wide)[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(np.diff(offs)),
                pa.array(folded(mix(flat ^ np.uint64(3)), offs, np.bitwise_xor).view(np.int64)),
                pa.array(folded(mix(flat ^ np.uint64(5)), offs, np.add).view(np.int64)),
                *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(SKETCH))],
                pa.array(long, type=pa.list_(pa.int64())),
            ], names=["id", "n", "c1", "c2", *SKETCH, "wide"])

    return docs.mapInArrow(run, "id long, n long, c1 long, c2 long, " + ", ".join(f"{k} long" for k in SKETCH)
                           + ", wide array<long>")


def _signature_rows(docs: DataFrame, bands: Bands) -> DataFrame:
    """(sig, id) rows. Of equal sets within a task only the first sends any."""
    def run(batches):
        import pyarrow as pa

        seen = set()
        for rows, flat, offs, _ in each_slice(batches, "text"):
            n = np.diff(offs)
            class_key = zip(n.tolist(), folded(mix(flat ^ np.uint64(3)), offs, np.bitwise_xor).tolist(),
                            folded(mix(flat ^ np.uint64(5)), offs, np.add).tolist())
            new = np.zeros(len(n), bool)
            for i, k in enumerate(class_key):
                if k not in seen:
                    seen.add(k)
                    new[i] = True
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            for scheme, d in bands.schemes(np.maximum(n, 1)):
                sig, own = signatures(flat, offs, np.where(new, scheme, -1), d, bands)
                for a in range(0, len(sig), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[a:a + (1 << 18)].view(np.int64)),
                                                      pa.array(ids[own[a:a + (1 << 18)]])], names=["sig", "id"])

    return docs.mapInArrow(run, "sig long, id long")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, n, set): shingle set of each document."""
    def run(batches):
        import pyarrow as pa

        for rows, flat, offs, _ in each_slice(batches, "text"):
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), lists], names=["id", "n", "set"])

    return docs.mapInArrow(run, "id long, n long, set array<long>")


def _may_be_similar(a: str, b: str, percent: int):
    """Whether sizes and bit sketches of two rows leave room for a link."""
    differ = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in SKETCH), F.lit(0))
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * low >= percent * high) & (differ * (100 + percent) <= (low + high) * (100 - percent))


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches may belong to similar sets."""
    both = pairs.join(sketches.alias("a"), F.col("u") == F.col("a.id")).join(sketches.alias("b"), F.col("v") == F.col("b.id"))
    return both.where(_may_be_similar("a", "b", percent)).select("u", "v").distinct()


def _likely_wide(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The same by the sketches of larger sets, which short ones can't tell apart. The longer one is
    folded to the length of the shorter: halves of a parity sketch XOR to the sketch of half the size."""
    a, b = (wide.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("wide").alias(f"w{i}")) for i in "uv")
    both = pairs.join(a, "u", "left").join(b, "v", "left")
    size = F.least(F.size("wu"), F.size("wv"))

    def folded_to(c):
        halves = F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) > size, halves).otherwise(F.col(c))

    differ = F.aggregate(F.zip_with(folded_to("wu"), folded_to("wv"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda t, x: t + x)
    room = differ * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent)
    return both.where(F.col("wu").isNull() | F.col("wv").isNull() | room).select("u", "v").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar, by exact intersection."""
    pairs = cut(pairs)
    left = _sets(docs.join(sized(pairs.select(F.col("u").alias("id")).distinct()), "id", "left_semi"))
    right = _sets(docs.join(sized(pairs.select(F.col("v").alias("id")).distinct()), "id", "left_semi"))
    right = right.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("set").alias("other"))
    both = right.join(sized(pairs), "v").join(left.select(F.col("id").alias("u"), "n", "set"), "u")
    shared = F.size(F.array_intersect("set", "other")).cast("long")
    return cut(both.where(100 * shared >= percent * (F.col("n") + F.col("m") - shared)).select("u", "v").distinct())


def _hot(docs: DataFrame, bands: Bands) -> DataFrame | None:
    """Signatures of large buckets, ``HOT_BUCKETS`` at most, as one document of ``LOOK`` shows them. Which they are
    bears on where rows are counted, not on what is found."""
    some = docs.where(F.pmod(F.xxhash64(F.lit("look"), "id"), F.lit(LOOK)) == 0)
    seen = cut(_signature_rows(some, bands).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT))
    rows = seen.agg(F.sum("n")).first()[0]
    return seen.where(F.col("n") > rows / HOT_BUCKETS).select("sig") if rows else None


def _bucket(known) -> Window:
    """The bucket of a row, or for hot buckets (``known``) one of the places that it is spread over."""
    return Window.partitionBy("sig", F.when(known, F.pmod("id", F.lit(SPREAD))).otherwise(F.lit(0)))


def _shared(sent: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows (sig, id) of buckets of more than one row. A hot bucket is known to have more, so its rows
    needn't meet."""
    rows, known = sent, F.lit(False)
    if hot is not None:
        rows, known = sent.join(F.broadcast(hot.select(F.col("sig").alias("_sig"))), F.col("sig") == F.col("_sig"), "left"), F.col("_sig").isNotNull()
    return rows.withColumn("k", F.count(F.lit(1)).over(_bucket(known))).where(known | (F.col("k") > 1)).select("sig", "id")


def _mixed(rows: DataFrame, value: str, hot: DataFrame | None) -> DataFrame:
    """The rows of buckets of more than one ``value``, with the smallest (``low``). Those of hot buckets are
    found by an aggregate and sent to every task, a row a bucket."""
    own, known, low, high = [F.col(c) for c in rows.columns], F.lit(False), F.min(value), F.max(value)
    if hot is None:
        bucket = _bucket(known)
        return rows.withColumn("low", low.over(bucket)).withColumn("_high", high.over(bucket)).where("low < _high").drop("_high")
    ends = rows.join(F.broadcast(hot), "sig", "left_semi").groupBy(F.col("sig").alias("_sig")).agg(low.alias("_lo"), high.alias("_hi"))
    d, bucket = rows.join(F.broadcast(ends), F.col("sig") == F.col("_sig"), "left"), _bucket(F.col("_sig").isNotNull())
    d = d.withColumn("low", F.coalesce("_lo", low.over(bucket))).withColumn("_high", F.coalesce("_hi", high.over(bucket)))
    return d.where("low < _high").select(*own, "low")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` and ``component_id``, the smallest id reachable
    over links of similarity ``percent`` or more, its own included.

    Sets are of 5-word shingles, A-Z lower-cased; a shorter text's whole sequence is its only
    shingle; a null or empty text, or one of white space, has none and links with nothing. Rows
    with one id are one document that links as all of its texts do; rows with a null id link with
    nothing and have a null component. Shingles are compared by 64-bit and whole sets by 128-bit
    hash. ``docs`` may have any other columns.

    Equal sets form a class first, and only its smallest id goes on. In each bucket of equal
    signatures the smallest id meets all others; then, in buckets still in several components, the
    pairs across these meet. Of the pairs met, those whose sizes and bit sketches allow it are
    verified. Pairs within a component are never made.
    """
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = d.where(F.col("id").isNotNull())
    rows = cut(_profiles(d))
    largest = rows.agg(F.max("n")).first()[0] or 0
    bands = Bands(int(largest), percent)
    group = ["n", "c1", "c2"]
    filled = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    slim = rows.select("id", *group)
    classes = cut(filled.groupBy(*group).agg(F.min("id").alias("rep"), F.max("id").alias("_last"))
                  .where("rep < _last").drop("_last"))
    of_class = slim.join(classes, group, "left").withColumn("rep", F.coalesce("rep", "id"))
    moved = cut(of_class.where("id <> rep and n > 0").select("id", "rep").distinct())
    # an id with several texts ties their classes together
    several = filled.groupBy("id").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a <> b").select("id")
    ties = of_class.join(several, "id", "left_semi").where("n > 0").select("id", "rep")
    low = ties.groupBy("id").agg(F.min("rep").alias("v"))
    tied = ties.join(low, "id").select(F.col("rep").alias("u"), "v")
    sketches = rows.where("id is not null and n > 0").select("id", "n", *SKETCH).distinct()
    wide = rows.where("id is not null and wide is not null").select("id", "n", "wide").join(several, "id", "left_anti")
    with staged(docs.sparkSession) as stage:
        hot = _hot(known, bands)
        shared = _shared(_signature_rows(known, bands), hot)
        shared = stage(shared.join(sized(moved), "id", "left").select("sig", F.coalesce("rep", "id").alias("id")).distinct())
        stars = _mixed(shared, "id", hot).where("id > low").select(F.col("low").alias("u"), F.col("id").alias("v")).distinct()
        links = cut(_verified(known, _likely_wide(_likely(stars, sketches, percent), wide, percent), percent).unionByName(tied))
        first = cut(components(links))
        placed = shared.join(sized(first), F.col("id") == F.col("node"), "left").select(
            "sig", "id", F.coalesce("component", "id").alias("c"))
        sides = stage(_mixed(placed, "c", hot).drop("low").join(sketches, "id"))
        a, b = sides.alias("a"), sides.alias("b")
        met = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.c") != F.col("b.c"))
        across = a.join(b, met & _may_be_similar("a", "b", percent)).select(
            F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
        across = across.join(stars, ["u", "v"], "left_anti")
        found = cut(components(links.unionByName(_verified(known, _likely_wide(across, wide, percent), percent))))
    out = of_class.join(found, F.col("rep") == F.col("node"), "left")
    component = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The documents, one of each group: the one with the smallest id. Of rows with that id one
    stays, the first in the order of its columns. Rows with a null id all stay."""
    docs, named, back = aside(docs, "_pj_")
    text, key = named(text), named(key)
    groups = near_duplicates(docs, text, key, percent)
    lost = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_pj_lost")).distinct()
    lost = cut(lost)
    stay = docs.join(sized(lost), docs[key] == F.col("_pj_lost"), "left_anti")
    again = cut(groups.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_pj_again")).count()
                .where("count > 1").select("_pj_again"))
    if again.isEmpty():
        return back(stay)
    again = sized(again)
    single = stay.join(again, stay[key] == F.col("_pj_again"), "left_anti")
    repeated = stay.join(again, stay[key] == F.col("_pj_again"), "left_semi")
    one = repeated.groupBy(F.col(key).alias("_pj_key")).agg(
        F.min(F.struct(*[quoted(c) for c in docs.columns])).alias("_pj_row"))
    return back(single.unionByName(one.select("_pj_row.*")))
