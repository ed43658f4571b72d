"""Fill-in-middle: cut texts at line ends into prefix, middle and suffix, and change their order.

The places where a text may be cut are a set of code point offsets, kept in containers of 65,536
offsets each: sorted arrays, bitmaps or runs, whichever is smallest. Cumulative cardinalities lead
to the container that holds the k-th offset, a select within it gives the offset. Texts travel to
Python once and come back as two numbers; parts are put together by built-in functions.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import arrow_bytes, code_points, slices
from .ship import by_value
from .text import free_name, others, quoted

by_value(__name__)

SEED = 7
#: out of 100: texts that are changed, and those of them that start with the suffix
RATE = 100
SUFFIX_FIRST = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class OffsetSet:
    """A sorted set of offsets in containers by their bits above the lowest sixteen."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(offsets, cuts) if len(cuts) else [offsets]
        self.bases = [int(p[0]) >> 16 << 16 for p in parts if len(p)]
        self.containers = [self._container((p & 0xFFFF).astype(np.uint16)) for p in parts if len(p)]
        self.before = np.cumsum([0] + [len(p) for p in parts])

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        """(kind, values, numbers of offsets before each value) of the smallest kind in bytes."""
        first = np.concatenate([[0], np.flatnonzero(np.diff(low.astype(np.int32)) != 1) + 1])
        if 4 * len(first) < min(2 * len(low), 8192):
            return "run", low[first], first
        if len(low) <= 4096:
            return "array", low, None
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return "bitmap", words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones in the set."""
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        kind, values, before = self.containers[c]
        k -= int(self.before[c])
        if kind == "array":
            return self.bases[c] + int(values[k])
        i = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[i])
        if kind == "run":
            return self.bases[c] + int(values[i]) + k
        word = np.unpackbits(values[i:i + 1].view(np.uint8), bitorder="little")
        return self.bases[c] + 64 * i + int(np.flatnonzero(word)[k])


def line_cuts(raw: np.ndarray, offs: np.ndarray):
    """For each text: the offsets where lines end, and 0."""
    raw, offs = raw[offs[0]:offs[-1]], offs - offs[0]
    ends = np.flatnonzero(raw == 10) + 1
    of_text = np.searchsorted(ends, offs, side="right")
    starts, ends = code_points(raw, offs), code_points(raw, ends)
    for i in range(len(offs) - 1):
        size = starts[i + 1] - starts[i]
        own = ends[of_text[i]:of_text[i + 1]] - starts[i]
        last = [size] if size and (not len(own) or own[-1] != size) else []
        yield OffsetSet(np.concatenate([[0], own, last]).astype(np.int64))


def _cutter():
    def cuts(texts, one, two):
        """Number of lines, and the smaller and the larger cut, of each text."""
        import pyarrow as pa

        raw, offs = arrow_bytes(texts)
        one, two = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (one, two))
        out = np.zeros((3, len(one)), np.int64)
        for a, b in slices(offs):
            for i, found in enumerate(line_cuts(raw, offs[a:b + 1]), start=a):
                n = len(found)
                low, high = sorted((int(one[i]) % n, int(two[i]) % n))
                out[:, i] = n - 1, found.select(low), found.select(high)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "low", "high"])

    # annotated here, as pyarrow is imported where it is used
    import pyarrow as pa

    cuts.__annotations__ = {"texts": pa.Array, "one": pa.Array, "two": pa.Array, "return": pa.Array}
    return F.arrow_udf(cuts, "struct<n:long,low:long,high:long>")


def draws(key: Column, seed) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed=SEED, rate: int = RATE,
                   suffix_first: int = SUFFIX_FIRST, out: str = "fim") -> DataFrame:
    """Add the struct ``out``: ``n`` (lines of the text), ``form`` (``plain``, ``psm`` or ``spm``),
    ``prefix_chars`` and ``middle_chars`` (code points; null if plain) and ``output``.

    A line is what ends in a newline, or what is left at the end. Both cuts and the form are drawn
    from the key, so reruns agree and repeated rows are cut alike; a null key draws as an empty
    one. A null text counts as empty; an empty text, one that holds a mark (``<P>``, ``<S>``,
    ``<M>``) and those beyond ``rate`` stay as they are. Texts may be of any length. An existing
    column called ``out`` is replaced; all other columns stay, whatever their names.
    """
    whole, cut = free_name(docs, "whole"), free_name(docs, "cuts")
    h1, h2, h3, h4 = draws(quoted(key), seed)
    d = docs.withColumn(whole, F.coalesce(quoted(text), F.lit("")))
    t = F.col(whole)
    d = d.withColumn(cut, _cutter()(t, h1, h2))
    n, low, high = (F.col(cut)[x] for x in ("n", "low", "high"))
    plain = (t == "") | F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE)) | (h3 % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    a, b = low.cast("int"), high.cast("int")
    prefix, middle = F.substr(t, F.lit(1), a), F.substr(t, a + 1, b - a)
    suffix = F.substr(t, b + 1)
    moved = F.when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return d.select(*others(docs, out), F.struct(
        n.alias("n"), form.alias("form"), F.when(~plain, low).alias("prefix_chars"), F.when(~plain, high - low).alias("middle_chars"),
        F.when(plain, t).otherwise(moved).alias("output")).alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` gave ``output`` and ``form`` for: no part holds a mark, so
    the first of each kind is the one that was put in."""
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    first = F.substr(F.substring_index(output, MIDDLE, 1), F.lit(4))
    middle = F.substr(output, F.instr(output, MIDDLE) + F.lit(3))
    at = F.when(form == "spm", F.instr(first, PREFIX)).otherwise(F.instr(first, SUFFIX))
    one, two = F.substr(first, F.lit(1), at - F.lit(1)), F.substr(first, at + F.length(second))
    moved = F.when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
    return F.when(form == "plain", output).otherwise(moved)
