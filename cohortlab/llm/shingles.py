"""Word shingles of UTF-8 text in numpy: whole Arrow buffers at a time, no loop over words."""
from __future__ import annotations

import numpy as np

from .ship import by_value

by_value(__name__)

SHINGLE = 5
#: texts are taken in slices of about so many bytes; one longer text is a slice by itself
SLICE_BYTES = 1 << 20
#: bytes whose code points are counted at a time
PIECE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of texts that together hold about ``limit`` bytes."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each of the sorted byte positions ``at``."""
    out, seen = np.empty(len(at), np.int64), 0
    for a in range(0, max(1, len(raw)), PIECE):
        lead = np.concatenate([[0], np.cumsum((raw[a:a + PIECE] & 0xC0) != 0x80)])
        i, j = np.searchsorted(at, [a, a + PIECE + (a + PIECE >= len(raw))])
        out[i:j] = seen + lead[at[i:j] - a]
        seen += int(lead[-1])
    return out


class Words:
    """Hashes of the words of a slice of texts. Words are runs of bytes other than ASCII white
    space, A-Z lower-cased; the hash joins two polynomials over the bytes, read off prefix sums."""

    def __init__(self):
        lower = np.arange(256)
        lower[65:91] += 32
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.codes = [constants(256, s)[lower] for s in (1, 2)]
        self.bases = [int(c) * 8 + 5 for c in (0x9E3779B97F4A7C15 >> 3, 0xC2B2AE3D27D4EB4F >> 3)]
        self.powers: list = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def _powers(self, which: int, n: int):
        up, down = self.powers[which]
        if len(up) < n:
            base = self.bases[which] % (1 << 64)
            back = pow(base, -1, 1 << 64)
            up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, back))
            self.powers[which] = (up, down)
        return up, down

    def hashes(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words before each text and in all)."""
        raw, offs = raw[offs[0]:offs[-1]], offs - offs[0]
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
        solid = ~self.blank[raw]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = offs[1:-1]
        first, last = edge[edge < n], edge[edge > 0] - 1
        start[first] = solid[first]
        end[last] = solid[last]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        out = np.zeros(len(s), np.uint64)
        for which in (0, 1):
            up, down = self._powers(which, n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.codes[which][raw] * up[:n], out=total[1:])
            part = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            out = out * np.uint64(0xD1342543DE82EF95) + part
        return mix(out), np.searchsorted(s, offs)


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, sorted within each text; offsets of the texts). A text with fewer words
    than ``size`` has its whole sequence as one shingle, one without words none."""
    keys = constants(size, 77) | np.uint64(1)
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k:k + len(rolled)] * keys[k]
    rolled = mix(rolled)
    parts, lengths = [], np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b - a >= size:
            own = np.sort(rolled[a:b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = mix((words[a:b] * keys[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            continue
        parts.append(own)
        lengths[i] = len(own)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def folded(values: np.ndarray, offs: np.ndarray, ufunc) -> np.ndarray:
    """``ufunc`` over each text's values; 0 for texts without any."""
    out = np.zeros(len(offs) - 1, np.uint64)
    some = offs[1:] > offs[:-1]
    if some.any():
        out[some] = ufunc.reduceat(values, offs[:-1][some])
    return out


def each_slice(batches, text: str):
    """For every Arrow batch and slice: (the slice's rows, shingles, offsets, word counts)."""
    words = Words()
    for batch in batches:
        raw, offs = arrow_bytes(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(offs):
            hashes, at = words.hashes(raw, offs[a:b + 1])
            flat, starts = shingle_sets(hashes, at)
            yield batch.slice(a, b - a), flat, starts, np.diff(at)
