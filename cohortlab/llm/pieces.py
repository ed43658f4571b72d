"""SentencePiece encoding by sampling, and decoding.

A token (what stands between two spaces, with the mark of a space in front) is a lattice of
vocabulary pieces. Forward filtering sums the probability of all ways to reach each position;
backward sampling draws the last piece, then the one before it, and so on, so that every
segmentation comes up with its own probability. Draws are hashes of the row's key, the token's
place and the step: rows encode alike wherever and however often they run. Lattices are built once
per distinct token of a slice, and all tokens of the slice are sampled side by side.

The vocabulary's scores are merge ranks, not probabilities; by Zipf's law rank r gets weight
1 / (r + 1). Pieces of several space marks have a score that rules them out, and stay out.
"""
from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import arrow_bytes, mix, slices
from .ship import by_value, map_batches
from .text import others

by_value(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20
#: weights are raised to this power: above 1 the likeliest segmentations win more often
SHARPNESS = 1.0
MARK = "▁"
#: longer tokens are taken apart into parts of about this many characters, at places that no piece
#: crosses; a longer stretch without such a place stays whole
TOKEN_CHARS = 240
SLICE_BYTES = 3 << 20
# Lone surrogates never stand in a text: one for a mark that the text itself has, one before the
# later parts of a long token
OWN_MARK, LATER_PART = "\ud800", "\udfff"
TABLE_BITS = 18


class Vocabulary:
    """Pieces with weights, as a trie; byte pieces stand in for every character without a piece of
    its own. Node k of the trie is the k-th prefix; ``opening`` has the nodes of first characters, and
    a hash table of (node, class of the next character) the others."""

    def __init__(self, pieces: dict[str, int], weights: dict[int, float], byte_ids: list[int], size: int):
        self.byte_ids, self.size = np.array(byte_ids, np.int32), size
        self.longest = max((len(p) for p in pieces), default=1)
        self.score = np.full(size + 1, -np.inf)
        total = sum(weights.values())
        for i, w in weights.items():
            self.score[i] = np.log(w / total)
        #: a character spelled in bytes: less likely than any piece
        self.score[size] = (min(self.score[list(weights)]) if weights else 0.0) - 10
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        node = {p: k for k, p in enumerate(prefixes)}
        later = {c: k + 1 for k, c in enumerate(sorted({c for p in prefixes for c in p[1:]}))}
        if len(later) >= 1 << 12 or len(prefixes) >= 1 << 19:
            raise ValueError("the vocabulary is too large")
        self.opening = np.full(0x110000, -1, np.int32)
        self.classes = np.zeros(0x110000, np.int32)
        for c, k in later.items():
            self.classes[ord(c)] = k
        self.piece = np.array([pieces.get(p, -1) for p in prefixes], np.int32)
        self.keys = np.full((1 << TABLE_BITS) + 64, -1, np.int32)
        self.nodes = np.full(len(self.keys), -1, np.int32)
        for p, k in node.items():
            if len(p) == 1:
                self.opening[ord(p)] = k
                continue
            key = node[p[:-1]] << 12 | later[p[-1]]
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - TABLE_BITS)
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.nodes[slot] = key, k
        shown = [b""] * size
        for p, i in pieces.items():
            shown[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            shown[i] = bytes([b])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(s) for s in shown])])

    @classmethod
    def load(cls, path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        usable = {p: i for p, i in pieces.items() if MARK not in p[1:]}
        if any(p.strip(MARK) for p in pieces if MARK in p[1:]):
            raise ValueError("a piece goes on after a space")
        rank = {i: r for r, i in enumerate(normal)}
        return cls(usable, {i: (rank[i] + 1.0) ** -sharpness for i in usable.values()}, byte_ids, n)

    def further(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Nodes reached from ``node`` by characters of the classes ``kind``, or -1."""
        key = node << 12 | kind
        slot = ((key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int32)
        there = self.keys[slot]
        out = np.where(there == key, self.nodes[slot], np.int32(-1))
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] += 1
            there = self.keys[slot[left]]
            hit = left[there == key[left]]
            out[hit] = self.nodes[slot[hit]]
            left = left[(there >= 0) & (there != key[left])]
        return out

    def parts(self, token: str) -> list[str]:
        """The token (without the mark in front) cut where no piece crosses, so that its lattice is
        the product of the parts' lattices; later parts begin with LATER_PART."""
        if len(token) <= TOKEN_CHARS:
            return [token]
        chars = np.frombuffer((MARK + token).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, node, alive = self.classes[chars], self.opening[chars], np.arange(len(chars))
        crossing = np.zeros(len(chars) + 1, np.int64)
        for length in range(2, self.longest + 1):
            on = (node >= 0) & (alive + length <= len(chars))
            alive, node = alive[on], node[on]
            if not len(alive):
                break
            node = self.further(node, kinds[alive + (length - 1)])
            who = alive[(node >= 0) & (self.piece[node] >= 0)]
            crossing[who + 1] += 1
            crossing[who + length] -= 1
        free = np.flatnonzero(np.cumsum(crossing)[2:-1] == 0) + 1
        cuts = [0]
        while len(token) - cuts[-1] > TOKEN_CHARS:
            k = np.searchsorted(free, cuts[-1] + TOKEN_CHARS, side="right")
            if k and free[k - 1] > cuts[-1]:
                k -= 1
            if k == len(free):
                break
            cuts.append(int(free[k]))
        return [(LATER_PART if a else "") + token[a:b] for a, b in zip(cuts, [*cuts[1:], len(token)])]


class Lattice:
    """Lattices of some distinct tokens. A state is a position in a token; states are numbered by
    position and then token, so that one step of the filter takes a run of states."""

    def __init__(self, vocabulary: Vocabulary, tokens: list[str]):
        v, n = vocabulary, len(tokens)
        later = [k for k, t in enumerate(tokens) if t[:1] == LATER_PART]
        size = np.fromiter(map(len, tokens), np.int64, n) + 1
        if later:
            size[later] -= 2
            tokens = [t[1:] if t[:1] == LATER_PART else MARK + t for t in tokens]
        text = "".join(tokens) if later else MARK + MARK.join(tokens)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.concatenate([[0], np.cumsum(size + 1)])
        at = np.arange(base[-1]) - np.repeat(base[:-1], size + 1)
        order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        self.steps = np.concatenate([[0], np.cumsum(np.bincount(at))])
        self.final = number[base[1:] - 1]
        # arcs by length: from every character as long as some piece begins like this
        owner = np.repeat(np.arange(n, dtype=np.int32), size)
        alive = np.arange(len(chars), dtype=np.int32)
        spot = alive + owner
        begin = number[spot]
        rest = (base[1:] - 1).astype(np.int32)[owner] - spot
        kinds = v.classes[chars]
        node, arcs = v.opening[chars], []
        piece = np.where(node >= 0, v.piece[node], -1)
        # a character spelled in bytes is numbered after the pieces by its code point
        arcs.append((begin, number[spot + 1], np.where(piece >= 0, piece, v.size + chars.astype(np.int32))))
        for length in range(2, v.longest + 1):
            on = (node >= 0) & (rest[alive] >= length)
            alive, node = alive[on], node[on]
            if not len(alive):
                break
            node = v.further(node, kinds[alive + (length - 1)])
            piece = np.where(node >= 0, v.piece[node], -1)
            has = np.flatnonzero(piece >= 0)
            who = alive[has]
            arcs.append((begin[who], number[spot[who] + length], piece[has]))
        fill = np.zeros(len(order), np.int32)
        for _, to, _ in arcs:
            fill[to] += 1
        width = fill
        self.first = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        fill = self.first[:-1].copy()
        self.source = np.empty(self.first[-1], np.int32)
        self.piece = np.empty(self.first[-1], np.int32)
        for source, to, piece in reversed(arcs):
            slot = fill[to]
            fill[to] += 1
            self.source[slot] = source
            self.piece[slot] = piece
        score = v.score.take(self.piece, mode="clip")
        state = np.repeat(np.arange(len(order), dtype=np.int32), width)
        self.log_sum = np.zeros(len(order))
        self.upto = np.empty(len(self.piece), np.float32)
        for k in range(1, len(self.steps) - 1):
            s, e = self.steps[k], self.steps[k + 1]
            a, b = self.first[s], self.first[e]
            own, local = self.first[s:e] - a, state[a:b] - np.int32(s)
            reach = self.log_sum[self.source[a:b]] + score[a:b]
            most = np.maximum.reduceat(reach, own)
            reach -= most[local]
            weight = np.exp(reach, out=reach)
            whole = np.add.reduceat(weight, own)
            self.log_sum[s:e] = most + np.log(whole)
            weight /= whole[local]
            run = np.cumsum(weight)
            run -= (run[own] - weight[own])[local]
            run[own + width[s:e] - 1] = np.inf
            self.upto[a:b] = run
        self.begin = self.steps[1]

    def sample(self, token: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation for each token number with its own seed: (pieces, pieces a token)."""
        state, live = self.final[token], np.arange(len(token))
        live = live[state >= self.begin]
        state = state[live]
        drawn, step = [], 0
        n = np.zeros(len(token), np.int64)
        while len(live):
            u = (mix(seed[live] + np.uint64(step)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
            arc = self.first[state]
            late = np.flatnonzero(u >= self.upto[arc])
            while len(late):
                arc[late] += 1
                late = late[u[late] >= self.upto[arc[late]]]
            n[live] += 1
            drawn.append((live, self.piece[arc]))
            state = self.source[arc]
            on = state >= self.begin
            live, state, step = live[on], state[on], step + 1
        end = np.cumsum(n)
        out = np.empty(end[-1] if len(end) else 0, np.int64)
        for k, (who, piece) in enumerate(drawn):
            out[end[who] - 1 - k] = piece
        return out, n


def _spelled(pieces: np.ndarray, n: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Write the characters without a piece as byte pieces."""
    odd = np.flatnonzero(pieces >= v.size)
    if not len(odd):
        return pieces.astype(np.int32), n
    width = np.ones(len(pieces), np.int64)
    spell = {}
    for c in np.unique(pieces[odd]).tolist():
        char = chr(c - v.size)
        spell[c] = v.byte_ids[np.frombuffer((MARK if char == OWN_MARK else char).encode(), np.uint8)]
    codes = pieces[odd].tolist()
    width[odd] = [len(spell[c]) for c in codes]
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(pieces, width)
    out[np.concatenate([np.arange(a, b) for a, b in zip(at[odd].tolist(), at[odd + 1].tolist())])] = np.concatenate(
        [spell[c] for c in codes])
    ends = np.concatenate([[0], np.cumsum(n)])
    return out.astype(np.int32), np.diff(at[ends])


def encode_texts(texts: list[str], seeds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, number of pieces of each). An empty text has none."""
    number, tokens, n_tokens = defaultdict(count().__next__), [], []
    for text in texts:
        if MARK in text:
            text = text.replace(MARK, OWN_MARK)
        parts = text.split(" ") if text else []
        if len(text) > TOKEN_CHARS and max(map(len, parts)) > TOKEN_CHARS:
            parts = [part for p in parts for part in v.parts(p)]
        tokens += [number[p] for p in parts]
        n_tokens.append(len(parts))
    n_tokens = np.array(n_tokens, np.int64)
    first = np.concatenate([[0], np.cumsum(n_tokens)])
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    place = (np.arange(first[-1]) - np.repeat(first[:-1], n_tokens)).astype(np.uint64)
    seed = mix(np.repeat(seeds, n_tokens) + place * np.uint64(0x9E3779B97F4A7C15))
    pieces, n = Lattice(v, list(number)).sample(np.array(tokens, np.int64), seed)
    pieces, n = _spelled(pieces, n, v)
    total = np.concatenate([[0], np.cumsum(n)])
    return pieces, np.diff(total[first])


def decode_pieces(pieces: np.ndarray, n: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets): the pieces' characters and bytes in a row, without the
    space that encoding puts first."""
    size = np.diff(v.shown_at)[pieces]
    at = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(at[-1]) + np.repeat(v.shown_at[pieces] - at[:-1], size)
    raw = v.shown[index]
    ends = at[np.concatenate([[0], np.cumsum(n)])]
    keep = np.ones(len(raw), bool)
    keep[ends[:-1][n > 0]] = False
    return raw[keep], ends - np.concatenate([[0], np.cumsum(n > 0)])


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, seed: int = SEED,
           sharpness: float = SHARPNESS, out: str = "pieces") -> DataFrame:
    """Add the struct ``out``: ``ids`` (sampled pieces of the whole text), ``n`` (their number) and
    ``lossless`` (whether decoding them gives the text again, which every row's does).

    Null and empty texts have no pieces. The draw depends on ``key``, ``seed`` and the text alone, so
    repeated rows encode alike; null keys count as one key. ``model`` is read by the driver only.
    Other columns stay; one called ``out`` is replaced.
    """
    own = others(docs, out)
    d = docs.select(*own, F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_pc_seed"),
                    F.col(text).alias("_pc_text"))
    kind = "struct<ids:array<int>,n:long,lossless:boolean>"
    schema = docs.select(*own, F.lit(None).cast(kind).alias(out)).schema
    v = Vocabulary.load(model, sharpness)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raw, offs = arrow_bytes(texts)
            seeds = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in slices(offs, SLICE_BYTES):
                own = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                ids, n = encode_texts(own, seeds[a:b], v)
                back, at = decode_pieces(ids, n, v)
                part, was = raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                if np.array_equal(at, was) and np.array_equal(back, part):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([np.array_equal(back[at[i]:at[i + 1]], part[was[i]:was[i + 1]]) for i in range(b - a)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                struct = pa.StructArray.from_arrays([lists, pa.array(n), pa.array(same)], names=["ids", "n", "lossless"])
                yield [*batch.slice(a, b - a).columns[:-2], struct]

    return map_batches(d, run, schema)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL, out: str = "text") -> DataFrame:
    """Add ``out``, the text that the piece ids stand for; null ids give a null text."""
    own = others(encoded, out)
    v = Vocabulary.load(model)
    schema = encoded.select(*own, F.lit(None).cast("string").alias(out)).schema
    d = encoded.select(*own, F.col(ids).alias("_pc_ids"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            flat = np.concatenate([np.array(x or [], np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
            raw, at = decode_pieces(flat, np.array([len(x or []) for x in lists], np.int64), v)
            data = raw.tobytes()
            texts = [None if x is None else data[at[i]:at[i + 1]].decode() for i, x in enumerate(lists)]
            yield [*batch.columns[:-1], pa.array(texts, type=pa.string())]

    return map_batches(d, run, schema)
