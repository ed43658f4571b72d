"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read each window of a text from the left and from the right; a linear
layer on both states gives every byte's language probabilities, and their mean over all bytes of
the whole text is the document's. The network is trained in numpy by backpropagation through
time on a bounded sample of windows and applied window by window, thousands side by side.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import SLICE_BYTES, arrow_bytes, slices
from .ship import by_value, map_batches
from .text import others

by_value(__name__)

HIDDEN = 8
WINDOW = 96
#: Training data: windows from at most this many documents, spread evenly over the languages.
SAMPLE_DOCS = 3000
WINDOWS_A_DOC = 2
#: the share of a language that there are too many others for
LEAST_DOCS = 8
#: for 64 languages or fewer; more take as many more steps
STEPS = 240
BATCH = 192
LEARNING_RATE = 0.02
LANES = 4096
PAD = 256


@dataclass
class Network:
    """Per direction: input weights by byte (3H, 257) and recurrent weights (3H, H), gates in the
    order update, reset, new; output weights (K, 2H) and bias (K, 1)."""

    inputs: list
    recurrent: list
    out: np.ndarray
    bias: np.ndarray
    languages: list

    def parameters(self) -> list:
        return [*self.inputs, *self.recurrent, self.out, self.bias]


def new_network(languages: list, hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    k = len(languages)
    inputs = [rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32) for _ in range(2)]
    for w in inputs:  # after the end of a text the state stays as it is, 0 for the reader from the right
        w[:hidden, PAD] = 200.0
    return Network(inputs,
                   [rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32) for _ in range(2)],
                   rng.normal(0, 0.3, (k, 2 * hidden)).astype(np.float32), np.zeros((k, 1), np.float32), languages)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x):
    e = np.exp(x - x.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Mean cross-entropy over all bytes of the windows ``x`` (T, B; PAD where a window has
    ended) with labels ``y``, and its gradient by every parameter, in the order of parameters()."""
    hidden, (steps, batch) = net.recurrent[0].shape[1], x.shape
    mask = (x != PAD).astype(np.float32)
    states, traces = [], []
    for d in (0, 1):
        w, u = net.inputs[d], net.recurrent[d]
        h = np.zeros((hidden, batch), np.float32)
        own, trace = np.empty((steps, hidden, batch), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a, g = w[:, x[t]], u @ h
            zr = _sigmoid(a[:2 * hidden] + g[:2 * hidden])
            z, r, q = zr[:hidden], zr[hidden:], g[2 * hidden:]
            n = np.tanh(a[2 * hidden:] + r * q)
            trace.append((t, h, z, r, q, n))
            h = n + z * (h - n)
            own[t] = h
        states.append(own)
        traces.append(trace)
    both = np.concatenate(states, axis=1)
    p = _softmax(net.out @ both + net.bias)
    at = (np.arange(steps)[:, None], y[None, :], np.arange(batch)[None, :])
    total = mask.sum()
    loss = float(-(np.log(p[at] + 1e-9) * mask).sum() / total)
    p[at] -= 1
    p *= (mask / total)[:, None, :]
    grads_out = np.einsum("tkb,thb->kh", p, both)
    grads_bias = p.sum(axis=(0, 2))[:, None]
    back = net.out.T @ p
    grads_in, grads_rec = [], []
    for d in (0, 1):
        u = net.recurrent[d]
        dh, du = np.zeros((hidden, batch), np.float32), np.zeros_like(u)
        da_all = np.zeros((steps, 3 * hidden, batch), np.float32)
        for t, h, z, r, q, n in reversed(traces[d]):
            dh = dh + back[t, d * hidden:(d + 1) * hidden]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r])
            du += dg @ h.T
            da_all[t] = np.concatenate([dz, dr, dn])
            dh = dh * z + u.T @ dg
        flat = x.reshape(-1)
        rows = da_all.transpose(1, 0, 2).reshape(3 * hidden, -1)
        grads_in.append(np.stack([np.bincount(flat, weights=row, minlength=257) for row in rows]).astype(np.float32))
        grads_rec.append(du)
    return loss, [*grads_in, *grads_rec, grads_out.astype(np.float32), grads_bias.astype(np.float32)]


def train(x: np.ndarray, y: np.ndarray, languages: list, hidden: int = HIDDEN, steps: int = STEPS,
          batch: int = BATCH, rate: float = LEARNING_RATE, seed: int = 11) -> Network:
    """Adam on random batches; languages are drawn equally often. ``x``: windows (N, T) of byte
    numbers, PAD after the end; ``y``: index into ``languages``."""
    rng = np.random.default_rng(seed)
    net = new_network(languages, hidden, seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    weight /= weight.sum()
    for step in range(1, steps + 1):
        rows = rng.choice(len(x), batch, p=weight)
        _, grads = gradients(net, x[rows].T, y[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(params, grads, first, second):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= np.float32(now) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


class Reader:
    """Applies a network to many windows at once, feature by feature in contiguous rows."""

    def __init__(self, net: Network):
        h = net.recurrent[0].shape[1]
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)[:, None]
        self.hidden, self.bias = h, net.bias
        # halved gates: a sigmoid is then half a tanh and a half
        self.inputs = [np.ascontiguousarray(w * half) for w in net.inputs]
        self.recurrent = [np.ascontiguousarray(u * half) for u in net.recurrent]
        self.out = [np.ascontiguousarray(net.out[:, :h]), np.ascontiguousarray(net.out[:, h:])]

    def _states(self, x: np.ndarray, d: int):
        """Step and state for every byte position, in the direction's order."""
        h, lanes = self.hidden, x.shape[1]
        w, u = self.inputs[d], self.recurrent[d]
        state = np.zeros((h, lanes), np.float32)
        a, g, tmp = (np.empty((3 * h, lanes), np.float32) for _ in range(3))
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            np.take(w, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=g)
            zr, q, n = g[:2 * h], g[2 * h:], tmp[:h]
            zr += a[:2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            q *= zr[h:]
            q += a[2 * h:]
            np.tanh(q, out=n)
            state -= n
            state *= zr[:h]
            state += n
            yield t, state

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each window (T, N) of the languages' probabilities: (K, N)."""
        k, lanes = self.out[0].shape[0], x.shape[1]
        left = np.empty((len(x), k, lanes), np.float32)
        for t, state in self._states(x, 0):
            np.matmul(self.out[0], state, out=left[t])
        total = np.zeros((k, lanes), np.float32)
        for t, state in self._states(x, 1):
            p = self.out[1] @ state
            p += left[t]
            p += self.bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= (x[t] != PAD) / p.sum(axis=0)
            total += p
        return total

    def read(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each text (texts, K); zeros for an empty one."""
        size = np.diff(offs)
        windows = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(windows)])
        text = np.repeat(np.arange(len(size)), windows)
        start = offs[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * WINDOW
        length = np.minimum(WINDOW, offs[1:][text] - start)
        sums = np.zeros((len(text), self.out[0].shape[0]))
        order = np.argsort(-length, kind="stable")
        step = np.arange(WINDOW)[:, None]
        lanes = max(1, LANES // -(-sums.shape[1] // 64))
        for a in range(0, len(order), lanes):
            own = order[a:a + lanes]
            span = step[:length[own[0]]]
            at = start[own][None, :] + span
            x = np.where(span < length[own][None, :], raw[np.minimum(at, len(raw) - 1)].astype(np.int64), PAD)
            sums[own] = self.probabilities(x).T
        pooled = np.zeros((len(size), sums.shape[1]))
        some = windows > 0
        if some.any():
            pooled[some] = np.add.reduceat(sums, first[:-1][some], axis=0) / size[some][:, None]
        return pooled


def held_out(key: Column) -> Column:
    """Documents kept out of training: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE_DOCS,
                     per_doc: int = WINDOWS_A_DOC, least: int = LEAST_DOCS):
    """(windows, labels, languages) of about ``sample`` labelled documents outside the held-out
    part: an equal share for each language, ``least`` documents if that is more, chosen by the
    hash of the id and one at any rate; windows begin at places chosen by hash. Equal rows count
    once, and twice the sample (or least shares) is never exceeded."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}") & ~held_out(F.col(key)))
    known = known.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"))
    known = known.withColumn("draw", F.xxhash64(F.lit("language"), "key", F.xxhash64("text")) / F.lit(float(1 << 64)) + 0.5)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min("draw").alias("first")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64), []
    share = max(sample / len(languages), least)
    # the first draw of a language is taken whatever its share
    upto = docs.sparkSession.createDataFrame([(r["lang"], max(r["first"], share / r["count"])) for r in counts],
                                             "lang string, upto double")
    places = [F.pmod(F.xxhash64(F.lit(i), "key"), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)) + 1
              for i in range(per_doc)]
    cut = [F.substring(F.col("text"), p.cast("int"), F.lit(WINDOW)) for p in places]
    wanted = known.join(F.broadcast(upto), "lang").where("draw <= upto")
    rows = wanted.select("lang", F.xxhash64("key").alias("h"), F.array(*cut).alias("cut")).distinct().limit(
        2 * int(np.ceil(share * len(languages)))).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["lang"], r["cut"]))
    number = {g: k for k, g in enumerate(languages)}
    x, y = [], []
    for r in rows:
        for piece in r["cut"]:
            b = np.frombuffer(piece.encode()[:WINDOW], np.uint8)
            if len(b):
                x.append(np.concatenate([b.astype(np.int64), np.full(WINDOW - len(b), PAD)]))
                y.append(number[r["lang"]])
    return np.array(x).reshape(-1, WINDOW), np.array(y, dtype=np.int64), languages


def identify_language(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                      out: str = "language", **training) -> DataFrame:
    """Add the struct ``out``: ``lang_pred`` and ``score`` (mean probability of that language over all
    bytes of the text).

    A null text, or one without a letter, is ``und`` with score 0, and so is everything if no
    labelled document can be learnt from. ``lang`` and ``key`` only choose the training rows.
    Repeated rows get the same prediction; an empty table gives an empty table. Other columns
    stay; one called ``out`` is replaced.
    """
    x, y, languages = training_windows(docs, text, lang, key)
    own = others(docs, out)
    empty = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not len(x):
        return docs.select(*own, empty.alias(out))
    more = -(-len(languages) // 64)
    reader = Reader(train(x, y, languages, **{"steps": STEPS * more} | training))
    read = F.when(F.col(text).rlike("\\p{L}"), F.col(text)).otherwise(F.lit("")).alias("_lg_text")
    d = docs.select(*own, read)
    schema = docs.select(*own, empty.alias(out)).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = arrow_bytes(batch.column(batch.num_columns - 1))
            for a, b in slices(offs, SLICE_BYTES // more):
                p = reader.read(raw, offs[a:b + 1])
                none = np.diff(offs[a:b + 1]) == 0
                best = p.argmax(axis=1)
                named = pa.array(["und" if e else languages[k] for e, k in zip(none, best)], type=pa.string())
                score = np.where(none, 0.0, np.clip(p[np.arange(len(p)), best], 0.0, 1.0))
                struct = pa.StructArray.from_arrays([named, pa.array(score)], names=["lang_pred", "score"])
                yield [*batch.slice(a, b - a).columns[:-1], struct]

    return map_batches(d, run, schema)
