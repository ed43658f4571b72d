"""Language network, vector cells, piece sampling and the pipeline."""
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import embed_cells, lang_gru, pieces
from cohortlab.llm.queries import QUERIES

from . import brute, odd

SF = "/root/testdata/sf0.001"


def test_gradients_match_differences():
    net = lang_gru.new_network(["a", "b", "c"], 3, 1)
    net = lang_gru.Network([w.astype(float) for w in net.inputs], [w.astype(float) for w in net.recurrent],
                           net.out.astype(float), net.bias.astype(float), net.languages)
    r = np.random.default_rng(0)
    x, y = r.integers(97, 101, (7, 5)), r.integers(0, 3, 5)
    x[5:, 2] = lang_gru.PAD
    _, grads = lang_gru.gradients(net, x, y)
    for p, g in zip(net.parameters(), grads):
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in p.shape)
            i = (i[0], int(x[1, 1])) if p.shape[-1] == 257 else i
            kept = p[i]
            p[i] = kept + 1e-3
            up = lang_gru.gradients(net, x, y)[0]
            p[i] = kept - 1e-3
            down = lang_gru.gradients(net, x, y)[0]
            p[i] = kept
            assert (up - down) / 2e-3 == pytest.approx(float(g[i]), abs=2e-4)


def test_reader_is_the_network():
    """The fast reader gives the probabilities of the training pass, for windows of any length."""
    net = lang_gru.new_network(["a", "b"], 4, 3)
    texts = [b"hello", b"", b"x" * 250, "é ß".encode()]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = lang_gru.Reader(net).read(raw, offs)
    for t, p in zip(texts, got):
        want = np.zeros(2)
        for a in range(0, len(t), lang_gru.WINDOW):
            x = np.frombuffer(t[a:a + lang_gru.WINDOW], np.uint8).astype(np.int64)[:, None]
            states = []
            for d in (0, 1):
                h, own = np.zeros((4, 1)), {}
                for s in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
                    i, g = net.inputs[d][:, x[s]], net.recurrent[d] @ h
                    z, u = 1 / (1 + np.exp(-(i[:4] + g[:4]))), 1 / (1 + np.exp(-(i[4:8] + g[4:8])))
                    n = np.tanh(i[8:] + u * g[8:])
                    h = (1 - z) * n + z * h
                    own[s] = h
                states.append(own)
            for s in range(len(x)):
                e = np.exp(net.out @ np.concatenate([states[0][s], states[1][s]]) + net.bias)[:, 0]
                want += e / e.sum()
        assert p == pytest.approx(want / max(1, len(t)), abs=1e-4)


def test_language_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_language_gru"](spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in docs if brute.crc(str(d)) % 4 == 2}
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark):
    df = lang_gru.identify_language(odd.table(spark), steps=5)
    got = df.select("text", "language.*", "`a.b`").collect()
    assert len(got) == len(odd.rows())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0.0)
    none = lang_gru.identify_language(odd.table(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.select("language.*").collect()} == {"und"}
    assert lang_gru.identify_language(odd.table(spark, [])).count() == 0


def test_every_language_is_a_class(spark):
    rows = [(k * 1000 + i, chr(0x4E00 + k) * 30, f"l{k:03}") for k in range(80) for i in range(400 if k == 3 else 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    x, y, languages = lang_gru.training_windows(df, "text", "lang", "doc_id", sample=100)
    assert languages == sorted({r[2] for r in rows}) and set(y.tolist()) == set(range(80))
    assert np.bincount(y).max() < 60
    for w, k in zip(x, y):
        assert bytes(w[:3].astype(np.uint8).tolist()).decode() == chr(0x4E00 + k)


def vectors(spark):
    r = np.random.default_rng(6)
    out = []
    for g in range(30):
        c = r.normal(size=16)
        out += [(c + r.normal(size=16) * s).tolist() for s in (0.0, 0.05, 0.1, 0.15, 0.2)]
    out += [out[0], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, None, [], [1.0, 2.0],
            [x * 1e200 for x in out[3]], [float("inf")] * 16]
    rows = [(i, v, "extra", 1) for i, v in enumerate(out)] + [(None, out[5], "extra", 1), (7, out[7], "extra", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, home string, w int").repartition(3), rows


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors_against_all_pairs(spark, block):
    df, rows = vectors(spark)
    exact = math.sqrt(2 - 2 * 0.9) / 2 + 1e-9
    got = embed_cells.near_vectors(df, margin=exact, cells=12, block=block).collect()
    fine = [i for i, (d, v, _, _) in enumerate(rows) if d is not None and v and len(v) == 16
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = embed_cells.unit(np.array([rows[i][1] for i in fine]))
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    n = {i: int(c) for i, c in zip(fine, hit.sum(axis=1))}
    at = brute.groups({d for d, *_ in rows if d is not None},
                      [(rows[fine[a]][0], rows[fine[b]][0]) for a, b in zip(*np.nonzero(hit))])
    want = [(d, n.get(i, 0), at.get(d), d is not None and at[d] == d) for i, (d, *_) in enumerate(rows)]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_vector_recall_in_production_settings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    r = np.random.default_rng(2)
    x = embed_cells.unit(np.array([v["embedding"] for v in df.orderBy("vec_id").collect()], dtype=float))
    noise = r.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    near = embed_cells.unit(0.905 * x + math.sqrt(1 - 0.905 ** 2) * embed_cells.unit(noise))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    got = embed_cells.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    both = np.concatenate([x, near])
    want = int((both @ both.T >= 0.9).sum()) - len(both)
    assert got.agg(F.sum("n_links")).first()[0] >= 0.995 * want


def uneven(n, dim=64):
    """Vectors that spread unevenly over their dimensions, each with one at cosine 0.901 whose
    difference spreads the same way."""
    r, spread = np.random.default_rng(11), 0.7 ** np.arange(dim)
    x = embed_cells.unit(r.normal(size=(n, dim)) * spread)
    off = r.normal(size=(n, dim)) * spread
    off -= (off * x).sum(axis=1, keepdims=True) * x
    return np.concatenate([x, 0.901 * x + math.sqrt(1 - 0.901 ** 2) * embed_cells.unit(off)])


@pytest.mark.parametrize("cells", [None, 70])
def test_every_link_of_uneven_vectors(spark, cells):
    x = uneven(2500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embed_cells.near_vectors(df, cells=cells).collect()
    x = embed_cells.unit(x)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("cells", [None, 20])
def test_every_length_is_compared(spark, cells):
    parts = [uneven(300, dim) for dim in (64, 24, 3)] + [np.array([[1.0], [2.0], [-1.0]])]
    parts[1] = np.concatenate([parts[1], parts[1][:5]])
    rows = [v.tolist() for x in parts for v in x]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    got = embed_cells.near_vectors(df, cells=cells).collect()
    want = [int(n) for x in map(embed_cells.unit, parts) for n in (x @ x.T >= 0.9).sum(axis=1) - 1]
    assert [r["n_links"] for r in sorted(got)] == want
    assert want[-3:] == [1, 1, 0] and [r["kept"] for r in sorted(got)][-3:] == [True, False, True]


def test_cells_are_as_many_as_pay():
    r = np.random.default_rng(12)
    apart = embed_cells.unit(r.normal(size=(5000, 64)))
    groups = embed_cells.unit(r.normal(size=(50, 64))[r.integers(50, size=5000)] + 0.05 * r.normal(size=(5000, 64)))
    margin = embed_cells.reach(0.9)
    assert len(embed_cells.fitted(groups, 200_000, margin, embed_cells.BLOCK)) > 1
    assert len(embed_cells.fitted(apart, 6000, margin, embed_cells.BLOCK)) == 1


def test_cells_of_grouped_vectors(spark, monkeypatch):
    """Production settings, enough vectors in groups that cells pay: they are used, and all links found."""
    r = np.random.default_rng(12)
    centre = embed_cells.unit(r.normal(size=(120, 24)))
    x = embed_cells.unit(np.concatenate([centre[r.integers(120, size=6000)] + 0.07 * r.normal(size=(6000, 24)), centre]))
    used, fitted = [], embed_cells.fitted

    def spied(*how):
        used.append(len(fitted(*how)))
        return fitted(*how)

    monkeypatch.setattr(embed_cells, "fitted", spied)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embed_cells.near_vectors(df).collect()))
    assert used and used[0] > 1
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    at = brute.groups(range(len(x)), zip(*[i.tolist() for i in np.nonzero(np.triu(hit))]))
    assert got == [(i, int(n), at[i], at[i] == i) for i, n in enumerate(hit.sum(axis=1))]


def test_the_sample_is_bounded(spark, monkeypatch):
    """In rows and in bytes, and drawn by each row for itself."""
    r = np.random.default_rng(13)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    seen, samples = [], embed_cells._samples

    def spied(*how):
        seen.append(samples(*how))
        return seen[-1]

    monkeypatch.setattr(embed_cells, "_samples", spied)
    embed_cells.near_vectors(df, cells=4, sample=500).count()
    monkeypatch.setattr(embed_cells, "SAMPLE_BYTES", 6 * 4 * 100)
    embed_cells.near_vectors(df, cells=4, sample=500).count()
    assert 400 < len(seen[0][6]) < 600 and 60 < len(seen[1][6]) < 140


def test_heads_rule_out_no_link():
    r = np.random.default_rng(14)
    x = embed_cells.unit(r.normal(size=(700, 40)) * np.linspace(2, 0.1, 40))
    y = embed_cells.unit(x[:300] + 0.4 * embed_cells.unit(r.normal(size=(300, 40))))
    q = embed_cells.directions(x)
    assert np.allclose(q.T @ q, np.eye(q.shape[1])) and q.shape[1] < 40
    hx, hy = embed_cells.heads(x, q), embed_cells.heads(y, q)
    assert (hx.astype(float) @ hy.T >= x @ y.T - 1e-5).all()
    for t in (0.5, 0.9):
        got = set(zip(*[i.tolist() for i in embed_cells.linked(x, y, t, hx, hy)]))
        assert got == set(zip(*[i.tolist() for i in np.nonzero(x @ y.T >= t)])) and got


def test_vectors_empty(spark):
    df, _ = vectors(spark)
    assert embed_cells.near_vectors(df.limit(0)).count() == 0
    only = embed_cells.near_vectors(df.where("embedding is null")).collect()
    assert [(r["n_links"], r["kept"]) for r in only] == [(0, True)]


VOCABULARY = pieces.Vocabulary.load()


def test_pieces_are_lossless(spark):
    df = pieces.encode(odd.table(spark))
    got = df.select("doc_id", "text", "pieces.*", "`a.b`").collect()
    assert len(got) == len(odd.rows())
    for r in got:
        assert r["lossless"] and r["n"] == len(r["ids"]) and (r["n"] > 0) == bool(r["text"])
    ids = df.select("text", F.col("pieces.ids").alias("ids"))
    back = pieces.decode(ids.withColumnRenamed("text", "was"))
    assert all((r["was"] or "") == r["text"] for r in back.collect())
    again = pieces.encode(odd.table(spark).repartition(5)).select("doc_id", "text", "pieces.ids").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in df.select("doc_id", "text", "pieces.ids").collect())
    assert pieces.encode(odd.table(spark, [])).count() == 0


def test_piece_query(spark):
    got = QUERIES["op7_sampled_pieces"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(r["lossless"] for r in got)


@pytest.mark.parametrize("token", ["therein", "aaa", "étéß"])
def test_sampling_has_the_lattice_probabilities(token):
    """Every way to spell the token, by enumeration, comes up as often as its probability says."""
    v, text = VOCABULARY, pieces.MARK + token
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            i = sp.piece_to_id(s[:k])
            if sp.id_to_piece(i) == s[:k] and np.isfinite(v.score[i]):
                yield from ((i, *rest) for rest in ways(s[k:]))

    every = list(ways(text))
    weight = np.array([v.score[list(w)].sum() for w in every])
    whole = np.logaddexp.reduce(weight)
    lattice = pieces.Lattice(v, [token])
    assert lattice.log_sum[lattice.final[0]] == pytest.approx(whole)
    n = 40_000
    out, size = lattice.sample(np.zeros(n, np.int64), pieces.mix(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(size)
    seen = Counter(tuple(out[e - s:e].tolist()) for e, s in zip(ends, size))
    assert set(seen) <= set(every)
    for w, p in zip(every, np.exp(weight - whole)):
        assert abs(seen[w] / n - p) < 0.012


@pytest.mark.parametrize("token", ["therein" * 45, "a" * 300, "日本語テスト" * 45, ("under" * 9 + "\n") * 7])
def test_long_tokens_have_the_whole_lattice(token):
    """How often a piece ends at a place is as the lattice of the uncut token says."""
    import sentencepiece

    sp, v, s = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), VOCABULARY, pieces.MARK + token

    def arcs():
        for a in range(len(s)):
            yield a, a + 1, v.score[-1] if sp.id_to_piece(sp.piece_to_id(s[a])) != s[a] else v.score[sp.piece_to_id(s[a])]
            for b in range(a + 2, min(len(s), a + v.longest) + 1):
                i = sp.piece_to_id(s[a:b])
                if sp.id_to_piece(i) == s[a:b] and np.isfinite(v.score[i]):
                    yield a, b, v.score[i]

    every = list(arcs())
    ahead, back = np.full((2, len(s) + 1), -np.inf)
    ahead[0] = back[-1] = 0
    for a, b, w in every:
        ahead[b] = np.logaddexp(ahead[b], ahead[a] + w)
    for a, b, w in reversed(every):
        back[a] = np.logaddexp(back[a], back[b] + w)
    n = 4000
    ids, size = pieces.encode_texts([token] * n, pieces.mix(np.arange(n, dtype=np.uint64)), v)
    # places in bytes: a character without a piece of its own ends with its last byte
    ends = np.cumsum(np.diff(v.shown_at)[ids]).reshape(-1)
    whole = len(token.encode()) + 1
    seen = np.bincount((ends - 1) % whole + 1, minlength=whole + 1) / n
    byte = np.cumsum([0, 1, *(len(c.encode()) for c in token)])
    assert np.abs(seen[byte[1:]] - np.exp(ahead + back - ahead[-1])[1:]).max() < 0.05


def test_a_token_longer_than_16_bits_count():
    token = "ab" * 35_000
    ids, n = pieces.encode_texts([token], pieces.mix(np.arange(1, dtype=np.uint64)), VOCABULARY)
    back, _ = pieces.decode_pieces(ids, n, VOCABULARY)
    assert back.tobytes().decode() == token


def test_pipeline(spark):
    """Each stage's decisions against plain Python on the stage before."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, steps = [n for n, _ in cp.STAGES], [docs]
    for _, f in cp.STAGES[:-1]:
        steps.append(f(spark, steps[-1], SF).cache())
        assert steps[-1].columns == docs.columns
    assert len(names) == 5
    read = [[tuple(r) for r in s.select("doc_id", "text", "n_chars").collect()] for s in steps]
    kept = {d for d, *_ in read[1]}
    assert all(not brute.quality(t)[5] for _, t, _ in read[1])
    assert len(kept) >= 0.6 * sum(not brute.quality(t)[5] for _, t, _ in read[0])
    lines = {d: (n, x) for d, _, n, x in brute.line_dedup([(d, t) for d, t, _ in read[1]])}
    import hashlib

    assert {d for d, *_ in read[2]} == kept
    assert all(hashlib.sha256(t.encode()).hexdigest() == lines[d][1] and n == len(t) for d, t, n in read[2])
    near = brute.near_duplicates([(d, t) for d, t, _ in read[2]])
    assert {d for d, *_ in read[3]} == {d for d, _, c in near if d == c}
    texts = {d: t for d, t, _ in read[3]}
    assert all(texts[d] == t for d, t, _ in read[4]) and max(Counter(d for d, *_ in read[4]).values()) <= 3
    last = cp.STAGES[-1][1](spark, steps[-1], SF).collect()
    assert len(last) == len(read[4]) and all(r["lossless"] for r in last)
    assert cp.run(spark, SF).count() == len(last)


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as cp

    for some in (None, []):
        df = odd.table(spark, some)
        for _, f in cp.STAGES[:-1]:
            before = df.columns
            df = f(spark, df, SF).cache()
            assert df.columns == before
        assert cp.STAGES[-1][1](spark, df, SF).where("not lossless").count() == 0
