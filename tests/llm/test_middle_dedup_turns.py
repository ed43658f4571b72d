"""Fill-in-middle, exact dedup and conversation repair against plain Python."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import exact_dedup, fill_middle, shingles, turn_grammar, turn_repair
from cohortlab.llm.queries import QUERIES

from . import brute, odd

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---
def middle(key, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = sha(f"7:{'' if key is None else key}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = [(100, "has <P> inside", "en", "a"), (101, "<M>", "en", "a"), (102, "\n\n\n", "en", "a"), (103, "a\n<\nS>\n<S", "en", "a"),
          (104, "é\n日本\n" * 30_000 + "end", "en", "a"), (105, "\n" * 70_000, "en", "a"), (106, "ab\n" * 40_000, "en", "a"),
          (107, "one line", "en", "a"), (108, "\nx", "en", "a"), (109, "<", "en", "a")]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 100)])
def test_fill_in_middle(spark, rate, spm):
    rows = odd.rows() + MARKED
    docs = odd.table(spark, rows).withColumn("whole", F.lit("clash")).withColumn("cuts", F.lit(1))
    got = fill_middle.fill_in_middle(docs, rate=rate, suffix_first=spm)
    assert got.columns == docs.columns + ["fim"]
    got = got.withColumn("back", fill_middle.restored(F.col("fim")["output"], F.col("fim")["form"])).collect()
    assert len(got) == len(rows) and all(r["whole"] == "clash" for r in got)
    for r in got:
        assert tuple(r["fim"]) == middle(r["doc_id"], r["text"], rate, spm)
        assert r["back"] == (r["text"] or "")
    assert {r["fim"]["form"] for r in got} == {(100, 50): {"plain", "psm", "spm"}, (40, 0): {"plain", "psm"}, (0, 100): {"plain"}}[rate, spm]


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(odd.table(spark, [])).count() == 0


def test_fill_middle_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_fill_middle"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, out = middle(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, p, m, sha(out), sha(texts[r["doc_id"]] or ""))


@pytest.mark.parametrize("offsets", [
    np.arange(0, 200_000), np.arange(0, 300_000, 2), np.arange(0, 900_000, 977), np.array([0]), np.array([0, 65_535, 65_536, 1 << 40]),
    np.unique(np.random.default_rng(1).integers(0, 1 << 18, 60_000)),
    np.concatenate([np.arange(10, 5000), np.arange(70_000, 140_000, 3)])])
def test_offset_set(offsets):
    found = fill_middle.OffsetSet(offsets.astype(np.int64))
    assert len(found) == len(offsets)
    for k in {0, len(offsets) - 1, *random.Random(1).choices(range(len(offsets)), k=200)}:
        assert found.select(k) == offsets[k]


def test_all_kinds_of_containers():
    kinds = {c[0] for o in (np.arange(0, 65_536), np.arange(0, 65_536, 2), np.arange(0, 65_536, 100))
             for c in fill_middle.OffsetSet(o.astype(np.int64)).containers}
    assert kinds == {"run", "bitmap", "array"}


def test_code_points_in_pieces(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 7)
    text = "aé日本\n😀b\n" * 9
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert shingles.code_points(raw, at).tolist() == list(range(len(text) + 1))
    assert shingles.code_points(raw[:0], np.array([0])).tolist() == [0]


# --- 12 ---
def same_texts(rows):
    at = defaultdict(list)
    for d, t in rows:
        at[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ids in at.items():
        ids = sorted(ids, key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), i == 0, sha(t)) for i, d in enumerate(ids)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


COPIES = [(200 + i, "the  same\ttext" if i % 2 else "the same text", "en", "a") for i in range(300)] + [
    (7, None, "en", "a"), (8, "", "en", "a"), (9, " ", "en", "a"), (9, "\n", "en", "a"), (None, "the same text", "en", "a")]


@pytest.mark.parametrize("counters,leaf_bits", [(1024, 16), (2, 4)])
def test_exact_duplicates(spark, counters, leaf_bits):
    rows = odd.rows() + COPIES
    docs = odd.table(spark, rows)
    got = exact_dedup.exact_duplicates(docs, counters=counters, leaf_bits=leaf_bits)
    got = got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    # of repeated rows any one is kept
    assert sorted(map(tuple, got), key=lambda r: tuple((x is None, x) for x in r)) == same_texts([r[:2] for r in rows])


@pytest.mark.parametrize("counters", [1024, 2])
def test_keep_first(spark, counters):
    rows = odd.rows() + COPIES
    docs = odd.table(spark, rows).withColumn("digest", F.lit(1)).withColumn("best", F.lit(2))
    got = exact_dedup.keep_first(docs, counters=counters, leaf_bits=4)
    assert got.columns == docs.columns
    want = sorted(((d, s) for d, _, _, k, s in same_texts([r[:2] for r in rows]) if k), key=lambda r: (r[0] is None, r))
    got = [(r["doc_id"], sha(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""))) for r in got.collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == want


def test_no_texts(spark):
    assert exact_dedup.exact_duplicates(odd.table(spark, [])).count() == 0
    assert exact_dedup.keep_first(odd.table(spark, [])).count() == 0


def test_frequent_items_are_found(spark):
    """Whatever order rows come in, an item above 1 of (counters + 1) rows is found, and never more than ``counters``."""
    r = random.Random(6)
    items = ["hot"] * 900 + ["warm"] * 500 + [f"i{r.randrange(1500)}" for _ in range(2600)]
    for shuffled in (items, sorted(items), r.sample(items, len(items))):
        rows = spark.createDataFrame(list(enumerate(shuffled)), "row long, item string")
        for counters in (4, 8, 40):
            got = [x["item"] for x in exact_dedup.frequent(rows, "item", "row", counters, leaf_bits=6, fan=3).collect()]
            assert len(got) == len(set(got)) <= counters
            assert {i for i in set(items) if items.count(i) * (counters + 1) > len(items)} <= set(got)


# --- 13 ---
def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows, limit=None):
    """All edits of a few rows, tried out: (cost, edits, lines)."""
    best = None

    def go(i, cost, edits, lines, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if legal("".join(x[:1] or "-" for x, _ in lines)) and (best is None or (cost, edits) < best[:2]):
                best = cost, edits, lines
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 3, edits + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                go(i + 1, cost + extra, edits + "K", lines + [(role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + extra, edits + "R", lines + [(new, text)], 0)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, cost + 2, edits + "I", lines + [(new, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def by_states(rows):
    """The same by a table over rows and last initials, with plain strings."""
    after = {("", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("", "s")}

    def insert(best):
        todo = list(best)
        for s in todo:
            for new in ("user", "assistant"):
                c, e, lines = best[s]
                if (s, new[0]) in after and (new[0] not in best or (c + 2, e + "I") < best[new[0]][:2]):
                    best[new[0]] = c + 2, e + "I", lines + [(new, "")]
                    todo.append(new[0])
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def put(s, entry):
            if s not in new or entry[:2] < new[s][:2]:
                new[s] = entry

        for s, (c, e, lines) in insert(best).items():
            put(s, (c + 3, e + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (s, role[:1]) in after:
                    put(role[:1], (c + extra, e + "K", lines + [(role, text)]))
                for r in ("user", "assistant"):
                    if (s, r[0]) in after:
                        put(r[0], (c + 2 + extra, e + "R", lines + [(r, text)]))
        best = new
    return min((x for s, x in insert(best).items() if s in ("", "a")), key=lambda x: x[:2])


def repaired(rows, solve=by_states, damage=True):
    """(conv, turn, role, text) -> one tuple a conversation."""
    at = defaultdict(list)
    for conv, turn, role, text in rows:
        own = at[conv]
        c, t, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in at.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns, seen, judged = {t for t, _, _ in own if t is not None}, set(), []
        for _, role, text in own:
            bare = text.strip(brute.WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, lines = solve(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *[sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")], bad, cost, edits,
                    sha("\n".join(f"{r}:{t}" for r, t in lines))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def chats(seed, n, most):
    r = random.Random(seed)
    texts = ["Fine.", "What?", "cut off", " ", "", None, "Yes!  ", "Été.", "tail. x", "new\nline."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", None, "User"]
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            turn = r.choice([t, t, t, t + 3, None])
            rows.append((c if c else None, turn, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"Words {r.randrange(99)}."))
    return rows


def chat_table(spark, rows):
    data = [(*x, "clash", "c") for x in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, key string, `edits.x` string").repartition(3)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_edits_by_trial():
    """The table over states finds what trying out all edits finds."""
    r = random.Random(8)
    faults = [None, None, None, "truncated", "blank", "duplicate"]
    for _ in range(60):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), f"t{i}", r.choice(faults)) for i in range(r.randrange(0, 5))]
        assert by_states(rows) == cheapest(rows)


def test_grammar_finds_the_cheapest_edits():
    r = random.Random(9)
    faults = [None, None, None, "truncated", "blank"]
    roles = {"user": "u", "assistant": "a", "system": "s", "tool": "t"}
    many = [[(r.choice(list(roles)), "x", r.choice(faults)) for _ in range(r.randrange(0, 40))] for _ in range(300)]
    many += [[("user", "x", None)] * 300, [("system", "x", None), ("user", "x", "truncated")] * 150, [("tool", "x", "blank")] * 5]
    coded = [bytes(turn_grammar.symbol(roles[a], f == "truncated", f == "blank") for a, _, f in rows) for rows in many]
    g = turn_grammar.Grammar()
    ends, whole = g.rows(coded), g.whole(coded)
    assert len(g.rules) > 100
    for rows, s in zip(many, coded):
        assert turn_grammar.finished(ends[s]) == turn_grammar.finished(whole[s][0]) == by_states(rows)[:2]


def test_re_pair_is_lossless():
    r = random.Random(10)
    rules = {}

    def rule(a, b):
        return rules.setdefault((a, b), 100 + len(rules))

    many = [r.choices(range(3), k=r.randrange(0, 60)) for _ in range(50)] + [[1] * 77, [1, 2] * 40, []]
    parts = {v: k for k, v in {**rules}.items()}
    packed = turn_grammar.re_pair(many, rule)
    parts = {v: k for k, v in rules.items()}

    def unpacked(s):
        return unpacked(parts[s][0]) + unpacked(parts[s][1]) if s in parts else [s]

    assert [[x for s in p for x in unpacked(s)] for p in packed] == many
    pairs = [(a, b) for p in packed for a, b in zip(p, p[1:])]
    assert len([x for x in set(pairs) if pairs.count(x) > 1 and x[0] != x[1]]) == 0


def test_ropes():
    r = random.Random(11)
    for _ in range(300):
        def rope(s):
            if len(s) < 2 or r.random() < 0.2:
                return s
            k = r.randrange(1, len(s))
            a, b = rope(s[:k]), rope(s[k:])
            return (len(s), turn_grammar._mark(s)[1], a, b)
        a = "".join(r.choices("DK", k=r.randrange(0, 12)))
        b = a[:r.randrange(0, len(a) + 1)] + "".join(r.choices("DK", k=r.randrange(0, 5)))
        assert turn_grammar.less(rope(a), rope(b)) == (a < b)
        assert turn_grammar.spelled(rope(a)) == a
        assert turn_grammar._mark(turn_grammar.joined(rope(a), rope(b))) == turn_grammar._mark(a + b)


@pytest.mark.parametrize("how", [{}, {"block_rows": 3}, {"block_chars": 40}])
def test_repairs(spark, how):
    rows = chats(1, 60, 12)
    df = chat_table(spark, rows)
    assert tuples(turn_repair.damaged_and_repaired(df, **how)) == repaired(rows)
    assert tuples(turn_repair.repair_conversations(df, **how)) == repaired(rows, damage=False)


def test_short_conversations_by_trial(spark):
    rows = chats(2, 40, 5)
    assert tuples(turn_repair.damaged_and_repaired(chat_table(spark, rows))) == repaired(rows, solve=lambda x: cheapest(x))


def test_one_conversation_over_many_tasks(spark):
    """Most rows are one conversation's, with repeated texts far apart."""
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Same.", f"Own {t}.", "open end"])) for t in range(3000)]
    rows += chats(4, 8, 6)
    df = chat_table(spark, rows).repartition(7)
    assert tuples(turn_repair.damaged_and_repaired(df, block_rows=100)) == repaired(rows)


def test_repeated_rows(spark):
    rows = [(1, 0, "user", "Hi.")] * 50 + [(1, None, "user", "Hi.")] * 3 + [(2, 7, "assistant", "A.")] * 2
    assert tuples(turn_repair.damaged_and_repaired(chat_table(spark, rows))) == repaired(rows)


def test_no_conversations(spark):
    assert turn_repair.damaged_and_repaired(chat_table(spark, [])).count() == 0
    gone = next(c for c in range(1, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = tuples(turn_repair.damaged_and_repaired(chat_table(spark, [(gone, 0, "user", "x")])))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_turn_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert tuples(QUERIES["op13_turn_grammar"](spark, SF)) == repaired(rows)
