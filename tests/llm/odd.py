"""A small table with everything that operators have to stand: null and empty values, ties,
repeated rows, near and exact copies, long texts, and extra columns with clashing names."""
import random

SHARED = "This long line of boiler plate stands in many of the documents here."


def rows():
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "wording", "Été", "straße", "niño", "plain", "over", "under", "tree", "house",
                  "walk", "green", "seven", "river", "stone", "cloud", "paper", "glass"] + [f"w{i}" for i in range(300)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    base = prose(130)
    near = base.split(" ")
    near[7] = "changed"
    out = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "fr", "b"), (4, base.upper(), "en", None)]
    out += [(10 + i, f"{SHARED if i % 2 else '  ' + SHARED.upper() + chr(9)}\n{prose(60)}\n\n{SHARED}\nshort", "en", "a")
            for i in range(6)]
    out += [(20, None, "en", "a"), (21, "", None, "b"), (22, " \n\t ", "de", ""), (23, "one two three", "de", "z"),
            (24, "ONE two\nthree", "de", "z"), (25, "one two three four five", "de", "é")]
    out += [(None, base, "en", "a"), (None, None, None, None), (30, "x " * 40 + "y", "es", "c"), (30, prose(80), "es", "c")]
    out += [(40, base, "en", "a"), (40, base, "en", "a")]
    out += [(50, "\n".join([prose(12), prose(9)] * 40), "en", "q"), (51, "a" * 30_000, "en", "q"),
            (52, prose(9000), "en", "q"), (53, "日本語 ▁ テスト\x00 é\t ﬀ  two  spaces ", "ja", "q")]
    out += [(60, 'password = "abcdefghijkl" token:\'short\' API_KEY:0123456789abcdef01', "en", "s"),
            (61, "é AKIAABCDEFGHIJKLMN0 deadbeefdeadbeefff xx deadbeef secret==abcdefghijklmnop", "en", "s"),
            (62, "token=x.password: abcdefghijklmnop, " + "SeCrEt' : aaaaaaaaaaaaaaaa", "en", "s")]
    return out


def table(spark, some=None):
    data = [(d, t, g, s, None if t is None else len(t), 1, 2, "w", 3.0, "dot") for d, t, g, s in (rows() if some is None else some)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size int, "
                                       "n int, target string, id double, `a.b` string").repartition(3)
