"""Plain Python versions of the operators, for small tables."""
import hashlib
import re
import zlib
from collections import defaultdict
from string import ascii_lowercase, ascii_uppercase

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
WHITE = "\t\n\x0b\x0c\r "


def words(text):
    return WORD.findall(text or "")


def quality(text):
    t, w = text or "", words(text)
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed)


def line_dedup(rows):
    """rows of (doc_id, text) -> sorted (doc_id, n_lines, n_dropped, sha256)."""
    least = -(1 << 63)

    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(least if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5
                or (least if d is None else d) == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_duplicates(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    links = []
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                links.append((a, b))
    at = groups({d for d, _ in rows if d is not None}, links)
    return [(d, len(s), at.get(d)) for d, s in sets]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*[sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(listed.encode()).hexdigest(), listed)


def jump(key, shards):
    """The published algorithm, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def crc(text):
    return zlib.crc32((text or "").encode())


def targets(sizes):
    """sizes by source (None last) -> target by source: reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        share = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if share[s] > 3 * sizes[s]} | capped
        if over == capped or len(over) == len(order):
            return {s: 3.0 * sizes[s] for s in order} if len(over) == len(order) else share
        capped = over
