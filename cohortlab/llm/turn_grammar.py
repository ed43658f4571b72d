"""Cheapest repair of role sequences by min-plus matrices over a grammar.

A row of a conversation is one of nine symbols: the role's initial, and whether the text is cut
off, or a row that has to go. Legal sequences of roles are the words of an automaton with four states,
so a stretch of rows is a 4 x 4 matrix of the cheapest edits from state to state. Re-Pair replaces
frequent neighbours by rules; each rule's matrix is the product of its two parts' and serves all
conversations. Edits are ropes that share the parts' edits; they are spelled out at the end.
"""
from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import pairwise

from .ship import by_value

by_value(__name__)

INITIALS = "sua"
#: symbols 0 to 7: initial (s, u, a, other) and cut off or not; a row that has to go
GONE = 8
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: states: nothing yet, after s, after u, after a
STATES = range(4)
ENDS = (0, 3)
#: state after a role from a state
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: texts of edits up to so many letters are kept as they are
LETTERS = 24
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)
#: rules are forgotten when there are more
RULES = 200_000


def symbol(initial: str, cut_off: bool, gone: bool) -> int:
    return GONE if gone else 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + cut_off


# --- ropes: a short string, or (length, hash, left, right) ---
def _mark(r) -> tuple[int, int]:
    if isinstance(r, tuple):
        return r[0], r[1]
    h = 0
    for c in r:
        h = (h * BASE + ord(c)) % PRIME
    return len(r), h


def joined(a, b):
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LETTERS:
        return a + b
    (n, h), (m, g) = _mark(a), _mark(b)
    return n + m, (h * pow(BASE, m, PRIME) + g) % PRIME, a, b


def spelled(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, tuple):
            todo += (r[3], r[2])
        else:
            out.append(r)
    return "".join(out)


def less(a, b) -> bool:
    """Whether ``a`` comes before ``b`` as a string; equal parts are passed by length and hash."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] if len(x) > n else []
            right += [y[n:]] if len(y) > n else []
            continue
        m, n = (z[0] if isinstance(z, tuple) else len(z) for z in (x, y))
        if m == n and _mark(x) == _mark(y):
            continue
        if isinstance(x, tuple) and (m >= n or not isinstance(y, tuple)):
            left += (x[3], x[2])
        else:
            left.append(x)
        if isinstance(y, tuple) and (n >= m or not isinstance(x, tuple)):
            right += (y[3], y[2])
        else:
            right.append(y)
    return not left and bool(right)


# --- matrices: by state and state, None or (cost, rope) ---
def better(x, y):
    """The cheaper of two entries, of equally dear ones the least in ASCII. For one stretch of rows
    and one state neither's edits begin the other's at the same cost, so what follows can't turn it."""
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if less(y[1], x[1]) else x


def times(row, matrix):
    """A row of entries, by state, times a matrix."""
    out = [None] * 4
    for m, x in enumerate(row):
        if x is not None:
            for q, y in enumerate(matrix[m]):
                if y is not None and (out[q] is None or x[0] + y[0] <= out[q][0]):
                    out[q] = better(out[q], (x[0] + y[0], joined(x[1], y[1])))
    return out


def product(a, b):
    return [times(row, b) for row in a]


def unit():
    return [[(0, "") if p == q else None for q in STATES] for p in STATES]


def _inserts():
    out = unit()
    for p in STATES:
        todo = [(p, 0, "")]
        for state, cost, edits in todo:
            for role in "ua":
                to = STEP.get((role, state))
                if to is not None and out[p][to] is None:
                    out[p][to] = (cost + INSERT, edits + "I")
                    todo.append((to, *out[p][to]))
    return out


INSERTS = _inserts()


def matrix_of(sym: int):
    """A row's matrix: what is inserted before it, and its own edit."""
    own = [[None] * 4 for _ in STATES]
    for p in STATES:
        own[p][p] = (DELETE, "D")
        if sym != GONE:
            initial, extra = (*INITIALS, "")[sym // 2], CUT_OFF * (sym % 2)
            edits = [(role, REROLE + extra, "R") for role in "ua"] + ([(initial, KEEP + extra, "K")] if initial else [])
            for role, cost, letter in edits:
                to = STEP.get((role, p))
                if to is not None:
                    own[p][to] = better(own[p][to], (cost, letter))
    return product(INSERTS, own)


def finished(row):
    """(cost, edits) of the cheapest legal end, from the entries by state after all rows."""
    row, best = times(row, INSERTS), None
    for q in ENDS:
        best = better(best, row[q])
    return best[0], spelled(best[1])


def re_pair(sequences: list[list[int]], rule) -> list[list[int]]:
    """Replace the most frequent pair of neighbours by ``rule(a, b)``, as long as one occurs twice.
    Pairs don't overlap and don't cross sequences; of equally frequent ones the least comes first."""
    sym, prev, nxt = [], [], []
    for s in sequences:
        first = len(sym)
        sym += s
        prev += [-1, *range(first, first + len(s) - 1)][:len(s)]
        nxt += [*range(first + 1, first + len(s)), -1][:len(s)]
    places = defaultdict(set)
    for i, j in enumerate(nxt):
        if j >= 0:
            places[sym[i], sym[j]].add(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)

    def drop(i):
        if i >= 0 and nxt[i] >= 0:
            places[sym[i], sym[nxt[i]]].discard(i)

    def add(i, touched):
        if i >= 0 and nxt[i] >= 0:
            pair = sym[i], sym[nxt[i]]
            places[pair].add(i)
            touched.add(pair)

    while heap:
        n, pair = heapq.heappop(heap)
        at = places.get(pair, ())
        if len(at) < 2:
            continue
        if len(at) != -n:
            heapq.heappush(heap, (-len(at), pair))
            continue
        new, touched = None, set()
        todo = sorted(at)
        if pair[0] == pair[1]:   # a run of one symbol: count the places that don't overlap
            free, last = [], -1
            for i in todo:
                if i != last:
                    free.append(i)
                    last = nxt[i]
                else:
                    last = -1
            if len(free) < 2:
                places.pop(pair)
                continue
        for i in todo:
            j = nxt[i]
            if j < 0 or sym[i] != pair[0] or sym[j] != pair[1] or i not in at:
                continue
            new = rule(*pair) if new is None else new
            before, after = prev[i], nxt[j]
            drop(before)
            drop(i)
            drop(j)
            sym[i], sym[j], nxt[i], nxt[j] = new, -1, after, -1
            if after >= 0:
                prev[after] = i
            add(before, touched)
            add(i, touched)
        places.pop(pair, None)
        for other in touched:
            if len(places.get(other, ())) > 1:
                heapq.heappush(heap, (-len(places[other]), other))
    out, first = [], 0
    for s in sequences:
        left, i = [], first if s else -1
        while i >= 0:
            left.append(sym[i])
            i = nxt[i]
        out.append(left)
        first += len(s)
    return out


class Grammar:
    """Rules and their matrices, shared by all sequences that a task meets."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices = [matrix_of(s) for s in range(GONE + 1)]

    def rule(self, a: int, b: int) -> int:
        """The number of the rule for two symbols; its matrix is made when it is first met."""
        if (a, b) not in self.rules:
            self.rules[a, b] = len(self.matrices)
            self.matrices.append(product(self.matrices[a], self.matrices[b]))
        return self.rules[a, b]

    def rows(self, sequences: list[bytes]) -> dict[bytes, list]:
        """By distinct sequence: the entries after it by state, from nothing."""
        return {s: self._through(unit()[0], c) for s, c in self._compressed(sequences)}

    def whole(self, sequences: list[bytes]) -> dict[bytes, list]:
        """By distinct sequence: its matrix."""
        return {s: [self._through(row, c) for row in unit()] for s, c in self._compressed(sequences)}

    def _compressed(self, sequences):
        if len(self.rules) > RULES:
            self.clear()
        distinct = sorted(set(sequences))
        return zip(distinct, re_pair([list(s) for s in distinct], self.rule))

    def _through(self, row, symbols):
        for s in symbols:
            row = times(row, self.matrices[s])
        return row


def illegal(initials: str) -> int:
    """Neighbours other than su, ua and au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
