"""Deterministic automata over bytes: small regular expressions to transition arrays.

Thompson's construction, subset construction over classes of bytes that no rule tells apart,
and minimisation by refining the partition of states. Several rules share one automaton; a state
carries the set of rules that it accepts as a bit mask.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .ship import by_value

by_value(__name__)


@dataclass
class Automaton:
    table: np.ndarray    #: next state by (state, byte class)
    classes: np.ndarray  #: class of each byte
    accept: np.ndarray   #: mask of the rules accepted by each state
    start: int
    dead: int            #: state that nothing leaves, or -1

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at ``at``, or -1."""
        state, end = self.start, at if self.accept[self.start] else -1
        rows, classes, accept = self.rows, self.class_list, self.accept_list
        for i in range(at, len(data)):
            state = rows[state][classes[data[i]]]
            if state == self.dead:
                break
            if accept[state]:
                end = i + 1
        return end

    def visits(self, data: bytes, backward: bool = False) -> list[int]:
        """Positions behind whose byte the automaton accepts, reading from one end to the other."""
        state, rows, accept, out = self.start, self.rows, self.accept_list, []
        kinds = data.translate(self.class_bytes)
        for i in range(len(data) - 1, -1, -1) if backward else range(len(data)):
            state = rows[state][kinds[i]]
            if accept[state]:
                out.append(i)
        return out

    def __post_init__(self):
        self.rows, self.class_list, self.accept_list = self.table.tolist(), self.classes.tolist(), self.accept.tolist()
        self.class_bytes = self.classes.astype(np.uint8).tobytes()


class _Builder:
    """Nondeterministic automaton: byte edges and empty edges between numbered states."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, tree, a: int) -> int:
        """Add ``tree`` from state ``a``; return its end state."""
        kind = tree[0]
        if kind == "set":
            b = self.state()
            self.edges[a].append((tree[1], b))
            return b
        if kind == "seq":
            for t in tree[1]:
                a = self.build(t, a)
            return a
        if kind == "or":
            b = self.state()
            for t in tree[1]:
                s = self.state()
                self.empty[a].append(s)
                self.empty[self.build(t, s)].append(b)
            return b
        _, body, low, high = tree
        for _ in range(low):
            a = self.build(body, a)
        if high is None:
            s = self.state()
            self.empty[a].append(s)
            self.empty[self.build(body, s)].append(s)
            return s
        ends = [a]
        for _ in range(high - low):
            a = self.build(body, a)
            ends.append(a)
        b = self.state()
        for e in ends:
            self.empty[e].append(b)
        return b


class _Pattern:
    """Recursive descent over the syntax used here: literals, ``\\`` escapes, ``\\xHH``, classes with
    ranges, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``."""

    def __init__(self, text: str, either_case: bool):
        self.text, self.at, self.either_case = text, 0, either_case

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        return ord(c)

    def cased(self, chars) -> tuple:
        chars = set(chars)
        if self.either_case:
            chars |= {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
        return "set", frozenset(chars)

    def either(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence(self):
        found = []
        while self.peek() and self.peek() not in "|)":
            found.append(self.repeated(self.atom()))
        return "seq", found

    def atom(self):
        if self.peek() == "(":
            self.take()
            tree = self.either()
            self.take()
            return tree
        if self.peek() == "[":
            self.take()
            chars: list[int] = []
            while self.peek() != "]":
                c = self.char()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    chars += range(c, self.char() + 1)
                else:
                    chars.append(c)
            self.take()
            return self.cased(chars)
        return self.cased([self.char()])

    def repeated(self, tree):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c != "{":
                tree = ("times", tree, int(c == "+"), 1 if c == "?" else None)
                continue
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at:end].partition(",")
            self.at = end + 1
            tree = ("times", tree, int(low), (int(high) if high else None) if comma else int(low))
        return tree


def _flipped(tree) -> tuple:
    """The tree of the same strings read from their ends."""
    if tree[0] == "seq":
        return "seq", [_flipped(t) for t in reversed(tree[1])]
    if tree[0] == "or":
        return "or", [_flipped(t) for t in tree[1]]
    return ("times", _flipped(tree[1]), *tree[2:]) if tree[0] == "times" else tree


def compiled(rules: list[tuple[str, bool]], search: bool, backward: bool = False) -> Automaton:
    """One automaton for the rules (pattern, letters in either case); bit i of ``accept`` stands
    for rule i. ``search``: a match may begin at any byte. ``backward``: it reads from the end."""
    nfa = _Builder()
    first, ends = nfa.state(), {}
    for i, (pattern, either_case) in enumerate(rules):
        s = nfa.state()
        nfa.empty[first].append(s)
        tree = _Pattern(pattern, either_case).either()
        e = nfa.build(_flipped(tree) if backward else tree, s)
        ends[e] = ends.get(e, 0) | 1 << i
    sets = sorted({s for es in nfa.edges for s, _ in es}, key=sorted)
    marks = np.array([[b in s for s in sets] for b in range(256)], dtype=np.uint8).reshape(256, -1)
    _, where, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes, of_class = classes.reshape(-1), where.tolist()

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    begin = closure([first])
    index, order, table = {begin: 0}, [begin], []
    for now in order:
        row = []
        out = [(chars, t) for s in now for chars, t in nfa.edges[s]]
        for b in of_class:
            then = closure([t for chars, t in out if b in chars] + ([first] if search else []))
            if then not in index:
                index[then] = len(order)
                order.append(then)
            row.append(index[then])
        table.append(row)
    mask = np.array([sum({ends.get(s, 0) for s in now}) for now in order], dtype=np.int64)
    return _minimal(np.array(table, dtype=np.int64), classes.astype(np.uint8), mask)


def _minimal(table: np.ndarray, classes: np.ndarray, accept: np.ndarray) -> Automaton:
    """Merge states that no input tells apart."""
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, one = np.unique(block, return_index=True)
    small = block[table[one]].astype(np.int32)
    loops = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (accept[one] == 0))
    return Automaton(small, classes, accept[one], int(block[0]), int(loops[0]) if len(loops) else -1)
