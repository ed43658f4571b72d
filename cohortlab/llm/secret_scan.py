"""Secret scans: all rules in one pass over the bytes.

The rules' regular expressions become one minimal automaton. A slice of texts is cut into lanes
of a few hundred bytes at bytes that take every state back to the start, so that no match
crosses a cut; all lanes step through the transition array together, and the last few long ones
one after the other. Few lanes meet an accepting state. In those, one pass from the end marks where
each rule's matches begin, and its own automaton gives them: leftmost, longest, non-overlapping. So
every byte is stepped a bounded number of times, whatever the text.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import compiled
from .shingles import arrow_bytes, code_points, slices
from .ship import by_value, map_batches
from .text import others

by_value(__name__)


@dataclass(frozen=True)
class Rule:
    """A secret is ``head`` and then a run of ``tail`` bytes as long as it goes. Matches need one tail
    byte; those with fewer than ``least`` are dropped, and what they cover isn't looked at again.
    ``hint``: what every match contains, if that is simpler to look for than head and tail."""

    kind: str
    head: str
    tail: str
    least: int
    either_case: bool = False
    hint: str = ""


BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
)
#: further kinds of keys with prefixes of their own
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "[rs]k_live_", "[A-Za-z0-9]", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.", "[A-Za-z0-9_-]", 8,
         hint="eyJ[A-Za-z0-9_-]+\\.eyJ"),
    Rule("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY----", "-", 1, hint="-----BEGIN "),
)
RULES = BASE + MORE
#: tail bytes behind a head that make a lane worth a closer look
HINT = 4
LANE = 256
#: lanes that are left to be stepped byte by byte
FEW = 64


class Scanner:
    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = list(rules)
        hints = [(r.hint or f"{r.head}{r.tail}{{{min(r.least, HINT) if r.head else r.least}}}", r.either_case) for r in rules]
        self.all = compiled(hints, search=True)
        self.whole = [compiled([(f"{r.head}{r.tail}+", r.either_case)], search=False) for r in rules]
        self.begins = [compiled([(f"{r.head}{r.tail}+", r.either_case)], search=True, backward=True) for r in rules]
        self.heads = [compiled([(r.head, r.either_case)], search=False) for r in rules]
        n, width = self.all.table.shape
        if n * width >= 1 << 31:
            raise ValueError("the rules' automaton is too large")
        self.step = (self.all.table * width).astype(np.int32).reshape(-1)
        self.width = width
        self.marks = np.repeat(self.all.accept, width)
        self.step_list, self.mark_list = self.step.tolist(), self.marks.tolist()
        back = (self.all.table == self.all.start).all(axis=0)
        self.resets = back[self.all.classes]

    def lanes(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, masks of the rules hinted at) of the lanes of some texts."""
        a, b = int(offs[0]), int(offs[-1])
        cuts = np.flatnonzero(self.resets[raw[a:b]]) + (a + 1)
        cuts = cuts[np.diff(cuts // LANE, prepend=-1) > 0]
        at = np.unique(np.concatenate([offs, cuts]))
        start, size = at[:-1], np.diff(at)
        order = np.argsort(-size, kind="stable")
        begin, longest = start[order], size[order]
        kinds = self.all.classes[raw[a:b]]
        state = np.full(len(order), self.all.start * self.width, dtype=np.int32)
        mask = np.zeros(len(order), dtype=np.int64)
        together = int(longest[FEW]) if len(longest) > FEW else 0
        live = np.searchsorted(-longest, -np.arange(1, together + 1), side="right")
        begin = begin - a
        for t, n in enumerate(live.tolist()):
            state[:n] = self.step[state[:n] + kinds[begin[:n] + t]]
            mask[:n] |= self.marks[state[:n]]
        step, marks = self.step_list, self.mark_list
        for i in range(min(FEW, len(order))):
            now, seen = int(state[i]), int(mask[i])
            for c in kinds[begin[i] + together:begin[i] + longest[i]].tobytes():
                now = step[now + c]
                if marks[now]:
                    seen |= marks[now]
            mask[i] = seen
        out = np.empty_like(mask)
        out[order] = mask
        return start, start + size, out

    def matches(self, data: bytes, mask: int):
        """(rule, start, end) of every match in a lane, in bytes."""
        for i, r in enumerate(self.rules):
            end = 0
            for at in reversed(self.begins[i].visits(data, backward=True) if mask >> i & 1 else []):
                if at >= end:
                    end = self.whole[i].longest(data, at)
                    if end - self.heads[i].longest(data, at) >= r.least:
                        yield i, at, end

    def spans(self, raw: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text: sorted (start, rule, end), in code points."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        start, end, mask = self.lanes(raw, offs)
        for k in np.flatnonzero(mask).tolist():
            text = int(np.searchsorted(offs, start[k], side="right")) - 1
            for rule, a, b in self.matches(raw[start[k]:end[k]].tobytes(), int(mask[k])):
                found.setdefault(text, []).append((int(start[k]) + a, rule, int(start[k]) + b))
        for text, own in found.items():
            at = np.unique([x - int(offs[text]) for a, _, b in own for x in (a, b)])
            point = dict(zip((at + int(offs[text])).tolist(), code_points(raw[offs[text]:offs[text + 1]], at).tolist()))
            found[text] = sorted((point[a], r, point[b]) for a, r, b in own)
        return found


def find_secrets(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "spans") -> DataFrame:
    """Add ``out``: array of (kind, start, end) in code points, end exclusive, by start and then in the
    rules' order. A null or empty text has none; kinds are found each for itself, so spans of
    different kinds may overlap. Repeated rows are scanned each for itself. An existing column
    called ``out`` is replaced.
    """
    scanner = Scanner(rules)
    own = others(docs, out)
    d = docs.select(*own)
    schema = d.withColumn(out, F.lit(None).cast("array<struct<kind:string,start:long,end:long>>")).schema
    position = d.columns.index(text)

    def run(batches):
        import pyarrow as pa

        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            raw, offs = arrow_bytes(batch.column(position))
            for a, b in slices(offs):
                found = scanner.spans(raw, offs[a:b + 1])
                spans = [[(scanner.rules[r].kind, s, e) for s, r, e in found.get(i, ())] for i in range(b - a)]
                yield [*batch.slice(a, b - a).columns, pa.array(spans, type=pa.list_(item))]

    return map_batches(d, run, schema)
