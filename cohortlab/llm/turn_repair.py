"""Conversation structure repair: faults of turns, and the cheapest edits to a legal order of roles.

Rows are dealt out by ranges of (conversation, turn), so a conversation with a third of all rows
spans many tasks. A task reads its sorted rows in blocks. Conversations that lie within a task are
finished there; of one that goes on in the next, each stretch gives a 4 x 4 matrix of cheapest
edits and a few counts, and these are put together in order. Only the digest of such a
conversation's repaired text, which is one long chain, is read again by one task, as a stream.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import turn_grammar as grammar
from .ship import by_value
from .storage import cut, sized
from .text import WHITE_SPACE, hash128, quoted

by_value(__name__)

#: rows, and characters, that a task holds at a time
BLOCK_ROWS = 20_000
BLOCK_CHARS = 1 << 25
FAULTS = ("blank", "duplicate", "truncated")
#: characters of a text by which rows of one turn are dealt out
PREFIX = 64
COUNTS = ("gaps", *FAULTS, "illegal", "cost")


def conversation_key(conv: Column) -> Column:
    """The conversation's id as a string; null has one of its own."""
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            period: int = 20) -> DataFrame:
    """Rows (key, turn, role, text) after planted damage, by crc32(``conv:turn``) modulo ``period``: 0 drops
    a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user. Nulls count
    as one space."""
    filled = [F.coalesce(quoted(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    d = rows.select(conversation_key(quoted(conv)).alias("key"), quoted(turn).cast("long").alias("turn"),
                    filled[2].alias("role"), filled[3].alias("text"),
                    (F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % period).alias("kind")).where("kind <> 0")
    t = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("key", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    t.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Add what a row shows by itself (``blank``, ``truncated``), and ``later``: an earlier turn has its role
    and text. Rows of one turn with one role and text are told apart where they are read in order."""
    bare = F.btrim(F.col("text"), F.lit(WHITE_SPACE))
    d = rows.select("*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    h1, h2 = hash128("key", "role", "text")
    d = d.withColumn("h1", h1).withColumn("h2", h2)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    said = d.where("not blank").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    said = cut(said.where("first < last").select("h1", "h2", "first"))
    return d.join(sized(said), ["h1", "h2"], "left").select(
        "key", "turn", "role", "text", "blank", "truncated", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))


def in_order(rows: DataFrame) -> list[Column]:
    """Rows of a conversation come by turn, nulls first, then by role and text."""
    return [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


@dataclass
class Stretch:
    """Rows of one conversation that follow each other."""

    key: str
    whole: bool                      #: begins with the conversation's first row
    symbols: bytearray = field(default_factory=bytearray)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    counts: list = field(default_factory=lambda: [0, 0, 0])
    turns: list = field(default_factory=lambda: [None, None, 0])   #: least, last, number of distinct

    def add(self, turn, role, text, fault):
        if fault >= 0:
            self.counts[fault] += 1
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.symbols.append(grammar.symbol(role[:1], fault == 2, fault in (0, 1)))
        self.roles.append(role)
        self.texts.append(text)

    @property
    def initials(self) -> list:
        return [r[:1] for r in self.roles]


class Repaired:
    """The digest of a repaired conversation: ``role:text`` of each row that the edits leave or put in,
    joined by newlines. What was last says what comes next: a user after nothing, a system or an
    assistant, else an assistant."""

    def __init__(self, edits: str):
        self.edits, self.at, self.last, self.hash = edits, 0, "", hashlib.sha256()

    def put(self, role, text):
        line = f"{role}:{text}" if not self.last else f"\n{role}:{text}"
        self.hash.update(line.encode("utf-8", "surrogatepass"))
        self.last = role[:1]

    def wanted(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self):
        while self.edits[self.at:self.at + 1] == "I":
            self.put(self.wanted(), "")
            self.at += 1

    def row(self, role, text):
        """Go on to the edit of the next row."""
        self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self.put(self.wanted() if edit == "R" else role, text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def digest_of(edits: str, roles, texts) -> str:
    out = Repaired(edits)
    for role, text in zip(roles, texts):
        out.row(role, text)
    return out.digest()


def _gaps(least, last, distinct) -> int:
    return 0 if least is None else last - least + 1 - distinct


STRETCH = ("key string, part int, block int, whole boolean, blank long, duplicate long, truncated long, illegal long, "
           "least long, last long, first_turn long, distinct long, first_initial string, last_initial string, "
           "costs array<long>, edits array<string>, digest string")


def _stretches(block_rows: int, block_chars: int):
    """From sorted rows to one row a stretch: finished, or with its matrix if it may go on elsewhere."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, rules = TaskContext.get().partitionId(), grammar.Grammar()
        schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_())]
                           + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "least", "last", "first_turn", "distinct")]
                           + [("first_initial", pa.string()), ("last_initial", pa.string()), ("costs", pa.list_(pa.int64())),
                              ("edits", pa.list_(pa.string())), ("digest", pa.string())])
        block = 0

        def rows_of(held, open_):
            """Rows for the stretches of a block, of which the last is ``open_`` if its end isn't known."""
            nonlocal block
            done = [s for s in held if s.whole and s is not open_]
            ends = rules.rows([bytes(s.symbols) for s in done])
            parts = rules.whole([bytes(s.symbols) for s in held if not (s.whole and s is not open_)])
            out = []
            for s in held:
                whole = s.whole and s is not open_
                if whole:
                    cost, edits = grammar.finished(ends[bytes(s.symbols)])
                    costs, edits_, digest = [cost], [edits], digest_of(edits, s.roles, s.texts)
                else:
                    entries = [e for row in parts[bytes(s.symbols)] for e in row]
                    costs = [None if e is None else e[0] for e in entries]
                    edits_, digest = [None if e is None else grammar.spelled(e[1]) for e in entries], None
                initials = s.initials
                out.append((s.key, part, block, whole, *s.counts, grammar.illegal(initials), s.turns[0], s.turns[1],
                            s.turns[0], s.turns[2], initials[0], initials[-1], costs, edits_, digest))
                block += 1
            columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], type=f.type) for f in schema]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        held, now, before, rows, chars = [], None, None, 0, 0
        for batch in batches:
            for key, turn, role, text, blank, truncated, later in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or key != now.key:
                    # the first one of a task may have begun in the task before
                    now, before = Stretch(key, now is not None), None
                    held.append(now)
                elif not now.roles and not held:
                    held.append(now)
                same = before == (turn, role, text)
                fault = 0 if blank else 1 if later or same else 2 if truncated else -1
                before = turn, role, text
                now.add(turn, role, text, fault)
                rows, chars = rows + 1, chars + len(text)
                if rows >= block_rows or chars >= block_chars:
                    yield rows_of(held, now)
                    held, now, rows, chars = [], Stretch(key, False), 0, 0
        if held:
            yield rows_of(held, now)

    return run


JOINED = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, edits string")


def _put_together(batches):
    """From the stretches of each conversation, in order, to one row a conversation."""
    import pyarrow as pa

    def row(key, counts, turns, entries):
        cost, edits = grammar.finished(entries)
        return pa.RecordBatch.from_arrays(
            [pa.array([key])] + [pa.array([x], type=pa.int64()) for x in (_gaps(*turns), *counts, cost)] + [pa.array([edits])],
            names=["key", "gaps", *FAULTS, "illegal", "cost", "edits"])

    key = None
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if r["key"] != key:
                if key is not None:
                    yield row(key, counts, turns, entries)
                key, counts, turns, entries, initial = r["key"], [0] * 4, [None, None, 0], grammar.unit()[0], None
            counts = [a + r[c] for a, c in zip(counts, (*FAULTS, "illegal"))]
            counts[3] += initial is not None and grammar.illegal([initial, r["first_initial"]])
            initial = r["last_initial"]
            if r["least"] is not None:
                turns = [r["least"] if turns[0] is None else turns[0], r["last"],
                         turns[2] + r["distinct"] - (turns[1] == r["first_turn"])]
            matrix = [[None if c is None else (c, e) for c, e in zip(r["costs"][4 * p:4 * p + 4], r["edits"][4 * p:4 * p + 4])]
                      for p in grammar.STATES]
            entries = grammar.times(entries, matrix)
    if key is not None:
        yield row(key, counts, turns, entries)


def _digests(batches):
    """From each conversation's edits and then its rows, in order, to the digest of the repaired text."""
    import pyarrow as pa

    def line(key, own):
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([own.digest()])], names=["key", "digest"])

    now, own = None, None
    for batch in batches:
        for key, edits, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if edits is not None:
                if own is not None:
                    yield line(now, own)
                now, own = key, Repaired(edits)
            else:
                own.row(role, text)
    if own is not None:
        yield line(now, own)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (key, turn, role, text; none of them null but ``turn``): ``key``, the counts
    ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, the ``cost`` and ``edits`` of the cheapest repair, and
    ``repaired_sha256``.

    Rows come by turn (nulls first), then role and text. ``gaps``: turns missing between the least and
    the last one. A row's first fault counts: blank, duplicate (role and text of an earlier row),
    truncated (doesn't end in ``.!?``). Edits: keep (0), rerole to user or assistant (2), delete (3, has to be
    for blank and duplicate rows), insert an empty user or assistant (2); a truncated row that stays costs 1
    more. The initials of the roles left are s or not and then u and a in turn, up to an a;
    a row whose role is empty or of another initial can't be kept. Of
    equally dear repairs the one whose edits (``K``, ``R``, ``D``, ``I``) come first in ASCII is taken.
    """
    dealt = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, PREFIX)]
    order = in_order(rows)
    d = faulty(rows)
    found = cut(d.repartitionByRange(*dealt).sortWithinPartitions(*order).mapInArrow(
        _stretches(block_rows, block_chars), STRETCH))
    done = found.where("whole").select(
        "key", F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.col("last") - F.col("least") + 1 - F.col("distinct")).cast("long").alias("gaps"),
        *FAULTS, "illegal", F.col("costs")[0].alias("cost"), F.col("edits")[0].alias("edits"), F.col("digest").alias("repaired_sha256"))
    open_ = found.where("not whole")
    joined = cut(open_.repartition("key").sortWithinPartitions("key", "part", "block").mapInArrow(
        _put_together, JOINED))
    some = sized(joined.select("key"))
    texts = joined.select("key", "edits", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text")).unionByName(
        rows.join(some, "key", "left_semi").select("key", F.lit(None).cast("string").alias("edits"), "turn", "role", "text"))
    # the edits come before the rows
    texts = texts.repartition("key").sortWithinPartitions(
        "key", F.col("edits").isNull(), F.col("turn").asc_nulls_first(), "role", "text").select("key", "edits", "role", "text")
    digests = texts.mapInArrow(_digests, "key string, digest string")
    rest = joined.join(digests, "key").withColumnRenamed("digest", "repaired_sha256")
    return done.unionByName(rest)


def repair_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", **how) -> DataFrame:
    """One row per conversation of the table as it is (``conv`` and the columns of ``repair``; ``audit`` for its
    edits). Null roles and texts count as one space; rows without id are one conversation."""
    key = conversation_key(quoted(conv))
    plain = conversations.select(key.alias("key"), quoted(turn).cast("long").alias("turn"),
                                 *[F.coalesce(quoted(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return _by_id(conversations, conv, repair(plain, **how))


def damaged_and_repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", **how) -> DataFrame:
    """Like ``repair_conversations`` after ``damaged``. A conversation without any row left has zeros, no
    edits and the digest of an empty text."""
    return _by_id(conversations, conv, repair(damaged(conversations, conv, turn, role, text), **how))


def _by_id(conversations: DataFrame, conv: str, found: DataFrame) -> DataFrame:
    ids = conversations.select(quoted(conv).alias(conv)).distinct()
    ids = ids.withColumn("key", conversation_key(quoted(conv))) if conv != "key" else ids.select(
        quoted(conv), conversation_key(quoted(conv)).alias("_key"))
    own = "_key" if conv == "key" else "key"
    f = found.withColumnRenamed("key", own).withColumnRenamed("edits", "audit")
    empty = hashlib.sha256().hexdigest()
    return ids.join(f, own, "left").select(
        quoted(conv), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
