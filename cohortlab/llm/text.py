"""Column expressions on whole texts, shared by the corpus operators (built-in functions only)."""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = "\t\n\x0b\f\r "
WHITE_RUN = "[\\t-\\r ]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it. The
    value is bound as the variable of a lambda, which the optimizer doesn't inline."""
    return F.transform(F.array(value), use)[0]


def words(text) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), WHITE_RUN), lambda w: w != "")


def n_words(text) -> Column:
    """Number of words. The pieces between runs of white space, less the empty first and last."""
    t = F.btrim(F.coalesce(_c(text), F.lit("")), F.lit(WHITE_SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITE_RUN))).cast("long")


def ascii_lower(text) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(_c(text), ascii_uppercase, ascii_lowercase)


def hash128(*cols) -> list[Column]:
    """Two independent 64-bit hashes; together they stand for the value."""
    return [F.xxhash64(*[_c(c) for c in cols]), F.xxhash64(F.lit("second"), *[_c(c) for c in cols])]


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df, out: str) -> list[Column]:
    """All columns but ``out``."""
    return [quoted(c) for c in df.columns if c.lower() != out.lower()]


def aside(df, prefix: str):
    """(``df`` with the columns that begin with ``prefix`` called otherwise, a function from their old names
    to the new ones, a function that gives a result the old ones back)."""
    new, taken = {}, {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower().startswith(prefix):
            name = f"c{len(new)}"
            while name in taken:
                name = "_" + name
            new[c] = name
            taken.add(name)
    if not new:
        return df, lambda name: name, lambda out: out
    old, lower = {v: k for k, v in new.items()}, {k.lower(): v for k, v in new.items()}
    moved = df.select(*[quoted(c).alias(new.get(c, c)) for c in df.columns])
    return (moved, lambda name: lower.get(name.lower(), name),
            lambda out: out.select(*[quoted(c).alias(old.get(c, c)) for c in out.columns]))


def free_name(df, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (names are
    compared without case, as Spark resolves them)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
