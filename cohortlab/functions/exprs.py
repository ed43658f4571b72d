"""Column expressions shared by the operators.

Everything here is a plain ``pyspark.sql.functions`` expression, so it stays inside
whole-stage codegen. The same formulas are written in the DuckDB oracle strings, which is
why the hash recipes are spelled out exactly.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(key, seed, *salt) -> Column:
    """md5 hex of ``key:seed[:salt...]``: a deterministic, partition-independent shuffle order.

    DuckDB: ``md5(CAST(key AS VARCHAR) || ':' || 'seed' ...)``.
    """
    parts = [_c(key).cast("string"), F.lit(":"), F.lit(str(seed))]
    for s in salt:
        parts += [F.lit(":"), _c(s).cast("string") if not isinstance(s, (int, str)) else F.lit(str(s))]
    return F.md5(F.concat(*parts))


def hex8_to_unit(h: Column, start: int = 1) -> Column:
    """Uniform in (0, 1) from 8 hex digits of a hash: ``(int + 0.5) / 2^32``."""
    return (F.conv(F.substring(h, start, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_32)


def gaussian_from_hash(h: Column) -> Column:
    """Box-Muller standard normal from two 8-hex-digit uniforms of one md5 hash."""
    u1 = hex8_to_unit(h, 1)
    u2 = hex8_to_unit(h, 9)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# Added before rounding so values that are exact decimal ties (x.xxxxxx5) do not round up in
# one engine and down in another depending on summation order. Same in the DuckDB oracle.
ROUND_NUDGE = 1e-9


def r6(c) -> Column:
    """Round to 6 digits, -0.0 -> 0.0; DuckDB oracle: ``round(x + 1e-9, 6) + 0.0``."""
    return F.round(_c(c) + F.lit(ROUND_NUDGE), 6) + F.lit(0.0)


def safe_ratio(num, den) -> Column:
    """num/den, 0 when the denominator is 0 or NULL (the reference's ``x if d > 0 else 0`` rule)."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0))),
                      F.lit(0.0))


def f1_of(p, r) -> Column:
    p, r = _c(p), _c(r)
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def is_inf(c) -> Column:
    c = _c(c)
    return c.isin(float("inf"), float("-inf"))


def combine_rows(*dfs):
    """Glue one-row results side by side without a join: union by name, then take each
    column's only non-NULL value."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    cols = []
    for d in dfs:
        cols += [c for c in d.columns if c not in cols]
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def materialize(df):
    """Keep a SMALL intermediate that several branches reuse (per-client label counts, confusion
    counts) so the row-level work behind it runs once: written to the checkpoint folder, which
    outlives a lost executor and which Spark cleans when nothing refers to it any more."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
