"""Order-insensitive comparison of a Spark result with a DuckDB oracle result (used by the
oracle tests and scripts/oracle_check.py)."""
from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return round(v + 0.0, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def spark_type_sql(dt) -> str:
    from pyspark.sql import types as T

    simple = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
              T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
              T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE"}
    for k, v in simple.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.ArrayType):
        return spark_type_sql(dt.elementType) + "[]"
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    return dt.simpleString().upper()


def compare(df, con, sql, check_types: bool = True) -> tuple[bool, str]:
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    dtypes = {d[0]: str(d[1]).upper() for d in res.description}
    drows = res.fetchall()
    if sorted(df.columns) != sorted(dcols):
        return False, f"columns spark={sorted(df.columns)} duck={sorted(dcols)}"
    if check_types:
        st = {f.name: spark_type_sql(f.dataType) for f in df.schema.fields}
        bad = {c: (st[c], dtypes[c]) for c in st if st[c] != dtypes[c]}
        if bad:
            return False, f"types differ (spark, duck): {bad}"
    a, b = canonical(df.columns, srows), canonical(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"rows spark={len(a)} duck={len(b)} diffs={diff}"
    return True, f"{len(a)} rows"
