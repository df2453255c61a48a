"""Order-insensitive comparison of a Spark result with a DuckDB oracle result (tests and the
local check script). Values are normalised (floats to 9 significant digits unless ``exact``,
decimals to float, dates to ISO text) and rows sorted before comparing."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_connection(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, exact=False):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return v if exact else float(f"{v:.9g}")
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, exact)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, exact) for x in v)
    return v


def normalise(columns, rows, exact=False):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i], exact) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return cols, out


def spark_rows(df):
    return list(df.columns), [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, rel.fetchall()


def compare(spark_df, con, sql, exact=False) -> tuple[bool, str]:
    """``exact`` compares floats bit for bit instead of to 9 significant digits."""
    sc, sr = normalise(*spark_rows(spark_df), exact=exact)
    dc, dr = normalise(*duck_rows(con, sql), exact=exact)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return False, f"first differing row:\n spark={a}\n duck ={b}"
    return True, f"{len(sr)} rows equal"
