"""Side-by-side comparison of a query with its SQL: same columns, same multiset of rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (bool, str, bytes)) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else p / '*.parquet'}'")
    return con


def differences(df, sql: str, con) -> str:
    """Empty if the two agree."""
    cur = con.execute(sql)
    theirs_cols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {sorted(df.columns)} against {sorted(theirs_cols)}"
    order = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [theirs_cols.index(c) for c in order]
    sql_rows = Counter(tuple(plain(r[i]) for i in at) for r in theirs)
    if ours == sql_rows:
        return ""
    return f"{sum(ours.values())} rows against {sum(sql_rows.values())}; only here {list((ours - sql_rows).items())[:3]}; only in SQL {list((sql_rows - ours).items())[:3]}"
