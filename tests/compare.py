"""Rows of a Spark result and of DuckDB SQL in one canonical form."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(canon, v)) + "]"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(canon(v) for v in r) for r in df.select(*names).collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    return names, sorted(tuple(canon(r[cols.index(n)]) for n in names) for r in cur.fetchall())
