"""Rows of a Spark query and of its SQL in DuckDB, normalised for comparison."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v) -> str:
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: normal(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return str(v)


def spark_rows(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted("|".join(normal(r[c]) for c in names) for r in df.collect())


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], list[str]]:
    got = con.execute(sql)
    have = [d[0] for d in got.description]
    names = sorted(have)
    at = [have.index(n) for n in names]
    return names, sorted("|".join(normal(row[k]) for k in at) for row in got.fetchall())
