"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return round(float(x), 6)
    return x


def rows_of(df) -> list:
    names = sorted(df.columns)
    return sorted((repr([plain(r[n]) for n in names]) for r in df.collect()))


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())
