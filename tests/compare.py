"""Compare a query with what DuckDB answers on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, sorted_rows(columns, found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, sorted_rows(df.columns, df.collect())


def check(df, sql: str, sf_dir: str) -> int:
    """Assert that columns and rows are equal; the number of rows."""
    (a, got), (b, want) = spark_rows(df), duck(sql, sf_dir)
    assert sorted(a) == sorted(b)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    different = [(x, y) for x, y in zip(got, want) if x != y]
    assert not different, (len(different), different[:2])
    return len(got)
