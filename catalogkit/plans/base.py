"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table loader as a query; ``sql`` is what DuckDB answers it with."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows(t, data: list[tuple], schema: str) -> DataFrame:
    """A literal table in the session of a loaded one."""
    return t("region").sparkSession.createDataFrame(data, schema)


def values(data: list[tuple]) -> str:
    """The same as SQL."""
    one = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in data) + ")"


def derived(t, sql: str) -> DataFrame:
    """A table made from the loaded ones by SQL that Spark and DuckDB read alike; ``{name}`` stands for a table."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    sql = re.sub(r"\{(\w+)\}", r"<<\1>>", sql).replace("{", "{{").replace("}", "}}")  # other braces are text
    sql = re.sub(r"<<(\w+)>>", r"{\1}", sql)
    return t("region").sparkSession.sql(sql, **{n: t(n) for n in names})


def plain(sql: str) -> str:
    """The same SQL for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
