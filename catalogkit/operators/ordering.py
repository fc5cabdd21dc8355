"""First-wins and keep-best by explicit order columns; ties never depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list, order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each partition before the shuffle."""
    return ranked(df, keys, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def keep_best(df: DataFrame, key: str, score: str, ord_: str) -> DataFrame:
    """The row with the highest score of each key, the earliest of equals, at the key's first position (``at``). Both
    are aggregates with partial results, so a key of very many rows fills no task."""
    rest = [c for c in df.columns if c not in (key, score, ord_)]
    best = df.groupBy(key).agg(F.max_by(F.struct(score, ord_, *rest), F.struct(F.col(score), -F.col(ord_))).alias("_best"), F.min(ord_).alias("at"))
    return best.select(key, *(F.col(f"_best.{c}").alias(c) for c in (score, ord_, *rest)), "at")


def clusters(df: DataFrame, key: str, ord_: str) -> DataFrame:
    """A row for each row of a key that has two or more: the key, its size, the row kept, and the row's own position."""
    g = df.groupBy(key).agg(F.count("*").alias("size"), F.min(ord_).alias("keep")).where("size > 1")
    return df.select(key, ord_).join(g, key)


def shared(df: DataFrame, key: str, by: str) -> DataFrame:
    """Rows whose value others have too, with how many rows and how many different ``by`` have it."""
    n = df.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(by).alias("sources")).where("rows > 1")
    return df.join(n, key)


def interleave(df: DataFrame, side: Column, order: list, limit: int) -> DataFrame:
    """Take turns between streams: the first of each, then the second of each; ``side`` orders the streams. No stream
    gives more than ``limit`` rows, and Spark keeps no more of each in a partition before they meet."""
    d = df.withColumn("side", side)
    return ranked(d, ["side"], order, "turn").where(F.col("turn") <= limit).orderBy("turn", "side").limit(limit)
